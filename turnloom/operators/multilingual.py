"""Transcripts in other languages: labelled lines with native labels, sentences out to a translator and back, and the English transcript put together again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import script_language, sentence_list
from turnloom.operators.parse import LINE_END

# Native speaker labels and what they mean, and a labelled line.
NATIVE_LABELS = {
    "சிகிச்சையாளர்": "THERAPIST", "ஆலோசகர்": "THERAPIST", "மருத்துவர்": "THERAPIST", "வாடிக்கையாளர்": "CLIENT", "நோயாளி": "CLIENT", "பயனர்": "CLIENT",
    "चिकित्सक": "THERAPIST", "थेरेपिस्ट": "THERAPIST", "परामर्शदाता": "THERAPIST", "काउंसलर": "THERAPIST", "क्लाइंट": "CLIENT", "ग्राहक": "CLIENT", "रोगी": "CLIENT", "मरीज़": "CLIENT", "मरीज": "CLIENT",
}
LABELLED = r"^\s*([^\s:：][^:：]{0,24}?)\s*[:：]\s*(.+?)\s*$"
SUPPORTED = ("ta", "hi", "en")


def native_label(label: Column) -> Column:
    """The English role of a native label; any other label stays as it is."""
    known = F.create_map(*[F.lit(x) for pair in NATIVE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, label), label)


def multilingual_turns(sessions: DataFrame, *keys: str, text: str = "transcript") -> DataFrame:
    """``(keys, turn, label, original_label, text)``: lines with a label of at most three words before a colon, each with the unlabelled lines up to the next.

    Lines before the first label make one turn without a label. Blank lines are left out; null texts give no rows. Order comes from a running count per session and the
    parts of one turn are joined in it.
    """
    lines = sessions.select(*keys, F.posexplode(F.split(F.col(text), LINE_END)).alias("pos", "line")).where(F.regexp_replace("line", r"\s", "") != "")
    label = F.regexp_replace(F.regexp_extract("line", LABELLED, 1), r"^\s+|\s+$", "")
    short = (label != "") & (F.size(F.split(label, r"\s+")) <= 3)
    said = F.regexp_replace(F.when(short, F.regexp_extract("line", LABELLED, 2)).otherwise(F.col("line")), r"^\s+|\s+$", "")
    marked = lines.select(*keys, "pos", F.when(short, label).alias("label_"), said.alias("said"))
    w = Window.partitionBy(*keys).orderBy("pos")
    numbered = marked.withColumn("n_", F.sum(F.when(F.col("label_").isNotNull(), 1).otherwise(0)).over(w))
    head = F.min(F.when(F.col("n_") == 0, 0).otherwise(1)).over(Window.partitionBy(*keys))
    numbered = numbered.withColumn("turn", (F.col("n_") - head).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "said")))
    turns = numbered.groupBy(*keys, "turn").agg(F.coalesce(F.max("label_"), F.lit("")).alias("original_label"), F.array_join(F.transform(parts, lambda p: p["said"]), " ").alias("text"))
    return turns.select(*keys, "turn", native_label(F.col("original_label")).alias("label"), "original_label", "text")


def translate_column(texts: DataFrame, *keys: str, text: str, translate: Callable[[Column], Column], out: str = "english") -> DataFrame:
    """``texts`` with ``out``: every text taken apart into sentences, each sentence given to ``translate``, and put together again in order.

    ``translate`` maps a column of sentences to one of translations: a pandas UDF over a model, or built-in functions. Sentences travel one a row, so that a model gets even batches
    however long the texts are. A text whose sentences do not all come back (a null translation) becomes null; a text without a sentence becomes empty.
    """
    one = texts.select(*keys, F.posexplode(sentence_list(F.coalesce(F.col(text), F.lit("")))).alias("k_", "s_"))
    done = one.withColumn("e_", translate(F.col("s_")))
    parts = F.array_sort(F.collect_list(F.struct("k_", "e_")))
    whole = F.when(F.count("e_") == F.count(F.lit(1)), F.trim(F.array_join(F.transform(parts, lambda p: p["e_"]), " ")))
    again = done.groupBy(*keys).agg(whole.alias(out), F.lit(True).alias("has_"))
    return texts.join(again, list(keys), "left").withColumn(out, F.when(F.col("has_").isNull(), F.lit("")).otherwise(F.col(out))).drop("has_")


def translate_transcripts(sessions: DataFrame, *keys: str, translate: Callable[[Column], Column], text: str = "transcript") -> tuple[DataFrame, DataFrame]:
    """``(turns, transcripts)``: the turns with their English, and one English transcript per session.

    A session in English by its script is passed on as it is. transcripts(keys, language, n_turns, available, english_transcript): not available where a translation failed.
    """
    lang = sessions.select(*keys, script_language(F.coalesce(F.col(text), F.lit(""))).alias("language"))
    turns = multilingual_turns(sessions, *keys, text=text).join(lang, list(keys))
    foreign = translate_column(turns.where("language <> 'en'"), *keys, "turn", text="text", translate=translate)
    turns = foreign.unionByName(turns.where("language = 'en'").withColumn("english", F.col("text")))
    line = F.when(F.col("label") != "", F.concat("label", F.lit(": "), "english")).otherwise(F.col("english"))
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    got = turns.groupBy(*keys, "language").agg(F.count(F.lit(1)).alias("n_turns"), (F.count("english") == F.count(F.lit(1))).alias("available"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("english_transcript"))
    return turns, got.withColumn("english_transcript", F.when(F.col("available"), F.col("english_transcript")))


def spoken_language(declared: Column, text: Column) -> Column:
    """The language a recording is taken to be in: the declared one if it is supported, else by the script of what was heard."""
    return F.when(declared.isin(*SUPPORTED), declared).otherwise(script_language(text))
