"""Labelled transcripts into turns, with roles looked up or inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Line ends, a stamp in front, and a speaker label with its separator.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
LEADING_STAMP = r"^\s*[\[(]?\s*(\d{1,2}:\d{2}(?::\d{2})?)(?:\.\d+)?\s*[\])]?\s*[-–]?\s*"
LABEL = r"^\s*\[?\s*([A-Za-z_][A-Za-z0-9 _\-]{0,24})\s*\]?\s*[:\-–]\s*(.+)$"
THERAPIST_LABELS = ("therapist", "t", "th", "counselor", "counsellor", "clinician", "doctor", "dr", "psychologist", "interviewer", "ellie", "helper")
CLIENT_LABELS = ("client", "c", "cl", "patient", "pt", "participant", "help-seeker", "helpseeker", "caller", "user")


def labelled_lines(sessions: DataFrame, *keys: str, text: str = "transcript") -> DataFrame:
    """Non-blank lines with ``label`` and ``said`` where a line starts with a speaker label, else null and the stripped line."""
    lines = sessions.select(*keys, F.posexplode(F.split(F.col(text), LINE_END)).alias("pos", "line")).where(F.trim(F.regexp_replace("line", r"\s", " ")) != "")
    bare = F.regexp_replace("line", LEADING_STAMP, "")
    label = F.regexp_extract(bare, LABEL, 1)
    said = F.regexp_replace(F.when(label != "", F.regexp_extract(bare, LABEL, 2)).otherwise(F.col("line")), r"^\s+|\s+$", "")
    return lines.select(*keys, "pos", F.when(label != "", label).alias("raw_label"), said.alias("said"))


def parse_transcripts(sessions: DataFrame, *keys: str, text: str = "transcript") -> tuple[DataFrame, DataFrame]:
    """``(turns, parse_info)``.

    turns(keys, idx, speaker, raw_label, text): continuation lines join the turn before them (gaps and islands over a running count of labels), idx counts labelled
    lines from 0 even where the text is empty. parse_info(keys, n_ignored, n_labels, inferred, single_role): lines before the first label, distinct labels, whether a role was inferred, and whether only one role is there.
    Unknown labels: the one with the highest question rate (ties: fewer words a turn, then the label) is the therapist if there are several, all others are clients.
    """
    lines = labelled_lines(sessions, *keys, text=text)
    w = Window.partitionBy(*keys).orderBy("pos")
    numbered = lines.withColumn("turn", F.sum(F.when(F.col("raw_label").isNotNull(), 1).otherwise(0)).over(w))
    parts = F.array_sort(F.collect_list(F.struct("pos", "said")))
    rows = numbered.where("turn > 0").groupBy(*keys, "turn").agg(
        F.max("raw_label").alias("raw_label"), F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["said"]), " "), r"^ ", "").alias("text")
    )
    plain = F.regexp_replace(F.lower(F.col("raw_label")), "[^a-z0-9_]", "")
    base = F.regexp_replace(plain, "[0-9_]+$", "")
    known = F.when(plain.isin(*THERAPIST_LABELS) | base.isin(*THERAPIST_LABELS), "therapist").when(plain.isin(*CLIENT_LABELS) | base.isin(*CLIENT_LABELS), "client")
    rows = rows.select(*keys, (F.col("turn") - 1).cast("int").alias("idx"), "raw_label", "text", plain.alias("label"), known.alias("known"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    asks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("?"), F.lit("")))
    stats = rows.groupBy(*keys, "label").agg(F.max("known").alias("known"), F.avg(asks).alias("asks"), F.avg(words).alias("words"))
    unknown = Window.partitionBy(*keys, F.col("known").isNull())
    rank = F.row_number().over(unknown.orderBy(F.desc("asks"), "words", "label"))
    many = F.count(F.lit(1)).over(unknown) > 1
    roles = stats.select(*keys, "label", "known", F.coalesce("known", F.when((rank == 1) & many, "therapist").otherwise("client")).alias("speaker"))
    turns = rows.join(roles.select(*keys, "label", "speaker"), [*keys, "label"]).where("text <> ''").select(*keys, "idx", "speaker", "raw_label", "text")
    found = roles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_labels"), F.max(F.col("known").isNull()).alias("inferred"), (F.min("speaker") == F.max("speaker")).alias("single_role")
    )
    ignored = numbered.groupBy(*keys).agg(F.sum(F.when(F.col("turn") == 0, 1).otherwise(0)).alias("n_ignored"))
    info = ignored.join(found, list(keys), "left").select(
        *keys, "n_ignored", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), F.coalesce("inferred", F.lit(False)).alias("inferred"), F.coalesce("single_role", F.lit(True)).alias("single_role")
    )
    return turns, info


def merge_speaker_runs(lines: DataFrame, *keys: str, order: str = "idx", speaker: str = "speaker", text: str = "text") -> DataFrame:
    """Consecutive lines of one speaker as one turn; empty lines are dropped first, a missing speaker is the client."""
    w = Window.partitionBy(*keys).orderBy(order)
    said = lines.where(F.trim(F.col(text)) != "").withColumn(speaker, F.coalesce(speaker, F.lit("client")))
    new = F.coalesce((F.lag(speaker).over(w) != F.col(speaker)).cast("int"), F.lit(1))
    runs = said.withColumn("new_", new).withColumn("run_", F.sum("new_").over(w))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return runs.groupBy(*keys, "run_").agg(F.min(speaker).alias("speaker"), F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(parts, lambda p: p[text]), " ").alias("text")).withColumnRenamed("run_", "turn_no")


def guess_speaker(text, position):
    """First guess for a line: who asks, or speaks first, is the therapist."""
    t = F.trim(text)
    return F.when(F.endswith(t, F.lit("?")) | F.endswith(t, F.lit("？")) | (position == 0), "therapist").otherwise("client")
