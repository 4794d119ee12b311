"""Sources and sinks: text and CSV corpora, JSON artefacts, CSV reports."""

from __future__ import annotations

import csv
import io
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_SCHEMA = T.StructType([
    T.StructField(n, t) for n, t in (
        ("transcript_id", T.IntegerType()), ("utterance_id", T.IntegerType()), ("interlocutor", T.StringType()), ("utterance_text", T.StringType()), ("timestamp", T.StringType()),
        ("client_talk_type", T.StringType()), ("main_therapist_behaviour", T.StringType()), ("mi_quality", T.StringType()),
    )
])
THERAPIST_ALIASES = ("therapist", "t", "th", "counselor", "counsellor", "clinician", "interviewer", "ellie")
MIN_CHARS = 20


def text_sessions(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Plain-text transcripts: (client_code, session_number, path, transcript), texts under 20 characters left out.

    Without ``pattern``, the directory is the client and the session number the rank of the file name in it. With it, named groups ``client`` and ``session`` are taken from the
    file name, files that do not match are skipped, and a missing or zero session number falls back to the rank.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = files.withColumns({"name_": name, "dir_": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)})
    if pattern is None:
        files = files.withColumns({"client_code": F.col("dir_"), "given_": F.lit(None).cast("int")})
    else:
        java = pattern.replace("(?P<", "(?<")
        at = re.compile(pattern).groupindex
        files = files.where(F.col("name_").rlike(java)).withColumn("client_code", F.regexp_extract("name_", java, at["client"]))
        given = F.regexp_extract("name_", java, at["session"]).try_cast("int") if "session" in at else F.lit(None).cast("int")
        files = files.withColumn("given_", F.nullif(given, F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("client_code").orderBy("name_"))
    ranked = files.withColumn("session_number", F.coalesce("given_", rank))
    return ranked.where(F.length(F.trim("value")) >= MIN_CHARS).select(F.substring("client_code", 1, 32).alias("client_code"), "session_number", "path", F.col("value").alias("transcript"))


def sniff_delimiter(head: str) -> str:
    """Delimiter of a CSV from its first 4 KB."""
    try:
        return csv.Sniffer().sniff(head[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        return max(",;\t|", key=io.StringIO(head).readline().count)


def csv_utterances(spark: SparkSession, path: str, conversation: str, speaker: str, text: str, delimiter: str | None = None) -> DataFrame:
    """Utterance rows of a CSV with a header: (conversation_id, pos, role, text) in file order, blank texts left out; missing columns raise."""
    if delimiter is None:
        head = spark.read.text(path, wholetext=False).limit(20).collect()  # the delimiter only
        delimiter = sniff_delimiter("\n".join(r["value"] for r in head))
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', sep=delimiter)
    missing = [c for c in (conversation, speaker, text) if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    role = F.when(F.lower(F.trim(speaker)).isin(*THERAPIST_ALIASES), "THERAPIST").otherwise("CLIENT")
    return rows.select(F.col(conversation).alias("conversation_id"), F.monotonically_increasing_id().alias("pos"), role.alias("role"), F.trim(text).alias("text")).where("text <> ''")


def assemble_sessions(utterances: DataFrame, case_pattern: str = r"^(.*?)[_-]?\d*$") -> DataFrame:
    """Transcripts of 'ROLE: text' lines per conversation, with a case code from group 1 of ``case_pattern`` and the rank of the conversation in its case."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(": ", "role", "text").alias("line"))))
    per = utterances.groupBy("conversation_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("transcript"))
    code = F.substring(F.regexp_extract("conversation_id", case_pattern, 1), 1, 32)
    return per.withColumn("client_code", code).withColumn("session_number", F.dense_rank().over(Window.partitionBy("client_code").orderBy("conversation_id")))


def annotated_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema=CORPUS_SCHEMA)


def task_rows(corpus: DataFrame, role: str, label: str, min_words: int = 3) -> DataFrame:
    """Rows of one classification task; the text said before is taken before any row is left out."""
    w = Window.partitionBy("transcript_id").orderBy("utterance_id")
    prev = corpus.withColumn("prev_text", F.coalesce(F.lag("utterance_text").over(w), F.lit("")))
    return prev.where((F.col("interlocutor") == role) & F.col(label).isNotNull() & (F.size(F.split(F.trim("utterance_text"), r"\s+")) >= min_words))


def json_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of named metrics as (name, metric, value) rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,double>>").alias("m"))
    return raw.select(F.explode("m").alias("name", "x")).select("name", F.explode("x").alias("metric", "value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, key: str = "client_id", buckets: int = 16) -> None:
    """Parquet partitioned by a hash bucket of the key, so that a client's rows are found without a full scan."""
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def ensure_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The parquet table at ``path``, made empty with ``schema`` where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return spark.read.schema(schema).parquet(path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a markdown table; more than ``most`` rows raise, since a report is no place for a table that grows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["-"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def media_files(spark: SparkSession, root: str, kinds: dict[str, str], max_bytes: int | None = None) -> DataFrame:
    """Media by extension: (path, kind, length); other files and, with ``max_bytes``, larger ones are left out and no bytes are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("ext"))
    kind = F.lit(None).cast("string")
    for ext, k in kinds.items():
        kind = F.when(F.col("ext") == ext, k).otherwise(kind)
    return f.withColumn("kind", kind).where("kind is not null").where(F.lit(True) if max_bytes is None else F.col("length") <= max_bytes).select("path", "kind", "length")
