"""Queries that read a whole case, calls of a fitted classifier per conversation, and transcripts in other languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.functions.numeric import round_n
from turnloom.operators import models as M
from turnloom.operators import multilingual as L
from turnloom.operators import posterior as P
from turnloom.operators import trajectory as T
from turnloom.operators.index import case_trajectory
from turnloom.operators.validate import class_metrics, confusion_long
from turnloom.plans.fixtures import corpus_turns, sql_round as R
from turnloom.plans.flagship import MOMENTUM, _IDX, _indexed
from turnloom.plans.series import LATEST, latest_measures
from turnloom.session import cut, table


def case_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cut(_indexed(spark, sf_dir))
    m = latest_measures(spark, sf_dir).select("client_id", F.col("session_number").cast("int").alias("session_number"), "instrument", "score")
    return case_trajectory(x, T.momentum(T.positions(x, "client_id", "session_number", "tpi"), "client_id"), m)


def native_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.multilingual_turns(_once(spark, sf_dir), "session_id")


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "transcripts").where("session_id is not null and transcript is not null").groupBy("session_id").agg(F.min("transcript").alias("transcript"))


def translated_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts taken apart into sentences and put together again; capitals stand in for a translator."""
    return L.translate_transcripts(_once(spark, sf_dir), "session_id", translate=F.upper)[1]


def case_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small wordings over measures and codes: durations, changes in percent, valid codes, shortened notes."""
    m = table(spark, sf_dir, "measures").where("score is not null and not isnan(score)").select("id", "score").distinct()
    return m.select("id", X.duration_words(F.abs(F.col("score")) * 7).alias("duration"), X.percent_change(F.col("score"), F.col("id") % 7).alias("change"))


def valid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "clients").select("id", "code", "notes").distinct()
    return c.select("id", X.valid_code(F.col("code")).alias("code"), X.cut_text(F.col("notes"), 80).alias("note_start"))


def _calls(spark: SparkSession, sf_dir: str, speaker: str, label: str) -> DataFrame:
    rows = corpus_turns(spark, sf_dir).where((F.col("speaker") == speaker) & F.col(label).isNotNull()).select("transcript_id", "text", F.col(label).alias("label"))
    return M.out_of_fold(cut(M.group_folds(rows, "transcript_id")), "nb", keep=("transcript_id",))


def client_talk_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change and sustain talk per conversation as a classifier calls it that has never seen the conversation, with the raw and the corrected ratio; a conversation without directional calls has none."""
    one = lambda v: F.sum((F.col("predicted") == v).cast("int"))
    c = _calls(spark, sf_dir, "client", "client_talk_type").groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n_turns"), one("change").alias("n_change"), one("sustain").alias("n_sustain"))
    raw = round_n(F.try_divide(F.col("n_change"), F.col("n_change") + F.col("n_sustain")), 4)
    return P.corrected_ratio(c, "n_change", "n_sustain").withColumn("raw_ratio", raw)


def therapist_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of what the therapist does per conversation as called out of fold, and reflections to questions."""
    n = lambda v: F.sum((F.col("predicted") == v).cast("int"))
    kinds = ("question", "reflection", "therapist_input", "other")
    c = _calls(spark, sf_dir, "therapist", "behaviour").groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n_turns"), *[n(k).alias(f"n_{k}") for k in kinds])
    return c.select("transcript_id", "n_turns", *[round_n(F.col(f"n_{k}") / F.col("n_turns"), 4).alias(f"share_{k}") for k in kinds], round_n(F.try_divide(F.col("n_reflection").cast("double"), F.col("n_question")), 3).alias("reflections_to_questions"))


def client_talk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_metrics(confusion_long(_calls(spark, sf_dir, "client", "client_talk_type"), "label", "predicted"))


_names = "case_view native_turns translated_transcripts case_scalars valid_codes client_talk_calls therapist_mix client_talk_metrics".split()
QUERIES = {n: globals()[n] for n in _names}

_ENDS = r"'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"
_WS = r"[\s\x0b]"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in L.NATIVE_LABELS.items()) + "}"
_LINES = rf"""one AS (SELECT session_id, min(transcript) AS transcript FROM transcripts WHERE session_id IS NOT NULL AND transcript IS NOT NULL GROUP BY session_id),
ln AS (SELECT session_id, unnest(regexp_split_to_array(transcript, {_ENDS})) AS line, generate_subscripts(regexp_split_to_array(transcript, {_ENDS}), 1) AS pos FROM one),
mk AS (SELECT session_id, pos, line, regexp_extract(line, '^{_WS}*([^\s\x0b:：][^:：]{{0,24}}?){_WS}*[:：]{_WS}*(.+?){_WS}*$', ['l', 't']) AS m FROM ln WHERE regexp_replace(line, '{_WS}', '', 'g') <> ''),
lb AS (SELECT *, m.l <> '' AND len(regexp_split_to_array(regexp_replace(m.l, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+')) <= 3 AS short FROM mk),
nn AS (SELECT *, sum(short::INT) OVER (PARTITION BY session_id ORDER BY pos) AS n FROM lb),
hd AS (SELECT *, n - min(CASE WHEN n = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id) AS turn FROM nn),
tn AS (SELECT session_id, turn::INT AS turn, coalesce(max(CASE WHEN short THEN regexp_replace(m.l, '^{_WS}+|{_WS}+$', '', 'g') END), '') AS original_label, string_agg(regexp_replace(CASE WHEN short THEN m.t ELSE line END, '^{_WS}+|{_WS}+$', '', 'g'), ' ' ORDER BY pos) AS text FROM hd GROUP BY session_id, turn),
tl AS (SELECT session_id, turn, coalesce({_MAP}[original_label], original_label) AS label, original_label, text FROM tn)"""
SQL = {
    "case_view": f"""WITH {_IDX}, {MOMENTUM}, {LATEST},
s AS (SELECT client_id, count(*) AS n_sessions, count(*) FILTER (confidence >= 0.6::DOUBLE) AS n_readable, max(session_number) AS latest_session, arg_max(tpi, session_number) AS latest_tpi, string_agg(session_number || '=' || printf('%.2f', tpi), ';' ORDER BY session_number) AS series FROM idx GROUP BY client_id),
m AS (SELECT client_id, string_agg(session_number || ':' || instrument || '=' || printf('%.1f', score), ';' ORDER BY session_number, instrument) AS measures, arg_min(instrument, {{'n': session_number, 'i': instrument}}) AS instrument FROM latest GROUP BY client_id)
SELECT s.client_id, n_sessions, n_readable, latest_session, latest_tpi, mom.state, m.instrument, series, coalesce(m.measures, '') AS measures FROM s LEFT JOIN mom USING (client_id) LEFT JOIN m USING (client_id)""",
    "native_turns": f"WITH {_LINES} SELECT * FROM tl",
    "translated_transcripts": rf"""WITH {_LINES}, c AS (SELECT session_id, len(regexp_extract_all(transcript, '[\x{{0B80}}-\x{{0BFF}}]')) AS ta, len(regexp_extract_all(transcript, '[\x{{0900}}-\x{{097F}}]')) AS hi, len(regexp_extract_all(transcript, '[A-Za-z]')) AS en FROM one),
g AS (SELECT session_id, CASE WHEN ta = 0 AND hi = 0 THEN 'en' WHEN ta >= hi AND ta >= 0.2 * (en + ta) THEN 'ta' WHEN hi > ta AND hi >= 0.2 * (en + hi) THEN 'hi' ELSE 'en' END AS language FROM c),
e AS (SELECT session_id, language, turn, label, CASE WHEN language = 'en' THEN text ELSE trim(array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?।|]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''), lambda s: upper(s)), ' ')) END AS english FROM tl JOIN g USING (session_id))
SELECT session_id, language, count(*) AS n_turns, true AS available, string_agg(CASE WHEN label <> '' THEN label || ': ' || english ELSE english END, chr(10) ORDER BY turn) AS english_transcript FROM e GROUP BY session_id, language""",
    "case_scalars": f"""WITH m AS (SELECT DISTINCT id, score, abs(score) * 7 AS s FROM measures WHERE score IS NOT NULL AND NOT isnan(score))
SELECT id, CASE WHEN s < 90 THEN round_even(s, 0)::BIGINT || ' seconds' ELSE (round_even(s / 60.0::DOUBLE * 10, 0)::BIGINT // 10) || '.' || (round_even(s / 60.0::DOUBLE * 10, 0)::BIGINT % 10) || ' minutes' END AS duration,
  CASE WHEN id % 7 = 0 THEN 0 ELSE round_even(100.0::DOUBLE * (score - id % 7) / (id % 7), 0)::INT END AS change FROM m""",
    "valid_codes": "SELECT DISTINCT id, CASE WHEN trim(code) <> '' AND NOT contains(trim(code), ' ') THEN trim(code) END AS code, substr(notes, 1, 80) AS note_start FROM clients",
}
