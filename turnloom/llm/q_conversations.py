"""Queries of problem 2: conversations rebuilt from utterance rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.conversations import CLIENT_NAMES, THERAPIST_NAMES, VISIBLE, dropped_conversations, link_conversations, rebuild_conversations
from turnloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_conversations(table(spark, sf_dir, "annotated_corpus"))


def p2_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild_conversations(table(spark, sf_dir, "annotated_corpus"))


def p2_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations found again without their ids: messages that only know which message they reply to, the one numbered before them if it is visible."""
    seen = table(spark, sf_dir, "annotated_corpus").where("transcript_id is not null and utterance_id is not null").where(F.col("utterance_text").rlike(VISIBLE))
    one = seen.select((F.col("transcript_id").cast("long") * 4_294_967_296 + F.col("utterance_id")).alias("message_id")).distinct()
    before = one.select((F.col("message_id") + 1).alias("message_id"), F.col("message_id").alias("reply_to"))
    return link_conversations(one.join(before, "message_id", "left"), "message_id", "reply_to")


QUERIES = {"p2_found": p2_found, "p2_conversations": p2_conversations, "p2_linked": p2_linked}

_names = lambda xs: ", ".join(f"'{x}'" for x in xs)
_VERDICTS = f"""
WITH v AS (
  SELECT DISTINCT transcript_id, utterance_id,
    CASE WHEN regexp_replace(lower(interlocutor), '[^\\p{{L}}]', '', 'g') IN ({_names(THERAPIST_NAMES)}) THEN 'therapist'
         WHEN regexp_replace(lower(interlocutor), '[^\\p{{L}}]', '', 'g') IN ({_names(CLIENT_NAMES)}) THEN 'client' END AS role,
    trim(regexp_replace(utterance_text, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')) AS said
  FROM annotated_corpus
  WHERE regexp_matches(utterance_text, '[\\p{{L}}\\p{{N}}]') AND utterance_id IS NOT NULL),
f AS (
  SELECT transcript_id, max(utterance_id) - min(utterance_id) + 1 > count(DISTINCT utterance_id) AS gap,
    count(*) > count(DISTINCT utterance_id) AS torn, bool_or(role IS NULL) AS no_role,
    count(DISTINCT role) AS roles, arg_max(role, utterance_id) AS last_role, min(utterance_id) AS first_u
  FROM v GROUP BY transcript_id),
r AS (
  SELECT t.transcript_id, f.first_u,
    CASE WHEN f.transcript_id IS NULL THEN 'empty' WHEN gap OR torn OR no_role THEN 'broken'
         WHEN roles < 2 OR last_role <> 'client' THEN 'missing_reply' END AS reason
  FROM (SELECT DISTINCT transcript_id FROM annotated_corpus WHERE transcript_id IS NOT NULL) t LEFT JOIN f USING (transcript_id))
"""
SQL = {
    "p2_linked": """WITH v AS (SELECT DISTINCT transcript_id::BIGINT * 4294967296 + utterance_id AS message_id FROM annotated_corpus
  WHERE transcript_id IS NOT NULL AND utterance_id IS NOT NULL AND regexp_matches(utterance_text, '[\\p{L}\\p{N}]')),
g AS (SELECT message_id, message_id - row_number() OVER (ORDER BY message_id) AS island FROM v)
SELECT message_id, min(message_id) OVER (PARTITION BY island) AS conversation_id FROM g""",
    "p2_found": _VERDICTS + "SELECT transcript_id, reason FROM r WHERE reason IS NOT NULL",
    "p2_conversations": _VERDICTS
    + """SELECT transcript_id, CAST(utterance_id - first_u + 1 AS INTEGER) AS turn_no, utterance_id, role, said AS text
FROM v JOIN r USING (transcript_id) WHERE reason IS NULL""",
}
