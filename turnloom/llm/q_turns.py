"""Queries of problem 6: clean, ordered turns of therapist and client."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.turns import calibrated_pause, session_turns
from turnloom.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = session_turns(table(spark, sf_dir, "transcripts"), table(spark, sf_dir, "utterances_raw"), keep_text=False)
    return turns.withColumnRenamed("sid", "session_id")


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean turns with their text; a turn also ends at a pause longer than 99 in 100 of those within a speaker's turn."""
    transcripts = table(spark, sf_dir, "transcripts")
    turns = session_turns(transcripts, table(spark, sf_dir, "utterances_raw"), pause=calibrated_pause(transcripts))
    return turns.withColumnRenamed("sid", "session_id")


QUERIES = {"p6_found": p6_found, "p6_turns": p6_turns}
SQL: dict = {}
