"""Queries of problem 1: personal information in transcripts and client notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.pii import personal_lines, redact
from turnloom.session import table


def _parts(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str, str, str]]:
    return [
        (table(spark, sf_dir, "transcripts"), "transcripts", "session_id", "transcript"),
        (table(spark, sf_dir, "clients"), "clients", "id", "notes"),
    ]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_lines(*_parts(spark, sf_dir))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(*_parts(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
SQL: dict = {}
