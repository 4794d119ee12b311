"""Queries of problem 4: languages of transcripts and of their stretches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.language import document_languages, label_cases, language_segments
from turnloom.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_cases(language_segments(table(spark, sf_dir, "transcripts")).drop("text"))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_segments(table(spark, sf_dir, "transcripts"))


def p4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(language_segments(table(spark, sf_dir, "transcripts")).drop("text"))


QUERIES = {"p4_found": p4_found, "p4_segments": p4_segments, "p4_documents": p4_documents}
SQL: dict = {}
