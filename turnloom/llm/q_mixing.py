"""Queries of problem 8: documents mixed to target shares of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.mixing import mix_report, mix_sources
from turnloom.session import table


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).drop("rate")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mix_report(mix_sources(table(spark, sf_dir, "documents"), targets), targets)


QUERIES = {"p8_copies": p8_copies, "p8_shares": p8_shares}
SQL: dict = {}
