"""Relational operators over the stored tables: upsert, unique insert, cascade delete and summaries, as joins and latest-wins windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of the same key; columns of ``table``."""
    kept = table.join(changes.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(changes.select(*table.columns))


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``(table with the new rows, rejected rows)``: a row whose key is there already is rejected."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti").select(*table.columns)), rows.join(table.select(key).distinct(), key, "left_semi")


def cascade_delete(gone: DataFrame, key: str, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each table without the rows that belong to a deleted key."""
    ids = gone.select(F.col(key).alias("gone_")).distinct()
    return [t.join(ids, t[c] == ids.gone_, "left_anti") for t, c in tables]


def next_number(sessions: DataFrame, key: str, number: str) -> DataFrame:
    return sessions.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))
