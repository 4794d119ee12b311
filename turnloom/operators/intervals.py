"""Continuous periods and gaps from overlapping, nested or touching intervals per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _millis(seconds: Column) -> Column:
    return F.round(seconds.cast("double") * 1000.0).cast("long")


def usable_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``(key, s_ms, e_ms)`` of rows with both times present, finite, not negative, and the end after the start."""
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    limit = F.lit(9.0e12)  # seconds; beyond it a millisecond count no longer fits in a timestamp
    good = s.isNotNull() & e.isNotNull() & ~F.isnan(s) & ~F.isnan(e) & (s >= 0) & (s < limit) & (e < limit)
    ms = df.where(good).select(F.col(key).alias("key"), _millis(s).alias("s_ms"), _millis(e).alias("e_ms"))
    return ms.where(F.col("e_ms") > F.col("s_ms"))


def merge_intervals(
    df: DataFrame, key: str = "session_id", start: str = "start_s", end: str = "end_s", bin_ms: int = 3_600_000
) -> DataFrame:
    """Periods and gaps per ``key``: ``(key, kind, from_ms, to_ms)`` with kind 'period' or 'gap'.

    ``session_window`` with the row's own duration merges overlapping rows within a bin of ``bin_ms`` of their start, so a
    key that holds a third of all rows is spread over its bins; one summary row per bin then carries the furthest end
    across bins, touching periods are joined, and neighbours are paired with ``lead``.

    Rows with a null, NaN, infinite or negative time or an end not after the start are ignored; repeated rows change
    nothing; a null key is an entity of its own; an empty table gives no rows; other columns are not looked at.
    """
    own = usable_intervals(df, key, start, end).withColumn("bin", F.floor(F.col("s_ms") / bin_ms))
    sessions = own.groupBy(
        "key",
        "bin",
        F.session_window(F.timestamp_millis("s_ms"), F.concat(F.col("e_ms") - F.col("s_ms"), F.lit(" milliseconds"))).alias("w"),
    ).agg(F.count(F.lit(1)).alias("n"))
    part = sessions.select("key", "bin", F.unix_millis("w.start").alias("a"), F.unix_millis("w.end").alias("b"))

    by_bin = Window.partitionBy("key").orderBy("bin")
    bins = part.groupBy("key", "bin").agg(F.max("b").alias("far"))
    carry = bins.select(
        F.col("key").alias("k2"),
        F.col("bin").alias("bin2"),
        F.max("far").over(by_bin.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"),
    )
    joined = part.join(carry, part.key.eqNullSafe(carry.k2) & (part.bin == carry.bin2))
    in_bin = Window.partitionBy("key", "bin").orderBy("a")
    reach = F.greatest(F.col("carry"), F.max("b").over(in_bin.rowsBetween(Window.unboundedPreceding, -1)))
    heads = joined.select("key", "bin", "a", "b", reach.alias("before")).where(F.col("before").isNull() | (F.col("a") > F.col("before")))

    # The end of a period is what lay before the head that follows it; the last period of a key ends at the key's furthest end.
    nexts = heads.groupBy("key", "bin").agg(F.min_by("before", "a").alias("head_before"))
    after = nexts.select(
        F.col("key").alias("k3"),
        F.col("bin").alias("bin3"),
        F.first("head_before", ignorenulls=True).over(by_bin.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    last = bins.groupBy(F.col("key").alias("k4")).agg(F.max("far").alias("final"))
    ends = heads.join(after, heads.key.eqNullSafe(after.k3) & (heads.bin == after.bin3)).join(last, heads.key.eqNullSafe(last.k4))
    periods = ends.select(
        "key", "a", "before", F.coalesce(F.lead("before").over(in_bin), "later", "final").alias("to_ms")
    )
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("a").alias("from_ms"), F.col("to_ms").alias("to_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("before").alias("from_ms"), F.col("a").alias("to_ms")),
    )
    out = periods.select("key", F.explode(kinds).alias("x")).where(F.col("x.from_ms").isNotNull())
    return out.select(F.col("key").alias(key), "x.kind", "x.from_ms", "x.to_ms")
