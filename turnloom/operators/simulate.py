"""Simulations as plain DataFrames: programmed shapes, the risk screen's false alarms, and how well a ratio can be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.numeric import round_n
from turnloom.operators import trajectory as T
from turnloom.operators.posterior import P_CC, P_CS, corrected_ratio

SHAPES = ("improving", "plateauing", "relapsing", "late_breakthrough", "flat")


def shapes(spark: SparkSession, n: int = 12) -> DataFrame:
    """(shape, n, level): the latent level of each programmed case, without noise."""
    # Where each shape starts, bends and ends.
    i, late = F.col("i").cast("double"), 0.6 * n
    level = (
        F.when(F.col("shape") == "improving", 0.25 + 0.55 * (i / max(1, n - 1))).when(F.col("shape") == "plateauing", 0.30 + 0.35 * F.least(F.lit(1.0), i / 3))
        .when(F.col("shape") == "relapsing", F.when(i <= 4, 0.30 + 0.40 * (i / 4)).otherwise(0.70 - 0.35 * ((i - 4) / max(1, n - 5))))
        .when(F.col("shape") == "late_breakthrough", F.when(i < late, 0.30).otherwise(0.30 + 0.50 * ((i - late) / (0.4 * n)))).otherwise(0.5)
    )
    kinds = spark.createDataFrame([(s,) for s in SHAPES], "shape string")
    return kinds.select("shape", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("shape", (F.col("i") + 1).alias("n"), round_n(level, 6).alias("level"))


def noisy_series(spark: SparkSession, n_series: int, n: int, slope: float, seed: int, parts: int = 8) -> DataFrame:
    """(sid, n, y, total): 50 plus a slope plus measurement noise; a fixed number of partitions keeps the draw reproducible."""
    ids = spark.range(0, n_series * n, 1, parts).select((F.col("id") / n).cast("long").alias("sid"), (F.col("id") % n + 1).cast("int").alias("n"), F.randn(seed).alias("e"))
    return ids.select("sid", "n", (50.0 + slope * (F.col("n") - 1) + T.SE_MEAS * F.col("e")).alias("y"), F.lit(n).alias("total"))


def screen_rates(spark: SparkSession, n_series: int = 20_000, n: int = 12, seed: int = 5) -> DataFrame:
    """(scenario, n, flagged): share of flat and of declining series that the risk screen flags."""
    out = None
    for name, slope in (("flat", 0.0), ("declining", -1.2)):
        r = T.risk_screen(noisy_series(spark, n_series, n, slope, seed), "sid")
        one = r.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("level") != "low").cast("double")).alias("flagged")).select(F.lit(name).alias("scenario"), "n", "flagged")
        out = one if out is None else out.union(one)
    return out


def reading_widths(spark: SparkSession, turns: tuple[int, ...] = (10, 20, 40, 80), n_sims: int = 300, seed: int = 3) -> DataFrame:
    """(turns, width, bias): mean 80 % interval and bias of the corrected ratio for sessions of so many directional turns with a random true share."""
    base = spark.range(0, n_sims, 1, 8).select(F.col("id").alias("sim"), F.rand(seed).alias("p"))
    base = base.select("*", F.explode(F.array(*[F.lit(t) for t in turns])).alias("turns"))
    draws = base.select("*", F.explode(F.sequence(F.lit(1), F.col("turns"))).alias("k")).withColumn("u", F.pmod(F.xxhash64("sim", "turns", "k", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0)
    hits = draws.groupBy("sim", "turns").agg(F.first("p").alias("p"), F.sum((F.col("u") < F.col("p") * P_CC + (1 - F.col("p")) * P_CS).cast("int")).alias("c"))
    r = corrected_ratio(hits.withColumn("s", F.col("turns") - F.col("c")), "c", "s")
    return r.groupBy("turns").agg(F.avg(F.col("hi") - F.col("lo")).alias("width"), F.avg(F.col("ratio") - F.col("p")).alias("bias"))
