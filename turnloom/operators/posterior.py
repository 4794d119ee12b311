"""Bias-corrected share of change talk from classifier counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.numeric import round_n

# Held-out confusion of the directional classes, as P(called change | change) and P(called change | sustain), and the grid of the posterior.
P_CC, P_CS = 0.7947, 0.4785
STEPS = 400
# Directional turns, and the width of the 80 % interval simulated for them.
RESOLVABILITY = [(4, 0.7367), (6, 0.7082), (8, 0.6833), (10, 0.6602), (12, 0.6381), (15, 0.607), (20, 0.5703), (25, 0.5365), (30, 0.5063), (40, 0.459), (50, 0.4228), (60, 0.3975), (80, 0.3578), (100, 0.3249), (120, 0.3033)]
READABLE_TURNS = 40


def corrected_ratio(df: DataFrame, n_change: str, n_sustain: str) -> DataFrame:
    """``df`` with ratio, lo, hi and wide: posterior mean and central 80 % of the true share, flat prior on a grid; nulls without directional turns.

    The counts are binomial in theta(p) = p * P_CC + (1 - p) * P_CS. The grid is folded inside each row; steps are columns of their own, so that none is
    worked out again for every point of the grid.
    """
    theta = lambda i: F.least(F.greatest(i / float(STEPS) * P_CC + (1.0 - i / float(STEPS)) * P_CS, F.lit(1e-9)), F.lit(1.0 - 1e-9))
    c, s = F.col(n_change).cast("double"), F.col(n_sustain).cast("double")
    own = df.withColumn("ll_", F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: c * F.log(theta(i)) + s * F.log1p(-theta(i))))
    own = own.withColumn("top_", F.array_max("ll_"))
    own = own.withColumn("w_", F.transform("ll_", lambda v: F.exp(v - F.col("top_"))))
    own = own.withColumn("mass_", F.aggregate("w_", F.lit(0.0), lambda a, w: a + w))
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("cum"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

    def walk(a: Column, w: Column) -> Column:
        cum = a["cum"] + w / F.col("mass_")
        return F.struct(
            (a["i"] + 1).alias("i"), cum.alias("cum"), (a["sum"] + w * a["i"]).alias("sum"),
            F.when(a["lo"].isNull() & (cum >= 0.10), a["i"]).otherwise(a["lo"]).alias("lo"), F.when(a["hi"].isNull() & (cum >= 0.90), a["i"]).otherwise(a["hi"]).alias("hi"),
        )

    own = own.withColumn("e_", F.aggregate("w_", start, walk))
    lo, hi = F.coalesce(F.col("e_.lo") / float(STEPS), F.lit(0.0)), F.coalesce(F.col("e_.hi") / float(STEPS), F.lit(1.0))
    some = c + s > 0
    return own.withColumns({
        "ratio": F.when(some, round_n(F.col("e_.sum") / F.col("mass_") / float(STEPS), 4)), "lo": F.when(some, round_n(lo, 4)), "hi": F.when(some, round_n(hi, 4)), "wide": F.when(some, hi - lo > 0.45).otherwise(False),
    }).drop("ll_", "top_", "w_", "mass_", "e_")


def adjusted_count(n_change: Column, n_sustain: Column) -> Column:
    """The 2x2 system solved for the true share and clipped to 0..1; null without directional turns."""
    q = F.try_divide(n_change, n_change + n_sustain)
    return F.when(q.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (q - P_CS) / (P_CC - P_CS))))


def resolvability(df: DataFrame, turns: str) -> DataFrame:
    """``df`` with the nearest simulated row (ties: fewer turns) and whether so many turns can be read."""
    near = F.array_min(F.array(*[F.struct(F.abs(F.col(turns) - F.lit(t)).alias("gap"), F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in RESOLVABILITY]))
    return df.withColumns({"nearest_turns": near["t"], "ci80_width": near["w"], "readable": F.col(turns) >= READABLE_TURNS})
