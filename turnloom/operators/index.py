"""Baseline, standardisation and the 0-100 process index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.numeric import clamp, mean_of_rounded, round_n
from turnloom.operators.score import DIMENSIONS

# Weight of each dimension, its cohort spread, the shrinkage strength and the smallest spread.
WEIGHTS = dict(zip(DIMENSIONS, (0.24, 0.18, 0.20, 0.20, 0.18)))
COHORT_SD = dict(zip(DIMENSIONS, (0.075, 0.070, 0.080, 0.085, 0.070)))
SHRINKAGE, SD_FLOOR = 3.0, 0.015


def baselines(sessions: DataFrame, key: str = "client_id", order: str = "session_number", k: int = 2) -> DataFrame:
    """Per key, from its first ``k`` sessions: mu_<dim>, sd_<dim> (shrunk towards the cohort's), n_baseline, provisional.

    ``row_number() <= k`` is a group limit, so only k rows a key leave each map task.
    """
    first = sessions.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rn_") <= k)
    aggs = [F.count(F.lit(1)).alias("n_baseline")]
    for d in DIMENSIONS:
        aggs += [mean_of_rounded(F.col(d)).alias(f"m_{d}"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias(f"s_{d}")]
    own = first.groupBy(key).agg(*aggs)
    lam = F.col("n_baseline") / (F.col("n_baseline") + F.lit(SHRINKAGE))
    cols = [round_n(F.coalesce(f"m_{d}", F.lit(0.5)), 4).alias(f"mu_{d}") for d in DIMENSIONS]
    cols += [round_n(F.greatest(F.lit(SD_FLOOR), lam * F.col(f"s_{d}") + (1 - lam) * F.lit(COHORT_SD[d])), 4).alias(f"sd_{d}") for d in DIMENSIONS]
    return own.select(key, *cols, "n_baseline", (F.col("n_baseline") < k).alias("provisional"))


def confidence(words: Column, turns: Column, provisional: Column) -> Column:
    c = F.when(words < 300, 0.55).when(words < 800, 0.8).otherwise(1.0) * F.when(turns < 10, 0.7).otherwise(1.0) * F.when(provisional, 0.6).otherwise(1.0)
    return round_n(F.least(F.lit(1.0), c), 3)


def confidence_notes(words: Column, turns: Column, provisional: Column) -> Column:
    return F.array_compact(F.array(
        F.when(words < 300, "few client words: noisy").when(words < 800, "short session: read with care"),
        F.when(turns < 10, "few client turns"), F.when(provisional, "baseline still provisional"),
    ))


def index_sessions(sessions: DataFrame, base: DataFrame, key: str = "client_id") -> DataFrame:
    """``sessions`` with z_<dim>, contribution_<dim>, tpi and confidence against the key's own baseline."""
    j = sessions.join(base, key)
    z = {f"z_{d}": round_n((F.coalesce(d, F.lit(0.0)) - F.col(f"mu_{d}")) / F.col(f"sd_{d}"), 4) for d in DIMENSIONS}
    z = {k: F.when(F.col(k[2:]).isNull(), F.lit(0.0)).otherwise(v) for k, v in z.items()}
    j = j.withColumns(z)
    j = j.withColumns({f"contribution_{d}": round_n(F.lit(10.0 * WEIGHTS[d]) * F.col(f"z_{d}"), 3) for d in DIMENSIONS})
    total = F.lit(50.0)
    for d in DIMENSIONS:
        total = total + F.col(f"contribution_{d}")
    return j.withColumns({"tpi": round_n(clamp(total, 0.0, 100.0), 2), "confidence": confidence(F.col("n_client_words"), F.col("n_client_turns"), F.col("provisional"))})


def absolute_index(features: DataFrame) -> DataFrame:
    """Index of a session by itself: 100 times the weighted mean of its dimensions, and z against the neutral middle and the cohort's spread."""
    x = {d: F.coalesce(F.col(d), F.lit(0.5)) for d in DIMENSIONS}
    total = F.lit(0.0)
    for d in DIMENSIONS:
        total = total + F.lit(WEIGHTS[d]) * x[d]
    cols = {"absolute_tpi": round_n(clamp(100.0 * total, 0.0, 100.0), 2), "absolute_confidence": confidence(F.col("n_client_words"), F.col("n_client_turns"), F.lit(True))}
    cols |= {f"part_{d}": round_n(100.0 * F.lit(WEIGHTS[d]) * x[d], 3) for d in DIMENSIONS}
    cols |= {f"abs_z_{d}": round_n((x[d] - 0.5) / F.lit(COHORT_SD[d]), 4) for d in DIMENSIONS}
    return features.withColumns(cols)


def within_person_z(rows: DataFrame, key: str, value: str, is_baseline: str) -> DataFrame:
    """``rows`` with <value>_z (four decimals) against the key's own baseline rows; null where those are fewer than two, and a spread of zero counts as 1e-6."""
    w = Window.partitionBy(key)
    b = F.when(F.col(is_baseline), F.col(value))
    n, m, s = F.count(b).over(w), F.avg(b).over(w), F.stddev_samp(b).over(w)
    return rows.withColumn(f"{value}_z", F.when(n >= 2, round_n((F.col(value) - m) / F.when(s == 0, 1e-6).otherwise(s), 4)))


def case_trajectory(indexed: DataFrame, trend: DataFrame, measures: DataFrame, key: str = "client_id", number: str = "session_number") -> DataFrame:
    """One row per case, ready to be shown: its sessions in order with index and confidence, the latest one, the state of the index, its outcome scores in order, and how many sessions can be read alone.

    ``trend(key, state)`` and ``measures(key, number, instrument, score)`` may lack cases. Each table is rolled up by case first and joined as one row, so nothing is looked up per case; the rows of a case are
    bounded by its number of sessions.
    """
    one = F.struct(F.col(number).alias("n"), F.col("tpi").alias("tpi"), F.col("confidence").alias("confidence"))
    s = indexed.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("s_"), F.count(F.lit(1)).alias("n_sessions"), F.sum((F.col("confidence") >= 0.6).cast("int")).alias("n_readable"), F.max_by("tpi", number).alias("latest_tpi"), F.max(number).alias("latest_session"))
    m = measures.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col("instrument").alias("i"), F.col("score").alias("x")))).alias("m_"), F.min_by("instrument", F.struct(F.col(number), F.col("instrument"))).alias("instrument"))
    j = s.join(trend.select(key, "state"), key, "left").join(m, key, "left")
    s_, m_ = F.col("s_"), F.col("m_")
    return j.select(
        key, "n_sessions", "n_readable", "latest_session", "latest_tpi", "state", "instrument",
        F.array_join(F.transform(s_, lambda x: F.format_string("%d=%.2f", x["n"], x["tpi"])), ";").alias("series"),
        F.coalesce(F.array_join(F.transform(m_, lambda x: F.format_string("%d:%s=%.1f", x["n"], x["i"], x["x"])), ";"), F.lit("")).alias("measures"),
    )


def norms_z(features: DataFrame, norms: dict[str, tuple[float, float]]) -> DataFrame:
    """``features`` with <name>_z for every column that has a norm (mean, deviation)."""
    return features.withColumns({f"{k}_z": round_n((F.col(k) - F.lit(m)) / F.lit(s), 4) for k, (m, s) in norms.items() if k in features.columns})
