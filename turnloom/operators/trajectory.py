"""Statistics of one ordered series per key: trend, change point, momentum, streaks, reliable change, forecast and screens.

``series(key, n, y)`` holds the position n = 1, 2, ... of each value; ``positions`` makes it. Every operator is one or two aggregations per key over it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.numeric import clamp, p_from_t, round_n

# Points of reliable change and standard error of one session, cut-offs of the screen, and the recent window.
S_DIFF = math.sqrt(2.0 * 10.0**2 * (1.0 - 0.82))
SE_MEAS = 10.0 * math.sqrt(1.0 - 0.82)
MODERATE_AT, ELEVATED_AT, RECENT = 0.30, 0.55, 6


def positions(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``(key, n, y, total)``: values by position, and how many there are."""
    w = Window.partitionBy(key)
    return rows.where(F.col(value).isNotNull()).select(
        key, F.row_number().over(w.orderBy(order)).alias("n"), F.col(value).cast("double").alias("y"), F.count(F.lit(1)).over(w).alias("total")
    )


def trend_stats(x: Column, y: Column, keep: Column | None = None) -> list[Column]:
    """Aggregates of a least-squares line: t_n, t_sx, t_sy, t_sxx, t_sxy, t_syy (centred on the first value, so that large values cancel nothing)."""
    ok = F.lit(True) if keep is None else keep
    a, b = F.when(ok, x.cast("double")), F.when(ok, y)
    return [F.count(a).alias("t_n"), F.avg(a).alias("t_mx"), F.avg(b).alias("t_my"), F.var_pop(a).alias("t_vx"), F.var_pop(b).alias("t_vy"), F.covar_pop(a, b).alias("t_c"), F.min_by(b, a).alias("t_first")]


def _line(prefix: str = "") -> dict[str, Column]:
    """Slope, intercept, t, p and R squared from ``trend_stats`` columns, rounded."""
    n, vx, vy, c = (F.col(x) for x in ("t_n", "t_vx", "t_vy", "t_c"))
    enough = n >= 3
    slope = F.try_divide(c, vx)
    sse = F.greatest(F.lit(0.0), n * (vy - F.coalesce(slope, F.lit(0.0)) * c))
    flat = vy < 1e-18
    se = F.sqrt(F.try_divide(F.try_divide(sse, n - 2), n * vx))
    t = F.when(flat | (se < 1e-9), F.lit(0.0)).otherwise(F.try_divide(slope, se))
    r2 = F.when(flat, F.lit(0.0)).otherwise(1 - F.try_divide(sse, n * vy))
    p = p_from_t(F.abs(t), (n - 2).cast("double"))
    return {
        f"{prefix}slope": F.when(enough, round_n(slope, 4)).otherwise(0.0), f"{prefix}intercept": F.when(enough, round_n(F.col("t_my") - slope * F.col("t_mx"), 3)).otherwise(F.coalesce("t_first", F.lit(50.0))),
        f"{prefix}t_stat": F.when(enough, round_n(t, 3)).otherwise(0.0), f"{prefix}p": F.when(enough, round_n(p, 4)).otherwise(1.0), f"{prefix}r2": F.when(enough, round_n(r2, 4)).otherwise(0.0),
    }


def ols_trend(series: DataFrame, key: str, recent: int | None = None, prefix: str = "") -> DataFrame:
    """Least-squares line over positions 0.. of all values, or of the last ``recent``."""
    s = series if recent is None else series.where(F.col("n") > F.col("total") - recent)
    x = F.col("n") - 1 if recent is None else F.col("n") - 1 - F.greatest(F.lit(0), F.col("total") - recent)
    return s.groupBy(key).agg(*trend_stats(x, F.col("y"))).select(key, F.col("t_n").alias(f"{prefix}n"), *[v.alias(k) for k, v in _line(prefix).items()])


def change_point(series: DataFrame, key: str, min_seg: int = 2) -> DataFrame:
    """The split with the largest |t| between both sides where |t| is at least 2: index, t, means, shift, direction and p.

    Running sums of centred values give every split's statistics in one pass over the series.
    """
    w = Window.partitionBy(key)
    run = w.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    c = series.withColumn("mid", F.avg("y").over(w)).withColumn("c", F.col("y") - F.col("mid"))
    c = c.withColumns({"s1": F.sum("c").over(run), "q1": F.sum(F.col("c") * F.col("c")).over(run), "s": F.sum("c").over(w), "q": F.sum(F.col("c") * F.col("c")).over(w)})
    a, b = F.col("n").cast("double"), (F.col("total") - F.col("n")).cast("double")
    ok = c.where((F.col("total") >= 2 * min_seg + 1) & (F.col("n") >= min_seg) & (F.col("n") <= F.col("total") - min_seg))
    s2, q2 = F.col("s") - F.col("s1"), F.col("q") - F.col("q1")
    va = F.greatest(F.lit(0.0), F.col("q1") - F.col("s1") * F.col("s1") / a) / F.greatest(F.lit(1.0), a - 1)
    vb = F.greatest(F.lit(0.0), q2 - s2 * s2 / b) / F.greatest(F.lit(1.0), b - 1)
    pooled = F.sqrt(va / a + vb / b)
    ma, mb = F.col("mid") + F.col("s1") / a, F.col("mid") + s2 / b
    split = ok.select(key, "n", "total", pooled.alias("pooled"), ma.alias("ma"), mb.alias("mb")).where("pooled >= 1e-6")
    split = split.withColumn("t", (F.col("mb") - F.col("ma")) / F.col("pooled"))
    best = split.groupBy(key).agg(F.max_by(F.struct("n", "total", "t", "ma", "mb"), F.struct(round_n(F.abs(F.col("t")), 9), -F.col("n"))).alias("b")).select(key, "b.*")
    t3 = round_n(F.col("t"), 3)
    return best.where(F.abs(t3) >= 2.0).select(
        key, F.col("n").alias("split_at"), t3.alias("t"), round_n(F.col("ma"), 2).alias("mean_before"), round_n(F.col("mb"), 2).alias("mean_after"), round_n(F.col("mb") - F.col("ma"), 2).alias("shift"),
        F.when(F.col("mb") > F.col("ma"), "improvement").otherwise("deterioration").alias("direction"), round_n(p_from_t(F.abs(t3), (F.col("total") - 2).cast("double")), 4).alias("p"),
    )


def momentum(series: DataFrame, key: str) -> DataFrame:
    """gaining, regressing, plateauing, steady or insufficient_data from the last six values, corroborated by the whole series."""
    last = series.where(F.col("n") > F.col("total") - RECENT)
    recent_x = F.col("n") - 1 - F.greatest(F.lit(0), F.col("total") - RECENT)
    now = last.groupBy(key).agg(
        *trend_stats(recent_x, F.col("y")), F.max("total").alias("total"), (F.max("y") - F.min("y")).alias("spread"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("vol"),
        F.avg(F.when(F.col("n") > F.col("total") - 3, F.col("y"))).alias("r3"),
    ).select(key, "total", "spread", "vol", "r3", *[v.alias(k) for k, v in _line("r_").items()])
    j = now.join(ols_trend(series, key, prefix="o_"), key)

    def way(sign: int) -> Column:
        strong = (sign * F.col("r_slope") > 1.0) & (F.col("r_p") < 0.20)
        return strong | ((sign * F.col("r_slope") > 0.6) & (sign * F.col("o_slope") > 0.4) & (F.col("o_p") < 0.15))

    state = (
        F.when(F.col("total") < 3, "insufficient_data").when(way(1), "gaining").when(way(-1), "regressing")
        .when((F.col("spread") < 6.0) | (F.abs("r_slope") <= 0.25), "plateauing").otherwise("steady")
    )
    return j.select(key, F.col("total").alias("n"), state.alias("state"), F.when(F.col("total") >= 3, round_n(F.col("r3"), 2)).alias("recent_mean"), F.when(F.col("total") >= 3, round_n(F.col("vol"), 2)).alias("volatility"), "r_slope", "o_slope")


def streaks(series: DataFrame, key: str, reference: float = 50.0) -> DataFrame:
    """Length of the run at the end that lies at or above, or below, ``reference``."""
    up = F.col("y") >= reference
    s = series.groupBy(key).agg(F.max("n").alias("n"), F.coalesce(F.max(F.when(~up, F.col("n"))), F.lit(0)).alias("last_down"), F.coalesce(F.max(F.when(up, F.col("n"))), F.lit(0)).alias("last_up"))
    return s.select(key, (F.col("n") - F.col("last_down")).alias("above"), (F.col("n") - F.col("last_up")).alias("below"))


def reliable_change(series: DataFrame, key: str) -> DataFrame:
    """Last value against the first in units of the reliable difference."""
    s = series.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by("y", "n").alias("first"), F.max_by("y", "n").alias("latest"))
    rci = (F.col("latest") - F.col("first")) / F.lit(S_DIFF)
    status = F.when(F.col("n") < 2, "baseline_only").when(rci >= 1.96, "reliable_improvement").when(rci <= -1.96, "reliable_deterioration").otherwise("no_reliable_change")
    return s.select(key, "n", F.when(F.col("n") < 2, 0.0).otherwise(round_n(F.col("latest") - F.col("first"), 2)).alias("net_change"), F.when(F.col("n") < 2, 0.0).otherwise(round_n(rci, 2)).alias("rci"), status.alias("status"))


def forecast(series: DataFrame, key: str, horizon: int = 3) -> DataFrame:
    """Damped projection of the recent slope, one row a step: the value is clamped at each step, so the steps are folded in order."""
    last = series.where((F.col("n") > F.col("total") - RECENT) & (F.col("total") >= 3))
    x = F.col("n") - 1 - F.greatest(F.lit(0), F.col("total") - RECENT)
    s = last.groupBy(key).agg(*trend_stats(x, F.col("y")), F.max("total").alias("total"), F.max_by("y", "n").alias("latest"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("sd"))
    s = s.select(key, "total", "latest", clamp(F.col("sd"), 2.5, 12.0).alias("sd"), _line()["slope"].alias("slope"))
    damp = F.array(*[F.lit(0.85**k) for k in range(1, horizon + 1)])
    fold = F.aggregate(
        F.sequence(F.lit(1), F.lit(horizon)), F.struct(F.col("latest").alias("now"), F.array().cast("array<double>").alias("path")),
        lambda a, k: F.struct(clamp(a["now"] + F.col("slope") * damp[k - 1], 15.0, 88.0).alias("now"), F.concat(a["path"], F.array(clamp(a["now"] + F.col("slope") * damp[k - 1], 15.0, 88.0))).alias("path")),
        lambda a: a["path"],
    )
    steps = s.select(key, "total", "latest", "sd", "slope", F.posexplode(fold).alias("i", "m"))
    k = F.col("i") + 1
    se = F.col("sd") * F.sqrt(1.0 + k * 0.5)
    return steps.select(
        key, (F.col("total") + k).alias("session_number"), round_n(F.col("m"), 1).alias("projected"),
        round_n(F.greatest(F.lit(10.0), F.col("m") - 1.282 * se), 1).alias("lo_80"), round_n(F.least(F.lit(95.0), F.col("m") + 1.282 * se), 1).alias("hi_80"),
        round_n(F.greatest(F.lit(5.0), F.col("m") - 1.96 * se), 1).alias("lo_95"), round_n(F.least(F.lit(100.0), F.col("m") + 1.96 * se), 1).alias("hi_95"), round_n(F.col("m") - F.col("latest"), 1).alias("expected_change"),
    )


def _with_back(series: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("n")
    return series.withColumns({"prev": F.lag("y").over(w), "back": F.col("total") - F.col("n") + 1})


def risk_screen(series: DataFrame, key: str) -> DataFrame:
    """Strain screen: last drop, declines in a row, last three against the baseline and recent spread, in units of measurement error."""
    s = _with_back(series, key).groupBy(key).agg(
        F.max("total").alias("n"), F.max(F.when(F.col("back") == 1, F.col("y") - F.col("prev"))).alias("drop"),
        F.coalesce(F.max(F.when(F.coalesce(F.col("y") >= F.col("prev"), F.lit(True)), F.col("n"))), F.lit(0)).alias("last_no_decline"),
        F.avg(F.when(F.col("back") <= 3, F.col("y"))).alias("m3"), F.coalesce(F.stddev_samp(F.when(F.col("back") <= 4, F.col("y"))), F.lit(0.0)).alias("sd4"),
    )
    down = F.col("n") - F.col("last_no_decline")
    score = (
        F.when(F.col("drop") <= -1.96 * S_DIFF, 0.5).when(F.col("drop") <= -1.40 * S_DIFF, 0.25).otherwise(0.0) + F.when(down >= 5, 0.45).when(down == 4, 0.25).otherwise(0.0)
        + F.when((F.col("n") >= 3) & (F.col("m3") < 50.0 - 1.96 * SE_MEAS / math.sqrt(3)), 0.3).otherwise(0.0) + F.when((F.col("n") >= 4) & (F.col("sd4") > 2.0 * SE_MEAS), 0.2).otherwise(0.0)
    )
    score = F.when(F.col("n") < 2, 0.0).otherwise(F.least(F.lit(1.0), round_n(score, 2)))
    scored = s.withColumns({"score": score, "consecutive_declines": down})
    return scored.select(key, "n", "consecutive_declines", "score", F.when(F.col("score") >= ELEVATED_AT, "elevated").when(F.col("score") >= MODERATE_AT, "moderate").otherwise("low").alias("level"))


def decline_alert(series: DataFrame, key: str, run: int = 3, min_step: float = 0.5) -> DataFrame:
    """Falls of more than ``min_step`` in a row at the end; active from ``run`` on."""
    s = _with_back(series, key).groupBy(key).agg(
        F.max("total").alias("n"), F.max_by("y", "n").alias("latest"), F.coalesce(F.max(F.when(~F.coalesce(F.col("y") < F.col("prev") - min_step, F.lit(False)), F.col("n"))), F.lit(0)).alias("start"),
        F.max_by("y", F.when(~F.coalesce(F.col("y") < F.col("prev") - min_step, F.lit(False)), F.col("n"))).alias("from_y"),
    )
    streak = F.when(F.col("n") < run + 1, 0).otherwise(F.col("n") - F.col("start"))
    s = s.withColumn("run_length", streak)
    some = F.col("run_length") > 0
    return s.select(
        key, (F.col("run_length") >= run).alias("active"), F.col("run_length"), F.when(some, round_n(F.col("from_y") - F.col("latest"), 1)).otherwise(0.0).alias("total_drop"),
        F.when(some, F.col("start")).alias("from_session"), F.when(some, F.col("n")).alias("to_session"),
    )


def turning_point(series: DataFrame, key: str) -> DataFrame:
    """The largest single rise and where it is (ties: the first)."""
    d = _with_back(series, key).where("prev is not null").withColumn("jump", F.col("y") - F.col("prev"))
    return d.groupBy(key).agg(F.max_by(F.struct("n", "jump"), F.struct("jump", -F.col("n"))).alias("b")).select(key, F.col("b.n").alias("at_session"), round_n(F.col("b.jump"), 2).alias("jump"))


def summarise(series: DataFrame, key: str) -> DataFrame:
    """One row per key with trend, recent trend, momentum, change point, streaks, reliable change and screen."""
    out = ols_trend(series, key).join(ols_trend(series, key, recent=RECENT, prefix="recent_"), key)
    out = out.join(momentum(series, key).select(key, "state", "recent_mean", "volatility"), key).join(streaks(series, key), key)
    out = out.join(change_point(series, key).select(key, "split_at", "shift", "direction"), key, "left").join(reliable_change(series, key).drop("n"), key)
    return out.join(risk_screen(series, key).select(key, "score", "level"), key)
