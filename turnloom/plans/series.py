"""Queries over series per client: outcome measures as a 0-100 series, and the statistics of trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions.numeric import round_n
from turnloom.operators import trajectory as T
from turnloom.plans.dyads import sql_erf
from turnloom.plans.fixtures import sql_round
from turnloom.session import table


def latest_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One valid score per client, session and instrument: the latest recorded (ties: the highest id)."""
    m = table(spark, sf_dir, "measures").withColumn("instrument", F.regexp_replace(F.lower("instrument"), "[^a-z0-9]", ""))
    w = Window.partitionBy("client_id", "session_number", "instrument").orderBy(F.desc("recorded_at"), F.desc("id"))
    return m.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1 and score >= 0 and score <= 50").select("id", "client_id", "session_number", "instrument", "score", "recorded_at")


def client_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = latest_measures(spark, sf_dir).groupBy("client_id", "session_number").agg(round_n(100.0 - 2.0 * F.avg("score"), 2).alias("tpi"))
    return T.positions(per, "client_id", "session_number", "tpi")


def _over(operator, *args, **kwargs):
    return lambda spark, sf_dir: operator(client_series(spark, sf_dir), "client_id", *args, **kwargs)


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ols_trend(client_series(spark, sf_dir), "client_id")


def momentum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.momentum(client_series(spark, sf_dir), "client_id").groupBy("state").agg(F.count(F.lit(1)).alias("n_clients"), F.sum("n").alias("n_sessions"))


def momentum_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.momentum(client_series(spark, sf_dir), "client_id").select("client_id", "n", "state", "recent_mean", "volatility", "r_slope", "o_slope")


def trajectory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.summarise(client_series(spark, sf_dir), "client_id")


def session_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last against first session of a client, as a self-join of the series."""
    s = client_series(spark, sf_dir)
    a = s.where("n = 1").select("client_id", F.col("y").alias("y_first"))
    b = s.where("n = total and total > 1").select("client_id", "total", F.col("y").alias("y_last"))
    return a.join(b, "client_id").select("client_id", "total", "y_first", "y_last", round_n(F.col("y_last") - F.col("y_first"), 2).alias("delta"))


def measure_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores turned upside down and scaled to 0..1 within a client and instrument, for drawing them over the index."""
    m = latest_measures(spark, sf_dir)
    w = Window.partitionBy("client_id", "instrument")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return m.select("client_id", "session_number", "instrument", F.when(hi > lo, 1 - (F.col("score") - lo) / (hi - lo)).alias("height"))


def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element at half the count of the sorted values, per client."""
    s = client_series(spark, sf_dir)
    w = Window.partitionBy("client_id").orderBy("y")
    return s.withColumn("r", F.row_number().over(w) - 1).where("r = floor(total / 2)").select("client_id", F.col("y").alias("median_y"))


def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("client_id").orderBy("n").rowsBetween(-2, 0)
    return client_series(spark, sf_dir).select("client_id", "n", "y", round_n(F.avg("y").over(w), 6).alias("mean_3"))


QUERIES = {
    "latest_measures": latest_measures, "client_series": client_series, "ols_trend": trend, "recent_trend": _over(T.ols_trend, recent=T.RECENT, prefix="recent_"), "change_point": _over(T.change_point),
    "momentum": momentum_states, "momentum_counts": momentum_counts, "streaks": _over(T.streaks), "reliable_change": _over(T.reliable_change), "forecast": _over(T.forecast),
    "risk_screen": _over(T.risk_screen), "decline_alert": _over(T.decline_alert), "turning_point": _over(T.turning_point), "trajectory_summary": trajectory_summary, "session_diff": session_diff,
    "measure_overlay": measure_overlay, "upper_median": upper_median, "running_mean": running_mean,
}

R = sql_round
LATEST = """
latest AS (SELECT id, client_id, session_number, instrument, score, recorded_at FROM (
  SELECT id, client_id, session_number, regexp_replace(lower(instrument), '[^a-z0-9]', '', 'g') AS instrument, score, recorded_at,
    row_number() OVER (PARTITION BY client_id, session_number, regexp_replace(lower(instrument), '[^a-z0-9]', '', 'g') ORDER BY recorded_at DESC, id DESC) AS rn FROM measures)
  WHERE rn = 1 AND score >= 0 AND score <= 50)"""
SERIES = f"""{LATEST},
per AS (SELECT client_id, session_number, {R('100.0::DOUBLE - 2.0::DOUBLE * avg(score)', 2)} AS tpi FROM latest GROUP BY client_id, session_number),
series AS (SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY session_number) AS n, tpi AS y, count(*) OVER (PARTITION BY client_id) AS total FROM per)"""


def sql_p(t: str, df: str) -> str:
    z = f"(({t}) * (1 - 1.0::DOUBLE / (4 * {df})) / sqrt(1 + ({t}) * ({t}) / (2 * {df})))"
    return f"(CASE WHEN {df} <= 0 THEN 1.0::DOUBLE ELSE 2 * (1 - 0.5::DOUBLE * (1 + {sql_erf(f'({z} / sqrt(2.0::DOUBLE))')})) END)"


def sql_trend(name: str, source: str, x: str, prefix: str = "") -> str:
    """CTEs with the line of ``source`` per client, from plain sums of squares about the means."""
    return f"""
{name}_a AS (SELECT *, {x} AS x, avg({x}) OVER (PARTITION BY client_id) AS mx, avg(y) OVER (PARTITION BY client_id) AS my FROM {source}),
{name}_b AS (SELECT client_id, count(*) AS tn, any_value(mx) AS mx, any_value(my) AS my, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy, arg_min(y, x) AS y0 FROM {name}_a GROUP BY client_id),
{name}_c AS (SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0.0::DOUBLE END AS sl, greatest(0.0::DOUBLE, syy - CASE WHEN sxx > 0 THEN sxy * sxy / sxx ELSE 0.0::DOUBLE END) AS sse FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN tn > 2 AND syy / tn >= 1e-18 AND sqrt(sse / (tn - 2) / sxx) >= 1e-9 THEN sl / sqrt(sse / (tn - 2) / sxx) ELSE 0.0::DOUBLE END AS tt FROM {name}_c),
{name} AS (SELECT client_id, tn AS {prefix}n, CASE WHEN tn >= 3 THEN {R('sl', 4)} ELSE 0.0 END AS {prefix}slope, CASE WHEN tn >= 3 THEN {R('my - sl * mx', 3)} ELSE y0 END AS {prefix}intercept,
  CASE WHEN tn >= 3 THEN {R('tt', 3)} ELSE 0.0 END AS {prefix}t_stat, CASE WHEN tn >= 3 THEN {R(sql_p('abs(tt)', '(tn - 2)'), 4)} ELSE 1.0 END AS {prefix}p,
  CASE WHEN tn >= 3 AND syy / tn >= 1e-18 THEN {R('1 - sse / syy', 4)} ELSE 0.0 END AS {prefix}r2 FROM {name}_d)"""


_LAST6 = "last6 AS (SELECT * FROM series WHERE n > total - 6)"
_X6 = "(n - 1 - greatest(0, total - 6))"
_OLS = f"WITH {SERIES},{sql_trend('o', 'series', '(n - 1)')}"
_RECENT = f"WITH {SERIES}, {_LAST6},{sql_trend('rc', 'last6', _X6, 'recent_')}"
_MOMENTUM = f"""WITH {SERIES}, {_LAST6},{sql_trend('o', 'series', '(n - 1)', 'o_')},{sql_trend('rc', 'last6', _X6, 'r_')},
vol AS (SELECT client_id, max(total) AS n, max(y) - min(y) AS spread, coalesce(stddev_samp(y), 0.0) AS vol, avg(y) FILTER (n > total - 3) AS r3 FROM last6 GROUP BY client_id),
mom AS (SELECT client_id, n, CASE WHEN n < 3 THEN 'insufficient_data'
    WHEN (r_slope > 1.0 AND r_p < 0.20) OR (r_slope > 0.6 AND o_slope > 0.4 AND o_p < 0.15) THEN 'gaining'
    WHEN (-r_slope > 1.0 AND r_p < 0.20) OR (-r_slope > 0.6 AND -o_slope > 0.4 AND o_p < 0.15) THEN 'regressing'
    WHEN spread < 6.0 OR abs(r_slope) <= 0.25 THEN 'plateauing' ELSE 'steady' END AS state,
  CASE WHEN n >= 3 THEN {R('r3', 2)} END AS recent_mean, CASE WHEN n >= 3 THEN {R('vol', 2)} END AS volatility, r_slope, o_slope
  FROM vol JOIN o USING (client_id) JOIN rc USING (client_id))"""
_CHANGE = f"""
sp AS (SELECT a.client_id, a.n, a.total, avg(b.y) FILTER (b.n <= a.n) AS ma, avg(b.y) FILTER (b.n > a.n) AS mb,
  coalesce(var_samp(b.y) FILTER (b.n <= a.n), 0) AS va, coalesce(var_samp(b.y) FILTER (b.n > a.n), 0) AS vb
  FROM series a JOIN series b USING (client_id) WHERE a.total >= 5 AND a.n >= 2 AND a.n <= a.total - 2 GROUP BY a.client_id, a.n, a.total),
tt AS (SELECT *, (mb - ma) / sqrt(va / n + vb / (total - n)) AS t FROM sp WHERE sqrt(va / n + vb / (total - n)) >= 1e-6),
bb AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {R('abs(t)', 9)} DESC, n) AS r FROM tt),
cp AS (SELECT client_id, n AS split_at, {R('t', 3)} AS t, {R('ma', 2)} AS mean_before, {R('mb', 2)} AS mean_after, {R('mb - ma', 2)} AS shift,
  CASE WHEN mb > ma THEN 'improvement' ELSE 'deterioration' END AS direction, {R(sql_p('abs(' + R('t', 3) + ')', '(total - 2)'), 4)} AS p FROM bb WHERE r = 1 AND abs({R('t', 3)}) >= 2.0)"""
_STREAK = """
stk AS (SELECT client_id, max(total) - coalesce(max(n) FILTER (y < 50), 0) AS above, max(total) - coalesce(max(n) FILTER (y >= 50), 0) AS below FROM series GROUP BY client_id)"""
_RCI = f"""
rr AS (SELECT client_id, count(*) AS n, arg_min(y, n) AS f, arg_max(y, n) AS l FROM series GROUP BY client_id),
rci AS (SELECT client_id, n, CASE WHEN n < 2 THEN 0.0 ELSE {R('l - f', 2)} END AS net_change, CASE WHEN n < 2 THEN 0.0 ELSE {R('(l - f) / sqrt(2.0::DOUBLE * 100 * (1.0::DOUBLE - 0.82::DOUBLE))', 2)} END AS rci,
  CASE WHEN n < 2 THEN 'baseline_only' WHEN (l - f) / sqrt(2.0::DOUBLE * 100 * (1.0::DOUBLE - 0.82::DOUBLE)) >= 1.96::DOUBLE THEN 'reliable_improvement'
    WHEN (l - f) / sqrt(2.0::DOUBLE * 100 * (1.0::DOUBLE - 0.82::DOUBLE)) <= -1.96::DOUBLE THEN 'reliable_deterioration' ELSE 'no_reliable_change' END AS status FROM rr)"""
_S, _E = "sqrt(2.0::DOUBLE * 100 * (1.0::DOUBLE - 0.82::DOUBLE))", "(10.0::DOUBLE * sqrt(1.0::DOUBLE - 0.82::DOUBLE))"
_BACK = "bk AS (SELECT *, lag(y) OVER (PARTITION BY client_id ORDER BY n) AS prev, total - n + 1 AS back FROM series)"
_RISK = f"""
{_BACK},
rs AS (SELECT client_id, max(total) AS n, max(y - prev) FILTER (back = 1) AS dr, max(total) - coalesce(max(n) FILTER (coalesce(y >= prev, true)), 0) AS down,
  avg(y) FILTER (back <= 3) AS m3, coalesce(stddev_samp(y) FILTER (back <= 4), 0.0) AS sd4 FROM bk GROUP BY client_id),
rk AS (SELECT client_id, n, down AS consecutive_declines, CASE WHEN n < 2 THEN 0.0 ELSE least(1.0::DOUBLE, {R(f'''
    CASE WHEN dr <= -1.96::DOUBLE * {_S} THEN 0.5::DOUBLE WHEN dr <= -1.40::DOUBLE * {_S} THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN down >= 5 THEN 0.45::DOUBLE WHEN down = 4 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN n >= 3 AND m3 < 50.0::DOUBLE - 1.96::DOUBLE * {_E} / sqrt(3.0::DOUBLE) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN n >= 4 AND sd4 > 2.0::DOUBLE * {_E} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END''', 2)}) END AS score FROM rs),
risk AS (SELECT *, CASE WHEN score >= 0.55::DOUBLE THEN 'elevated' WHEN score >= 0.30::DOUBLE THEN 'moderate' ELSE 'low' END AS level FROM rk)"""
SQL = {
    "latest_measures": f"WITH {LATEST} SELECT * FROM latest",
    "client_series": f"WITH {SERIES} SELECT * FROM series",
    "ols_trend": f"{_OLS} SELECT * FROM o",
    "recent_trend": f"{_RECENT} SELECT * FROM rc",
    "change_point": f"WITH {SERIES},{_CHANGE} SELECT * FROM cp",
    "momentum": f"{_MOMENTUM} SELECT * FROM mom",
    "momentum_counts": f"{_MOMENTUM} SELECT state, count(*) AS n_clients, sum(n) AS n_sessions FROM mom GROUP BY state",
    "streaks": f"WITH {SERIES},{_STREAK} SELECT * FROM stk",
    "reliable_change": f"WITH {SERIES},{_RCI} SELECT * FROM rci",
    "forecast": f"""WITH RECURSIVE {SERIES}, {_LAST6},{sql_trend('rc', 'last6', _X6)},
b AS (SELECT client_id, max(total) AS total, arg_max(y, n) AS latest, greatest(2.5::DOUBLE, least(12.0::DOUBLE, coalesce(stddev_samp(y), 0.0))) AS sd FROM last6 WHERE total >= 3 GROUP BY client_id),
st AS (SELECT client_id, total, latest, sd, slope, 0 AS k, latest AS m FROM b JOIN rc USING (client_id)
  UNION ALL SELECT client_id, total, latest, sd, slope, k + 1, greatest(15.0::DOUBLE, least(88.0::DOUBLE, m + slope * power(0.85::DOUBLE, k + 1))) FROM st WHERE k < 3)
SELECT client_id, total + k AS session_number, {R('m', 1)} AS projected, {R('greatest(10.0::DOUBLE, m - 1.282::DOUBLE * (sd * sqrt(1.0::DOUBLE + k * 0.5::DOUBLE)))', 1)} AS lo_80,
  {R('least(95.0::DOUBLE, m + 1.282::DOUBLE * (sd * sqrt(1.0::DOUBLE + k * 0.5::DOUBLE)))', 1)} AS hi_80, {R('greatest(5.0::DOUBLE, m - 1.96::DOUBLE * (sd * sqrt(1.0::DOUBLE + k * 0.5::DOUBLE)))', 1)} AS lo_95,
  {R('least(100.0::DOUBLE, m + 1.96::DOUBLE * (sd * sqrt(1.0::DOUBLE + k * 0.5::DOUBLE)))', 1)} AS hi_95, {R('m - latest', 1)} AS expected_change FROM st WHERE k > 0""",
    "risk_screen": f"WITH {SERIES},{_RISK} SELECT * FROM risk",
    "decline_alert": f"""WITH {SERIES}, {_BACK}, d AS (SELECT *, coalesce(y < prev - 0.5::DOUBLE, false) AS fell FROM bk),
g AS (SELECT client_id, max(total) AS n, arg_max(y, n) AS latest, max(n) FILTER (NOT fell) AS start, arg_max(y, n) FILTER (NOT fell) AS from_y FROM d GROUP BY client_id),
r AS (SELECT *, CASE WHEN n < 4 THEN 0 ELSE n - start END AS run_length FROM g)
SELECT client_id, run_length >= 3 AS active, run_length, CASE WHEN run_length > 0 THEN {R('from_y - latest', 1)} ELSE 0.0 END AS total_drop, CASE WHEN run_length > 0 THEN start END AS from_session, CASE WHEN run_length > 0 THEN n END AS to_session FROM r""",
    "turning_point": f"WITH {SERIES}, {_BACK}, r AS (SELECT client_id, n, y - prev AS j, row_number() OVER (PARTITION BY client_id ORDER BY y - prev DESC, n) AS r FROM bk WHERE prev IS NOT NULL) SELECT client_id, n AS at_session, {R('j', 2)} AS jump FROM r WHERE r = 1",
    "trajectory_summary": f"""{_MOMENTUM},{sql_trend('ot', 'series', '(n - 1)')},{sql_trend('rt', 'last6', _X6, 'recent_')},{_CHANGE},{_STREAK},{_RCI},{_RISK}
SELECT ot.*, rt.* EXCLUDE (client_id), mom.state, mom.recent_mean, mom.volatility, above, below, split_at, shift, direction, net_change, rci.rci, status, score, level
FROM ot JOIN rt USING (client_id) JOIN mom USING (client_id) JOIN stk USING (client_id) LEFT JOIN cp USING (client_id) JOIN rci USING (client_id) JOIN risk USING (client_id)""",
    "session_diff": f"WITH {SERIES} SELECT a.client_id, b.total, a.y AS y_first, b.y AS y_last, {R('b.y - a.y', 2)} AS delta FROM series a JOIN series b ON a.client_id = b.client_id AND a.n = 1 AND b.n = b.total AND b.total > 1",
    "measure_overlay": f"WITH {LATEST} SELECT client_id, session_number, instrument, CASE WHEN max(score) OVER w > min(score) OVER w THEN 1 - (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS height FROM latest WINDOW w AS (PARTITION BY client_id, instrument)",
    "upper_median": f"WITH {SERIES} SELECT client_id, list_sort(list(y))[count(*) // 2 + 1] AS median_y FROM series GROUP BY client_id",
    "running_mean": f"WITH {SERIES} SELECT client_id, n, y, {R('avg(y) OVER (PARTITION BY client_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 6)} AS mean_3 FROM series",
}
