"""Queries that hold scores against outcomes and expert labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions.numeric import round_n, safe_corr
from turnloom.operators import posterior as P
from turnloom.operators import validate as V
from turnloom.operators.score import DIMENSIONS, score_utterances
from turnloom.plans.dyads import _corr, sql_erf
from turnloom.plans.fixtures import CORPUS, SCORED_CORPUS, corpus_turns, scored_turns, sql_round as R, sql_scored, sql_space_words, space_words
from turnloom.plans.series import LATEST, latest_measures
from turnloom.session import table


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with both questionnaires, joined on client and session."""
    m = latest_measures(spark, sf_dir)
    a = m.where("instrument = 'phq9'").select("client_id", "session_number", F.col("score").alias("x"))
    return a.join(m.where("instrument = 'gad7'").select("client_id", "session_number", F.col("score").alias("y")), ["client_id", "session_number"])


def measure_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _two(spark, sf_dir).withColumn("all_", F.lit("all"))
    return V.correlate(j, "x", "y", "all_").withColumnRenamed("all_", "scope")


def measure_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = latest_measures(spark, sf_dir)
    return V.correlate(m, "session_number", "score", "instrument")


def measure_lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = latest_measures(spark, sf_dir).groupBy("client_id", "session_number").agg(F.avg("score").alias("y"))
    return V.lead_lag_validity(m.withColumn("x", F.col("session_number").cast("double")), "x", "y", "client_id", "session_number")


def _directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_turns(spark, sf_dir).where("speaker = 'client' and client_talk_type in ('change', 'sustain')").withColumn("is_change", (F.col("client_talk_type") == "change").cast("int"))


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scored_turns(spark, sf_dir).where("speaker = 'client' and client_talk_type is not null")
    return t.groupBy("client_talk_type").agg(F.count(F.lit(1)).alias("n"), *[round_n(F.avg(d), 6).alias(f"mean_{d}") for d in DIMENSIONS])


def label_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _directional(spark, sf_dir).select("is_change", F.explode(F.map_from_arrays(F.array(*[F.lit(d) for d in DIMENSIONS]), F.array(*DIMENSIONS))).alias("dimension", "value"))
    return V.cohens_d(t, "value", F.col("is_change") == 1, "dimension")


def rank_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mann_whitney(_directional(spark, sf_dir).withColumn("v", round_n(F.col("process_mean"), 6)), "v", "is_change")


def conversation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of change talk against the mean score per conversation with five or more directional turns, by quality."""
    t = _directional(spark, sf_dir).groupBy("transcript_id", "mi_quality").agg(F.count(F.lit(1)).alias("k"), F.avg("is_change").alias("ratio"), F.avg("process_mean").alias("pm")).where("k >= 5")
    return V.correlate(t.withColumn("mi_quality", F.coalesce("mi_quality", F.lit("none"))).withColumns({"ratio": round_n(F.col("ratio"), 6), "pm": round_n(F.col("pm"), 6)}), "ratio", "pm", "mi_quality")


def _clock(c):
    m = F.regexp_extract_all(c, F.lit(r"^(\d+):(\d{1,2})(?::(\d{1,2}))?$"), F.lit(0))
    parts = F.split(c, ":")
    num = lambda i: F.try_element_at(parts, F.lit(i)).cast("double")
    return F.when(F.size(m) == 0, None).when(F.size(parts) == 3, num(1) * 3600 + num(2) * 60 + num(3)).otherwise(num(1) * 60 + num(2))


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus_turns(spark, sf_dir).withColumns({"at_s": _clock(F.col("spoken_at")), "words": space_words(F.col("text"))})
    w = Window.partitionBy("transcript_id").orderBy("idx")
    d = t.withColumn("duration", F.lead("at_s").over(w) - F.col("at_s")).where("duration > 0 and duration <= 120 and words >= 3")
    return d.select("transcript_id", "idx", "speaker", "client_talk_type", "duration", (F.col("words") / F.col("duration")).alias("rate"))


def speech_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rates(spark, sf_dir).where("speaker = 'client' and client_talk_type is not null")
    return r.groupBy("client_talk_type").agg(F.count(F.lit(1)).alias("n"), round_n(F.avg("rate"), 6).alias("mean_rate"), round_n(F.percentile("rate", 0.5), 6).alias("median_rate"), round_n(F.coalesce(F.stddev_samp("rate"), F.lit(0.0)), 6).alias("sd_rate"))


def rate_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech rate against the conversation's own mean and median, and the change from the turn before."""
    r = _rates(spark, sf_dir)
    w = Window.partitionBy("transcript_id")
    med = r.groupBy("transcript_id").agg(F.percentile("rate", 0.5).alias("med"))
    z = F.when(F.coalesce(F.stddev_samp("rate").over(w), F.lit(0.0)) > 1e-12, (F.col("rate") - F.avg("rate").over(w)) / F.stddev_samp("rate").over(w))
    return r.withColumns({"z": z, "delta": F.col("rate") - F.lag("rate").over(w.orderBy("idx"))}).join(med, "transcript_id").select(
        "transcript_id", "idx", round_n(F.col("z"), 4).alias("z"), round_n(F.col("rate") - F.col("med"), 6).alias("off_median"), round_n(F.col("delta"), 6).alias("delta")
    )


def rate_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-biserial correlation of speech rate with change talk among directional client turns."""
    r = _rates(spark, sf_dir).where("speaker = 'client' and client_talk_type in ('change', 'sustain')")
    y = (F.col("client_talk_type") == "change").cast("double")
    return r.agg(F.count(F.lit(1)).alias("n"), round_n(safe_corr(F.col("rate"), y), 6).alias("r"))


def paired_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired t of the two questionnaires of one session."""
    return V.paired_t(_two(spark, sf_dir), "x", "y")


def first_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instrument of a client's first measure, by id."""
    return table(spark, sf_dir, "measures").where("client_id is not null").groupBy("client_id").agg(F.min_by("instrument", "id").alias("instrument"))


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain rule as stand-in classifier: the side of the score, neutral in between."""
    t = scored_turns(spark, sf_dir).where("speaker = 'client' and client_talk_type is not null")
    return t.select("transcript_id", F.col("client_talk_type").alias("actual"), F.when(F.col("process_mean") >= 0.44, "change").when(F.col("process_mean") < 0.41, "sustain").otherwise("neutral").alias("predicted"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.confusion_long(_called(spark, sf_dir), "actual", "predicted")


def metrics_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.class_metrics(confusion(spark, sf_dir))


def metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.overall_metrics(confusion(spark, sf_dir))


def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.class_weights(_called(spark, sf_dir), "actual")


def weight_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the dimensions refitted to tell change from sustain talk; solved on the driver from one small matrix."""
    w = V.refit_weights(_directional(spark, sf_dir).withColumn("target", -F.col("is_change")), DIMENSIONS, "target") or {}
    return spark.createDataFrame(list(w.items()), "dimension string, weight double")


def weight_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross products that ``weight_refit`` solves."""
    return V.cross_products(_directional(spark, sf_dir).withColumn("target", -F.col("is_change")), [*DIMENSIONS, "target"])


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda v: F.sum(F.when(F.col("predicted") == v, 1).otherwise(0))
    return _called(spark, sf_dir).groupBy("transcript_id").agg(one("change").alias("n_change"), one("sustain").alias("n_sustain"))


def change_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir)
    c = P.corrected_ratio(c, "n_change", "n_sustain")
    raw = round_n(F.try_divide(F.col("n_change"), F.col("n_change") + F.col("n_sustain")), 4)
    return c.select("*", raw.alias("raw_ratio"), round_n(P.adjusted_count(F.col("n_change"), F.col("n_sustain")), 4).alias("adjusted"))


def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir).select("transcript_id", (F.col("n_change") + F.col("n_sustain")).alias("directional"))
    return P.resolvability(c, "directional")


QUERIES = {
    "measure_agreement": measure_agreement, "measure_by_session": measure_by_session, "measure_lead_lag": measure_lead_lag, "label_means": label_means, "label_contrast": label_contrast, "rank_auc": rank_auc,
    "conversation_validity": conversation_validity, "speech_rate": speech_rate, "rate_correlation": rate_correlation, "paired_scores": paired_scores, "first_instrument": first_instrument, "rate_within": rate_within, "confusion_long": confusion, "metrics_by_class": metrics_by_class, "metrics_overall": metrics_overall,
    "class_weights": balanced_weights, "weight_refit": weight_refit, "weight_products": weight_products, "change_ratio": change_ratio, "readability": readability,
}

_pear = lambda x, y: R(f"CASE WHEN count(*) >= 3 AND var_pop({x}) * var_pop({y}) > 1e-24 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END", 4)


def _ranks(source: str, x: str, y: str, key: str) -> str:
    avg = lambda v: f"(rank() OVER (PARTITION BY {key} ORDER BY {v}) + (count(*) OVER (PARTITION BY {key}, {v}) - 1) / 2.0::DOUBLE)"
    return f"rk AS (SELECT *, {avg(x)} AS rx, {avg(y)} AS ry FROM {source}) SELECT {key}, count(*) AS n, {_pear(x, y)} AS pearson, {_pear('rx', 'ry')} AS spearman FROM rk GROUP BY {key}"


_DIR = f"{SCORED_CORPUS}, dir AS (SELECT *, (client_talk_type = 'change')::INT AS is_change FROM turns WHERE speaker = 'client' AND client_talk_type IN ('change', 'sustain'))"
_RATES = f"""WITH {CORPUS},
tm AS (SELECT *, {sql_space_words('text')} AS words, string_split(spoken_at, ':') AS p FROM corpus),
ts AS (SELECT *, CASE WHEN NOT regexp_matches(spoken_at, '^\\d+:\\d{{1,2}}(:\\d{{1,2}})?$') THEN NULL WHEN len(p) = 3 THEN p[1]::DOUBLE * 3600 + p[2]::DOUBLE * 60 + p[3]::DOUBLE WHEN len(p) = 2 THEN p[1]::DOUBLE * 60 + p[2]::DOUBLE END AS at_s FROM tm),
td AS (SELECT *, lead(at_s) OVER (PARTITION BY transcript_id ORDER BY idx) - at_s AS duration FROM ts),
rates AS (SELECT transcript_id, idx, speaker, client_talk_type, words / duration AS rate FROM td WHERE duration > 0 AND duration <= 120 AND words >= 3)"""
_CALLED = f"{SCORED_CORPUS}, called AS (SELECT transcript_id, client_talk_type AS actual, CASE WHEN process_mean >= 0.44::DOUBLE THEN 'change' WHEN process_mean < 0.41::DOUBLE THEN 'sustain' ELSE 'neutral' END AS predicted FROM turns WHERE speaker = 'client' AND client_talk_type IS NOT NULL)"
_CONF = f"""{_CALLED}, cls AS (SELECT actual AS c FROM called UNION SELECT predicted FROM called),
conf AS (SELECT a.c AS actual, b.c AS predicted, (SELECT count(*) FROM called x WHERE x.actual = a.c AND x.predicted = b.c) AS n FROM cls a, cls b)"""
_CLS = f"""{_CONF}, pc AS (SELECT c AS label, sum(n) FILTER (actual = c) AS support, sum(n) FILTER (predicted = c) AS called, sum(n) FILTER (actual = c AND predicted = c) AS tp FROM conf, cls GROUP BY c),
pr AS (SELECT *, coalesce(tp / nullif(called, 0), 0.0) AS p, coalesce(tp / nullif(support, 0), 0.0) AS r FROM pc),
met AS (SELECT label, support, {R('p', 6)} AS precision, {R('r', 6)} AS recall, {R('coalesce(2 * p * r / nullif(p + r, 0), 0.0)', 6)} AS f1 FROM pr)"""
_CNT = f"{_CALLED}, cnt AS (SELECT transcript_id, count(*) FILTER (predicted = 'change') AS n_change, count(*) FILTER (predicted = 'sustain') AS n_sustain FROM called GROUP BY transcript_id)"
_theta = f"least(greatest(g.p * {P.P_CC}::DOUBLE + (1.0::DOUBLE - g.p) * {P.P_CS}::DOUBLE, 1e-9::DOUBLE), 1.0::DOUBLE - 1e-9::DOUBLE)"
SQL = {
    "measure_agreement": f"WITH {LATEST}, j AS (SELECT 'all' AS scope, a.score AS x, b.score AS y FROM latest a JOIN latest b USING (client_id, session_number) WHERE a.instrument = 'phq9' AND b.instrument = 'gad7'), {_ranks('j', 'x', 'y', 'scope')}",
    "measure_by_session": f"WITH {LATEST}, {_ranks('latest', 'session_number', 'score', 'instrument')}",
    "measure_lead_lag": f"""WITH {LATEST}, s AS (SELECT client_id, session_number, session_number::DOUBLE AS x, avg(score) AS y FROM latest GROUP BY client_id, session_number),
d AS (SELECT *, count(*) OVER (PARTITION BY client_id) AS c, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM s WINDOW w AS (PARTITION BY client_id ORDER BY session_number)),
n AS (SELECT *, lead(dx) OVER w AS dxn, lead(dy) OVER w AS dyn FROM d WHERE c >= 5 WINDOW w AS (PARTITION BY client_id ORDER BY session_number)),
p AS (SELECT client_id, CASE WHEN dx IS NOT NULL AND dyn IS NOT NULL THEN dx END AS a1, CASE WHEN dx IS NOT NULL AND dyn IS NOT NULL THEN dyn END AS b1, CASE WHEN dy IS NOT NULL AND dxn IS NOT NULL THEN dy END AS a2, CASE WHEN dy IS NOT NULL AND dxn IS NOT NULL THEN dxn END AS b2 FROM n)
SELECT client_id, {R(_corr('a1', 'b1'), 4)} AS x_leads, {R(_corr('a2', 'b2'), 4)} AS y_leads FROM p GROUP BY client_id""",
    "label_means": f"{SCORED_CORPUS} SELECT client_talk_type, count(*) AS n, {', '.join(f'{R(f"avg({d})", 6)} AS mean_{d}' for d in DIMENSIONS)} FROM turns WHERE speaker = 'client' AND client_talk_type IS NOT NULL GROUP BY client_talk_type",
    "label_contrast": f"""{_DIR}, lg AS (UNPIVOT (SELECT is_change, {', '.join(DIMENSIONS)} FROM dir) ON {', '.join(DIMENSIONS)} INTO NAME dimension VALUE v),
s AS (SELECT dimension, count(*) FILTER (is_change = 1) AS n1, count(*) FILTER (is_change = 0) AS n0, avg(v) FILTER (is_change = 1) AS m1, avg(v) FILTER (is_change = 0) AS m0, var_samp(v) FILTER (is_change = 1) AS v1, var_samp(v) FILTER (is_change = 0) AS v0 FROM lg GROUP BY dimension)
SELECT dimension, n1, n0, {R('m1', 6)} AS mean1, {R('m0', 6)} AS mean0, {R('(m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0)', 6)} AS d FROM s""",
    "rank_auc": f"""{_DIR}, rk AS (SELECT is_change, rank() OVER (ORDER BY {R('process_mean', 6)}) + (count(*) OVER (PARTITION BY {R('process_mean', 6)}) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {R('process_mean', 6)}) AS c FROM dir),
s AS (SELECT sum(is_change)::DOUBLE AS n1, count(*)::DOUBLE AS n, sum(r) FILTER (is_change = 1) AS r1, sum(c::DOUBLE * c - 1) AS ties FROM rk),
u AS (SELECT *, n - n1 AS n0, r1 - n1 * (n1 + 1) / 2 AS u FROM s), z AS (SELECT *, greatest(0.0::DOUBLE, abs(u - n1 * n0 / 2) - 0.5::DOUBLE) / sqrt(n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u)
SELECT n1::BIGINT AS n1, n0::BIGINT AS n0, u, {R('1 - ' + sql_erf('(z / sqrt(2.0::DOUBLE))'), 6)} AS p, {R('u / (n1 * n0)', 6)} AS auc FROM z""",
    "conversation_validity": f"{_DIR}, cv AS (SELECT transcript_id, coalesce(mi_quality, 'none') AS mi_quality, {R('avg(is_change)', 6)} AS ratio, {R('avg(process_mean)', 6)} AS pm FROM dir GROUP BY transcript_id, mi_quality HAVING count(*) >= 5), {_ranks('cv', 'ratio', 'pm', 'mi_quality')}",
    "speech_rate": f"{_RATES} SELECT client_talk_type, count(*) AS n, {R('avg(rate)', 6)} AS mean_rate, {R('quantile_cont(rate, 0.5)', 6)} AS median_rate, {R('coalesce(stddev_samp(rate), 0.0)', 6)} AS sd_rate FROM rates WHERE speaker = 'client' AND client_talk_type IS NOT NULL GROUP BY client_talk_type",
    "rate_correlation": f"{_RATES} SELECT count(*) AS n, {R('corr(rate, (client_talk_type = ' + chr(39) + 'change' + chr(39) + ')::INT)', 6)} AS r FROM rates WHERE speaker = 'client' AND client_talk_type IN ('change', 'sustain')",
    "paired_scores": f"""WITH {LATEST}, d AS (SELECT a.score - b.score AS d FROM latest a JOIN latest b USING (client_id, session_number) WHERE a.instrument = 'phq9' AND b.instrument = 'gad7')
SELECT count(d) AS n, {R('avg(d)', 6)} AS mean_diff, {R('coalesce(stddev_samp(d), 0)', 6)} AS sd, {R('avg(d) / (stddev_samp(d) / sqrt(count(d)))', 4)} AS t FROM d""",
    "first_instrument": "SELECT client_id, arg_min(instrument, id) AS instrument FROM measures WHERE client_id IS NOT NULL GROUP BY client_id",
    "rate_within": f"""{_RATES}, m AS (SELECT transcript_id, avg(rate) AS m, stddev_samp(rate) AS s, quantile_cont(rate, 0.5) AS med FROM rates GROUP BY transcript_id)
SELECT transcript_id, idx, {R('CASE WHEN coalesce(s, 0) > 1e-12 THEN (rate - m) / s END', 4)} AS z, {R('rate - med', 6)} AS off_median, {R('rate - lag(rate) OVER (PARTITION BY transcript_id ORDER BY idx)', 6)} AS delta FROM rates JOIN m USING (transcript_id)""",
    "confusion_long": f"{_CONF} SELECT actual, predicted, n, {R('coalesce(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 0.0)', 4)} AS row_share FROM conf",
    "metrics_by_class": f"{_CLS} SELECT * FROM met",
    "metrics_overall": f"""{_CLS} SELECT (SELECT sum(n) FROM conf) AS n, {R('(SELECT sum(n) FILTER (actual = predicted) / sum(n) FROM conf)', 6)} AS accuracy, {R('avg(f1)', 6)} AS macro_f1, {R('avg(precision)', 6)} AS macro_precision, {R('avg(recall)', 6)} AS macro_recall, {R('sum(f1 * support) / sum(support)', 6)} AS weighted_f1 FROM met""",
    "weight_products": f"{_DIR}, x AS (SELECT {', '.join(DIMENSIONS)}, -is_change AS target FROM dir) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {R(f'covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b}))', 6)} AS corr FROM x" for i, a in enumerate([*DIMENSIONS, "target"]) for b in [*DIMENSIONS, "target"][i:]),
    "class_weights": f"{_CALLED} SELECT actual AS label, count(*) AS n, {R('sum(count(*)) OVER () / (count(*) OVER () * count(*))', 6)} AS weight FROM called GROUP BY actual",
    "change_ratio": f"""{_CNT}, g AS (SELECT i / 400.0::DOUBLE AS p FROM range(401) t(i)),
ll AS (SELECT cnt.*, g.p, n_change * ln({_theta}) + n_sustain * ln(1 - {_theta}) AS ll FROM cnt, g WHERE n_change + n_sustain > 0),
wt AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY transcript_id)) AS w FROM ll), cu AS (SELECT *, sum(w) OVER (PARTITION BY transcript_id ORDER BY p) / sum(w) OVER (PARTITION BY transcript_id) AS cum FROM wt),
ps AS (SELECT transcript_id, sum(p * w) / sum(w) AS mean, coalesce(min(p) FILTER (cum >= 0.10), 0.0) AS lo, coalesce(min(p) FILTER (cum >= 0.90), 1.0) AS hi FROM cu GROUP BY transcript_id)
SELECT transcript_id, n_change, n_sustain, {R('mean', 4)} AS ratio, {R('lo', 4)} AS lo, {R('hi', 4)} AS hi, coalesce(hi - lo > 0.45::DOUBLE, false) AS wide, {R('n_change / nullif(n_change + n_sustain, 0)', 4)} AS raw_ratio,
  CASE WHEN n_change + n_sustain > 0 THEN {R(f'greatest(0.0::DOUBLE, least(1.0::DOUBLE, (n_change / nullif(n_change + n_sustain, 0) - {P.P_CS}::DOUBLE) / ({P.P_CC}::DOUBLE - {P.P_CS}::DOUBLE)))', 4)} END AS adjusted FROM cnt LEFT JOIN ps USING (transcript_id)""",
    "readability": f"""{_CNT}, d AS (SELECT transcript_id, n_change + n_sustain AS directional FROM cnt), tb AS (SELECT * FROM (VALUES {', '.join(f'({t}, {w}::DOUBLE)' for t, w in P.RESOLVABILITY)}) v(t, w))
SELECT transcript_id, directional, (SELECT t FROM tb ORDER BY abs(t - directional), t LIMIT 1) AS nearest_turns, (SELECT w FROM tb ORDER BY abs(t - directional), t LIMIT 1) AS ci80_width, directional >= 40 AS readable FROM d""",
}
