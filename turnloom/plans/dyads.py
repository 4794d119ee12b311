"""Queries over therapist and client turns of the annotated corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.lexicon import FAMILY_DEFAULT, FAMILY_OF, INTERVENTIONS
from turnloom.functions.numeric import round_n
from turnloom.operators.dyad import (
    best_moves, chi2_yates, dependence, intervention_impact, lead_lag, pooled_impact, response_profile, state_conditional, tag_intervention, top_moments, triples, turn_pairs,
)
from turnloom.operators.score import DIMENSIONS, score_utterances
from turnloom.plans.fixtures import CORPUS, SCORED_CORPUS, corpus_turns, scored_turns, sql_round, sql_scored, sql_tag


def intervention_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus_turns(spark, sf_dir).where("speaker = 'therapist'")
    return t.select("transcript_id", "idx", tag_intervention(F.col("text")).alias("intervention"))


def intervention_in_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus_turns(spark, sf_dir).where("speaker = 'therapist' and behaviour is not null")
    return t.select("transcript_id", "idx", "behaviour", tag_intervention(F.col("text"), F.col("behaviour")).alias("intervention"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(scored_turns(spark, sf_dir), "transcript_id")


def turn_pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def impact_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervention_impact(_pairs(spark, sf_dir), "transcript_id")


def impact_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervention_impact(_pairs(spark, sf_dir))


def impact_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled_impact(intervention_impact(_pairs(spark, sf_dir), "transcript_id"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_moments(_pairs(spark, sf_dir), "transcript_id")


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response_profile(_pairs(spark, sf_dir), "transcript_id")


def response_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir)


def response_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence(_profile(spark, sf_dir), "transcript_id")


def best_move_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_moves(_profile(spark, sf_dir), "transcript_id")


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(scored_turns(spark, sf_dir), "transcript_id").where("behaviour is not null")


def corpus_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triples(spark, sf_dir)


def conditional_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_conditional(_triples(spark, sf_dir))


def change_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _triples(spark, sf_dir).join(corpus_turns(spark, sf_dir).select("transcript_id", "mi_quality").distinct(), "transcript_id")
    cubed = t.cube("behaviour", "mi_quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("next_change", F.lit(False)).cast("int")).alias("n_change"), F.grouping_id().alias("level"))
    return cubed.select("behaviour", "mi_quality", F.col("level").cast("int").alias("level"), "n", "n_change")


def change_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each behaviour against the others: does the next client turn speak of change? Chi-square with Yates' correction."""
    t = _triples(spark, sf_dir).select("behaviour", F.coalesce("next_change", F.lit(False)).cast("int").alias("y"))
    per = t.groupBy("behaviour").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    all_ = per.agg(F.sum("n").alias("nn"), F.sum("k").alias("kk"))
    j = per.join(F.broadcast(all_))  # one row of totals
    stat, p = chi2_yates(F.col("k"), F.col("n") - F.col("k"), F.col("kk") - F.col("k"), F.col("nn") - F.col("kk") - F.col("n") + F.col("k"))
    return j.select("behaviour", "n", F.col("k").alias("n_change"), round_n(stat, 6).alias("chi2"), round_n(p, 6).alias("p"))


def lead_lag_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = score_utterances(corpus_turns(spark, sf_dir).where("speaker = 'client'").select("transcript_id", "idx", "text"))
    return lead_lag(t, DIMENSIONS, "transcript_id", order="idx")


QUERIES = {
    "intervention_tags": intervention_tags, "intervention_in_family": intervention_in_family, "turn_pairs": turn_pair_rows, "impact_by_session": impact_by_session, "impact_overall": impact_overall,
    "impact_pooled": impact_pooled, "top_moments": moments, "response_cells": response_cells, "response_dependence": response_dependence, "best_move_by_state": best_move_by_state,
    "corpus_triples": corpus_triples, "conditional_rates": conditional_rates, "change_cube": change_cube, "change_by_quality": change_by_quality, "lead_lag": lead_lag_matrix,
}

_AROUND = "OVER (PARTITION BY transcript_id ORDER BY idx"
_PAIRS = f"""{SCORED_CORPUS},
near AS (SELECT *,
  last_value(CASE WHEN speaker = 'client' THEN {{'pm': process_mean, 'words': n_space_words}} END IGNORE NULLS) {_AROUND} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN speaker = 'client' THEN {{'pm': process_mean, 'words': n_space_words}} END IGNORE NULLS) {_AROUND} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a
  FROM turns),
pairs AS (SELECT transcript_id, idx AS therapist_idx, {sql_tag('text')} AS intervention, {sql_round('b.pm', 4)} AS before, {sql_round('a.pm', 4)} AS after, {sql_round('a.pm - b.pm', 4)} AS lift
  FROM near WHERE speaker = 'therapist' AND b IS NOT NULL AND a.words >= 5)"""


_MEAN = "sum(round(lift * 10000)::BIGINT)::DOUBLE / count(lift) / 10000.0::DOUBLE"


def _impact(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}intervention, n, {sql_round('m', 4)} AS mean_lift, {sql_round('s', 4)} AS sd, {sql_round('m - 1.96::DOUBLE * (s / sqrt(n::DOUBLE))', 4)} AS ci_lo,
  {sql_round('m + 1.96::DOUBLE * (s / sqrt(n::DOUBLE))', 4)} AS ci_hi, n >= 3 AND abs(m) > 1.96::DOUBLE * (s / sqrt(n::DOUBLE)) AS reliable
FROM (SELECT {k}intervention, count(*) AS n, {_MEAN} AS m, coalesce(stddev_samp(lift), 0.0::DOUBLE) AS s FROM pairs GROUP BY {k}intervention)"""


_PROFILE = f"""{_PAIRS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY before) - 1 AS r, count(*) OVER (PARTITION BY transcript_id) AS c FROM pairs),
cuts AS (SELECT transcript_id, max(before) FILTER (r = c // 3) AS lo, max(before) FILTER (r = 2 * c // 3) AS hi FROM ranked WHERE c >= 12 GROUP BY transcript_id),
cells AS (SELECT *, CASE WHEN before <= lo THEN 'stuck' WHEN before >= hi THEN 'moving' ELSE 'middling' END AS state FROM pairs JOIN cuts USING (transcript_id)),
prof AS (SELECT transcript_id, intervention, state, count(*) AS n, {sql_round(_MEAN, 4)} AS mean_lift, {sql_round('coalesce(stddev_samp(lift), 0.0::DOUBLE)', 4)} AS sd,
  {sql_round('coalesce(stddev_samp(lift), 0.0::DOUBLE) / sqrt(count(*)::DOUBLE)', 4)} AS se FROM cells GROUP BY ALL HAVING count(*) >= 3)"""
_TRIPLES = f"""{SCORED_CORPUS},
nb AS (SELECT *, lag(speaker) {_AROUND}) AS ps, lag(n_space_words) {_AROUND}) AS pw, lag(process_mean) {_AROUND}) AS pp,
  lead(speaker) {_AROUND}) AS xs, lead(n_space_words) {_AROUND}) AS xw, lead(process_mean) {_AROUND}) AS xp, lead(client_talk_type) {_AROUND}) AS xt FROM turns),
triples AS (SELECT transcript_id, idx AS therapist_idx, behaviour, pp AS before, xp AS after, xp - pp AS lift, xt = 'change' AS next_change FROM nb
  WHERE speaker = 'therapist' AND ps = 'client' AND xs = 'client' AND pw >= 5 AND xw >= 5 AND behaviour IS NOT NULL)"""
_tag_in_family = "CASE " + " ".join(
    f"WHEN behaviour = '{FAMILY_OF[name]}' AND regexp_matches(trim(text), '(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + f"') THEN '{name}'" for name, patterns in INTERVENTIONS
) + " " + " ".join(f"WHEN behaviour = '{f}' THEN '{d}'" for f, d in FAMILY_DEFAULT.items()) + " ELSE 'other' END"


def sql_erf(x: str, terms: int = 60) -> str:
    """The series summed term by term with a fold over the same recurrence."""
    return f"""(CASE WHEN {x} > 4 THEN 1.0::DOUBLE WHEN {x} < -4 THEN -1.0::DOUBLE ELSE 1.1283791670955126::DOUBLE * list_reduce(
  list_transform(range(1, {terms + 1}), lambda k: {{'k': k::DOUBLE, 'term': 0.0::DOUBLE, 'total': 0.0::DOUBLE}}),
  lambda a, b: {{'k': b.k, 'term': a.term * -({x}) * ({x}) / b.k, 'total': a.total + (a.term * -({x}) * ({x}) / b.k) / (2 * b.k + 1)}},
  {{'k': 0.0::DOUBLE, 'term': ({x}), 'total': ({x})}}).total END)"""


_N = "(k + (n - k) + (kk - k) + (nn - kk - n + k))::DOUBLE"
_GAP = f"greatest(0.0::DOUBLE, abs(k::DOUBLE * (nn - kk - n + k) - (n - k)::DOUBLE * (kk - k)) - {_N} / 2.0::DOUBLE)"
_corr = lambda x, y: (
    f"CASE WHEN count({x}) FILTER ({y} IS NOT NULL) >= 3 AND var_pop({x}) * var_pop({y}) > 1e-24 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"
)
SQL = {
    "intervention_tags": f"WITH {CORPUS} SELECT transcript_id, idx, {sql_tag('text')} AS intervention FROM corpus WHERE speaker = 'therapist'",
    "intervention_in_family": f"WITH {CORPUS} SELECT transcript_id, idx, behaviour, {_tag_in_family} AS intervention FROM corpus WHERE speaker = 'therapist' AND behaviour IS NOT NULL",
    "turn_pairs": f"{_PAIRS} SELECT * FROM pairs",
    "impact_by_session": f"{_PAIRS} {_impact('transcript_id')}",
    "impact_overall": f"{_PAIRS} {_impact('')}",
    "impact_pooled": f"{_PAIRS}, s AS ({_impact('transcript_id')}) SELECT intervention, sum(n) AS n, {sql_round('sum(n::DOUBLE * mean_lift) / sum(n::DOUBLE)', 4)} AS mean_lift FROM s GROUP BY intervention",
    "top_moments": f"""{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY lift DESC, therapist_idx) AS hi, row_number() OVER (PARTITION BY transcript_id ORDER BY lift, therapist_idx DESC) AS lo FROM pairs)
SELECT transcript_id, 'opening' AS side, hi AS rank, therapist_idx, intervention, lift FROM r WHERE hi <= 5 UNION ALL SELECT transcript_id, 'closing', lo, therapist_idx, intervention, lift FROM r WHERE lo <= 5""",
    "response_cells": f"{_PROFILE} SELECT * FROM prof",
    "response_dependence": f"""{_PROFILE} SELECT transcript_id, intervention, count(*) AS n_states, {sql_round('max(mean_lift) - min(mean_lift)', 4)} AS spread, max(mean_lift) > 0 AND min(mean_lift) < 0 AS sign_flip,
  max(mean_lift) - min(mean_lift) > 0.02::DOUBLE AS depends FROM prof GROUP BY transcript_id, intervention HAVING count(*) >= 2""",
    "best_move_by_state": f"""{_PROFILE} SELECT transcript_id, state, intervention, n, mean_lift FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, state ORDER BY mean_lift DESC, intervention) AS r FROM prof WHERE mean_lift > 0) WHERE r = 1""",
    "corpus_triples": f"{_TRIPLES} SELECT * FROM triples",
    "conditional_rates": f"""{_TRIPLES}, c AS (SELECT quantile_cont(before, [1/3, 2/3]) AS q FROM triples),
s AS (SELECT behaviour, CASE WHEN before <= q[1] THEN 'stuck' WHEN before >= q[2] THEN 'moving' ELSE 'middling' END AS state, coalesce(next_change, false)::INT AS y FROM triples, c)
SELECT behaviour, state, count(*) AS n, sum(y) AS n_change, CASE WHEN count(*) >= 10 THEN {sql_round('sum(y)::DOUBLE / count(*)', 4)} END AS p_change FROM s GROUP BY behaviour, state""",
    "change_cube": f"""{_TRIPLES}, t AS (SELECT behaviour, mi_quality, coalesce(next_change, false)::INT AS y FROM triples JOIN (SELECT DISTINCT transcript_id, mi_quality FROM corpus) USING (transcript_id))
SELECT behaviour, mi_quality, grouping_id(behaviour, mi_quality)::INT AS level, count(*) AS n, sum(y) AS n_change FROM t GROUP BY CUBE (behaviour, mi_quality)""",
    "change_by_quality": f"""{_TRIPLES}, b AS (SELECT behaviour, count(*) AS n, sum(coalesce(next_change, false)::INT) AS k FROM triples GROUP BY behaviour),
j AS (SELECT b.*, nn, kk FROM b, (SELECT sum(n) AS nn, sum(k) AS kk FROM b)),
st AS (SELECT *, CASE WHEN n * (nn - n) * kk * (nn - kk) = 0 THEN NULL ELSE {_N} * {_GAP} * {_GAP} / (n::DOUBLE * (nn - n)::DOUBLE * kk::DOUBLE * (nn - kk)::DOUBLE) END AS stat FROM j)
SELECT behaviour, n, k AS n_change, {sql_round('stat', 6)} AS chi2, {sql_round('greatest(0.0::DOUBLE, 1.0::DOUBLE - ' + sql_erf('sqrt(stat / 2.0::DOUBLE)') + ')', 6)} AS p FROM st""",
    "lead_lag": f"""WITH {CORPUS}, client AS (SELECT transcript_id, idx, text FROM corpus WHERE speaker = 'client'),{sql_scored('client')},
num AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY idx) AS i, count(*) OVER (PARTITION BY transcript_id) AS c FROM scored),
long AS (UNPIVOT (SELECT transcript_id, i, {', '.join(DIMENSIONS)} FROM num WHERE c >= 6) ON {', '.join(DIMENSIONS)} INTO NAME dim VALUE v),
d AS (SELECT transcript_id, i, dim, v - lag(v) OVER (PARTITION BY transcript_id, dim ORDER BY i) AS delta FROM long),
p AS (SELECT x.transcript_id, x.dim AS a, y.dim AS b, x.delta AS dx, y.delta AS dy FROM d x JOIN d y ON x.transcript_id = y.transcript_id AND y.i = x.i + 1 AND x.dim <> y.dim WHERE x.delta IS NOT NULL AND y.delta IS NOT NULL),
f AS (SELECT transcript_id, a, b, {_corr('dx', 'dy')} AS fwd FROM p GROUP BY ALL)
SELECT x.transcript_id, x.a, x.b, {sql_round('x.fwd', 4)} AS fwd, {sql_round('y.fwd', 4)} AS rev, {sql_round('x.fwd - y.fwd', 4)} AS asymmetry, x.fwd - y.fwd > 0.25::DOUBLE AND x.fwd > 0.2::DOUBLE AS strong
FROM f x JOIN f y ON x.transcript_id = y.transcript_id AND x.a = y.b AND x.b = y.a WHERE x.fwd IS NOT NULL AND y.fwd IS NOT NULL""",
}
