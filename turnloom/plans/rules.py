"""Queries of the rule operators over the index of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.operators import rules as K
from turnloom.operators import trajectory as T
from turnloom.operators.index import baselines
from turnloom.operators.score import DIMENSIONS
from turnloom.plans.dyads import _profile, _PROFILE
from turnloom.plans.fixtures import corpus_turns, sql_round as R
from turnloom.plans.flagship import MOMENTUM, _BASE, _IDX, _features, _indexed


def goal_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A goal on one dimension for every other session, and one beyond the last."""
    x = _indexed(spark, sf_dir)
    dims = F.array(*[F.lit(d) for d in (*DIMENSIONS, "unknown")])
    goals = x.select("client_id", (F.col("session_number") + F.col("client_id") % 2).cast("int").alias("session_number"), F.element_at(dims, (F.col("session_number") % 6 + 1).cast("int")).alias("dimension"))
    return K.evaluate_goals(goals, x)


def dimension_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    return K.target_dimensions(f, baselines(f))


def early_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _indexed(spark, sf_dir)
    return K.early_warning(x, T.momentum(T.positions(x, "client_id", "session_number", "tpi"), "client_id"))


def next_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = corpus_turns(spark, sf_dir).select("transcript_id").distinct().withColumn("tpi", (40 + F.col("transcript_id") % 21).cast("double"))
    return K.next_moves(latest, _profile(spark, sf_dir), "transcript_id")


def session_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _indexed(spark, sf_dir)
    return x.select("client_id", "session_number", K.session_note(x).alias("note"))


QUERIES = {"goal_evaluation": goal_evaluation, "dimension_targets": dimension_targets, "early_warnings": early_warnings, "next_moves": next_moves, "session_notes": session_notes}

_z = lambda p: "{" + ", ".join(f"'{d}': {p}z_{d}" for d in DIMENSIONS) + "}"
_pick = lambda d, p: "CASE " + " ".join(f"WHEN {d} = '{x}' THEN {p}z_{x}" for x in DIMENSIONS) + " END"
_M4 = lambda c: f"sum(round(x * 10000)::BIGINT) FILTER ({c})::DOUBLE / count(*) FILTER ({c}) / 10000.0::DOUBLE"
SQL = {
    "goal_evaluation": f"""WITH {_IDX}, g AS (SELECT client_id, (session_number + client_id % 2)::INT AS session_number, ['self_agency', 'future_orientation', 'emotional_granularity', 'problem_ownership', 'reflection_depth', 'unknown'][session_number % 6 + 1] AS dimension FROM idx),
s AS (SELECT *, lag(session_number) OVER w AS before, {', '.join(f'lag(z_{d}) OVER w AS bz_{d}' for d in DIMENSIONS)} FROM idx WINDOW w AS (PARTITION BY client_id ORDER BY session_number)),
j AS (SELECT g.*, s.before, s.tpi, {_pick('dimension', 's.')} - {_pick('dimension', 's.b')} AS dl FROM g LEFT JOIN s USING (client_id, session_number))
SELECT client_id, session_number, dimension, CASE WHEN dimension = 'unknown' THEN 'invalid' WHEN tpi IS NULL THEN 'pending' WHEN before IS NULL THEN 'no_comparison' WHEN dl >= 0.3::DOUBLE THEN 'moved_toward' WHEN dl <= -0.3::DOUBLE THEN 'moved_away' ELSE 'held' END AS status,
  {R('dl', 3)} AS delta_sd, before AS compared_with FROM j""",
    "dimension_targets": f"""WITH {_BASE}, n AS (SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY session_number) AS i, count(*) OVER (PARTITION BY client_id) AS c, {', '.join(DIMENSIONS)} FROM feat),
l AS (UNPIVOT (SELECT * FROM n WHERE c >= 3) ON {', '.join(DIMENSIONS)} INTO NAME dimension VALUE x),
b AS ({' UNION ALL '.join(f"SELECT client_id, '{d}' AS dimension, mu_{d} AS m, sd_{d} AS s, {i} AS o FROM base" for i, d in enumerate(DIMENSIONS))}),
a AS (SELECT client_id, dimension, max(c) AS n_sessions, {_M4('i > c - 3')} AS r, {_M4('i <= greatest(2, c // 3)')} AS e, sum((x < m)::INT) AS sessions_below, any_value(m) AS m, any_value(s) AS s, any_value(o) AS o FROM l JOIN b USING (client_id, dimension) GROUP BY client_id, dimension)
SELECT client_id, dimension, n_sessions, {R('(r - m) / s', 3)} AS recent_z, {R('r - e', 4)} AS drift, sessions_below, row_number() OVER (PARTITION BY client_id ORDER BY {R('(r - m) / s', 3)}, o) AS rank FROM a""",
    "early_warnings": f"""WITH {_IDX}, {MOMENTUM}, n AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY session_number DESC) AS back, count(*) OVER (PARTITION BY client_id) AS c FROM idx),
s AS (SELECT client_id, max(c) AS n, max(tpi) FILTER (back = 1) AS y1, max(tpi) FILTER (back = 3) AS y3, max(tpi) FILTER (back <= 4) - min(tpi) FILTER (back <= 4) AS spread, max(hopelessness) FILTER (back = 1) AS hope, max(rumination) FILTER (back = 1) AS rum,
  max(n_client_words) FILTER (back = 1) AS words, avg(n_client_words) FILTER (back > 1) AS prior FROM n WHERE c >= 4 GROUP BY client_id),
w AS (SELECT s.client_id, s.n, [{{'c': (y1 - y3) / 2 < -2.0, 'k': 'falling', 'v': 0.35::DOUBLE}}, {{'c': (y1 - y3) / 2 < -0.8::DOUBLE AND (y1 - y3) / 2 >= -2.0, 'k': 'drifting_down', 'v': 0.18::DOUBLE}}, {{'c': y1 < 44, 'k': 'below_baseline', 'v': 0.2::DOUBLE}},
  {{'c': s.n >= 5 AND s.spread > 18, 'k': 'wide_spread', 'v': 0.15::DOUBLE}}, {{'c': hope > 0.3::DOUBLE, 'k': 'hopelessness', 'v': 0.25::DOUBLE}}, {{'c': rum > 0.3::DOUBLE, 'k': 'rumination', 'v': 0.12::DOUBLE}},
  {{'c': prior > 0 AND words < 0.6::DOUBLE * prior, 'k': 'fewer_words', 'v': 0.2::DOUBLE}}, {{'c': s.n >= 6 AND m.state = 'plateauing', 'k': 'plateau', 'v': 0.1::DOUBLE}}] AS hits FROM s LEFT JOIN mom m USING (client_id)),
r AS (SELECT client_id, n, {R('least(1.0::DOUBLE, list_reduce(list_transform(hits, lambda h: CASE WHEN h.c THEN h.v ELSE 0.0::DOUBLE END), lambda a, b: a + b))', 3)} AS score, array_to_string(list_transform(list_filter(hits, lambda h: h.c), lambda h: h.k), ';') AS reasons FROM w)
SELECT *, CASE WHEN score >= 0.55::DOUBLE THEN 'elevated' WHEN score >= 0.3::DOUBLE THEN 'watch' ELSE 'none' END AS level FROM r""",
    "next_moves": f"""{_PROFILE}, now AS (SELECT DISTINCT transcript_id, CASE WHEN 40 + transcript_id % 21 <= 45 THEN 'stuck' WHEN 40 + transcript_id % 21 >= 56 THEN 'moving' ELSE 'middling' END AS state FROM corpus),
o1 AS (SELECT now.transcript_id, now.state, intervention AS move, mean_lift AS score, n FROM now JOIN prof USING (transcript_id, state) WHERE n >= 4),
o2 AS (SELECT *, 'own' AS source FROM o1 QUALIFY count(*) OVER (PARTITION BY transcript_id) >= 2 AND max(score) OVER (PARTITION BY transcript_id) > 0.01::DOUBLE),
pr AS (SELECT * FROM (VALUES {', '.join(f"('{s}', '{f}', {p}::DOUBLE)" for s, f, p in K.CORPUS_PRIOR)}) v(state, move, score)),
al AS (SELECT transcript_id, state, move, score, n, source FROM o2 UNION ALL SELECT transcript_id, now.state, move, score, 0, 'corpus' FROM now JOIN pr USING (state) WHERE transcript_id NOT IN (SELECT transcript_id FROM o2))
SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY score DESC, move) AS rank FROM al""",
    "session_notes": f"""WITH {_IDX}, b AS (SELECT *, greatest({', '.join(f'contribution_{d}' for d in DIMENSIONS)}) AS top FROM idx)
SELECT client_id, session_number, concat_ws(' ', CASE WHEN tpi >= 58 THEN 'The index lies above the client''s own baseline.' WHEN tpi <= 42 THEN 'The index lies below the client''s own baseline.' ELSE 'The index lies near the client''s own baseline.' END,
  CASE WHEN top >= 0.6::DOUBLE THEN 'Most of it comes from ' || CASE {' '.join(f"WHEN contribution_{d} = top THEN '{d.replace('_', ' ')}'" for d in DIMENSIONS)} END || '.' END, CASE WHEN confidence < 0.6::DOUBLE THEN 'The session is short, so read it with care.' END,
  CASE WHEN hopelessness > 0.25::DOUBLE THEN 'Words of hopelessness are frequent.' END, CASE WHEN rumination > 0.25::DOUBLE THEN 'Backward-looking words are frequent.' END, CASE WHEN n_client_words = 0 THEN 'The client is not heard.' END) AS note FROM b""",
}
