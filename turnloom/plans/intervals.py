"""Queries over timed turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.operators.intervals import merge_intervals
from turnloom.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_intervals(table(spark, sf_dir, "aligned_turns"))


QUERIES = {"p5_found": p5_found}

SQL = {
    "p5_found": """
WITH u AS (
  SELECT DISTINCT session_id, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e
  FROM aligned_turns
  WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s)
    AND start_s >= 0 AND end_s < 9e12 AND round(end_s * 1000) > round(start_s * 1000)),
r AS (
  SELECT *, max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
h AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
    OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM r),
p AS (SELECT session_id, g, min(s) AS a, max(e) AS b FROM h GROUP BY session_id, g),
n AS (SELECT *, lead(a) OVER (PARTITION BY session_id ORDER BY g) AS nxt FROM p)
SELECT session_id, 'period' AS kind, a AS from_ms, b AS to_ms FROM n
UNION ALL
SELECT session_id, 'gap', b, nxt FROM n WHERE nxt IS NOT NULL
""",
}
