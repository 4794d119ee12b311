"""Queries of problem 3: groups of related transcripts and their splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.splits import related_groups, split_records
from turnloom.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_groups(table(spark, sf_dir, "recordings"))


def p3_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_records(table(spark, sf_dir, "annotated_corpus"), table(spark, sf_dir, "recordings"))


QUERIES = {"p3_found": p3_found, "p3_split": p3_split}

SQL = {
    "p3_found": """
WITH RECURSIVE c AS (
  SELECT DISTINCT transcript_id, code FROM (
    SELECT transcript_id, 'c' || regexp_replace(lower(client_code), '[^\\p{L}\\p{N}]', '', 'g') AS code FROM recordings
    UNION ALL
    SELECT transcript_id, 'r' || regexp_replace(lower(recording_code), '[^\\p{L}\\p{N}]', '', 'g') FROM recordings)
  WHERE code IS NOT NULL AND transcript_id IS NOT NULL
    AND substr(code, 2) NOT IN ('', 'na', 'none', 'null', 'nan', 'unknown', 'missing', 'tbd', 'notavailable', 'notapplicable')),
e AS (SELECT DISTINCT x.transcript_id AS a, y.transcript_id AS b FROM c x JOIN c y USING (code) WHERE x.transcript_id <> y.transcript_id),
w AS (
  SELECT a AS node, a AS root FROM e
  UNION
  SELECT e.b, w.root FROM w JOIN e ON w.node = e.a WHERE w.root < e.b)
SELECT node AS transcript_id, min(root) AS group_id FROM w GROUP BY node
""",
}
