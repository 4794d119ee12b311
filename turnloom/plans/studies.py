"""Queries without an SQL twin: simulations and a fitted classifier (rows only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import models as M
from turnloom.operators import simulate as Q
from turnloom.operators.validate import confusion_long
from turnloom.plans.fixtures import CORPUS, corpus_turns, sql_round as R


def programmed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.shapes(spark)


def screen_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.screen_rates(spark)


def ratio_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.reading_widths(spark)


def behaviour_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes for therapist behaviour, each of five grouped folds held against a fit on the other four: the confusion table of all rows."""
    rows = corpus_turns(spark, sf_dir).where("speaker = 'therapist' and behaviour is not null").select("transcript_id", "text", F.col("behaviour").alias("label"))
    return confusion_long(M.out_of_fold(M.group_folds(rows, "transcript_id").cache(), "nb"), "label", "predicted")


def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.group_folds(corpus_turns(spark, sf_dir).select("transcript_id", "idx"), "transcript_id").groupBy("fold").agg(F.count_distinct("transcript_id").alias("n_groups"), F.count(F.lit(1)).alias("n_rows"))


QUERIES = {"programmed_shapes": programmed_shapes, "screen_calibration": screen_calibration, "ratio_widths": ratio_widths, "behaviour_classifier": behaviour_classifier, "grouped_folds": grouped_folds}
SQL = {
    "grouped_folds": f"WITH {CORPUS} SELECT (('0x' || substr(md5(transcript_id::VARCHAR), 1, 8))::BIGINT % 5)::INT AS fold, count(DISTINCT transcript_id) AS n_groups, count(*) AS n_rows FROM corpus GROUP BY 1",
    "programmed_shapes": f"""WITH s AS (SELECT unnest(['improving', 'plateauing', 'relapsing', 'late_breakthrough', 'flat']) AS shape), g AS (SELECT shape, unnest(range(12)) AS i FROM s)
SELECT shape, (i + 1)::INT AS n, {R("""CASE shape WHEN 'improving' THEN 0.25::DOUBLE + 0.55::DOUBLE * (i / 11.0::DOUBLE) WHEN 'plateauing' THEN 0.30::DOUBLE + 0.35::DOUBLE * least(1.0::DOUBLE, i / 3.0::DOUBLE)
  WHEN 'relapsing' THEN CASE WHEN i <= 4 THEN 0.30::DOUBLE + 0.40::DOUBLE * (i / 4.0::DOUBLE) ELSE 0.70::DOUBLE - 0.35::DOUBLE * ((i - 4) / 7.0::DOUBLE) END
  WHEN 'late_breakthrough' THEN CASE WHEN i < 7.2::DOUBLE THEN 0.30::DOUBLE ELSE 0.30::DOUBLE + 0.50::DOUBLE * ((i - 7.2::DOUBLE) / 4.8::DOUBLE) END ELSE 0.5::DOUBLE END""", 6)} AS level FROM g""",
}
