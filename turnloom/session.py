"""Session helpers: where lineage is cut, and how work is spread over the cores."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; on a local master without one, a temporary folder will do, elsewhere its absence is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get(CHECKPOINT_CONF)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="turnloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder, so later steps neither recompute it nor depend on one executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, per_core: int = 2) -> DataFrame:
    """Spread the rows of a Python-heavy stage evenly, at least ``per_core`` tasks a core and as many as shuffles have.

    The number is taken from the session, not from the plan: asking a plan for its partitions may run the jobs in front of it.
    """
    spark = df.sparkSession
    want = max(spark.sparkContext.defaultParallelism * per_core, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(want, *keys)


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", parts: int = 64, share: float = 0.002, least: int = 100_000, rows: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row per key, so that a key with a large share of the rows of ``left`` is spread over ``parts`` tasks.

    The hot keys are the 1 / share most frequent ones among those with more than ``least`` rows: a short list whatever the data, and a key left out of it holds less than ``share`` of all rows. Rows of a hot key
    get one of ``parts`` salts by a hash of the whole row, and its one row on the right is repeated for each salt. Counting is a map-side aggregation. ``left`` should be cheap to read twice;
    where its number of ``rows`` is known and not above ``least``, nothing is counted.
    """
    if rows is not None and rows <= least:
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_hot"))
    often = counts.where(F.col("n_hot") > least)
    hot = [r[0] for r in often.select(key, "n_hot").orderBy(F.desc("n_hot")).limit(int(1 / share)).collect()]
    if not hot:
        return left.join(right, key, how)
    held = F.col(key).isin(hot)
    salted = left.withColumn("salt_", F.when(held, F.pmod(F.xxhash64(*left.columns), F.lit(parts))).otherwise(F.lit(0)).cast("int"))
    copies = right.withColumn("salt_", F.explode(F.when(held, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [key, "salt_"], how).drop("salt_")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
