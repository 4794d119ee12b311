"""Values carried along ordered rows of a key without sorting the whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, value: Column, order: str, *keys: str, out: str = "carried", block: int = 4096, ahead: bool = False, inclusive: bool = False) -> DataFrame:
    """``df`` with ``out``: the nearest non-null ``value`` before each row of a key (``ahead``: behind it; ``inclusive``: or at it), by a whole-number ``order``.

    The window runs within blocks of ``block`` numbers; one summary row per block carries the value on, so that a key that holds a large share of all rows is spread over
    its blocks. Null without such a row. Rows with a null ``order`` are left out.
    """
    own = df.where(F.col(order).isNotNull()).withColumns({"blk_": F.floor(F.col(order) / block), "val_": value})
    along = F.desc(order) if ahead else F.asc(order)
    inside = Window.partitionBy(*keys, "blk_").orderBy(along).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    pick = F.min_by if ahead else F.max_by
    ends = own.groupBy(*keys, "blk_").agg(pick("val_", F.when(F.col("val_").isNotNull(), F.col(order))).alias("end_"))
    over = Window.partitionBy(*keys).orderBy(F.desc("blk_") if ahead else F.asc("blk_")).rowsBetween(Window.unboundedPreceding, -1)
    far = ends.select(*[F.col(k).alias(f"far_{k}") for k in keys], F.col("blk_").alias("far_blk_"), F.last("end_", ignorenulls=True).over(over).alias("far_")).where("far_ is not null")
    near = own.withColumn("near_", F.last("val_", ignorenulls=True).over(inside))
    same = F.col("blk_") == F.col("far_blk_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"far_{k}"))
    return near.join(far, same, "left").withColumn(out, F.coalesce("near_", "far_")).select(*df.columns, out)
