import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnloom.operators.blocks import carried


@pytest.mark.parametrize(("block", "ahead", "inclusive"), [(1, False, False), (7, False, True), (7, True, False), (50, True, True), (10_000, False, False)])
def test_against_one_window(spark, block, ahead, inclusive):
    """The same values as one window over the whole key gives, with gaps in the numbers, nulls, and a key that holds most rows."""
    rng = random.Random(block)
    rows = [(k, n, rng.choice([None, n, n * 10])) for k, most in ((1, 400), (2, 9), (None, 30)) for n in sorted(rng.sample(range(-50, 3 * most), most))]
    df = spark.createDataFrame(rows + [(1, None, 5)], "k int, n int, v int")
    w = Window.partitionBy("k").orderBy(F.desc("n") if ahead else F.asc("n")).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.where("n is not null").withColumn("carried", F.last("v", ignorenulls=True).over(w))
    got = carried(df, F.col("v"), "n", "k", block=block, ahead=ahead, inclusive=inclusive)
    key = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert got.columns == ["k", "n", "v", "carried"] and key(got) == key(want)


def test_no_rows(spark):
    assert carried(spark.createDataFrame([], "k int, n int, v int"), F.col("v"), "n", "k").collect() == []
