"""Agreement of scores with outcomes and labels: correlations, contrasts, rank statistics and metrics, all as aggregations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.numeric import erf, round_n, safe_corr
from turnloom.session import cut


def average_rank(df: DataFrame, value: str, out: str, *keys: str) -> DataFrame:
    """``df`` with the rank of ``value`` within keys, ties sharing their mean rank.

    Ranks come from counts per distinct value, so one common value is counted map-side rather than sorted row by row.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c_"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per.select(*keys, value, (F.coalesce(F.sum("c_").over(w), F.lit(0)) + (F.col("c_") + 1) / 2.0).alias(out))
    return df.join(ranks, [*keys, value])


def correlate(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """n, Pearson and Spearman per key (null under three pairs or without variance)."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, x, "rx_", *keys), y, "ry_", *keys)
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), round_n(safe_corr(F.col(x), F.col(y)), 4).alias("pearson"), round_n(safe_corr(F.col("rx_"), F.col("ry_")), 4).alias("spearman")
    )


def lead_lag_validity(df: DataFrame, x: str, y: str, key: str, order: str) -> DataFrame:
    """Correlation of this step's change in x with the next step's change in y, and the other way, for keys with five or more shared sessions."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.withColumns({"n_": F.count(F.lit(1)).over(Window.partitionBy(key)), "dx": F.col(x) - F.lag(x).over(w), "dy": F.col(y) - F.lag(y).over(w)}).where("n_ >= 5")
    d = d.withColumns({"dx_next": F.lead("dx").over(w), "dy_next": F.lead("dy").over(w)})
    return d.groupBy(key).agg(round_n(safe_corr(F.col("dx"), F.col("dy_next")), 4).alias("x_leads"), round_n(safe_corr(F.col("dy"), F.col("dx_next")), 4).alias("y_leads"))


def cohens_d(df: DataFrame, value: str, group: Column, *keys: str) -> DataFrame:
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    s = df.groupBy(*keys).agg(F.count(a).alias("n1"), F.count(b).alias("n0"), F.avg(a).alias("m1"), F.avg(b).alias("m0"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return s.select(*keys, "n1", "n0", round_n(F.col("m1"), 6).alias("mean1"), round_n(F.col("m0"), 6).alias("mean0"), round_n(F.try_divide(F.col("m1") - F.col("m0"), pooled), 6).alias("d"))


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of the rows where ``group`` is 1, its two-sided p by the tie-corrected normal approximation, and the area under the ROC curve U / (n1 n0)."""
    per = df.groupBy(value).agg(F.sum(group).alias("p_"), F.count(F.lit(1)).alias("c_"))
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)  # one row per distinct value, not per row
    ranked = per.withColumn("rank_", F.coalesce(F.sum("c_").over(w), F.lit(0)) + (F.col("c_") + 1) / 2.0)
    s = ranked.agg(F.sum("p_").cast("double").alias("n1"), F.sum("c_").cast("double").alias("n"), F.sum(F.col("rank_") * F.col("p_")).alias("r1"), F.sum(F.col("c_").cast("double") * F.col("c_") * F.col("c_") - F.col("c_")).alias("ties"))
    n0 = F.col("n") - F.col("n1")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * n0 / 12 * ((F.col("n") + 1) - F.try_divide(F.col("ties"), F.col("n") * (F.col("n") - 1)))
    z = F.try_divide(F.greatest(F.lit(0.0), F.abs(u - F.col("n1") * n0 / 2) - 0.5), F.sqrt(var))
    return s.select(F.col("n1").cast("long").alias("n1"), n0.cast("long").alias("n0"), u.alias("u"), round_n(1 - erf(z / math.sqrt(2.0)), 6).alias("p"), round_n(F.try_divide(u, F.col("n1") * n0), 6).alias("auc"))


def cross_products(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, n, corr)`` for every pair of columns, each with itself included: all that a linear regression needs, from one aggregation."""
    rows = cut(df.select(*[F.col(c).cast("double") for c in columns])).dropna()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    got = rows.agg(F.count(F.lit(1)).alias("n"), *[safe_corr(F.col(a), F.col(b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), round_n(F.col(f"c{k}"), 6).alias("corr")) for k, (a, b) in enumerate(pairs)])
    return got.select("n", F.explode(cells).alias("x")).select("x.a", "x.b", "n", "x.corr")


def refit_weights(df: DataFrame, features: tuple[str, ...], target: str, least: int = 7, ridge: float = 1e-3) -> dict[str, float] | None:
    """Non-negative weights that sum to 1 from a ridge regression of the negated target on standardised features.

    One aggregation yields the means, variances and cross products; only that small matrix reaches the driver.
    """
    rows = cut(df.select(*[F.col(c).cast("double") for c in (*features, target)])).dropna()  # cut first: the scoring expressions would otherwise be repeated in the filter and in every product
    cols = [*features, target]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.covar_samp(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    r = rows.agg(*aggs).first()
    if r["n"] < least:
        return None
    k = len(features)
    cov = np.array([[r[f"c_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)])
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-18))
    corr = cov / np.outer(sd, sd)
    scale = r["n"] - 1
    w = np.linalg.solve(scale * corr[:k, :k] + ridge * np.eye(k), -scale * corr[:k, k])
    w = np.maximum(w, 0.0)
    total = w.sum()
    return {f: round(float(x / total), 4) if total > 0 else round(1 / k, 4) for f, x in zip(features, w)}


def confusion_long(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n, row_share) over the full grid of classes seen in either column."""
    cells = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    classes = cells.select(F.col("actual").alias("c")).union(cells.select("predicted")).distinct()
    grid = classes.select(F.col("c").alias("actual")).join(F.broadcast(classes.select(F.col("c").alias("predicted"))), how="cross")  # class names only
    full = grid.join(cells, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
    rows = F.sum("n").over(Window.partitionBy("actual"))
    return full.select("actual", "predicted", "n", round_n(F.coalesce(F.try_divide(F.col("n"), rows), F.lit(0.0)), 4).alias("row_share"))


def class_metrics(confusion: DataFrame) -> DataFrame:
    """Per class: support, precision, recall, F1 (0 where undefined)."""
    per = confusion.groupBy("actual").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    got = confusion.groupBy(F.col("predicted").alias("actual")).agg(F.sum("n").alias("called"))
    j = per.join(got, "actual")
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("called")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return j.select(F.col("actual").alias("label"), "support", round_n(p, 6).alias("precision"), round_n(r, 6).alias("recall"), round_n(f1, 6).alias("f1"))


def overall_metrics(confusion: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1, macro precision and recall."""
    m = class_metrics(confusion)
    acc = confusion.agg(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("ok"), F.sum("n").alias("n"))
    s = m.agg(F.avg("f1").alias("f"), F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.sum(F.col("f1") * F.col("support")).alias("wf"), F.sum("support").alias("s"))
    return s.join(F.broadcast(acc)).select(  # one row each
        F.col("n"), round_n(F.try_divide(F.col("ok"), F.col("n")), 6).alias("accuracy"), round_n(F.col("f"), 6).alias("macro_f1"), round_n(F.col("p"), 6).alias("macro_precision"),
        round_n(F.col("r"), 6).alias("macro_recall"), round_n(F.try_divide(F.col("wf"), F.col("s")), 6).alias("weighted_f1"),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight of each class: n / (k * n_class)."""
    per = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))  # one row per class
    return per.select("label", "n", round_n(F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")), 6).alias("weight"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """Paired t over folds: n, mean difference, its standard deviation and t."""
    d = F.col(a) - F.col(b)
    s = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return s.select("n", round_n(F.col("m"), 6).alias("mean_diff"), round_n(F.coalesce("s", F.lit(0.0)), 6).alias("sd"), round_n(F.try_divide(F.col("m"), F.col("s") / F.sqrt(F.col("n").cast("double"))), 4).alias("t"))
