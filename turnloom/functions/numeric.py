"""Numeric helpers as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_n(x: Column, n: int) -> Column:
    """Half-even rounding of the product with 10^n. It differs from rounding the exact binary value only where that product itself is rounded onto a tie (2.675 and the like)."""
    k = float(10**n)
    return F.rint(x * F.lit(k)) / F.lit(k)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def erf(x: Column, terms: int = 60) -> Column:
    """Maclaurin series for |x| <= 4 (error below 5e-11), 1 beyond."""
    start = F.struct(x.alias("term"), x.alias("total"))
    step = lambda a, k: F.struct(
        (a["term"] * -x * x / k).alias("term"), (a["total"] + (a["term"] * -x * x / k) / (2 * k + 1)).alias("total")
    )
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda a: a["total"] * F.lit(2 / math.sqrt(math.pi)))
    return F.when(x > 4, F.lit(1.0)).when(x < -4, F.lit(-1.0)).otherwise(series)


def p_from_t(t: Column, df: Column) -> Column:
    """Two-tailed p of |t| by a normal approximation with a small-sample correction; 1 without degrees of freedom."""
    z = t * (1 - F.lit(1.0) / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
    return F.when(df <= 0, F.lit(1.0)).otherwise(2 * (1 - 0.5 * (1 + erf(z / F.lit(math.sqrt(2.0))))))


def safe_corr(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson correlation as an aggregate; null below ``least`` pairs or without variance (ANSI mode would raise)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.var_pop(a) * F.var_pop(b)
    return F.when((F.count(a) >= least) & (spread > 1e-24), F.try_divide(F.covar_pop(a, b), F.sqrt(spread)))


def sd_or_zero(x: Column) -> Column:
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def mean_of_rounded(x: Column, n: int = 4) -> Column:
    """Aggregate mean of values that carry ``n`` decimals, summed as integers, so that it does not depend on the order of rows."""
    k = 10**n
    return F.sum(F.round(x * k).cast("long")).cast("double") / F.count(x) / float(k)
