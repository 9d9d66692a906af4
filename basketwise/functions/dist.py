"""Tail probabilities as column expressions (no scipy, no UDF)."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-tailed Nemenyi quantiles at alpha 0.05 for k = 2..15 models.
NEMENYI_Q_05 = {
    2: 1.960, 3: 2.344, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102,
    10: 3.164, 11: 3.219, 12: 3.268, 13: 3.313, 14: 3.354, 15: 3.391,
}


def normal_sf(x: Column) -> Column:
    """P(Z > x): power series near zero, continued fraction for the tail."""
    a = F.abs(x)
    density = F.exp(-a * a / 2) / F.lit(math.sqrt(2 * math.pi))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(a.alias("term"), a.alias("total")),
        lambda s, k: F.struct(
            (s["term"] * a * a / (2 * k + 1)).alias("term"),
            (s["total"] + s["term"] * a * a / (2 * k + 1)).alias("total"),
        ),
        lambda s: s["total"],
    )
    fraction = F.aggregate(
        F.sequence(F.lit(200), F.lit(1), F.lit(-1)), a, lambda acc, k: a + k / acc
    )
    upper = F.when(a < 3.0, F.lit(0.5) - density * series).otherwise(density / fraction)
    return F.when(x >= 0, upper).otherwise(1 - upper)


def chi2_sf(x: Column, df: Column | int) -> Column:
    """P(chi-squared with integer ``df`` > x) in closed form: a finite sum of ``df / 2`` terms."""
    df = F.lit(df) if isinstance(df, int) else df
    root, half = F.sqrt(x), x / 2

    def terms(count: Column, first: Column, factor) -> Column:
        start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))
        return F.when(count >= 1, F.aggregate(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))), start,
            lambda s, i: F.struct((s["term"] * factor(i)).alias("term"), (s["total"] + s["term"]).alias("total")),
            lambda s: s["total"])).otherwise(F.lit(0.0))

    even = F.exp(-half) * terms(F.floor(df / 2).cast("int"), F.lit(1.0), lambda i: half / i)
    density = F.exp(-half) / F.lit(math.sqrt(2 * math.pi))
    odd = 2 * normal_sf(root) + 2 * density * terms(F.floor((df - 1) / 2).cast("int"), root, lambda i: x / (2 * i + 1))
    return F.when(df % 2 == 0, even).otherwise(odd)


def studentized_range_q(k: int, alpha: float = 0.05) -> float:
    """Quantile of the range of ``k`` standard normals, over the square root of 2: bisection on the integral."""
    z = np.linspace(-8.0, 8.0, 4001)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    below = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2 * (z[1] - z[0]))])
    low, high = 0.5, 12.0
    while high - low > 1e-9:
        q = (low + high) / 2
        inside = below - np.interp(z - q, z, below, left=0.0)
        share = float(np.trapezoid(k * density * inside ** (k - 1), z))
        low, high = (q, high) if share < 1 - alpha else (low, q)
    return (low + high) / 2 / math.sqrt(2)


@functools.cache
def _nemenyi_table(largest: int = 200) -> tuple[float, ...]:
    return tuple(NEMENYI_Q_05.get(k) or studentized_range_q(k) for k in range(2, largest + 1))


def nemenyi_q(k: Column) -> Column:
    """Two-tailed Nemenyi quantile at 0.05 for 2 to 200 models; NULL outside."""
    return F.when(k >= 2, F.get(F.lit(list(_nemenyi_table())), (k - 2).cast("int")))
