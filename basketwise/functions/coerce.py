"""Lenient casts: a value that does not parse becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(c: Column, digits: int | None = None) -> Column:
    """Finite double or NULL, optionally rounded."""
    v = finite(c.try_cast("double"))
    return F.round(v, digits) if digits is not None else v


def as_long(c: Column) -> Column:
    """Whole number or NULL: ``"3"`` and ``3.0`` pass, ``"3.5"`` and ``"x"`` do not."""
    v = finite(c.try_cast("double"))
    return F.when(v == F.floor(v), v.try_cast("bigint"))


def finite(c: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(
        ~F.isnan(c) & (c != F.lit(float("inf"))) & (c != F.lit(float("-inf"))), c
    )


def as_timestamp(c: Column) -> Column:
    """ISO-8601 text, ``Z`` accepted, anything else NULL."""
    return c.try_cast("timestamp")


def weighted_mean(sum_qx: Column, sum_q: Column) -> Column:
    return F.when(sum_q > 0, sum_qx / sum_q)


def weighted_pop_std(sum_q: Column, sum_qx: Column, sum_qxx: Column) -> Column:
    """Population deviation from weighted power sums; rounding noise around zero reads as zero."""
    mean_sq = sum_qxx / sum_q
    var = mean_sq - (sum_qx / sum_q) * (sum_qx / sum_q)
    return F.when(sum_q > 0, F.when(var <= mean_sq * 4e-15, F.lit(0.0)).otherwise(F.sqrt(var)))
