"""Distinct counts that can be merged: one sketch of bounded size per batch or group, unions without the rows.

A sketch of ``2**log_k`` registers holds at most that many bytes whatever it has seen. Its standard error is about
``1.04 / sqrt(2**log_k)`` (0.8 % for the default), the same for merged sketches. NULL is no value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_K = 14


def standard_error(log_k: int = LOG_K) -> float:
    return 1.04 / 2 ** (log_k / 2)


def sketch(value: str | Column, log_k: int = LOG_K) -> Column:
    """Aggregate: the sketch of a column of whole numbers, text or bytes."""
    return F.hll_sketch_agg(value, log_k)


def sketches(df: DataFrame, by: Sequence[str], columns: Sequence[str], log_k: int = LOG_K) -> DataFrame:
    """``by`` and one ``<column>_sketch`` each, ready to be appended to a table of sketches."""
    return df.groupBy(*by).agg(*[sketch(c, log_k).alias(f"{c}_sketch") for c in columns])


def merged(stored: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``by`` and one ``n_<column>`` each: distinct values over all stored sketches of the group, copies counted once."""
    estimates = [F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(f"n_{c}") for c in columns]
    return stored.groupBy(*by).agg(*estimates)
