"""Deterministic hash order and exact ranks that never sort one class in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_order(seed, *cols: str | Column) -> Column:
    """Hex digest of ``seed:col:col…``; a reproducible shuffle key in any SQL engine."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [seed_col.cast("string")]
    parts += [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def spread_rank(
    df: DataFrame,
    within: Sequence[str],
    digest: str,
    ties: Sequence[str | Column] = (),
    out: str = "rank",
    prefix_chars: int = 3,
) -> DataFrame:
    """1-based exact row number inside each ``within`` group, ordered by a hex digest column.

    A plain ``row_number`` over three labels would sort a third of the data in one task. The
    digest's leading characters cut every group into ``16 ** prefix_chars`` even slices; slice
    sizes are counted, prefix-summed (a table of at most groups x slices rows) and added to the
    row number inside the slice. Raise ``prefix_chars`` with the data.
    """
    slice_col = f"__{out}_slice"
    offset = f"__{out}_offset"
    sliced = df.withColumn(slice_col, F.substring(F.col(digest), 1, prefix_chars))
    keys = [*within, slice_col]
    before = (
        Window.partitionBy(*(within or [F.lit(0)]))
        .orderBy(slice_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        sliced.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(offset, F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy(*keys).orderBy(F.col(digest), *ties)
    joined = _null_safe_join(sliced, offsets, keys)
    return joined.withColumn(
        out, F.col(offset) + F.row_number().over(inside).cast("bigint")
    ).drop(slice_col, offset)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, "inner").drop(*[f"__r_{k}" for k in keys])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                  out: str = "rank") -> DataFrame:
    """First ``n`` rows per group. ``rank <= n`` lets Spark trim every map task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("bigint")).filter(F.col(out) <= n)


def average_rank(value: Column, within: Sequence[str | Column], descending: bool = True) -> Column:
    """Average rank of ties (1-based) inside ``within``; used on fold x model tables only."""
    w = Window.partitionBy(*within).orderBy(value.desc() if descending else value.asc())
    same = Window.partitionBy(*within, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0)
