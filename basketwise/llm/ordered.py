"""Total order of a table in slices of bounded size, for running sums and next-row lookups."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_SLICES = 100_000


def add_slices(df: DataFrame, key: str, rows_per_slice: int, out: str) -> DataFrame:
    """Add ``out`` (int): slices in the order of ``key`` with about ``rows_per_slice`` rows each.

    Bounds come from a quantile sketch of the whole column; there are at most ``MAX_SLICES`` of them, which is
    what the driver holds. Equal keys share a slice, so callers put a tie-break into the key. Null
    keys get slice -1.
    """
    rows = df.count()
    n = max(1, min(MAX_SLICES, -(-rows // rows_per_slice)))
    cuts: list[float] = []
    if n > 1:
        at = [i / n for i in range(1, n)]
        found = df.agg(F.percentile_approx(key, at, max(10_000, 10 * n))).first()[0]
        cuts = sorted({float(c) for c in found or []})
    wide = f"__{out}"
    cut = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol=wide, outputCol=out, handleInvalid="keep")
    held = df.withColumn(wide, F.col(key).cast("double"))
    known = cut.transform(held) if cuts else held.withColumn(out, F.lit(0.0))
    return known.withColumn(out, F.when(F.col(key).isNull(), -1).otherwise(F.col(out)).cast("int")).drop(wide)


def running_start(df: DataFrame, slice_col: str, order: list[str], size: str, out: str) -> DataFrame:
    """Add ``out``: sum of ``size`` over all rows before this one in the order (slice, *order)."""
    sums = df.groupBy(slice_col).agg(F.sum(size).alias("__sum"))
    # one row per slice (at most MAX_SLICES), so a single window and a broadcast are bounded
    base = sums.select(slice_col, (F.sum("__sum").over(
        Window.orderBy(slice_col).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")).alias("__base"))
    inside = F.sum(size).over(
        Window.partitionBy(slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return (df.withColumn("__upto", inside).join(F.broadcast(base), slice_col)
            .withColumn(out, F.col("__base") + F.col("__upto") - F.col(size)).drop("__base", "__upto"))
