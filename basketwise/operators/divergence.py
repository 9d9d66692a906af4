"""How, where and in which direction two ordinal labels differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketwise.functions.quantiles import exact_quantiles
from basketwise.operators.profile import means, top_groups


def with_delta(df: DataFrame, y1: str = "y1", y2: str = "y2") -> DataFrame:
    return df.withColumns({"delta": F.col(y2) - F.col(y1), "abs_delta": F.abs(F.col(y2) - F.col(y1))})


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.lit(100.0) * part / whole)


def agreement(df: DataFrame, y1: str = "y1", y2: str = "y2", by: Sequence[str] = ()) -> DataFrame:
    """Exact, within one, within two; mean and median absolute difference. A label difference has a
    handful of values, so the exact median's state is tiny."""
    d = F.abs(F.col(y2) - F.col(y1))
    n = F.count(F.lit(1))
    aggs = [
        n.alias("n"),
        *[F.count_if(d <= k).alias(name) for k, name in enumerate(("n_exact", "n_within_1", "n_within_2"))],
        *[_pct(F.count_if(d <= k), n).alias(name) for k, name in enumerate(("pct_exact", "pct_within_1", "pct_within_2"))],
        F.avg(d).alias("mean_abs_delta"), F.percentile(d, F.lit(0.5)).alias("median_abs_delta"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def crosstab(df: DataFrame, y1: str, y2: str, labels: Sequence[int], columns: Sequence[int] | None = None) -> DataFrame:
    """One row per ``y1``, ``n_<label>`` and ``pct_<label>`` per ``y2`` value, zeros filled in.

    Counts come from one grouped aggregate; labels without rows are added from the label list.
    """
    columns = list(columns or labels)
    counted = df.groupBy(F.col(y1).cast("bigint").alias("y1")).agg(
        *[F.count_if(F.col(y2) == c).alias(f"n_{c}") for c in columns])
    spine = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x).cast("bigint") for x in labels])).alias("y1"))
    filled = spine.join(counted, "y1", "left").select(
        "y1", *[F.coalesce(f"n_{c}", F.lit(0).cast("bigint")).alias(f"n_{c}") for c in columns])
    total = sum((F.col(f"n_{c}") for c in columns), F.lit(0))
    return filled.select("*", *[F.coalesce(_pct(F.col(f"n_{c}"), total), F.lit(0.0)).alias(f"pct_{c}") for c in columns])


def distribution(df: DataFrame, column: str) -> DataFrame:
    counted = df.groupBy(F.col(column).cast("bigint").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", _pct(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))))


def direction(df: DataFrame, delta: str = "delta") -> DataFrame:
    """Rows above, equal and below, and the net tendency."""
    d, n = F.col(delta), F.count(F.lit(1))
    above, below = F.count_if(d > 0), F.count_if(d < 0)
    return df.agg(
        n.alias("n"), above.alias("n_above"), F.count_if(d == 0).alias("n_equal"), below.alias("n_below"),
        F.avg(d).alias("mean_delta"),
        F.when(above > below, "reference_above").when(above < below, "reference_below").otherwise("balanced").alias("tendency"),
    )


def by_value(df: DataFrame, group: Column, delta: str = "delta") -> DataFrame:
    """Divergence per value of a discrete expression: n, share without difference, mean, median."""
    d = F.col(delta)
    n = F.count(F.lit(1))
    return df.groupBy(group.alias("bucket")).agg(
        n.alias("n"), _pct(F.count_if(d == 0), n).alias("pct_zero"), F.avg(d).alias("mean_delta"),
        F.avg(F.abs(d)).alias("mean_abs_delta"), F.percentile(F.abs(d), F.lit(0.5)).alias("median_abs_delta"),
    )


def quantile_edges(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """One row with the sorted distinct quantile edges (at most ``bins + 1`` numbers)."""
    probs = [i / bins for i in range(bins + 1)]
    return exact_quantiles(df, [], column, probs).agg(
        F.array_sort(F.collect_set("quantile")).alias("edges"))


def by_quantile(df: DataFrame, column: str, bins: int = 5, delta: str = "delta") -> DataFrame:
    """Divergence per quantile bin; bins are right-closed, the lowest value belongs to the first,
    repeated edges collapse. NULL values are left out."""
    edges = F.broadcast(quantile_edges(df, column, bins))  # one row
    below = F.size(F.filter("edges", lambda e: e < F.col(column)))
    binned = df.filter(F.col(column).isNotNull()).join(edges).withColumn(
        "__bin", F.greatest(below, F.lit(1)).cast("bigint"))
    named = binned.withColumn("__lo", F.element_at("edges", F.col("__bin").cast("int"))) \
        .withColumn("__hi", F.try_element_at("edges", (F.col("__bin") + 1).cast("int")))
    out = by_value(named, F.struct("__bin", "__lo", "__hi"), delta)
    return out.select(
        F.col("bucket.__bin").alias("bin"), F.col("bucket.__lo").alias("low"), F.col("bucket.__hi").alias("high"),
        *[c for c in out.columns if c != "bucket"])


def count_bucket(column: Column, top: int = 4) -> Column:
    """``0``, ``1``, … ``top+``."""
    return F.when(column >= top, F.lit(f"{top}+")).otherwise(column.cast("bigint").cast("string"))


def sign_of(delta: Column) -> Column:
    return F.when(delta > 0, "above").when(delta < 0, "below").otherwise("equal")


def means_by_sign(df: DataFrame, columns: Sequence[str], delta: str = "delta") -> DataFrame:
    return means(df.withColumn("sign", sign_of(F.col(delta))), columns, ["sign"])


def extremes(df: DataFrame, base: DataFrame, y2: str, values: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """Column means of rows whose reference label lies outside the modelling range, next to the base."""
    outside = means(df.filter(F.col(y2).isin(*values)), columns, [y2]).withColumnRenamed("mean", "mean_outside")
    inside = means(base, columns).withColumnRenamed("mean", "mean_base")
    return outside.join(inside, "column").withColumn("difference", F.col("mean_outside") - F.col("mean_base"))


def extreme_groups(df: DataFrame, y2: str, values: Sequence[int], group: str, n: int = 10) -> DataFrame:
    return top_groups(df.filter(F.col(y2).isin(*values)), group, n, by=y2)
