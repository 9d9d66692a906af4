"""Exploratory profiles of the feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketwise.functions.quantiles import column_quantiles, exact_quantiles, long_columns, pivot_quantiles
from basketwise.functions.ranking import top_per_group


def value_counts(df: DataFrame, column: str, missing: str = "missing", by: Sequence[str] = ()) -> DataFrame:
    """Counts and percentages per value; NULL is its own ``missing`` row. The window runs over the
    counted table, which has one row per distinct value."""
    counted = df.groupBy(*by, F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))
    return counted.withColumn("pct", F.lit(100.0) * F.col("n") / total)


def presence(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """How many rows have each flag, as rows ``(flag, n, pct)``; one pass."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(f).cast("boolean")).alias(f) for f in flags])
    pairs = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("n")) for f in flags])
    return row.select("__n", F.inline(pairs)).select(
        "flag", "n", (F.lit(100.0) * F.col("n") / F.col("__n")).alias("pct"))


def _wide_to_rows(row: DataFrame, columns: Sequence[str], parts: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{p}").alias(p) for p in parts]) for c in columns
    ])
    return row.select(*by, F.inline(pairs))


def column_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(column, n, n_null, mean, std, median)`` with sample deviation and exact median."""
    parts = ("n", "n_null", "mean", "std")
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"{c}__n"), F.count_if(v.isNull()).alias(f"{c}__n_null"),
                 F.avg(v).alias(f"{c}__mean"), F.stddev_samp(v).alias(f"{c}__std")]
    moments = _wide_to_rows(df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs), columns, parts, by)
    medians = column_quantiles(df, columns, [0.5], by).select(*by, "column", F.col("quantile").alias("median"))
    return moments.join(medians, [*by, "column"], "left")


def means(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, column, mean)`` of columns, overall or per label."""
    aggs = [F.avg(F.col(c).cast("double")).alias(f"{c}__mean") for c in columns]
    return _wide_to_rows(df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs), columns, ("mean",), by)


def flag_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, mean, median, pct_any)``: share of rows with at least one."""
    parts = ("mean", "pct_any")
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mean"),
                 (F.lit(100.0) * F.count_if(F.col(c) >= 1) / F.count(F.lit(1))).alias(f"{c}__pct_any")]
    rows = _wide_to_rows(df.agg(*aggs), columns, parts)
    medians = column_quantiles(df, columns, [0.5]).select("column", F.col("quantile").alias("median"))
    return rows.join(medians, "column", "left")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that have NULLs, most first, with percentages; one pass for all columns."""
    columns = list(columns or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns])
    return (
        row.select("__n", F.inline(pairs)).filter(F.col("n_null") > 0)
        .select("column", "n_null", (F.lit(100.0) * F.col("n_null") / F.col("__n")).alias("pct"))
        .orderBy(F.col("n_null").desc(), "column")
    )


def top_values(df: DataFrame, columns: Sequence[str], id_col: str, n: int = 3) -> DataFrame:
    """Largest ``n`` values per column with their row ids."""
    long = long_columns(df, columns, [id_col]).filter(F.col("value").isNotNull())
    return top_per_group(long, ["column"], [F.col("value").desc(), F.col(id_col)], n)


def boxplot(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Quartiles and whiskers per (label, column): extremes within 1.5 interquartile ranges."""
    q = pivot_quantiles(column_quantiles(df, columns, [0.25, 0.5, 0.75], [by]), [by, "column"],
                        {0.25: "q1", 0.5: "median", 0.75: "q3"})
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("value") >= F.col("q1") - 1.5 * iqr) & (F.col("value") <= F.col("q3") + 1.5 * iqr)
    # labels x columns rows: a class list times a column list
    return (
        long_columns(df, columns, [by]).join(F.broadcast(q), [by, "column"])
        .groupBy(by, "column", "q1", "median", "q3")
        .agg(F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
             F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
             F.count("value").alias("n"))
    )


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def group_summary(df: DataFrame, group: str) -> DataFrame:
    """Number of groups, median entities per group, groups with several members."""
    sizes = group_sizes(df, group)
    counts = sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_multi"))
    median = exact_quantiles(sizes, [], "n", [0.5]).select(F.col("quantile").alias("median_size"))
    return counts.join(median)  # two one-row tables


def top_groups(df: DataFrame, group: str, n: int = 15, by: str | None = None) -> DataFrame:
    """Most frequent groups, overall or per value of ``by``; ties by group key."""
    if by is None:
        return group_sizes(df, group).orderBy(F.col("n").desc(), group).limit(n)
    sizes = df.groupBy(by, group).agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(sizes, [by], [F.col("n").desc(), F.col(group)], n)


def widest_columns(df: DataFrame, columns: Sequence[str], top: int) -> list[str]:
    """Names of the ``top`` columns by sample variance (one aggregate row, as wide as the schema)."""
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns]).first()
    spread = sorted(((row[c], c) for c in columns if row[c] is not None), key=lambda p: (-p[0], p[1]))
    return [c for _, c in spread[:top]]


def correlation(df: DataFrame, columns: Sequence[str], top: int = 30) -> DataFrame:
    """Pearson correlation of the widest columns, each pair over its complete rows, in one pass."""
    chosen = widest_columns(df, columns, top)
    pairs = [(a, b) for i, a in enumerate(chosen) for b in chosen[i + 1:]]
    aggs: list[Column] = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        aggs.append(F.corr(F.when(both, x), F.when(both, y)).alias(f"p{i}"))
    rows = F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"p{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ])
    return df.agg(*aggs).select(F.inline(rows))
