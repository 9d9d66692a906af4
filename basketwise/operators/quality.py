"""Table-quality checks: identity, coverage, alignment, recompute-and-compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_report(df: DataFrame, id_col: str, size: Column, expected: tuple[int, int]) -> DataFrame:
    """Totals, distinct ids, duplicates and size statistics. Ids are combined first, so the distinct
    count is a plain count over a distributed table."""
    low, high = expected
    per_id = df.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.sum(size).alias("total"),
        F.count(size).alias("sized"), F.count_if(~size.between(low, high)).alias("wrong"),
    )
    return per_id.agg(
        F.sum("n").cast("bigint").alias("n_rows"), F.count_if(F.col(id_col).isNotNull()).alias("n_ids"),
        F.count_if(F.col("n") > 1).alias("n_repeated_ids"),
        F.min("lo").alias("min_size"), F.max("hi").alias("max_size"),
        (F.sum("total") / F.sum("sized")).alias("mean_size"),
        F.coalesce(F.sum("wrong"), F.lit(0)).cast("bigint").alias("n_wrong_size"),
    )


def alignment(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids only on the left (missing on the right), only on the right (extra), and on both sides."""
    keys = list(keys)
    a = left.select(*keys).distinct().withColumn("__l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(True))
    both = a.join(b, keys, "full_outer")
    return both.agg(
        F.count_if(F.col("__l").isNotNull() & F.col("__r").isNull()).alias("n_missing"),
        F.count_if(F.col("__l").isNull() & F.col("__r").isNotNull()).alias("n_extra"),
        F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("n_common"),
    )


def unreferenced(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Ids used by ``rows`` that ``table`` does not have, with how often they are used."""
    used = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_uses"))
    return used.join(table.select(key).distinct(), key, "left_anti")


def label_coverage(df: DataFrame, label: Column, failed: Column, score: Column) -> DataFrame:
    """Label states and mean numeric score; a failed attempt is neither labelled nor missing."""
    return df.agg(
        F.count_if(~failed & label.isNotNull()).alias("n_labelled"), F.count_if(failed).alias("n_failed"),
        F.count_if(~failed & label.isNull()).alias("n_missing"), F.avg(score).alias("mean_score"),
    )


def span(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"))


def overall_status(checks: DataFrame, ok: str = "ok") -> DataFrame:
    """``ok`` when every check row passes, else the number of failures."""
    return checks.agg(
        F.when(F.bool_and(ok), F.lit("ok")).otherwise(F.lit("issues")).alias("status"),
        F.count_if(~F.col(ok)).alias("n_failed"),
    )


def recompute_diff(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], columns: Sequence[str],
                   tolerance: float = 1e-6) -> DataFrame:
    """Cells that differ, in long form ``(keys, column, stored, fresh, problem)``.

    Rows are matched once by key; each pair is then opened into its columns, so the join never
    carries more than one row per key and side.
    """
    keys = list(keys)
    a = stored.select(*keys, F.struct(*columns).alias("__a"), F.lit(True).alias("__in_a"))
    b = fresh.select(*keys, F.struct(*columns).alias("__b"), F.lit(True).alias("__in_b"))
    both = a.join(b, keys, "full_outer")
    floats = {f.name for f in stored.schema.fields if f.dataType.typeName() in ("double", "float")}

    def differs(c: str) -> Column:
        x, y = F.col("__a")[c], F.col("__b")[c]
        if c in floats:
            return ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)))
        return ~x.eqNullSafe(y)

    cells = F.array_compact(F.array(*[
        F.when(differs(c), F.struct(
            F.lit(c).alias("column"), F.col("__a")[c].cast("string").alias("stored"),
            F.col("__b")[c].cast("string").alias("fresh")))
        for c in columns
    ]))
    problem = F.when(F.col("__in_b").isNull(), "not_recomputed").when(F.col("__in_a").isNull(), "not_stored") \
        .otherwise("different")
    return both.select(*keys, problem.alias("problem"), F.inline(cells))


def compare_if_current(live: DataFrame, saved: DataFrame, key: str, live_updated: str, saved_fetched: str,
                       fields: Sequence[str]) -> DataFrame:
    """Compare records only when the live one has not changed since the saved one was fetched."""
    a = live.select(key, F.col(live_updated).alias("__live_at"), F.struct(*fields).alias("__live"))
    b = saved.select(key, F.col(saved_fetched).alias("__saved_at"), F.struct(*fields).alias("__saved"))
    status = (
        F.when(F.col("__live_at") > F.col("__saved_at"), "skipped_newer_live")
        .when(F.col("__live").eqNullSafe(F.col("__saved")), "identical")
        .otherwise("different")
    )
    return a.join(b, key).select(key, status.alias("status"))
