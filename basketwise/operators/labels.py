"""Second-label bookkeeping: upserts, targets, comparison and audit samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.functions.ranking import md5_order, top_per_group
from basketwise.functions.skew import join_to_rows

# Fields compared when the same entity is scored again.
COMPARED_FIELDS = (
    "commander_bracket", "power_level", "score", "efficiency", "impact", "average_playability",
    "tipping_point", "not_loaded_cards",
)


def latest_labels(log: DataFrame, key: str, order: Column) -> DataFrame:
    """Last attempt per key. ``max_by`` keeps one row per key and task before the shuffle."""
    row = F.struct(*[F.col(c) for c in log.columns])
    return log.groupBy(key).agg(F.max_by(row, order).alias("__row")).select("__row.*")


def upsert(entities: DataFrame, latest: DataFrame, key: str, columns: Sequence[str],
           spread: Column | None = None) -> DataFrame:
    """New label values win when present; entities without a new label stay as they are.

    Where the key repeats in ``entities`` (a label per customer, say), pass a ``spread`` column that
    tells the rows apart: a key with very many rows is then joined in slices.
    """
    fresh = latest.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = entities.join(fresh, key, "left") if spread is None else \
        join_to_rows(entities, fresh, [key], spread, how="left")
    for c in columns:
        old = F.col(c) if c in entities.columns else F.lit(None).cast(latest.schema[c].dataType)
        joined = joined.withColumn(c, F.coalesce(F.col(f"__new_{c}"), old))
    return joined.drop(*[f"__new_{c}" for c in columns])


def label_state(value: Column, error: Column) -> Column:
    """``missing``, ``failed`` or ``ok``."""
    return F.when(error.isNotNull(), F.lit("failed")).when(value.isNull(), F.lit("missing")).otherwise(F.lit("ok"))


def targets(entities: DataFrame, state: Column, log: DataFrame | None = None, key: str = "snapshot_id",
            refresh_existing: bool = False, retry_failed: bool = True) -> DataFrame:
    """Entities that still need a label; finished log rows are skipped."""
    wanted = F.lit(True) if refresh_existing else state.isin("missing", *(["failed"] if retry_failed else []))
    chosen = entities.filter(wanted)
    return chosen.join(log.select(key).distinct(), key, "left_anti") if log is not None else chosen


def compare_payloads(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str] = COMPARED_FIELDS) -> DataFrame:
    """Both readings side by side per field subset, with one null-safe match flag."""
    a = left.select(key, F.struct(*fields).alias("saved"))
    b = right.select(key, F.struct(*fields).alias("fresh"))
    return a.join(b, key).withColumn("is_match", F.col("saved").eqNullSafe(F.col("fresh")))


def stability(compared: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    hits = F.count_if("is_match")
    return compared.agg(
        n.alias("n"), hits.alias("matched"), (n - hits).alias("mismatched"),
        F.when(n > 0, hits / n).alias("match_share"),
    )


def without_excluded(df: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that match the exclusion list on none of several keys (NULL keys match nothing)."""
    out = df
    for key in keys:
        listed = excluded.select(key).filter(F.col(key).isNotNull()).distinct()
        out = out.join(listed, key, "left_anti")
    return out


def coverage_sample(df: DataFrame, id_col: str, label: str, n: int, exclude: DataFrame | None = None) -> DataFrame:
    """``n`` rows in id order, but the lowest id of every label comes first.

    Labels are a small class set, so their lowest ids fit a broadcast; the rest is one
    distributed top-n.
    """
    pool = df.join(exclude.select(id_col), id_col, "left_anti") if exclude is not None else df
    lead = pool.groupBy(label).agg(F.min(id_col).alias(id_col)).select(id_col, F.lit(0).alias("__rest"))
    return (
        pool.join(lead, id_col, "left")
        .withColumn("__rest", F.coalesce("__rest", F.lit(1)))
        .orderBy("__rest", id_col).limit(n)
        .withColumn("is_label_lead", F.col("__rest") == 0)
        .drop("__rest")
    )


def per_label_sample(df: DataFrame, id_col: str, label: str, n: int, seed: int) -> DataFrame:
    """``n`` random rows per label, reproducible by seed."""
    keyed = df.withColumn("__digest", md5_order(seed, id_col))
    return top_per_group(keyed, [label], [F.col("__digest"), F.col(id_col)], n).drop("__digest")
