"""Which items and columns go with a prediction: lift, means, standardised differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.functions.ranking import top_per_group
from basketwise.functions.skew import join_to_rows
from basketwise.operators.metrics import LABELS

# Smoothing added to both frequencies, entities an item needs to be reported.
SMOOTHING = 5e-4
MIN_ENTITIES = 10


def _item_weights(oof: DataFrame, bag: DataFrame, groups: dict[str, Column], entity: str) -> tuple[DataFrame, DataFrame]:
    """(per item: weight in each group and number of entities; one row of group totals).

    Repeated out-of-fold rows are folded to one weight vector per entity before they meet the bag,
    so the bag is read and shuffled once whatever the number of repeats.
    """
    weights = oof.groupBy(entity).agg(*[F.count_if(c).alias(g) for g, c in groups.items()])
    present = weights.join(bag.select(entity).distinct(), entity, "left_semi")
    totals = present.agg(*[F.sum(g).alias(f"total_{g}") for g in groups])
    joined = join_to_rows(bag.filter(F.col("quantity") > 0).select(entity, "item_id"), weights, [entity], F.col("item_id"))
    items = joined.groupBy("item_id").agg(
        *[F.sum(g).alias(g) for g in groups], F.count(F.lit(1)).alias("n_entities"))
    return items, totals


def _named(df: DataFrame, names: DataFrame | None) -> DataFrame:
    """Item names, the id where there is none. Only the top rows are looked up."""
    if names is None:
        return df.withColumn("item_name", F.col("item_id").cast("string"))
    return df.join(names.select("item_id", "item_name"), "item_id", "left").withColumn(
        "item_name", F.coalesce("item_name", F.col("item_id").cast("string")))


def class_lift(oof: DataFrame, bag: DataFrame, names: DataFrame | None = None, labels: Sequence[int] = LABELS,
               min_entities: int = MIN_ENTITIES, top: int = 20, entity: str = "entity_id") -> DataFrame:
    """Top items per predicted class by ``P(item | class) / P(item)``; rare items are left out."""
    known = oof.filter(F.col("y_pred").isin(*labels))
    groups = {f"c{k}": F.col("y_pred") == k for k in labels}
    items, totals = _item_weights(known, bag, groups, entity)
    everything = sum((F.col(f"c{k}") for k in labels), F.lit(0))
    all_total = sum((F.col(f"total_c{k}") for k in labels), F.lit(0))
    freq = F.array(*[
        F.struct(F.lit(k).cast("bigint").alias("label"), F.col(f"c{k}").alias("hits"),
                 (F.col(f"c{k}") / F.greatest(F.col(f"total_c{k}"), F.lit(1))).alias("freq_in_class")) for k in labels])
    rows = items.filter(F.col("n_entities") >= min_entities).join(F.broadcast(totals)).select(  # one row
        "item_id", "n_entities", (everything / F.greatest(all_total, F.lit(1))).alias("freq_overall"), F.inline(freq)
    ).filter(F.col("hits") > 0).withColumn("lift", F.round(F.col("freq_in_class") / F.col("freq_overall"), 12))
    best = top_per_group(rows, ["label"], [F.col("lift").desc(), F.col("item_id")], top)
    return _named(best, names)


def divergence_lift(oof: DataFrame, bag: DataFrame, names: DataFrame | None = None, min_entities: int = MIN_ENTITIES,
                    top: int = 20, alpha: float = SMOOTHING, entity: str = "entity_id") -> DataFrame:
    """Smoothed lift between rows that follow the reference label and rows that do not, both ways, and
    between over- and under-prediction, both ways."""
    d = F.col("y_pred") - F.col("y2")
    groups = {"concordant": d == 0, "divergent": d != 0, "over": d > 0, "under": d < 0}
    items, totals = _item_weights(oof.filter(F.col("y_pred").isNotNull() & F.col("y2").isNotNull()), bag, groups, entity)

    def freq(g: str) -> Column:
        return F.col(g) / F.greatest(F.col(f"total_{g}"), F.lit(1))

    directions = (("divergent", "concordant"), ("concordant", "divergent"), ("over", "under"), ("under", "over"))
    rows = F.array(*[
        F.struct(F.lit(f"{a}_vs_{b}").alias("direction"), freq(a).alias("freq_base"), freq(b).alias("freq_other"))
        for a, b in directions])
    lifted = items.filter(F.col("n_entities") >= min_entities).join(F.broadcast(totals)).select(  # one row
        "item_id", "n_entities", F.inline(rows)
    ).filter(F.col("freq_base") >= alpha).withColumn(
        "lift", F.round((F.col("freq_base") + alpha) / (F.col("freq_other") + alpha), 12))
    return _named(top_per_group(lifted, ["direction"], [F.col("lift").desc(), F.col("item_id")], top), names)


def means_by_prediction(oof: DataFrame, features: DataFrame, columns: Sequence[str], entity: str = "entity_id",
                        min_rows: int = 5) -> DataFrame:
    """Column means per predicted class (NULL below ``min_rows``) and overall (class NULL)."""
    joined = oof.select(entity, "y_pred").join(features.select(entity, *columns), entity)
    per_class = joined.groupBy(F.col("y_pred").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), *[F.struct(F.count(c).alias("k"), F.sum(F.col(c).cast("double")).alias("s")).alias(c) for c in columns])
    total = per_class.agg(
        F.sum("n").cast("bigint").alias("n"),
        *[F.struct(F.sum(f"{c}.k").alias("k"), F.sum(f"{c}.s").alias("s")).alias(c) for c in columns],
    ).select(F.lit(None).cast("bigint").alias("label"), "n", *columns)
    both = per_class.unionByName(total)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.when((F.col("n") >= min_rows) & (F.col(c)["k"] > 0), F.col(c)["s"] / F.col(c)["k"]).alias("mean"))
        for c in columns])
    return both.select("label", "n", F.inline(rows))


def divergent_differences(oof: DataFrame, features: DataFrame, columns: Sequence[str], top: int = 20,
                          entity: str = "entity_id") -> DataFrame:
    """Column means where the prediction leaves the reference label against where it follows it, as a
    difference in population deviations; largest first."""
    flagged = oof.select(entity, (F.col("y_pred") != F.col("y2")).alias("divergent")).join(
        features.select(entity, *columns), entity)
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [F.avg(F.when(F.col("divergent"), v)).alias(f"{c}__d"), F.avg(F.when(~F.col("divergent"), v)).alias(f"{c}__c"),
                 F.stddev_pop(v).alias(f"{c}__s")]
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__d").alias("mean_divergent"),
                 F.col(f"{c}__c").alias("mean_concordant"), F.col(f"{c}__s").alias("std")) for c in columns])
    gap = F.col("mean_divergent") - F.col("mean_concordant")
    out = flagged.agg(*aggs).select(F.inline(rows)).withColumn("difference", gap).withColumn(
        "effect", F.when(F.col("std") > 0, gap / F.col("std")).otherwise(0.0))
    return out.orderBy(F.abs("effect").desc(), "column").limit(top)
