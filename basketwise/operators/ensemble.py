"""Hard voting over out-of-fold rows and majority labels over repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.operators.metrics import LABELS, confusion, mean_std, scores

ROW = ("fold_id", "entity_id")


def members_of(preds: DataFrame, members: Sequence[str]) -> DataFrame:
    return preds.filter(F.col("model_id").isin(list(members)))


def vote(preds: DataFrame, strength: DataFrame, members: Sequence[str], tie: str = "mean",
         row: Sequence[str] = ROW, carry: Sequence[str] = ("y_true", "y2")) -> DataFrame:
    """Most votes; ties by the members' score (``mean`` or ``max`` over the voters), then the smaller label.

    Only rows that every member predicted count. All members are stacked and grouped, so the number
    of members never becomes a number of joins.
    """
    mine = members_of(preds, members).join(F.broadcast(strength.select("model_id", "strength")), "model_id")  # one row per model
    pick = {"mean": F.avg, "max": F.max}[tie]
    per_label = mine.groupBy(*row, *carry, "y_pred").agg(
        F.count(F.lit(1)).alias("votes"), F.round(pick("strength"), 12).alias("support"))
    return per_label.groupBy(*row, *carry).agg(
        F.max_by("y_pred", F.struct("votes", "support", -F.col("y_pred"))).alias("y_pred"),
        F.max("votes").alias("votes"), F.sum("votes").alias("__n"),
    ).filter(F.col("__n") == len(members)).drop("__n")


def member_predictions(preds: DataFrame, members: Sequence[str], row: Sequence[str] = ROW) -> DataFrame:
    """Per row a map of member predictions (one entry per member)."""
    return members_of(preds, members).groupBy(*row).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_id", "y_pred")))).alias("per_member"))


def shared_keys(preds: DataFrame, members: Sequence[str], row: Sequence[str] = ROW) -> DataFrame:
    """Row keys present for all members."""
    return members_of(preds, members).groupBy(*row).agg(F.count_distinct("model_id").alias("n")) \
        .filter(F.col("n") == len(members)).drop("n")


def ensemble_scores(voted: DataFrame, labels: Sequence[int] = LABELS) -> tuple[DataFrame, DataFrame]:
    """(per fold, mean and deviation over folds) of a voted table with ``voting_id``."""
    by = ["voting_id", "fold_id"]
    folds = scores(confusion(voted, by), by, labels)
    return folds, mean_std(folds, ["voting_id"])


def representation_of(members: DataFrame, by: str = "voting_id") -> DataFrame:
    """``BC``, ``DF`` or ``BC+DF`` from the member representations."""
    return members.groupBy(by).agg(
        F.array_join(F.array_sort(F.collect_set(F.upper("representation"))), "+").alias("representation"))


def majority(preds: DataFrame, by: Sequence[str] = ("model_id", "entity_id"), labels: Sequence[int] = LABELS,
             carry: Sequence[str] = ("y_true", "y2")) -> DataFrame:
    """Majority label over repeats with its share and the count vector; the smaller label wins ties."""
    per_label = preds.filter(F.col("y_pred").isin(*labels)).groupBy(*by, *carry, "y_pred").agg(F.count(F.lit(1)).alias("c"))
    return per_label.groupBy(*by, *carry).agg(
        F.max_by("y_pred", F.struct(F.col("c"), -F.col("y_pred"))).alias("majority"),
        (F.max("c") / F.sum("c")).alias("confidence"),
        F.array(*[F.sum(F.when(F.col("y_pred") == x, F.col("c")).otherwise(0)) for x in labels]).alias("counts"),
    )


def hits_by_source(preds: DataFrame, by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """How many predictions match the target, the reference, or neither, and which way they lean."""
    y, a, b = F.col("y_pred"), F.col("y_true"), F.col("y2")
    counted = preds.groupBy(*by).agg(
        F.count_if(y == a).alias("y1_hits"), F.count_if(y == b).alias("y2_hits"),
        F.count_if((y != a) & (y != b)).alias("other_hits"))
    lean: Column = F.when(F.col("y1_hits") > F.col("y2_hits"), "y1").when(F.col("y1_hits") < F.col("y2_hits"), "y2") \
        .otherwise("none")
    return counted.withColumn("leaning", lean)
