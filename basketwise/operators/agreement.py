"""Predictions against both labels: agreement, subsets and the three-way table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.operators.metrics import LABELS, confusion, scores


def comparable(preds: DataFrame, labels: Sequence[int] = LABELS, y_pred: str = "y_pred", y2: str = "y2") -> DataFrame:
    """Rows whose prediction and reference label are both known classes."""
    return preds.filter(F.col(y_pred).isin(*labels) & F.col(y2).isin(*labels))


def agreement_scores(preds: DataFrame, by: Sequence[str], y_ref: str = "y2", y_pred: str = "y_pred",
                     labels: Sequence[int] = LABELS) -> DataFrame:
    """n, exact and within-one shares, mean absolute difference and macro-F1 against ``y_ref``.

    One aggregate to label pairs; the rest runs on that small table.
    """
    counts = confusion(comparable(preds, labels, y_pred, y_ref), by, y_ref, y_pred)
    gap = F.abs(F.col("y_true") - F.col("y_pred"))
    n = F.sum("n")
    more = [
        (F.sum(F.when(gap <= 1, F.col("n")).otherwise(0)) / n).alias("within_1"),
        (F.sum(gap * F.col("n")) / n).alias("mean_abs_delta"),
    ]
    return scores(counts, by, labels, also=more).select(
        *by, F.col("accuracy").alias("exact"), "within_1", "mean_abs_delta", "n", "macro_f1")


def subset_of(y_true: Column, y2: Column) -> Column:
    return F.when(y_true == y2, "concordant").otherwise("discordant")


def agreement_by_subset(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Agreement where the two labels agree and where they differ."""
    tagged = preds.withColumn("subset", subset_of(F.col("y_true"), F.col("y2")))
    return agreement_scores(tagged, [*by, "subset"])


def meaning(y_pred: Column, y1: Column, y2: Column) -> Column:
    """Whom a prediction follows."""
    return F.when((y_pred == y1) & (y_pred == y2), "both").when(y_pred == y1, "y1").when(y_pred == y2, "y2") \
        .otherwise("other")


def triadic(preds: DataFrame, by: Sequence[str], y1: str = "y_true", y2: str = "y2") -> DataFrame:
    """Per (y1, y2) cell: how many predictions follow y1, y2, both or neither, with shares; the rows
    with NULL labels hold the totals over agreeing, differing and all cells."""
    counted = comparable(preds).groupBy(*by, F.col(y1).alias("y1"), F.col(y2).alias("y2"),
                                        meaning(F.col("y_pred"), F.col(y1), F.col(y2)).alias("follows")).agg(
        F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("bigint")

    def part(scope: Column, a: Column, b: Column) -> Column:
        return F.struct(scope.alias("scope"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    scope = F.explode(F.array(
        part(F.lit("cell"), F.col("y1"), F.col("y2")),
        part(F.when(F.col("y1") == F.col("y2"), "equal").otherwise("different"), none, none),
        part(F.lit("all"), none, none),
    ))
    opened = counted.select(*by, "follows", "n", scope.alias("s")).select(
        *by, "follows", "n", F.col("s.scope").alias("scope"), F.col("s.a").alias("y1"), F.col("s.b").alias("y2"))
    out = opened.groupBy(*by, "scope", "y1", "y2").agg(
        F.sum("n").cast("bigint").alias("n"),
        *[F.sum(F.when(F.col("follows") == f, F.col("n")).otherwise(0)).cast("bigint").alias(f"n_{f}")
          for f in ("both", "y1", "y2", "other")])
    return out.withColumns({f"pct_{f}": 100.0 * F.col(f"n_{f}") / F.col("n") for f in ("both", "y1", "y2", "other")})


def extremes(agreement: DataFrame, score: str = "exact") -> DataFrame:
    """Best and worst model by a score; ids break ties."""
    return agreement.agg(
        F.max_by("model_id", F.struct(F.col(score), F.col("model_id"))).alias("best_model"), F.max(score).alias("best"),
        F.min_by("model_id", F.struct(F.col(score), F.col("model_id"))).alias("worst_model"), F.min(score).alias("worst"))


def manifest(entities: DataFrame, y1: str = "y1", y2: str = "y2") -> DataFrame:
    """Row count, exact agreement and mean absolute difference of a labelled table."""
    return entities.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(y1) == F.col(y2)).cast("double")).alias("exact"),
        F.avg(F.abs(F.col(y2) - F.col(y1))).alias("mean_abs_delta"))
