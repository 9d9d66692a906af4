"""Friedman, Nemenyi and Wilcoxon tests over a fold x model score table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketwise.functions.dist import chi2_sf, nemenyi_q, normal_sf
from basketwise.functions.ranking import average_rank
from basketwise.operators.metrics import complete_cases

EXACT_UP_TO = 50


def fold_ranks(folds: DataFrame, score: str = "macro_f1") -> DataFrame:
    """Average rank of every model inside every complete fold, best first."""
    cases = complete_cases(folds, score)
    same = Window.partitionBy("fold_id", "score")
    return cases.withColumn("rank", average_rank(F.col("score"), ["fold_id"])).withColumn(
        "tied", F.count(F.lit(1)).over(same))


def average_ranks(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("model_id").agg(F.avg("rank").alias("average_rank"), F.count(F.lit(1)).alias("n_folds"))


def friedman(ranks: DataFrame) -> DataFrame:
    """Statistic with tie correction and p-value; ``insufficient_data`` below 3 models or 2 folds."""
    per_model = ranks.groupBy("model_id").agg(
        F.sum("rank").alias("r"), F.sum(F.col("tied") * F.col("tied") - 1).alias("t"), F.count(F.lit(1)).alias("n"))
    sums = per_model.agg(F.count(F.lit(1)).alias("n_models"), F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("n_folds"),
                         F.sum(F.col("r") * F.col("r")).alias("squares"), F.sum("t").alias("t"))
    k, n = F.col("n_models").cast("double"), F.col("n_folds").cast("double")
    enough = (F.col("n_models") >= 3) & (F.col("n_folds") >= 2)
    raw = 12.0 / (n * k * (k + 1)) * F.col("squares") - 3.0 * n * (k + 1)
    tested = sums.withColumn("statistic", F.when(enough, raw / (1.0 - F.col("t") / (n * k * (k * k - 1)))))
    return tested.select(
        F.when(enough, "ok").otherwise("insufficient_data").alias("status"), "n_models", "n_folds", "statistic",
        F.when(enough, chi2_sf(F.col("statistic"), (F.col("n_models") - 1).cast("int"))).alias("p_value"))


def critical_difference(k: Column, n: Column) -> Column:
    return nemenyi_q(k) * F.sqrt(k * (k + 1) / (6.0 * n))


def _pairs(df: DataFrame, column: str, within: list[str]) -> DataFrame:
    """Unordered model pairs with the value of each side, inside every ``within`` group.

    The models of one fold are a short list, so pairs are opened from it instead of joining.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col("model_id").alias("m"), F.col(column).alias("v"))))
    models = df.groupBy(*within).agg(listed.alias("ms")) if within else df.agg(listed.alias("ms"))
    pairs = F.flatten(F.transform("ms", lambda a: F.transform(
        F.filter("ms", lambda b: a["m"] < b["m"]),
        lambda b: F.struct(a["m"].alias("model_a"), b["m"].alias("model_b"), a["v"].alias("value_a"), b["v"].alias("value_b")))))
    return models.select(*within, F.inline(pairs))


def nemenyi(ranks: DataFrame) -> DataFrame:
    """Every model pair with its rank difference, the critical difference and a flag."""
    means = average_ranks(ranks)
    shape = means.agg(F.count(F.lit(1)).alias("k"), F.max("n_folds").alias("n"))
    pairs = _pairs(means, "average_rank", []).join(F.broadcast(shape))  # one row
    gap, cd = F.abs(F.col("value_a") - F.col("value_b")), critical_difference(F.col("k"), F.col("n"))
    return pairs.select("model_a", "model_b", gap.alias("rank_diff"), cd.alias("critical_difference"),
                        (gap > cd).alias("significant"))


def wilcoxon(folds: DataFrame, score: str = "macro_f1", method: str = "auto") -> DataFrame:
    """Signed-rank test per model pair, zeros dropped. ``method``: ``exact``, ``normal``, or ``auto``, which is exact up
    to 50 folds.

    The exact null distribution is counted by a subset-sum fold over the (doubled) ranks, so ties are
    exact too.
    """
    cases = complete_cases(folds, score)
    diffs = _pairs(cases, "score", ["fold_id"]).withColumn("d", F.col("value_a") - F.col("value_b"))
    nonzero = diffs.filter(F.col("d") != 0)
    pair = ["model_a", "model_b"]
    size = F.abs(F.col("d"))
    tied = Window.partitionBy(*pair, F.abs(F.col("d")))
    ranked = nonzero.withColumn("r", average_rank(size, [*pair], descending=False)).withColumn(
        "t", F.count(F.lit(1)).over(tied))
    summed = ranked.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"),
        F.sum(F.col("t") * F.col("t") - 1).alias("ties"),
        # one entry per fold
        F.collect_list((F.col("r") * 2).cast("int")).alias("doubled"),
    )
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method {method}")
    w = F.least("w_plus", "w_minus")
    exact = F.col("n") <= EXACT_UP_TO if method == "auto" else F.lit(method == "exact")
    tested = summed.withColumn("statistic", w).withColumn("p_value", F.when(
        exact, _exact_p(F.col("doubled"), F.col("statistic"), F.col("n"))
    ).otherwise(_normal_p(F.col("statistic"), F.col("n"), F.col("ties"))))
    everyone = diffs.select(*pair).distinct()
    return everyone.join(tested.select(*pair, "n", "statistic", "p_value"), pair, "left").select(
        *pair, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("statistic", F.lit(0.0)).alias("statistic"),
        F.coalesce("p_value", F.lit(1.0)).alias("p_value"))


def _exact_p(doubled: Column, statistic: Column, n: Column) -> Column:
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    start = F.transform(F.sequence(F.lit(0), total), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(doubled, start, lambda acc, r: F.transform(
        acc, lambda c, i: c + F.when(i >= r, F.try_element_at(acc, F.greatest(i - r + 1, F.lit(1)))).otherwise(0.0)))
    low = F.aggregate(F.slice(ways, F.lit(1), (statistic * 2).cast("int") + 1), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(1.0), 2 * low / F.pow(F.lit(2.0), n))


def _normal_p(statistic: Column, n: Column, ties: Column) -> Column:
    mean = n * (n + 1) / 4.0
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    return F.least(F.lit(1.0), 2 * normal_sf(F.abs(statistic - mean) / F.sqrt(variance)))
