"""Classification scores from confusion counts, fold summaries, model ranking and result tables.

Predictions are reduced to confusion counts in one aggregate; everything after that works on tables
of models x folds x label pairs, which do not grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketwise.functions.coerce import finite

# The ordinal classes of the modelling base.
LABELS = (2, 3, 4)
SCORES = ("accuracy", "precision_macro", "recall_macro", "macro_f1")


def confusion(preds: DataFrame, by: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """``(*by, y_true, y_pred, n)``."""
    return preds.groupBy(*by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_cells(counts: DataFrame, by: Sequence[str], labels: Sequence[int] = LABELS) -> DataFrame:
    """All label pairs with zeros filled in."""
    sums = [F.sum(F.when((F.col("y_true") == a) & (F.col("y_pred") == b), F.col("n")).otherwise(0)).alias(f"c_{a}_{b}")
            for a in labels for b in labels]
    cells = F.array(*[
        F.struct(F.lit(a).cast("bigint").alias("y_true"), F.lit(b).cast("bigint").alias("y_pred"),
                 F.col(f"c_{a}_{b}").cast("bigint").alias("n")) for a in labels for b in labels])
    wide = counts.groupBy(*by).agg(*sums) if by else counts.agg(*sums)
    return wide.select(*by, F.inline(cells))


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(counts: DataFrame, by: Sequence[str], labels: Sequence[int] = LABELS) -> DataFrame:
    """``(*by, label, support, predicted, precision, recall, f1)`` over a fixed label list; 0 where undefined."""
    aggs = []
    for c in labels:
        true, pred = F.col("y_true") == c, F.col("y_pred") == c
        for name, cond in (("tp", true & pred), ("support", true), ("predicted", pred)):
            aggs.append(F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("bigint").alias(f"{name}_{c}"))
    wide = counts.groupBy(*by).agg(*aggs) if by else counts.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).cast("bigint").alias("label"), *[F.col(f"{n}_{c}").alias(n) for n in ("tp", "support", "predicted")])
        for c in labels])
    long = wide.select(*by, F.inline(rows))
    precision, recall = _safe(F.col("tp"), F.col("predicted")), _safe(F.col("tp"), F.col("support"))
    return long.select(*by, "label", "support", "predicted", precision.alias("precision"), recall.alias("recall")) \
        .withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def scores(counts: DataFrame, by: Sequence[str], labels: Sequence[int] = LABELS, seen_only: bool = False,
           also: Sequence[Column] = ()) -> DataFrame:
    """Accuracy and macro scores from one aggregate, with the aggregates in ``also`` beside them. ``seen_only`` averages
    over labels that occur instead of the fixed list."""
    aggs = [F.sum("n").cast("bigint").alias("n"),
            (F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")]
    for c in labels:
        true, pred = F.col("y_true") == c, F.col("y_pred") == c
        for name, cond in (("tp", true & pred), ("support", true), ("predicted", pred)):
            aggs.append(F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("bigint").alias(f"__{name}_{c}"))
    plain = len(aggs)
    aggs += also
    wide = counts.groupBy(*by).agg(*aggs) if by else counts.agg(*aggs)
    beside = wide.columns[len(by) + plain:]
    side = lambda name, c: F.col(f"__{name}_{c}")
    classes = F.array(*[F.struct(
        _safe(side("tp", c), side("predicted", c)).alias("precision"), _safe(side("tp", c), side("support", c)).alias("recall"),
        _safe(2.0 * side("tp", c), side("support", c) + side("predicted", c)).alias("f1"),
        ((side("support", c) > 0) | (side("predicted", c) > 0)).alias("seen")) for c in labels])
    used = F.filter(classes, lambda x: x["seen"]) if seen_only else classes

    def mean(name: str) -> Column:
        total = F.aggregate(F.col("__used"), F.lit(0.0), lambda s, x: s + x[name])
        return F.when(F.size("__used") > 0, total / F.size("__used"))

    return wide.withColumn("__used", used).select(
        *by, "n", "accuracy", mean("precision").alias("precision_macro"), mean("recall").alias("recall_macro"),
        mean("f1").alias("macro_f1"), *beside)


def fold_scores(preds: DataFrame, by: Sequence[str] = ("model_id", "fold_id"), labels: Sequence[int] = LABELS) -> DataFrame:
    return scores(confusion(preds, by), by, labels)


def mean_std(folds: DataFrame, by: Sequence[str], columns: Sequence[str] = SCORES) -> DataFrame:
    """Mean and sample deviation over folds (0 for a single fold), with the number of folds."""
    aggs = [F.count(F.lit(1)).alias("n_folds")]
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std")]
    return folds.groupBy(*by).agg(*aggs)


def finite_columns(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL before results are written."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: finite(F.col(c)) for c in doubles}) if doubles else df


# ---------------------------------------------------------------- ranking and selection


def rank_models(summary: DataFrame, within: Sequence[str] = (), mean: str = "macro_f1_mean",
                std: str = "macro_f1_std", out: str = "rank") -> DataFrame:
    """Mean descending, deviation ascending, then id; a table of models."""
    w = Window.partitionBy(*(within or [F.lit(0)])).orderBy(F.col(mean).desc(), F.col(std).asc(), "model_id")
    return summary.withColumn(out, F.row_number().over(w).cast("bigint"))


def spot_summary(results: DataFrame, by: Sequence[str] = ("algorithm", "representation", "min_df")) -> DataFrame:
    """Per configuration: successes, failures, seeds and score statistics over seeds."""
    ok = F.col("status") == "ok"
    return results.groupBy(*by).agg(
        F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_error"),
        F.avg(F.when(ok, F.col("macro_f1"))).alias("macro_f1_mean"),
        F.coalesce(F.stddev_samp(F.when(ok, F.col("macro_f1"))), F.lit(0.0)).alias("macro_f1_std"),
        F.avg(F.when(ok, F.col("accuracy"))).alias("accuracy_mean"),
        F.avg(F.when(ok, F.col("fit_seconds"))).alias("fit_seconds_mean"),
        F.array_sort(F.collect_list(F.when(ok, F.struct("seed", "macro_f1")))).alias("values"),
    )


def best_setting(summary: DataFrame, setting: str = "min_df", score: str = "macro_f1_mean") -> DataFrame:
    """The setting with the highest mean of means; the first (smallest) wins ties."""
    means = summary.filter(F.col(setting).isNotNull()).groupBy(setting).agg(F.avg(score).alias("mean_score"))
    return means.orderBy(F.col("mean_score").desc(), F.col(setting).asc()).limit(1)


def rank_per_representation(summary: DataFrame, eligible: Column, keep: int = 5) -> DataFrame:
    """Eligible configurations first, then by score; ``selected`` marks the best ``keep`` of each side."""
    w = Window.partitionBy("representation").orderBy(
        F.col("eligible").desc(), F.col("macro_f1_mean").desc_nulls_last(), "algorithm")
    ranked = summary.withColumn("eligible", eligible).withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.withColumn("selected", F.col("eligible") & (F.col("rank") <= keep))


def selected_union(ranked: DataFrame, algorithm: str = "algorithm") -> DataFrame:
    """Algorithms selected on any side."""
    return ranked.filter("selected").select(algorithm).distinct()


def model_plan(spark: SparkSession, representations: Sequence[str], algorithms: Sequence[str]) -> DataFrame:
    """Every representation with every algorithm, from two short literal lists."""

    def each(values: Sequence[str]) -> Column:
        return F.explode(F.array(*[F.lit(v) for v in values]))

    return spark.range(1).select(each(representations).alias("representation")).withColumn(
        "algorithm", each(algorithms)).withColumn("model_id", F.concat_ws("_", "representation", "algorithm"))


def grid_summary(cv: DataFrame, by: Sequence[str] = ("model_id", "fold_id"), config: str = "config_index",
                 score: str = "macro_f1") -> DataFrame:
    """Mean and population deviation per configuration, minimum rank, and the first best one."""
    means = cv.groupBy(*by, config).agg(
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"), F.count(F.lit(1)).alias("n_splits"))
    w = Window.partitionBy(*by).orderBy(F.round("mean_score", 12).desc())
    first = Window.partitionBy(*by).orderBy(F.round("mean_score", 12).desc(), F.col(config))
    return means.withColumn("rank", F.rank().over(w).cast("bigint")).withColumn(
        "is_best", F.row_number().over(first) == 1)


def modal_params(best: DataFrame, model: str = "model_id", params: str = "params", order: str = "fold_ordinal") -> DataFrame:
    """Most frequent parameter text per model; the earliest seen wins ties."""
    counted = best.groupBy(model, params).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return counted.groupBy(model).agg(
        F.max_by(params, F.struct(F.col("n"), -F.col("first_seen"))).alias(params), F.max("n").alias("n"))


def canonical_params(params: Column) -> Column:
    """A parameter map as JSON text with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def completeness(folds: DataFrame, expected: DataFrame, n_folds: int = 15) -> DataFrame:
    """Folds present per expected model: ``COMPLETE``, ``PARTIAL`` or ``INCOMPLETE``."""
    present = folds.groupBy("model_id").agg(F.count_distinct("fold_id").alias("n_present"))
    n = F.coalesce("n_present", F.lit(0).cast("bigint"))
    return expected.select("model_id").distinct().join(present, "model_id", "left").select(
        "model_id", n.alias("n_present"),
        F.when(n >= n_folds, "COMPLETE").when(n > 0, "PARTIAL").otherwise("INCOMPLETE").alias("status"))


def fold_consistency(folds: DataFrame) -> DataFrame:
    """Does every model have the same fold ids as the first model?"""
    sets = folds.groupBy("model_id").agg(F.array_sort(F.collect_set("fold_id")).alias("folds"))
    reference = sets.agg(F.min_by("folds", "model_id").alias("reference"))
    return sets.join(F.broadcast(reference)).select(  # one row
        "model_id", F.size("folds").cast("bigint").alias("n_folds"), (F.col("folds") == F.col("reference")).alias("consistent"))


def complete_cases(folds: DataFrame, score: str = "macro_f1") -> DataFrame:
    """Fold x model scores of the folds every model has."""
    n_models = folds.agg(F.count_distinct("model_id").alias("__k"))
    full = folds.groupBy("fold_id").agg(F.count_distinct("model_id").alias("__n")).join(F.broadcast(n_models)) \
        .filter(F.col("__n") == F.col("__k")).select("fold_id")
    return folds.join(F.broadcast(full), "fold_id").select("model_id", "fold_id", F.col(score).alias("score"))


def merge_results(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union by key; the current run wins."""
    both = current.withColumn("__old", F.lit(0)).unionByName(previous.withColumn("__old", F.lit(1)))
    row = F.struct(*[F.col(c) for c in current.columns])
    return both.groupBy(*keys).agg(F.min_by(row, "__old").alias("__row")).select("__row.*")


def generalisation_gap(stratified: DataFrame, grouped: DataFrame) -> DataFrame:
    """Stratified mean, grouped mean and their difference per model."""
    return stratified.select("model_id", F.col("macro_f1_mean").alias("stratified")).join(
        grouped.select("model_id", F.col("macro_f1_mean").alias("grouped")), "model_id"
    ).withColumn("gap", F.col("stratified") - F.col("grouped"))


def by_representation(summary: DataFrame, score: str = "macro_f1_mean", sides: tuple[str, str] = ("df", "bc")) -> DataFrame:
    """One row per algorithm with both representations side by side and their difference."""
    a, b = sides
    pivoted = summary.groupBy("algorithm").agg(*[
        F.max(F.when(F.col("representation") == s, F.col(score))).alias(s) for s in sides])
    return pivoted.withColumn("difference", F.col(a) - F.col(b))


def gain_over_single(ensembles: DataFrame, singles: DataFrame, score: str = "macro_f1_mean") -> DataFrame:
    """Each ensemble against the best single model of its representation (any, when mixed)."""
    best = singles.groupBy("representation").agg(
        F.max_by(F.struct("model_id", F.col(score).alias("s")), F.struct(F.col(score))).alias("best"))
    overall = singles.agg(F.max_by(F.struct("model_id", F.col(score).alias("s")), F.struct(F.col(score))).alias("overall"))
    # one row per representation, and one row
    joined = ensembles.join(F.broadcast(best), "representation", "left").join(F.broadcast(overall))
    reference = F.coalesce("best", "overall")
    return joined.select(
        "voting_id", "representation", reference["model_id"].alias("reference_model"), F.col(score),
        reference["s"].alias("reference_score"), (F.col(score) - reference["s"]).alias("gain"))
