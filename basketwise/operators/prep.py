"""Leakage-safe preparation: label picks, feature choice, dense stage, vocabulary, sparse vectors."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketwise.functions.coerce import as_double, as_long, finite
from basketwise.functions.quantiles import column_quantiles
from basketwise.session import materialize

# Columns that must never become features, and prefixes of leaking ones.
DENY_COLUMNS = (
    "y1", "y2", "delta", "abs_delta", "target_label", "reference_label", "entity_id", "snapshot_id", "deck_id",
    "group_id", "fetched_at", "updated_at", "commander_oracle_uids", "deck_name", "name", "source_url",
)
DENY_PREFIXES = ("epl_", "reference_")
IMPUTE_PREFIXES = ("edhrec_rank_", "salt_")
CAP_COLUMN = "price_total"
CAP_PROBABILITY = 0.99


# ---------------------------------------------------------------- labels and columns


def pick_label(*candidates: Column) -> Column:
    """First candidate that reads as a whole number."""
    return F.coalesce(*[as_long(c) for c in candidates])


def filter_reason(y1: Column, y2: Column, labels: Sequence[int]) -> Column:
    """``included``, or which label is out of range (the target is tested first)."""

    def bad(c: Column) -> Column:
        return ~F.coalesce(c.isin(*labels), F.lit(False))

    def text(name: str, c: Column) -> Column:
        return F.concat(F.lit(f"{name}_out_of_range:"), F.coalesce(c.cast("string"), F.lit("None")))

    return F.when(bad(y1), text("y1", y1)).when(bad(y2), text("y2", y2)).otherwise("included")


def split_modelling(df: DataFrame, y1: str, y2: str, labels: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(modelling base, excluded rows with ``reason``)."""
    tagged = df.withColumn("reason", filter_reason(F.col(y1), F.col(y2), labels))
    return (tagged.filter(F.col("reason") == "included").drop("reason"),
            tagged.filter(F.col("reason") != "included"))


def require_labels(df: DataFrame, label: str) -> DataFrame:
    """Label as double; a NULL label fails the job."""
    value = F.when(F.col(label).isNull(), F.raise_error(F.lit(f"{label} must not be NULL"))) \
        .otherwise(F.col(label).cast("double"))
    return df.withColumn(label, value)


def infer_feature_columns(df: DataFrame, deny: Sequence[str] = DENY_COLUMNS,
                          deny_prefixes: Sequence[str] = DENY_PREFIXES) -> list[str]:
    """Sorted numeric and boolean columns, plus text columns in which every value reads as a number; an empty text is
    no number. Text columns are tested together in one aggregate row."""
    allowed = [f for f in df.schema.fields if f.name not in deny and not f.name.startswith(tuple(deny_prefixes))]
    numeric = [f.name for f in allowed if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    texts = [f.name for f in allowed if isinstance(f.dataType, T.StringType)]
    if texts:
        row = df.agg(*[
            (F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()) == 0)
            .alias(c) for c in texts
        ]).first()
        numeric += [c for c in texts if row[c]]
    return sorted(numeric)


def as_number(df: DataFrame, column: str) -> Column:
    """Booleans as 0/1, text read leniently, NaN and infinities NULL."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        return F.col(column).cast("double")
    if isinstance(kind, T.StringType):
        return as_double(F.col(column))
    return finite(F.col(column).cast("double"))


# ---------------------------------------------------------------- dense stage


class _DenseParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    imputePrefixes = Param(Params._dummy(), "imputePrefixes", "median-imputed prefixes", TypeConverters.toListString)
    capColumn = Param(Params._dummy(), "capColumn", "column winsorised at the top", TypeConverters.toString)
    capProbability = Param(Params._dummy(), "capProbability", "winsorising quantile", TypeConverters.toFloat)
    scale = Param(Params._dummy(), "scale", "standardise with population deviation", TypeConverters.toBoolean)


class DensePreprocessor(Estimator, _DenseParams, DefaultParamsReadable, DefaultParamsWritable):
    """Impute, cap, zero-fill, drop constants, optionally scale; everything learned on the fitted rows.

    Two passes whatever the number of columns: one for the quantiles, one aggregate for the moments.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", imputePrefixes=IMPUTE_PREFIXES,
                 capColumn=CAP_COLUMN, capProbability=CAP_PROBABILITY, scale=False):
        super().__init__()
        self._setDefault(outputCol="features", imputePrefixes=list(IMPUTE_PREFIXES), capColumn=CAP_COLUMN,
                         capProbability=CAP_PROBABILITY, scale=False)
        given = {k: (list(v) if isinstance(v, tuple) else v) for k, v in self._input_kwargs.items() if v is not None}
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> "DensePreprocessorModel":
        columns = self.getOrDefault(self.inputCols)
        numbers = dataset.select(*[as_number(dataset, c).alias(c) for c in columns])
        prefixes = tuple(self.getOrDefault(self.imputePrefixes))
        imputed = [c for c in columns if prefixes and c.startswith(prefixes)]
        cap_column = self.getOrDefault(self.capColumn)
        fill, cap, top = {c: 0.0 for c in imputed}, None, self.getOrDefault(self.capProbability)
        capped = [cap_column] if cap_column in columns else []
        if imputed or capped:
            found = column_quantiles(numbers, list(dict.fromkeys([*imputed, *capped])), [0.5, top]).collect()  # two rows a column
            fill |= {r["column"]: r["quantile"] for r in found if r["column"] in fill and r["prob"] == 0.5}
            cap = next((r["quantile"] for r in found if r["column"] in capped and r["prob"] == top), None)
        state = {"columns": columns, "fill": fill, "cap_column": cap_column, "cap": cap}
        cleaned = numbers.select(*clean_columns(state))
        aggs = []
        for c in columns:
            aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"),
                     F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
        row = cleaned.agg(*aggs).first()  # one row
        state["kept"] = [c for c in columns if row[f"{c}__min"] is not None and row[f"{c}__min"] != row[f"{c}__max"]]
        state["mean"] = {c: row[f"{c}__mean"] for c in state["kept"]}
        state["std"] = {c: row[f"{c}__std"] for c in state["kept"]}
        model = DensePreprocessorModel(
            state=json.dumps(state, sort_keys=True), outputCol=self.getOrDefault(self.outputCol),
            scale=self.getOrDefault(self.scale))
        return model


def clean_columns(state: dict, dataset: DataFrame | None = None) -> list[Column]:
    out = []
    for c in state["columns"]:
        value = as_number(dataset, c) if dataset is not None else F.col(c)
        if c in state["fill"]:
            value = F.coalesce(value, F.lit(float(state["fill"][c])))
        if c == state["cap_column"] and state["cap"] is not None:
            value = F.when(value > state["cap"], F.lit(float(state["cap"]))).otherwise(value)
        out.append(F.coalesce(value, F.lit(0.0)).alias(c))
    return out


class DensePreprocessorModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Holds only literals, so the transform is a projection inside generated code."""

    state = Param(Params._dummy(), "state", "fitted literals as JSON", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    scale = Param(Params._dummy(), "scale", "standardise", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, state="{}", outputCol="features", scale=False):
        super().__init__()
        self._setDefault(state="{}", outputCol="features", scale=False)
        self._set(**self._input_kwargs)

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def feature_names(self) -> list[str]:
        return self.fitted["kept"]

    def prepared_columns(self, dataset: DataFrame) -> list[Column]:
        state = self.fitted
        cleaned = dict(zip(state["columns"], clean_columns(state, dataset)))
        if not self.getOrDefault(self.scale):
            return [cleaned[c] for c in state["kept"]]
        return [((cleaned[c] - F.lit(state["mean"][c])) / F.lit(state["std"][c])).alias(c) for c in state["kept"]]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(
            self.getOrDefault(self.outputCol), array_to_vector(F.array(*self.prepared_columns(dataset))))


# ---------------------------------------------------------------- bags


def vocabulary(bag: DataFrame, min_df: int, item: str = "item_id", quantity: str = "quantity") -> DataFrame:
    """``(item, df, idx)`` of items held by at least ``min_df`` entities, indexed in sorted order.

    ``bag`` has one row per (entity, item), so document frequency is a plain count. Items are sorted as text in range
    partitions, stored once; a position is the place in the partition plus the sizes of the partitions before
    (one row each), so ids that share a long prefix spread like any others.
    """
    if min_df < 1:
        raise ValueError("min_df must be at least 1")
    counted = bag.filter(F.col(quantity) > 0).groupBy(item).agg(F.count(F.lit(1)).alias("df")) \
        .filter(F.col("df") >= min_df)
    text = F.col(item).cast("string")
    sorted_items = materialize(
        counted.repartitionByRange(text).sortWithinPartitions(text).withColumn("__at", F.monotonically_increasing_id()),
        "vocabulary")
    placed = sorted_items.withColumn("__part", F.shiftright("__at", 33)).withColumn(
        "__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").select(item, "df", (F.col("__before") + F.col("__row")).alias("idx"))


def vectorize_long(bag: DataFrame, vocab: DataFrame, entity: str = "entity_id", item: str = "item_id",
                   quantity: str = "quantity") -> DataFrame:
    """``(entity, idx, value)`` over known items; unseen items and non-positive quantities drop out."""
    return bag.filter(F.col(quantity) > 0).join(vocab, item).select(
        entity, "idx", F.col(quantity).cast("double").alias("value"), "df")


def tfidf_long(vectors: DataFrame, n_docs: int | Column, entity: str = "entity_id") -> DataFrame:
    """Smoothed TF-IDF with unit length per entity: ``tf * (ln((1 + n) / (1 + df)) + 1)``. Rows without an entity drop out.

    The length comes from a window over the entity, so rows move once and are read once; an entity has at most
    one row a known item, which bounds the window by the vocabulary.
    """
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    weighted = vectors.withColumn("__w", F.col("value") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(entity)))
    return weighted.filter(F.col(entity).isNotNull()).select(entity, "idx", "__w").select(
        entity, "idx", (F.col("__w") / norm).alias("value"))


_SPARSE = T.StructType([T.StructField("v", VectorUDT())])


def sparse_vectors(long: DataFrame, size: int, entity: str = "entity_id", out: str = "features") -> DataFrame:
    """One sparse vector per entity, built in the JVM: the vector type's own struct form is read back
    with ``from_json``, so no Python row function is involved. A vector has at most ``size`` entries."""
    entries = long.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(
        F.col("idx").cast("int").alias("i"), F.col("value").alias("x")))).alias("e"))
    body = F.struct(F.struct(
        F.lit(0).alias("type"), F.lit(size).alias("size"),
        F.transform("e", lambda p: p["i"]).alias("indices"), F.transform("e", lambda p: p["x"]).alias("values"),
    ).alias("v"))
    return entries.select(entity, F.from_json(F.to_json(body), _SPARSE)["v"].alias(out))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, weight)`` with ``n_total / (n_classes * n)``; one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("__total"), F.count(F.lit(1)).alias("__k"))
    return counts.join(F.broadcast(totals)).select(  # one row
        label, "n", (F.col("__total") / (F.col("__k") * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(weights), label)  # one row per class
