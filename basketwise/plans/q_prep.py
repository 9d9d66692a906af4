"""Preparation, split and neighbour queries."""

from __future__ import annotations

from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from basketwise.operators import folds, neighbours, prep
from basketwise.plans import tables as t
from basketwise.plans.q_features import base_features, feats_cte
from basketwise.plans.registry import Registry, rounded
from basketwise.session import materialize

R = Registry()

DENSE = ["creature_count", "edhrec_rank_mean", "has_companion", "price_total", "salt_median", "unique_card_count"]
GROUPS = ["structure", "types", "popularity", "price"]
SPLIT_CTE = f"""{feats_cte(["structure", "types", "popularity"], detail=True)},
sized AS (SELECT *, count(*) OVER (PARTITION BY y1) AS n_y1, row_number() OVER (
    PARTITION BY y1 ORDER BY md5(concat_ws(':', '11', entity_id)), entity_id) AS rk FROM fbase),
split AS (SELECT *, rk <= round(n_y1 * 0.2) AS is_test FROM sized),
fit AS (SELECT median(edhrec_rank_mean) AS m_rank, median(salt_median) AS m_salt,
  quantile_cont(price_total, 0.99) AS cap FROM split WHERE NOT is_test),
clean AS (SELECT entity_id, is_test, CAST(creature_count AS DOUBLE) AS creature_count,
  coalesce(edhrec_rank_mean, m_rank) AS edhrec_rank_mean, 0.0 AS has_companion,
  coalesce(CASE WHEN price_total > cap THEN cap ELSE price_total END, 0) AS price_total,
  coalesce(salt_median, m_salt) AS salt_median, CAST(unique_card_count AS DOUBLE) AS unique_card_count FROM split, fit)"""
KEPT = [c for c in DENSE if c != "has_companion"]


def dense_split(spark, sf):
    """Features of the base, stored once, with a stratified 20 % test flag."""
    stored = materialize(base_features(spark, sf, GROUPS).select("entity_id", "y1", *DENSE), "dense")
    return materialize(folds.holdout(stored, "entity_id", "y1", 0.2, seed=11), "dense-split")


def _prepared(spark, sf, scale: bool):
    data = dense_split(spark, sf)
    model = prep.DensePreprocessor(inputCols=DENSE, scale=scale).fit(data.filter(~F.col("is_test")))
    return rounded(data.select("entity_id", "is_test", *model.prepared_columns(data)))


@R.query("prep_impute_cap", f"""{SPLIT_CTE}
SELECT entity_id, is_test, {", ".join(f"round({c}, 6) AS {c}" for c in KEPT)} FROM clean""")
def prep_impute_cap(spark, sf):
    """Train-fitted medians and price cap applied to all rows; the constant column is gone."""
    return _prepared(spark, sf, scale=False)


@R.query("prep_scale", f"""{SPLIT_CTE}, mom AS (
  SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in KEPT)} FROM clean WHERE NOT is_test)
SELECT entity_id, is_test, {", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in KEPT)} FROM clean, mom""")
def prep_scale(spark, sf):
    return _prepared(spark, sf, scale=True)


@R.query("prep_zero_variance", f"""{SPLIT_CTE}
{" UNION ALL ".join(f"SELECT '{c}' AS \"column\", var_pop({c}) > 0 AS kept FROM clean WHERE NOT is_test" for c in DENSE)}""")
def prep_zero_variance(spark, sf):
    data = dense_split(spark, sf)
    kept = prep.DensePreprocessor(inputCols=DENSE).fit(data.filter(~F.col("is_test"))).feature_names()
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in kept).alias("kept")) for c in DENSE])
    return spark.range(1).select(F.inline(pairs))


# ---------------------------------------------------------------- text bags

TOKENS = r"tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS item FROM documents)"
VOCAB = f"""{TOKENS}, bag AS (SELECT doc_id, item, count(*) AS q FROM tok GROUP BY ALL),
vocab AS (SELECT item, df, row_number() OVER (ORDER BY item) - 1 AS idx FROM (
  SELECT item, count(*) AS df FROM bag GROUP BY item HAVING count(*) >= 5))"""


def token_bag(spark, sf, docs=None):
    """``(entity_id, item_id, quantity)`` of every document's whole text. Texts are dealt out by document before they are
    split, so its words are counted where they arise; a text takes up far less than a row for each of its words."""
    docs = docs if docs is not None else t.table(spark, sf, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    dealt = docs.select(F.col("doc_id").alias("entity_id"), "text").repartition("entity_id")
    return dealt.select("entity_id", F.explode(words).alias("item_id")) \
        .groupBy("entity_id", "item_id").agg(F.count(F.lit(1)).alias("quantity"))


@R.query("prep_vocabulary", f"WITH {VOCAB} SELECT item AS item_id, df, idx FROM vocab")
def prep_vocabulary(spark, sf):
    return prep.vocabulary(token_bag(spark, sf), 5)


@R.query("prep_vectorize", f"""WITH {VOCAB}
SELECT doc_id, idx, CAST(q AS DOUBLE) AS "value" FROM bag JOIN vocab USING (item)""")
def prep_vectorize(spark, sf):
    bag = materialize(token_bag(spark, sf), "tokens")
    return prep.vectorize_long(bag, prep.vocabulary(bag, 5)).select(F.col("entity_id").alias("doc_id"), "idx", "value")


@R.query("prep_tfidf", f"""WITH {VOCAB}, w AS (
  SELECT doc_id, idx, q * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM bag JOIN vocab USING (item))
SELECT doc_id, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS "value" FROM w""")
def prep_tfidf(spark, sf):
    bag = materialize(token_bag(spark, sf), "tokens")
    n = t.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_docs"))
    vectors = prep.vectorize_long(bag, prep.vocabulary(bag, 5)).join(F.broadcast(n))  # one row
    weighted = prep.tfidf_long(vectors, F.col("n_docs"))
    return rounded(weighted.select(F.col("entity_id").alias("doc_id"), "idx", "value"))


@R.query("class_weights", """WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY ALL)
SELECT quality, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""")
def class_weights(spark, sf):
    return rounded(prep.class_weights(t.table(spark, sf, "labels"), "quality"))


@R.query("nb_multinomial", f"""WITH {TOKENS}, bag AS (
  SELECT doc_id, item, count(*) AS q, quality FROM tok JOIN labels USING (doc_id) GROUP BY ALL),
vocab AS (SELECT item FROM bag GROUP BY item HAVING count(*) >= 3),
known AS (SELECT * FROM bag JOIN vocab USING (item)),
docs AS (SELECT DISTINCT doc_id, quality FROM known),
prior AS (SELECT quality AS c, ln(count(*) + 1.0) - ln((SELECT count(*) FROM docs) + (SELECT count(DISTINCT quality) FROM docs)) AS lp
  FROM docs GROUP BY quality),
tot AS (SELECT quality AS c, sum(q) AS s FROM known GROUP BY quality),
cnt AS (SELECT quality AS c, item, sum(q) AS s FROM known GROUP BY ALL),
theta AS (SELECT tot.c, vocab.item, ln(coalesce(cnt.s, 0) + 1.0) - ln(tot.s + (SELECT count(*) FROM vocab)) AS lt
  FROM tot CROSS JOIN vocab LEFT JOIN cnt ON cnt.c = tot.c AND cnt.item = vocab.item),
score AS (SELECT k.doc_id, k.quality, theta.c, any_value(lp) + sum(k.q * lt) AS s
  FROM known k JOIN theta USING (item) JOIN prior ON prior.c = theta.c GROUP BY k.doc_id, k.quality, theta.c)
SELECT doc_id, CAST(any_value(quality) AS BIGINT) AS quality, CAST(arg_max(c, s) AS BIGINT) AS prediction FROM score GROUP BY doc_id""")
def nb_multinomial(spark, sf):
    """Multinomial naive Bayes on token counts, fitted and applied with ``pyspark.ml``."""
    labelled = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id")
    bag = materialize(token_bag(spark, sf, labelled), "nb-bag")
    vocab = materialize(prep.vocabulary(bag, 3), "nb-vocab")
    vectors = prep.sparse_vectors(prep.vectorize_long(bag, vocab), vocab.count())
    data = vectors.join(labelled.select(F.col("doc_id").alias("entity_id"), F.col("quality").cast("double").alias("label")),
                        "entity_id")
    model = NaiveBayes(modelType="multinomial", smoothing=1.0).fit(data)
    return model.transform(data).select(
        F.col("entity_id").alias("doc_id"), F.col("label").cast("bigint").alias("quality"),
        F.col("prediction").cast("bigint").alias("prediction"))


# ---------------------------------------------------------------- splits


@R.query("split_holdout", f"""WITH {t.BASE}, s AS (SELECT entity_id, y1, count(*) OVER (PARTITION BY y1) AS n,
  row_number() OVER (PARTITION BY y1 ORDER BY md5(concat_ws(':', '42', entity_id)), entity_id) AS rk FROM base)
SELECT entity_id, y1, rk <= round(n * 0.2) AS is_test FROM s""")
def split_holdout(spark, sf):
    base = t.modelling_base(spark, sf).select("entity_id", "y1")
    return folds.holdout(base, "entity_id", "y1", 0.2, seed=42)


FOLDED = f"""{t.BASE}, folded AS (
  SELECT repeat_seed, entity_id, y1, (row_number() OVER (PARTITION BY repeat_seed, y1
    ORDER BY md5(concat_ws(':', repeat_seed, entity_id)), entity_id) - 1) % 5 + 1 AS outer_fold
  FROM base, (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS repeat_seed))"""


@R.query("folds_stratified", f"""WITH {FOLDED}
SELECT repeat_seed, CAST(outer_fold AS BIGINT) AS outer_fold, 'r' || repeat_seed || '_f' || outer_fold AS fold_id, entity_id, y1 FROM folded""")
def folds_stratified(spark, sf):
    return folds.stratified_folds(t.modelling_base(spark, sf), "entity_id", "y1", 5, (1, 2, 3))


@R.query("folds_inner", f"""WITH {FOLDED}, inn AS (
  SELECT f.repeat_seed, o.k AS outer_fold, entity_id, y1 FROM folded f, (SELECT unnest(range(1, 6)) AS k) o WHERE f.outer_fold <> o.k)
SELECT repeat_seed, outer_fold, entity_id, y1, (row_number() OVER (PARTITION BY repeat_seed, outer_fold, y1
  ORDER BY md5(concat_ws(':', repeat_seed + 100, outer_fold, entity_id)), entity_id) - 1) % 3 + 1 AS inner_fold FROM inn""")
def folds_inner(spark, sf):
    outer = folds.stratified_folds(t.modelling_base(spark, sf), "entity_id", "y1", 5, (1, 2, 3))
    return folds.inner_folds(outer, "entity_id", "y1", 3)


GROUPED = f"""{t.BASE}, g AS (SELECT group_id, count(*) AS n FROM base GROUP BY ALL),
p AS (SELECT *, row_number() OVER (ORDER BY n DESC, md5(concat_ws(':', '0', group_id)), group_id) - 1 AS pos FROM g),
gf AS (SELECT group_id, n, CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END + 1 AS fold FROM p)"""


@R.query("folds_group", f"WITH {GROUPED} SELECT group_id, n, fold FROM gf")
def folds_group(spark, sf):
    return folds.group_folds(t.modelling_base(spark, sf), "group_id", 5)


@R.query("folds_group_rows", f"WITH {GROUPED} SELECT entity_id, group_id, y1, fold FROM base JOIN gf USING (group_id)")
def folds_group_rows(spark, sf):
    base = t.modelling_base(spark, sf).select("entity_id", "group_id", "y1")
    return folds.with_group_fold(base, "group_id", 5, "entity_id")


@R.query("knn_exact", """WITH d AS (SELECT a.vec_id AS q, b.vec_id AS id, b.label, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS rk FROM d) WHERE rk <= 5),
v AS (SELECT q, label, count(*) AS votes FROM top GROUP BY ALL)
SELECT v.q AS vec_id, CAST(any_value(w.label) AS BIGINT) AS prediction, round(any_value(t1.dist), 6) AS nearest
FROM v JOIN (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY votes DESC, label) AS r FROM v) w ON w.q = v.q AND w.r = 1
JOIN top t1 ON t1.q = v.q AND t1.rk = 1 GROUP BY v.q""")
def knn_exact(spark, sf):
    """Leave-one-out 5-nearest-neighbour labels of every embedding."""
    points = t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    found = materialize(neighbours.knn(points, points, 5), "knn")
    nearest = found.filter(F.col("rank") == 1).select("query_id", F.round("distance", 6).alias("nearest"))
    return neighbours.knn_vote(found).join(nearest, "query_id").withColumnRenamed("query_id", "vec_id")


KNN_SQL = """WITH d AS (SELECT a.vec_id AS q, b.vec_id AS id, b.label, {distance} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS rk FROM d) WHERE rk <= {k}),
v AS (SELECT q, label, round(sum({weight}), 9) AS votes FROM top GROUP BY ALL)
SELECT q AS vec_id, CAST(label AS BIGINT) AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY votes DESC, label) = 1"""
MANHATTAN = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE)))"


def _knn_labels(spark, sf, k: int, p: int, weights: str):
    points = t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return neighbours.knn_vote(neighbours.knn(points, points, k, p), weights).withColumnRenamed("query_id", "vec_id")


@R.query("knn_manhattan", KNN_SQL.format(distance=MANHATTAN, k=7, weight="1.0"))
def knn_manhattan(spark, sf):
    """Leave-one-out labels from the 7 nearest by absolute differences."""
    return _knn_labels(spark, sf, 7, 1, "uniform")


@R.query("knn_weighted", KNN_SQL.format(distance="list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", k=11,
                                        weight="1.0 / greatest(dist, 1e-12)"))
def knn_weighted(spark, sf):
    """Leave-one-out labels from the 11 nearest, votes weighted by inverse distance."""
    return _knn_labels(spark, sf, 11, 2, "distance")
