import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from basketwise.operators import folds, labels, neighbours, prep
from conftest import rows


def test_filter_reasons_and_label_pick(spark):
    df = spark.createDataFrame([("s1", 2, 2), ("s2", 3, 5), ("s3", 1, 3)], "id string, y1 int, y2 int")
    kept, out = prep.split_modelling(df, "y1", "y2", (2, 3, 4))
    assert rows(kept, "id") == [("s1",)]
    assert rows(out, "reason") == [("y1_out_of_range:1",), ("y2_out_of_range:5",)]
    picked = spark.createDataFrame([("x", "3.0"), ("2", "4")], "a string, b string").select(prep.pick_label(F.col("a"), F.col("b")))
    assert [r[0] for r in picked.collect()] == [3, 2]
    with pytest.raises(PySparkException):
        prep.require_labels(spark.createDataFrame([(None,)], "y int"), "y").collect()


def test_feature_inference(spark):
    df = spark.createDataFrame([(1, 2.0, True, "3", "x", 4, 5)], "y1 int, b double, a boolean, num string, txt string, epl_x int, deck_id int")
    assert prep.infer_feature_columns(df) == ["a", "b", "num"]
    gaps = spark.createDataFrame([("1", "1", None), ("", None, None)], "empty string, missing string, never string")
    assert prep.infer_feature_columns(gaps) == ["missing", "never"]


def test_dense_stage_learns_from_train_only(spark, tmp_path):
    train = spark.createDataFrame([(10.0, 0.2, 100.0, 36, 1), (30.0, 0.6, 1000.0, 38, 1)],
                                  "edhrec_rank_mean double, salt_mean double, price_total double, land_count int, constant int")
    test = spark.createDataFrame([(None, None, 5000.0, None, 1)], train.schema)
    columns = train.columns
    model = prep.DensePreprocessor(inputCols=columns).fit(train)
    state = model.fitted
    assert state["fill"] == {"edhrec_rank_mean": 20.0, "salt_mean": 0.4} and state["cap"] == pytest.approx(991.0)
    assert model.feature_names() == ["edhrec_rank_mean", "salt_mean", "price_total", "land_count"]
    got = model.transform(test).select(vector_to_array("features")).first()[0]
    assert got == pytest.approx([20.0, 0.4, 991.0, 0.0])
    path = str(tmp_path / "model")
    model.write().save(path)
    assert prep.DensePreprocessorModel.load(path).fitted == state
    scaled = prep.DensePreprocessor(inputCols=columns, scale=True).fit(train).transform(train)
    assert np.allclose(np.array([r[0] for r in scaled.select(vector_to_array("features")).collect()]).mean(axis=0), 0)


def test_vocabulary_vectors_tfidf(spark):
    data = [("a", "sol-ring"), ("a", "rare-a"), ("b", "sol-ring"), ("b", "rare-b"), ("c", "sol-ring"), ("c", "rare-a")]
    bag = spark.createDataFrame([(e, i, 1) for e, i in data], "entity_id string, item_id string, quantity int")
    vocab = prep.vocabulary(bag, 2)
    assert rows(vocab, "idx", "item_id") == [(0, "rare-a"), (1, "sol-ring")]
    test = spark.createDataFrame([("t", "sol-ring", 1), ("t", "unseen", 4), ("t", "rare-a", 0)], bag.schema)
    vec = prep.sparse_vectors(prep.vectorize_long(test, vocab), 2).first()["features"]
    assert vec.toArray().tolist() == [0.0, 1.0]
    with pytest.raises(ValueError):
        prep.vocabulary(bag, 0)
    two = spark.createDataFrame([("1", "a", 1), ("1", "b", 1), ("2", "a", 1)], bag.schema)
    got = {(r["entity_id"], r["idx"]): r["value"] for r in prep.tfidf_long(prep.vectorize_long(two, prep.vocabulary(two, 1)), 2).collect()}
    assert got[("1", 0)] == pytest.approx(0.579739, abs=1e-6) and got[("1", 1)] == pytest.approx(0.814802, abs=1e-6) and got[("2", 0)] == 1.0


def test_folds_partition_and_groups_stay_whole(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 3 + 2).alias("y"), (F.col("id") % 17).alias("g"))
    f = folds.stratified_folds(df, "id", "y", 5, (1, 2))
    assert f.count() == 400 and f.select("repeat_seed", "id").distinct().count() == 400
    sizes = [r["count"] for r in f.groupBy("repeat_seed", "outer_fold", "y").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    inner = folds.inner_folds(f, "id", "y", 3)
    assert inner.count() == 400 * 4
    assert inner.join(f, ["repeat_seed", "outer_fold", "id"]).count() == 0
    g = folds.with_group_fold(df, "g", 4, "id")
    assert g.count() == 200 and g.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    h = folds.holdout(df, "id", "y", 0.2, 1)
    assert {r["y"]: r["n"] for r in h.filter("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()} == {2: 13, 3: 13, 4: 13}


@pytest.mark.parametrize("p", [1, 2])
def test_knn_equals_brute_force_with_tiny_blocks(spark, p):
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(size=(120, 5)), np.zeros((60, 5))])  # a third of the points coincide
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(points)], "id long, vector array<double>, label long")
    got = {}
    for r in neighbours.knn(df, df, 4, p=p, pivots=6, block=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    d = np.linalg.norm(points[:, None] - points[None], axis=2) if p == 2 else np.abs(points[:, None] - points[None]).sum(axis=2)
    for i in range(len(points)):
        order = [j for j in np.lexsort((np.arange(len(points)), d[i])) if j != i][:4]
        assert [j for _, j in sorted(got[i])] == order


def test_samples_targets_and_upsert(spark):
    df = spark.range(20).select(F.format_string("snap-%02d", "id").alias("id"), (F.col("id") % 5 + 1).alias("label"))
    sample = labels.coverage_sample(df, "id", "label", 10)
    assert sample.count() == 10 and sample.select("label").distinct().count() == 5
    without = labels.coverage_sample(df, "id", "label", 10, exclude=df.filter("id = 'snap-00'"))
    assert without.filter("id = 'snap-00'").count() == 0
    ent = spark.createDataFrame([("a", None), ("b", 3)], "snapshot_id string, label int")
    state = labels.label_state(F.col("label"), F.lit(None).cast("string"))
    assert rows(labels.targets(ent, state), "snapshot_id") == [("a",)]
    assert rows(labels.targets(ent, state, refresh_existing=True), "snapshot_id") == [("a",), ("b",)]
    log = spark.createDataFrame([("a", 1, 2), ("a", 2, 4)], "snapshot_id string, at int, label int")
    assert labels.targets(ent, state, log).count() == 0
    new = labels.upsert(ent, labels.latest_labels(log, "snapshot_id", F.col("at")), "snapshot_id", ["label"])
    assert rows(new, "snapshot_id", "label") == [("a", 4), ("b", 3)]


def test_unknown_weights_and_class_weights(spark):
    df = spark.createDataFrame([(2,), (2,), (2,), (3,)], "y int")
    got = dict(rows(prep.class_weights(df, "y"), "y", "weight"))
    assert got == {2: pytest.approx(4 / 6), 3: 2.0}
    assert math.isclose(sum(r["weight"] for r in prep.with_class_weight(df, "y").collect()), 4.0)


def test_vocabulary_of_ids_with_one_prefix(spark):
    from basketwise.operators import prep

    bag = spark.range(100_000).selectExpr("id % 2 as entity_id", "concat('a-long-shared-prefix-', id div 2) as item_id", "1 as quantity")
    words = prep.vocabulary(bag, 2)
    got = [r["item_id"] for r in words.orderBy("idx").collect()]
    assert got == sorted(got) and len(got) == 50_000
    assert words.agg({"idx": "min"}).first()[0] == 0 and words.agg({"idx": "max"}).first()[0] == 49_999


def test_float_vectors_travel_as_floats_and_give_the_same_neighbours(spark, monkeypatch):
    from basketwise.operators import neighbours as nb

    points = spark.range(60).select("id", F.expr("array(cast(sin(id) as float), cast(cos(id * 3) as float))").alias("vector"),
                                    F.lit(1).alias("label"))
    whole, kept = nb.materialize, {}
    monkeypatch.setattr(nb, "materialize", lambda df, label: kept.update({label: df.schema}) or whole(df, label))
    for p in (1, 2):
        short = rows(nb.knn(points, points, 3, p))
        assert all(kept[x]["vector"].dataType.simpleString() == "array<float>" for x in ("knn-base", "knn-queries"))
        wide = points.withColumn("vector", F.col("vector").cast("array<double>"))
        assert rows(nb.knn(wide, wide, 3, p)) == short
        assert kept["knn-base"]["vector"].dataType.simpleString() == "array<double>"
