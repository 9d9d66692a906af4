"""Steps that must not grow faster than their input: boxes, folds, texts dealt once, words kept."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketwise.operators import models, neighbours, prep, search
from basketwise.plans import q_prep


@pytest.mark.parametrize("p", [1, 2])
def test_short_vectors_visit_few_boxes_and_lose_nothing(spark, monkeypatch, p):
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((3000, 3)), 1)  # rounded, so that many distances tie
    x[100:140] = x[100]
    kept = {}
    plain = neighbours.materialize
    monkeypatch.setattr(neighbours, "materialize", lambda df, label: kept.setdefault(label, plain(df, label)))
    monkeypatch.setattr(neighbours, "BOX_ROWS", 60)
    base = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, vector array<double>, label long")
    asked = base.filter("id % 10 = 0").select("id", "vector")
    found = {}
    for r in neighbours.knn(base, asked, 4, p).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["distance"]))
    assert len(found) == 300
    for q, got in found.items():
        d = np.abs(x - x[q])
        d = np.sqrt((d * d).sum(axis=1)) if p == 2 else d.sum(axis=1)
        want = sorted((float(d[i]), i) for i in range(len(x)) if i != q)[:4]
        assert [i for _, i, _ in sorted(got)] == [i for _, i in want]
    cells = kept["knn-base"].select("cell").distinct().count()
    assert cells > 30 and kept["knn-visits"].count() < 300 * cells / 3


def test_fewer_points_than_neighbours(spark):
    few = spark.createDataFrame([(1, [0.0], 0), (2, [0.0], 1), (3, [5.0], 1)], "id long, vector array<double>, label long")
    got = neighbours.knn(few, few.select("id", "vector"), 5).select("query_id", "rank", "id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]


def test_a_repeat_is_joined_once(spark, monkeypatch, tmp_path):
    labels = []
    plain = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, label: labels.append(label) or plain(df, label))
    data = spark.range(60).select(F.col("id").alias("entity_id"), (F.col("id") % 3 + 2).alias("y1"), (F.col("id") % 3 + 2).alias("y2"),
                                  (F.col("id") % 7).cast("double").alias("a"))
    spec = search.SearchSpec(columns=["a"], outer_k=2, inner_k=2, seeds=(1,), grids={"naive_bayes": [{"var_smoothing": 1e-9}]})
    oof = search.nested_cv(data, [("df", "naive_bayes")], spec, str(tmp_path / "out"))["oof"]
    assert labels.count("cv-rows") == 1 and labels.count("inner") == 2
    assert sorted(r["entity_id"] for r in oof.collect()) == list(range(60))


def test_widest_variance_from_the_classes(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(50, 3, (200, 2)) * [1, 20], rng.integers(0, 3, 200)
    x[y == 1] += 40
    rows = prep.array_to_vector(F.col("x")).alias("features")
    data = spark.createDataFrame([(v.tolist(), float(k)) for v, k in zip(x, y)], "x array<double>, label double").select(rows, "label")
    model = models.GaussianBayes.fit(data, 0.5)
    want = [x[y == k].var(axis=0) + 0.5 * x.var(axis=0).max() for k in range(3)]
    assert np.allclose(model.variances, want, rtol=1e-12)
    with pytest.raises(ValueError):
        models.GaussianBayes.fit(data.limit(0))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_by_document_and_lengths_need_no_join(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, None), (None, "a")], "doc_id long, text string")
    bag = q_prep.token_bag(spark, "", docs)
    assert plan(bag).count("Exchange") == 1
    assert sorted(map(tuple, bag.collect()), key=str) == sorted(
        [(1, "a", 2), (1, "b", 2), (1, "c", 1), (None, "a", 1)], key=str)
    long = spark.createDataFrame([(1, 0, 3.0, 2), (1, 1, 4.0, 2), (None, 0, 1.0, 2)], "entity_id long, idx long, value double, df long")
    out = prep.tfidf_long(long, 2)
    assert "Join" not in plan(out)
    assert sorted((r["entity_id"], r["idx"], round(r["value"], 9)) for r in out.collect()) == [(1, 0, 0.6), (1, 1, 0.8)]


def test_words_in_use_stay_known():
    from basketwise.llm import curve_packing
    words = curve_packing.WordIds.__new__(curve_packing.WordIds)
    words.remember, words.marks, words.older, words.plain, asked = 2, {}, {}, False, []
    words.tokenizer = SimpleNamespace(encode=lambda text, add_special_tokens: asked.append(text) or SimpleNamespace(ids=[len(asked)]))
    first = [words.encode(t).tolist() for t in ("a b c", "a d", "a")]
    assert first == [[1, 2, 3], [1, 4], [1]] and asked == ["a", "b", "c", "d"]


def test_plain_words_need_no_matching(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from basketwise.llm import curve_packing
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    marks = curve_packing.WordIds.MARKS.decode()
    plain = ["word", "Word", "WORD,", "word...", "a", "I", *[f"Mark{m}{m}" for m in marks], f"all{marks}"]
    other = ["it's", "don't.", "end'", "Stra\u00dfe,", "\u00c9t\u00e9!", "e\u0301", "x1", "(in)", "a-b", "7", "a<|endoftext|>", "\u0130st."]
    words = curve_packing.WordIds(path)
    for text in other:
        assert words.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(curve_packing.WordIds, "LETTERS", None)  # any use of the pattern fails from here on
    for text in plain:
        assert words.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_model_rows_combine_only_lines_of_the_base(spark, monkeypatch, tmp_path):
    from basketwise.operators import features, folds
    from basketwise.plans import q_features, q_models
    from basketwise.plans import tables as t

    sf = str(tmp_path)
    orders = [(k, k % 7, float(50_000 + 40_000 * (k % 9)), f"{1 + k % 5}-X") for k in range(60)]
    orders += [(12, 1, 150_000.0, "1-X"), (12, 2, 150_000.0, "2-X"), (None, 3, 150_000.0, "2-X"), (71, 3, 250_000.0, "3-X")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").select(
        "*", F.lit("O").alias("o_orderstatus"), F.lit("2020-01-01").cast("timestamp").alias("o_orderdate")).write.parquet(f"{sf}/orders.parquet")
    lines = [(k if k < 60 else None, (k * n) % 25, n % 4 + 1, float(n + 1), 10.5 * n + k, 0.01 * (n % 11), "ANR"[n % 3])
             for k in range(61) for n in range(k % 6)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                 "l_discount double, l_returnflag string").write.parquet(f"{sf}/lineitem.parquet")
    parts = [(k, f"old blue {k % 3}", f"B{k % 4}", ("ECONOMY", "LARGE", "PROMO")[k % 3], k % 20, 90.0 + k) for k in range(20)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double") \
        .write.parquet(f"{sf}/part.parquet")

    seen, split = [], []
    combine = features.bag_long
    monkeypatch.setattr(features, "bag_long", lambda df, *a: seen.append(df) or combine(df, *a))
    got = q_models.modelling_data(spark, sf)
    base = {r[0] for r in t.modelling_base(spark, sf).select("entity_id").collect()}
    assert len(seen) == 2 and all({r[0] for r in df.select("entity_id").collect()} <= base - {None} for df in seen)
    whole = q_features.base_features(spark, sf, q_models.GROUPS).select(*[c for c in got.columns if c != "counts"])
    maps = features.bag_map(combine(t.lines(spark, sf))).select("entity_id", "counts")
    expected = whole.join(maps, "entity_id", "left").withColumn("bag", F.sort_array(F.map_entries("counts"))).drop("counts")
    plain = lambda df: sorted(([str(v) for v in r[:-1]], [(str(i), q) for i, q in sorted((int(i), q) for i, q in r[-1] or [])])
                              for r in df.collect())
    assert got.count() > 15 and plain(got.withColumn("bag", F.map_entries("counts")).drop("counts")) == plain(expected)

    def dealt(df, *a, **k):
        split.extend(df.columns)
        raise StopIteration

    monkeypatch.setattr(q_models, "modelling_data", lambda *a: got)
    monkeypatch.setattr(folds, "holdout", dealt)
    with pytest.raises(StopIteration):
        q_models.permutation_importance(spark, sf)
    assert split == ["entity_id", *q_models.COLUMNS, "y1"]  # trees take no bags


@pytest.mark.parametrize("p", [1, 2])
def test_a_query_travels_once_to_a_group_of_cells(spark, monkeypatch, p):
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((900, 20)), 1)
    x[50:70] = x[50]
    base = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, vector array<float>, label long")
    searched = []
    plain = neighbours._search
    monkeypatch.setattr(neighbours, "_search", lambda b, q, *a: searched.append((b, q)) or plain(b, q, *a))
    got = {}
    for r in neighbours.knn(base, base.filter("id % 9 = 0").select("id", "vector"), 4, p, pivots=30, block=60).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    x = x.astype(np.float32).astype(np.float64)
    assert len(got) == 100
    for q, ranked in got.items():
        d = np.abs(x - x[q])
        d = np.sqrt((d * d).sum(axis=1)) if p == 2 else d.sum(axis=1)
        assert [i for _, i in sorted(ranked)] == [i for _, i in sorted((float(d[i]), i) for i in range(len(x)) if i != q)[:4]]
    # without structure nearly all cells are visited, but a query is sent to groups only: three, of 300 points each at most
    groups = searched[1][0].select("cell").distinct().count()
    assert groups < 10 and searched[1][1].count() <= 100 * groups and searched[1][1].selectExpr("sum(size(parts)) n").first()["n"] > 1000
    assert {c for c, in searched[1][1].select("limit").collect()} - {float("inf")}


def test_cells_are_grouped_by_their_place():
    centres = np.array([[0.0, 9.0], [0.1, 1.0], [0.2, 5.0], [0.0, 3.0]])
    assert neighbours.cell_groups(centres, {0: 10, 1: 4, 2: 50, 3: 6}, 12) == {1: 0, 3: 0, 2: 1, 0: 2}
    assert neighbours.cell_groups(centres, {}, 12) == {}


def test_absolute_differences_in_four_bytes_are_within_their_bound():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((70, 40)) * 50, rng.standard_normal((1500, 40)) * 50
    exact, bound = neighbours._distances(a, b, 1), neighbours._single(a, b)
    assert np.allclose(neighbours._rough(a, b, 1), exact, rtol=1e-12)
    assert 0 < np.abs(neighbours._rough(a, b, 1, np.float32) - exact).max() < bound / 2
    assert neighbours._single(a * 1e30, b) is None and neighbours._single(a * np.nan, b) is None


def test_points_that_four_bytes_do_not_tell_apart(spark):
    rng = np.random.default_rng(4)
    x = 1e9 + rng.standard_normal((1500, 18))  # next to each other far from zero
    base = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, vector array<double>, label long")
    got = {}
    for r in neighbours.knn(base, base.filter("id < 40").select("id", "vector"), 2, 1, pivots=1).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for q, ranked in got.items():
        d = np.abs(x - x[q]).sum(axis=1)
        assert [i for _, i in sorted(ranked)] == [i for _, i in sorted((float(d[i]), i) for i in range(len(x)) if i != q)[:2]]
    assert len(got) == 40
