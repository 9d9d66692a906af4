"""Sources, sinks, streams, models and plan shape."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from basketwise.functions.ranking import top_per_group
from basketwise.operators import features, interpret, models, search
from basketwise.sources import jsonl, modelruns, tables
from basketwise.streaming import incremental as inc
from conftest import rows


def test_jsonl_strict_quarantine_and_order(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y"}\n')
    assert rows(jsonl.read_jsonl(spark, str(good), "a long, b string")) == [(1, "x"), (2, "y")]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a long").count() == 0
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n{"a": oops\n')
    with pytest.raises(Exception, match="bad.jsonl"):
        jsonl.read_jsonl(spark, str(bad), "a long").collect()
    ok, broken = jsonl.read_jsonl_quarantine(spark, str(bad), "a long")
    assert rows(ok) == [(1,)] and [r["line"] for r in broken.collect()] == ['{"a": oops']
    ordered = jsonl.with_file_order(jsonl.read_jsonl(spark, str(good), "a long, b string"))
    assert [r["a"] for r in ordered.orderBy("position").collect()] == [1, 2]


def test_sinks_ids_inventory_and_publish(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    out = str(tmp_path / "out")
    jsonl.append_jsonl(df, out)
    jsonl.append_jsonl(df, out)
    assert spark.read.text(out).first()[0] == '{"a":"x","b":1}' and spark.read.text(out).count() == 2
    jsonl.replace_jsonl(df, out)
    assert spark.read.text(out).count() == 1
    ids = tmp_path / "ids.json"
    ids.write_text('[\n"s2",\n"s1"\n]')
    assert [r["id"] for r in jsonl.read_id_list(spark, str(ids)).orderBy("ordinal").collect()] == ["s2", "s1"]
    jsonl.write_id_list(spark.createDataFrame([("q", 1), ("p", 0)], "s string, o int"), str(tmp_path / "idt"), "s", F.col("o"))
    assert [r["id"] for r in jsonl.read_id_table(spark, str(tmp_path / "idt")).orderBy("ordinal").collect()] == ["p", "q"]
    lines = tmp_path / "l.txt"
    lines.write_text("a\n\nb\n")
    inv = {r["path"]: (r["exists"], r["n_lines"], r["size"]) for r in jsonl.file_inventory(spark, [str(lines), str(tmp_path / "no")]).collect()}
    assert inv == {str(lines): (True, 2, 5), str(tmp_path / "no"): (False, None, None)}
    root = str(tmp_path / "table")
    assert tables.current(spark, root) is None
    tables.publish(df, root)
    held = tables.current(spark, root)
    tables.publish(held.withColumn("b", F.col("b") + 1), root)
    assert rows(tables.current(spark, root), "b") == [(2,)] and rows(held, "b") == [(1,)]
    watched, watch = tables.observed(spark.range(10), "w", n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    tables.write_table(watched, str(tmp_path / "w"), overwrite=True)
    now = datetime.now(timezone.utc)
    summary = tables.run_summary(spark, "step", {"x": 1}, watch.get, now, now).first()
    assert summary["counters"] == {"n": 10, "odd": 5} and json.loads(summary["params"]) == {"x": 1}
    tables.export_json(df, str(tmp_path / "e"), "b")
    assert json.loads(spark.read.text(str(tmp_path / "e")).first()[0]) == {"b": 1, "json": '{"a":"x"}'}


def test_model_run_scans(spark, tmp_path):
    for model, f1 in (("df_a", 0.5), ("bc_b", 0.6)):
        d = tmp_path / "runs" / model
        d.mkdir(parents=True)
        (d / "metrics_per_fold.json").write_text(json.dumps(
            {"aggregate": {"x": "1"}, "folds": [{"fold_id": "r1_f1", "macro_f1": f1, "confusion_matrix": [[1, 2]]}]}, indent=1))
    got = rows(modelruns.read_fold_metrics(spark, str(tmp_path / "runs")), "model_id", "macro_f1")
    assert got == [("bc_b", 0.6), ("df_a", 0.5)]
    preds = spark.createDataFrame([("m1", 1), ("m2", 2)], "model_id string, y_pred int")
    modelruns.write_predictions(preds, str(tmp_path / "oof"))
    one = modelruns.read_predictions(spark, str(tmp_path / "oof"), ["m2"])
    assert rows(one, "y_pred") == [(2,)] and "PartitionFilters: [isnotnull(model_id" in one._jdf.queryExecution().toString()


def _events(spark, path, data):
    spark.createDataFrame(data, "k string, at int, v int").coalesce(1).write.mode("append").parquet(path)


def test_streams_over_several_batches(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "k string, at int, v int"
    first, second = [("a", 1, 1), ("a", 2, 2), ("b", 1, 5)], [("a", 3, 9), ("b", 1, 7), ("c", 1, 1)]
    for data in (first, second):
        _events(spark, src, data)
        inc.dedup_stream(inc.file_stream(spark, src, schema, "parquet"), ["k"], F.col("at"), f"{tmp_path}/d", f"{tmp_path}/cd")
        inc.label_stream(inc.file_stream(spark, src, schema, "parquet"), "k", F.col("at"), f"{tmp_path}/l", f"{tmp_path}/cl")
        inc.counter_stream(inc.file_stream(spark, src, schema, "parquet"), ["k"], f"{tmp_path}/c", f"{tmp_path}/cc")
    assert rows(inc.read_table(spark, f"{tmp_path}/d"), "k", "at", "v") == [("a", 1, 1), ("b", 1, 5), ("c", 1, 1)]
    latest = {r["k"]: r["at"] for r in inc.current_labels(spark, f"{tmp_path}/l", "k", F.col("at")).collect()}
    assert latest == {"a": 3, "b": 1, "c": 1}
    assert rows(inc.current_counters(spark, f"{tmp_path}/c", ["k"])) == [("a", 3), ("b", 2), ("c", 1)]


def test_stream_window_counts(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 1), "x", 1.0), (datetime(2024, 1, 2, 1), "x", 2.0), (datetime(2024, 1, 9), "y", 4.0)],
                               "ts timestamp, kind string, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = inc.window_counts(inc.file_stream(spark, f"{tmp_path}/in", df.schema, "parquet"), "ts", ["kind"], value="value")
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck") \
        .outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = spark.read.parquet(f"{tmp_path}/out")
    assert rows(closed, "kind", "n", "total") == [("x", 1, 1.0), ("x", 1, 2.0)]  # the last window is still open
    assert inc.window_counts(df, "ts", ["kind"], value="value").count() == 3


@pytest.fixture(scope="module")
def ninety(spark):
    data = [(f"s{i:02d}", i % 15, 2 + i % 3, 2 + (i // 3) % 3, float(i % 7), float(2 + i % 3), {f"card_{2 + i % 3}": 1, f"shared_{i % 5}": 1})
            for i in range(90)]
    return spark.createDataFrame(data, "entity_id string, g int, y1 int, y2 int, feature_a double, feature_b double, counts map<string,long>")


def test_nested_cv_and_resume(spark, tmp_path, ninety):
    spec = search.SearchSpec(columns=["feature_a", "feature_b"], outer_k=2, inner_k=2, seeds=(1,), min_df=1,
                             grids={"decision_tree": [{"max_depth": 2}], "naive_bayes": [{"alpha": 1.0}]})
    plan, out = [("df", "decision_tree"), ("bc", "naive_bayes")], str(tmp_path / "cv")
    first = search.nested_cv(ninety, plan, spec, out)
    assert first["fold_metrics"].count() == 4
    for model in ("df_decision_tree", "bc_naive_bayes"):
        oof = first["oof"].filter(F.col("model_id") == model)
        assert oof.count() == 90 and oof.select("entity_id").distinct().count() == 90
    assert first["fold_metrics"].agg(F.min("macro_f1")).first()[0] == 1.0
    attempts = rows(first["fold_metrics"], "attempt")
    again = search.nested_cv(ninety, plan, spec, out)
    assert rows(again["fold_metrics"], "attempt") == attempts and again["cv_results"].count() == 4
    changed = search.SearchSpec(columns=["feature_a"], outer_k=2, inner_k=2, seeds=(1,), grids=spec.grids)
    assert changed.signature("decision_tree", "df") != spec.signature("decision_tree", "df")


def test_importance_and_failures(spark, ninety):
    spec = search.SearchSpec(columns=["feature_a", "feature_b"], seeds=(1,))
    model = search.final_model(ninety, spec, "decision_tree", "df", {"max_depth": 2})
    got = dict(rows(search.permutation_importance(model, ninety, spec, repeats=2, block=1), "column", "importance"))
    assert got["feature_b"] > 0.3 and abs(got["feature_a"]) < 1e-9
    spot = search.spot_check(ninety, [("bc", "naive_bayes"), ("df", "decision_tree")], spec, min_dfs=(1000,))
    assert {r["algorithm"]: r["status"] for r in spot.collect()} == {"naive_bayes": "error", "decision_tree": "ok"}


def test_grids_stay_in_budget():
    for representation in ("df", "bc"):
        for algorithm in ("decision_tree", "gradient_boosting", "knn", "logistic_regression", "random_forest", "linear_svc", "naive_bayes"):
            full = models.param_grid(algorithm, representation)
            assert 1 <= len(full) <= models.MAX_CONFIGS
            assert len(models.param_grid(algorithm, representation, first_values=1)) == 1


def test_lift_with_hot_entity(spark):
    bag = spark.createDataFrame([(e, f"i{j}", 1) for e in range(12) for j in range(1 + e % 2)], "entity_id long, item_id string, quantity long")
    oof = spark.createDataFrame([(e, 2 + e % 2, 2) for e in range(12) for _ in range(3)], "entity_id long, y_pred long, y2 long")
    got = {(r["label"], r["item_id"]): r["lift"] for r in interpret.class_lift(oof, bag, min_entities=6).collect()}
    assert got[(3, "i1")] == pytest.approx(2.0) and got[(2, "i0")] == pytest.approx(1.0) and (2, "i1") not in got


def test_plan_shape(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    top = top_per_group(df, ["g"], [F.col("id").desc()], 5)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    sf = "/root/testdata/sf0.001"
    from basketwise.plans import tables as t

    plan = features.bag_long(t.lines(spark, sf))._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.splitlines() if "ReadSchema" in x][0]
    assert "l_extendedprice" not in scan and "l_partkey" in scan
