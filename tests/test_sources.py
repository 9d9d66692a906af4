"""Exact places in split files, publishing by several writers, bucketed joins, merged sketches."""

import json
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from basketwise import session
from basketwise.functions import distinct
from basketwise.operators import features
from basketwise.sources import numbered, tables

from conftest import rows


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "100"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_line_numbers_across_splits(spark, tmp_path, small_splits):
    lines = [json.dumps({"a": i}) if i % 7 else "" for i in range(400)]
    lines[300] = '{"a": oops'
    path = tmp_path / "in"
    path.mkdir()
    (path / "one.jsonl").write_text("\n".join(lines) + "\n")
    (path / "two.jsonl").write_text('{"a": 1}\n[1]\r\n\n{"a": 2}')
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 3
    found = numbered.number_lines(spark, str(path)).select(F.regexp_extract("source_file", r"(\w+)\.jsonl$", 1), "line_number", "line")
    want = [("one", i + 1, x) for i, x in enumerate(lines)] + [("two", i + 1, x) for i, x in enumerate(['{"a": 1}', "[1]", "", '{"a": 2}'])]
    assert rows(found) == sorted(want, key=str)
    assert sorted((r["source_file"][-9:], r["line_number"]) for r in numbered.broken_lines(spark, str(path)).collect()) == [
        ("one.jsonl", 301), ("two.jsonl", 2)]


def test_strict_scan_names_the_broken_line(spark, tmp_path, small_splits):
    good = ['{"line_number": %d}' % i for i in range(200)] + [" "]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(good))
    read = numbered.read_jsonl_located(spark, str(path), "line_number long")
    assert read.columns == ["line_number", "source_file", "__line_number"]
    assert rows(read, "line_number", "__line_number") == sorted(((i, i + 1) for i in range(200)), key=str)
    path.write_text("\n".join([*good, '{"line_number": oops']))
    broken = numbered.read_jsonl_located(spark, str(path), "line_number long")
    for use in (broken, broken.select("source_file"), broken.groupBy().count()):
        with pytest.raises(Exception, match="malformed line 202 of .*x.jsonl"):
            use.collect()
    assert numbered.read_jsonl_located(spark, str(tmp_path / "none"), "a long").count() == 0


IDS = ["a", "b,c", 'q"x,y', "back\\,\\", "é,,,", "]", "[,", " pad ", "", "new\nline, here"]


@pytest.mark.parametrize("style", [{}, {"indent": 1}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_id_array_across_splits(spark, tmp_path, small_splits, style):
    ids = [f"{IDS[i * i % 10]}{i if i % 10 else ''}" for i in range(700)] + [5, None, "z]"]
    path = tmp_path / "ids.json"
    path.write_text(json.dumps(ids, **style) + "\n", encoding="utf-8")
    got = [(r["ordinal"], r["id"]) for r in numbered.read_id_array(spark, str(path)).orderBy("ordinal").collect()]
    assert got == [(i, None if x is None else str(x)) for i, x in enumerate(ids)]


def test_id_array_edges(spark, tmp_path):
    path = tmp_path / "ids.json"
    for text, want in ((" [ ]\n", []), ('["a"]', [(0, "a")]), ('[\n1 ,\n"x, y"\n]\n', [(0, "1"), (1, "x, y")])):
        path.write_text(text)
        assert rows(numbered.read_id_array(spark, str(path)), "ordinal", "id") == want
    path.write_text('["a", oops]')
    with pytest.raises(Exception, match="no JSON value at ordinal 1"):
        numbered.read_id_array(spark, str(path)).collect()


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "table")
    assert tables.current_version(spark, root) == 0 and tables.versions(spark, root).count() == 0
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: tables.publish(spark.range(i, i + 1), root), range(6)))
    assert rows(tables.versions(spark, root), "version") == [(v,) for v in range(1, 7)]
    assert sorted(tables.current(spark, root, v).first()[0] for v in range(1, 7)) == list(range(6))


def test_a_stale_base_is_refused(spark, tmp_path):
    root = str(tmp_path / "table")
    tables.publish(spark.range(1), root, based_on=0)
    tables.publish(spark.range(2), root, based_on=1)
    with pytest.raises(tables.PublishConflict):
        tables.publish(spark.range(3), root, based_on=1)
    assert tables.current(spark, root).count() == 2 and tables.current_version(spark, root) == 2
    assert tables._claim(spark, f"{root}/_versions", "000000000002.json", "{}") is False
    assert not [p for p in (tmp_path / "table" / "_versions").iterdir() if re.match(r"\.[0-9a-f]{32}$", p.name)]


def test_bucketed_join_moves_no_rows(spark):
    lines = spark.range(400).select((F.col("id") % 7).alias("entity_id"), F.col("id").alias("line_id"), F.lit("i").alias("item_id"), F.lit(1).alias("quantity"))
    detail = lines.filter("line_id % 3 = 0").select("entity_id", "line_id", F.col("line_id").alias("price"))
    keys = ["entity_id", "line_id"]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = features.join_detail(session.bucketed(lines, "lines", keys), session.bucketed(detail, "detail", keys))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        got = rows(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert got == rows(features.join_detail(lines, detail)) and len(got) == 400


def test_sketches_merge_like_one_pass(spark, tmp_path):
    df = spark.range(30000).select((F.col("id") % 3).alias("g"), (F.col("id") % 20011).alias("v"),
                                   F.when(F.col("id") % 2 == 0, F.lit("x")).alias("w"))
    for k in range(4):
        distinct.sketches(df.filter(F.col("v") % 5 >= k), ["g"], ["v", "w"]).write.mode("append").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    total = distinct.merged(stored, [], ["v", "w"]).first()
    assert abs(total["n_v"] - 20011) < 4 * distinct.standard_error() * 20011 and total["n_w"] == 1
    assert distinct.merged(stored, ["g"], ["v"]).count() == 3
    once = distinct.sketches(df, [], ["v"])
    assert distinct.merged(once, [], ["v"]).first()[0] == total["n_v"]
