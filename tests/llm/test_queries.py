"""Registered text queries: SQL twins, brute force where SQL has no words, and the whole pipeline."""

import importlib.util
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

import check_oracles  # noqa: E402
import corpus_pipeline  # noqa: E402
from basketwise.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in queries.ORACLES if queries.ORACLES[n]))
def test_same_rows_as_sql(spark, name):
    con = check_oracles.connect(SF)
    status, note, _ = check_oracles.compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert status in ("ok", "EMPTY"), note


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert "pipeline" not in queries.ORACLES
    assert importlib.util.find_spec("basketwise.llm.queries")


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    states = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids
        states.append(now)
        ids = now
    assert len(states[0]) >= 190 and states[1] < states[0] and states[2] == states[1] == states[3]
    assert docs.filter(F.col("text").rlike('token = "[0-9a-fA-F]{40}"')).count() == 0
    pieces = corpus_pipeline.packing(spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == ids
    whole = corpus_pipeline.run(spark, SF)
    order = ["sequence_id", "offset"]
    assert [tuple(r) for r in whole.orderBy(order).collect()] == [tuple(r) for r in pieces.orderBy(order).collect()]
