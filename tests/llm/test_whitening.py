import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketwise.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string, x string, n string"


def brute(rows, weights="count", most=32):
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in usable]
    fit = xs if weights == "count" else [list(x) for x in {tuple(x) for x in xs}]
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    y = np.array([[float(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    cov = y.T @ y / n
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    own = np.array([[float(n * c - s) / n for c, s in zip(x, sums)] for x in xs])
    z = own @ vector / np.sqrt(value)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in xs]
    return [i for i, _ in usable], n, deviation, z, value / np.trace(cov)


def check(got, rows, **kw):
    ids, n, deviation, z, explained = brute(rows, **kw)
    assert len(got) == z.size
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append((r["vec_id"], r["deviation"], r["whitened"], r["explained"], r["n"]))
        assert r["identity_error"] <= 1e-4
    assert sorted(by) == list(range(1, z.shape[1] + 1))
    for c, own in by.items():
        want = sorted(zip(ids, deviation, z[:, c - 1]), key=lambda t: (str(t[0]), abs(t[2])))
        own = sorted(own, key=lambda t: (str(t[0]), abs(t[2])))
        assert [t[:2] for t in own] == [t[:2] for t in want] and {t[4] for t in own} == {n}
        sign = np.sign(sum(a[2] * b[2] for a, b in zip(own, want)))
        assert max(abs(sign * a[2] - b[2]) for a, b in zip(own, want)) < 1e-8
        assert abs(own[0][3] / explained[c - 1] - 1) < 1e-9


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    mixed = rng.standard_normal((400, 40)) @ rng.standard_normal((40, 40))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # one vector holds a large part of the table
    rows += [(2000, None), (2001, [None, *rows[0][1][1:]]), (2002, [float("nan"), *rows[0][1][1:]]),
             (2003, [float("-inf"), *rows[0][1][1:]]), (5, rows[9][1]), (None, rows[3][1]), (6, rows[6][1])]
    return rows


@pytest.mark.parametrize("weights", ["count", "one"])
def test_same_as_numpy(spark, rows, weights):
    frame = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA).repartition(3)
    check(whitening.whiten(frame, whitening.WhiteningSpec(weights=weights)).collect(), rows, weights=weights)


def test_whitened_is_white_on_the_given_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = whitening.whiten(frame, whitening.WhiteningSpec(components=5))
    check(got.collect(), [tuple(r) for r in frame.select("vec_id", "embedding").collect()], most=5)


def test_odd_rows(spark):
    make = lambda rows: spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        got = whitening.whiten(make(rows))
        assert got.columns == columns and got.count() == 0
    # another length takes no part; a dimension without spread gives no component
    rows = [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0]), (4, [1.0, 2.0, 3.0])]
    got = whitening.whiten(make(rows)).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["component"], r["n"]) for r in got] == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]
    assert [r["deviation"] for r in got] == [(3 * 64) ** 2, 0, (3 * 64) ** 2] and got[0]["explained"] == 1.0
    # entries far out: exact where a long can hold the result, else null
    far = whitening.whiten(make([(1, [3e38, 1.0]), (2, [-3e38, 5.0]), (3, [1e9, 2.0])])).filter("component = 1")
    assert [r["deviation"] for r in far.collect()] == [None] * 3
    large = whitening.whiten(make([(1, [1e6, 0.0]), (2, [-1e6, 0.0])])).collect()
    assert [r["deviation"] for r in large] == [(2 * 64_000_000) ** 2] * 2
    assert far.filter(F.isnan("whitened")).count() == 0
