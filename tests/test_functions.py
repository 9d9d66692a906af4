import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketwise.functions import coerce, dist, sets, text
from basketwise.functions.quantiles import column_quantiles, exact_quantiles
from basketwise.functions.ranking import md5_order, spread_rank
from basketwise.functions.skew import hot_keys, join_group_values, join_to_rows, with_slices
from conftest import rows

BODY = """Commander Bracket: 4
Power Level 8.40 / 10
Tipping Point 4
Efficiency 6.20 / 10
Impact 512.34
Score 650 / 1000
Average Playability 85.5%
ERROR: Not all card data was loaded, check your formatting below

1 Lost Card
2 Other Card
Analyze List"""


def test_page_fields_and_unresolved_list(spark):
    page = spark.createDataFrame([(BODY,)], "body string")
    got = page.select(*text.extract_fields(F.col("body"), text.SCORE_PAGE_PATTERNS)).first().asDict()
    assert got == {"commander_bracket": "4", "power_level": "8.40", "tipping_point": "4", "efficiency": "6.20",
                   "impact": "512.34", "score": "650", "average_playability": "85.5"}
    names = page.select(text.extract_list(F.col("body"), text.UNRESOLVED_BLOCK, text.UNRESOLVED_LINE).alias("n")).first()["n"]
    assert names == ["Lost Card", "Other Card"]


def test_default_state_needs_every_field(spark):
    good = tuple(text.DEFAULT_STATE.values())
    bad = good[:2] + ("448",) + good[3:]
    df = spark.createDataFrame([good, bad], ", ".join(f"{c} string" for c in text.DEFAULT_STATE))
    hit = text.is_default_state({c: F.col(c) for c in text.DEFAULT_STATE})
    assert [r[0] for r in df.select(hit).collect()] == [True, False]


def test_normalize_and_signatures(spark):
    df = spark.createDataFrame([("Tokens & Extras", ["b", "a", "b"]), ("Tokens/Extras", []), ("tokens extras", None)],
                               "c string, ids array<string>")
    got = df.select(text.normalize(F.col("c")), text.signature(F.coalesce("ids", F.array().cast("array<string>"))),
                    text.id_signature(F.col("ids"))).collect()
    assert [tuple(r) for r in got] == [
        ("tokensextras", "a // b", "a|b|b"), ("tokensextras", "", "__unknown__"), ("tokensextras", "", "__unknown__")]


def test_casts(spark):
    df = spark.createDataFrame([("3",), ("3.0",), ("3.5",), ("9.5+",), ("nan",), (None,)], "x string")
    got = [tuple(r) for r in df.select(coerce.as_long(F.col("x")), coerce.as_double(F.col("x"))).collect()]
    assert got == [(3, 3.0), (3, 3.0), (None, 3.5), (None, None), (None, None), (None, None)]


def test_colors(spark):
    df = spark.createDataFrame([(["White", "U", "Purple", "W"],), ([],), (None,)], "c array<string>")
    symbols = sets.color_symbols(F.col("c"))
    got = [tuple(r) for r in df.select(symbols, sets.mask_key(sets.color_mask(symbols))).collect()]
    assert got == [(["W", "U"], "WU"), ([], "C"), ([], "C")]


@pytest.mark.parametrize("prefix", [1, 3])
def test_spread_rank_equals_plain_rank(spark, prefix):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, None).otherwise("g").alias("g"), md5_order(1, "id").alias("d"))
    got = {(r["g"], r["id"]): r["rank"] for r in spread_rank(df, ["g"], "d", ["id"], prefix_chars=prefix).collect()}
    for g in ("g", None):
        ordered = sorted((r["d"], r["id"]) for r in df.collect() if r["g"] == g)
        assert [got[(g, i)] for _, i in ordered] == list(range(1, len(ordered) + 1))


def test_exact_quantiles_small_and_sketched(spark, monkeypatch):
    from basketwise.functions import quantiles

    rng = np.random.default_rng(0)
    values = np.round(rng.lognormal(size=5000), 3)
    data = [("a" if i % 4 else None, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    probs = [0.0, 0.2, 0.5, 0.99, 1.0]
    for small in (100_000, 10):  # the second value forces the sketched brackets
        monkeypatch.setattr(quantiles, "SMALL_GROUP", small)
        got = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
        for g in ("a", None):
            mine = [v for k, v in data if k == g]
            for p in probs:
                assert got[(g, p)] == pytest.approx(np.percentile(mine, p * 100), abs=1e-12)
    one = {r["column"]: r["quantile"] for r in column_quantiles(spark.createDataFrame([(1.0, None), (2.0, 5.0), (10.0, 7.0)], "a double, b double"), ["a", "b"], [0.99]).collect()}
    assert one["a"] == pytest.approx(9.84) and one["b"] == pytest.approx(6.98)


def test_hot_keys_are_sliced_and_nothing_is_lost(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    assert rows(hot_keys(df, ["k"], 100), "k") == [(0,)]
    sliced = with_slices(df, ["k"], F.col("id"), 100)
    sizes = {(r["k"], r["slice"]): r["count"] for r in sliced.groupBy("k", "slice").count().collect()}
    assert sum(sizes.values()) == 900 and len([1 for k, _ in sizes if k == 0]) == 3
    groups = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    for joined in (join_group_values(df, groups, ["k"], "n", F.col("id"), 100),
                   join_to_rows(df, groups, ["k"], F.col("id"), 100)):
        assert joined.count() == 900 and joined.filter("k = 0 AND top = 897").count() == 300


def test_tails(spark):
    df = spark.createDataFrame([(0.3,), (1.96,), (2.9,), (3.1,), (8.0,)], "x double")
    for x, p in df.select("x", dist.normal_sf(F.col("x"))).collect():
        assert p == pytest.approx(0.5 * math.erfc(x / math.sqrt(2)), rel=1e-9)
    got = spark.range(1).select(dist.chi2_sf(F.lit(158.83589743589744), 11), dist.chi2_sf(F.lit(3.0), 2)).first()
    assert got[0] == pytest.approx(2.3173653163241833e-28, rel=1e-6) and got[1] == pytest.approx(math.exp(-1.5))
    one = spark.range(1).select(dist.chi2_sf(F.lit(1.0), 1), dist.chi2_sf(F.lit(2.0), 3)).first()
    assert one[0] == pytest.approx(0.31731050786291415) and one[1] == pytest.approx(0.5724067044708798)


def test_studentized_range(spark):
    for k, q in dist.NEMENYI_Q_05.items():
        assert dist.studentized_range_q(k) == pytest.approx(q, abs=1e-3)
    got = spark.createDataFrame([(1,), (2,), (16,), (40,), (201,)], "k long").select(dist.nemenyi_q(F.col("k"))).collect()
    assert got[0][0] is None and got[1][0] == 1.96 and got[2][0] == pytest.approx(3.426, abs=2e-3) and got[3][0] > 3.8 and got[4][0] is None
