"""Curation steps whose work per line must not repeat: one parse a line, one category list a record, one batch a build."""

from pyspark.sql import functions as F

from basketwise.functions import sets
from basketwise.operators import curate
from basketwise.plans import q_ingest
from basketwise.sources import jsonl
from basketwise.sources.schemas import RAW_DETAILS


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_line_is_parsed_once(spark, tmp_path):
    texts = ['{"deck_id": "1"}', "", "  ", '{"deck_id": oops', '["x"]', '{"deck_id": {"a": 1}, "status": "200"}', '{"status": 5}']
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    good, bad = jsonl.read_jsonl_quarantine(spark, str(tmp_path / "in"), RAW_DETAILS)
    assert plan(good).count("from_json(") == 1
    assert sorted((r["deck_id"], r["status"]) for r in good.fillna("").collect()) == [("", "5"), ("1", ""), ('{"a":1}', "200")]
    assert sorted(r["line"] for r in bad.collect()) == ['["x"]', '{"deck_id": oops']


def test_categories_of_a_record_are_worked_out_before_its_lines(spark):
    raw = spark.createDataFrame([], RAW_DETAILS).withColumn("entity_id", F.lit(1)).withColumn("record_id", F.lit(1))
    # the sorted list stands below the explode, that is further down in the plan
    text = plan(curate.raw_lines(curate.unwrap(raw)).select("exclusion", "is_lead"))
    assert "array_sort" not in text[:text.find("Generate")]


def test_own_categories_and_colours(spark):
    lists = spark.createDataFrame([(None,), ([],), ([("Cat B", False, True), (None, False, True), ("Sideboard!", False, None)],)],
                                  "c array<struct<name string, includedInDeck boolean, isPremier boolean>>")
    boards = ["maybeboard", "sideboard", "tokensandextras", "tokensextras"]
    got = [tuple(r) for r in lists.select(curate.excluded_categories(F.col("c")), curate.lead_categories(F.col("c"))).collect()]
    assert got == [(boards, ["commander"])] * 2 + [(["catb", *boards, None], ["catb", "commander", None])]
    colours = spark.createDataFrame([(x,) for x in (None, [], [None, "Red"], ["W", "White", "Gold"], ["Green", "U", None])], "c array<string>")
    for old, new in colours.select(sets.color_mask(sets.color_symbols(F.col("c"))), sets.color_bits(F.col("c"))).collect():
        assert old == new


def test_batches_of_records_are_built_alone_and_whole(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(k, k % 7, 50_000.0 + k, f"{1 + k % 5}-X") for k in [*range(1, 210), 11]],
                          "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").select(
        "*", F.lit("O").alias("o_orderstatus"), F.lit("2020-01-01").cast("timestamp").alias("o_orderdate")).write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame([(k, (k * n) % 25, n, float(n * 10), 0.05 * n, 0.08 * (n % 2), "ANR"[n % 3], "OF"[n % 2])
                           for k in range(1, 210) for n in range(1, 1 + k % 5)],
                          "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, "
                          "l_returnflag string, l_linestatus string").write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame([(k, 'old "blue" ' + str(k), ("PROMO", None)[k % 2], k * 2 + 10) for k in range(24)],
                          "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{sf}/part.parquet")
    whole = sorted(tuple(r) for r in q_ingest.raw_records(spark, sf).collect())
    apart = [sorted(tuple(r) for r in q_ingest.raw_records(spark, sf, batch=k).collect()) for k in range(3)]
    assert sorted(sum(apart, [])) == whole and all({b for _, b, _ in rows} == {k} for k, rows in enumerate(apart))
    versions = sum(1 + (k % 13 == 0 and k % 101 != 0) + (k % 11 == 0) for k in [*range(1, 210), 11])
    assert len(whole) == versions
    # the printed record reads back as one object with its lines in order
    parsed = spark.createDataFrame(whole, "value string, batch long, position long").select(F.from_json("value", RAW_DETAILS).alias("r")) \
        .select("r.deck_id", F.transform("r.response.cards", lambda c: c["id"]).alias("ids"), "r.response.cards").collect()
    by_id = {r["deck_id"]: r for r in parsed}
    assert by_id["9"]["ids"] == [1, 2, 3, 4] and by_id["10"]["ids"] == [] and by_id["x101"]["ids"] == [1]
    assert by_id["9"]["cards"][0]["categories"] == ["Cat N", "Commander"]
    assert by_id["9"]["cards"][0]["card"]["oracleCard"]["name"] == 'old "blue" 9'
