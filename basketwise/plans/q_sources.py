"""Sources and sinks as queries: each writes the driver's rows with a sink and reads them back with a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketwise.functions import distinct
from basketwise.operators import features
from basketwise.plans import tables as t
from basketwise.plans.registry import Registry, rounded
from basketwise.session import bucketed, scratch_path
from basketwise.sources import jsonl, numbered, tables

R = Registry()

PARTS = 16  # files written by a query, each of which is one sequence of lines


def _one_file_a_part(rows, path):
    """Text files ``part=k``, one each, lines in the order of ``at``."""
    rows.repartition(PARTS, "part").sortWithinPartitions("part", "at").select("part", "value") \
        .write.partitionBy("part").text(path)
    return path


def _part():
    return F.regexp_extract("source_file", r"part=(\d+)", 1).cast("bigint").alias("part")


ORDER_LINES = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY o_custkey % {PARTS} ORDER BY o_orderkey) AS line_number FROM orders)"""


def order_lines(spark, sf, broken=True):
    """Orders as JSON lines; one in 40 is blank and one in 50 of the others cut off."""
    key = F.col("o_orderkey")
    value = F.to_json(F.struct(key.alias("id"), F.col("o_orderstatus").alias("status")))
    if broken:
        value = F.when(key % 50 == 7, F.concat(F.lit('{"id": '), key.cast("string"), F.lit(', "status"'))).otherwise(value)
    value = F.when(key % 40 == 0, F.lit("")).otherwise(value)
    rows = t.table(spark, sf, "orders").select((F.col("o_custkey") % PARTS).alias("part"), key.alias("at"), value.alias("value"))
    return _one_file_a_part(rows, scratch_path(spark, "order-lines"))


@R.query("source_broken_lines", f"""WITH {ORDER_LINES}
SELECT o_custkey % {PARTS} AS part, line_number, '{{"id": ' || o_orderkey || ', "status"' AS line FROM numbered
WHERE o_orderkey % 50 = 7 AND o_orderkey % 40 <> 0""")
def source_broken_lines(spark, sf):
    """Every malformed line with the number it has in its file, blank lines counted."""
    return numbered.broken_lines(spark, order_lines(spark, sf)).select(_part(), "line_number", "line")


@R.query("source_strict_lines", f"""WITH {ORDER_LINES}
SELECT o_custkey % {PARTS} AS part, line_number, o_orderkey AS id, o_orderstatus AS status FROM numbered WHERE o_orderkey % 40 <> 0""")
def source_strict_lines(spark, sf):
    """The strict scan over sound files: every record with its line number, blank lines left out."""
    return numbered.read_jsonl_located(spark, order_lines(spark, sf, broken=False), "id bigint, status string").select(
        _part(), "line_number", "id", "status")


@R.query("source_id_array", f"""SELECT o_custkey % {PARTS} AS part, row_number() OVER (PARTITION BY o_custkey % {PARTS} ORDER BY o_orderkey) - 1 AS ordinal,
  CASE WHEN o_orderkey % 30 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR)
       WHEN o_orderkey % 7 = 0 THEN 'id "' || o_orderkey || '", of, ' || o_orderstatus ELSE 'id' || o_orderkey END AS id FROM orders""")
def source_id_array(spark, sf):
    """Files that are one JSON array each: numbers, null, ids with quotes and commas inside; ordinals as in the file."""
    key = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit('id "'), key, F.lit('", of, '), F.col("o_orderstatus"))) \
        .otherwise(F.concat(F.lit("id"), key))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))
    element = F.when(F.col("o_orderkey") % 30 == 0, F.lit("null")).when(F.col("o_orderkey") % 3 == 0, key).otherwise(quoted)
    orders = t.table(spark, sf, "orders").withColumn("part", F.col("o_custkey") % PARTS)
    ends = orders.groupBy("part").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    rows = orders.join(ends, "part").select("part", F.col("o_orderkey").alias("at"), F.concat(
        F.when(F.col("o_orderkey") == F.col("first"), F.lit("[")).otherwise(F.lit(" ,")), element,
        F.when(F.col("o_orderkey") == F.col("last"), F.lit("]")).otherwise(F.lit(""))).alias("value"))
    path = _one_file_a_part(rows, scratch_path(spark, "id-array"))
    return numbered.read_id_array(spark, path).select(_part(), "ordinal", "id")


@R.query("source_sinks", """SELECT 'appended' AS kind, o_orderkey AS id, o_orderstatus AS status, 2 AS n FROM orders
UNION ALL SELECT 'replaced', o_orderkey, o_orderstatus, 1 FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'missing', NULL, NULL, 0""")
def source_sinks(spark, sf):
    """Rows appended twice, rows that replaced others, and the inventory's word on a path that is not there."""
    out = scratch_path(spark, "sinks")
    rows = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    for _ in range(2):
        jsonl.append_jsonl(rows, f"{out}/appended")
    jsonl.replace_jsonl(rows, f"{out}/replaced")
    jsonl.replace_jsonl(rows.filter("status = 'O'"), f"{out}/replaced")
    parts = [jsonl.read_jsonl(spark, f"{out}/{k}", "id bigint, status string").groupBy("id", "status").agg(
        F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(k).alias("kind"), "id", "status", "n")
        for k in ("appended", "replaced")]
    missing = jsonl.file_inventory(spark, [f"{out}/none"]).filter("not exists").select(
        F.lit("missing").alias("kind"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("status"),
        F.lit(0).alias("n"))
    return parts[0].unionByName(parts[1]).unionByName(missing)


@R.query("source_publish", """SELECT v AS version, o_orderkey AS id, v = 3 AS is_current FROM orders, (SELECT unnest([1, 2, 3]) AS v)
WHERE v = 3 OR (v = 1 AND o_orderstatus = 'O') OR (v = 2 AND o_orderstatus IN ('O', 'F'))""")
def source_publish(spark, sf):
    """Three versions of one table, each built on the one before; all stay readable and the last is current."""
    root = scratch_path(spark, "published")
    orders = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    for status in ("O", "F", "P"):
        base = tables.current_version(spark, root)
        more = orders.filter(F.col("status") == status)
        tables.publish(tables.current(spark, root).unionByName(more) if base else more, root, based_on=base)
    last = tables.current_version(spark, root)
    parts = [tables.current(spark, root, v).select(F.lit(v).alias("version"), "id", F.lit(v == last).alias("is_current"))
             for v in range(1, last + 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.query("line_detail_bucketed", f"""WITH {t.LINES}, {t.DETAIL}
SELECT entity_id, line_id, item_id, quantity, rarity, round(price, 6) AS price FROM lines LEFT JOIN detail USING (entity_id, line_id)""")
def line_detail_bucketed(spark, sf):
    """Lines with rarity and price from two tables bucketed by (entity, line): the join itself moves no rows, and a basket
    with a third of all lines is spread over the buckets by its line ids."""
    return rounded(bucketed_join(spark, sf).select(
        "entity_id", "line_id", "item_id", "quantity", F.lower("rarity").alias("rarity"),
        features.price_of(F.col("prices")).alias("price")))


def bucketed_join(spark, sf):
    keys = ["entity_id", "line_id"]
    return features.join_detail(bucketed(t.lines(spark, sf), "lines", keys), bucketed(t.detail(spark, sf), "detail", keys))


@R.query("distinct_sketches", f"""{" UNION ALL ".join(
    f"SELECT '{c}' AS measure, count(DISTINCT {e}) AS n_exact, true AS within_error FROM orders"
    for c, e in (("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("day", "o_orderdate")))}""")
def distinct_sketches(spark, sf):
    """Sketches of every month of orders, stored batch by batch and merged: within four standard errors of the exact count."""
    out = scratch_path(spark, "distinct")
    columns = ["o_orderkey", "o_custkey", "day"]
    orders = t.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    distinct.sketches(orders.filter("o_orderkey % 2 = 0"), ["month"], columns).write.mode("append").parquet(out)
    distinct.sketches(orders.filter("o_orderkey % 2 <> 0"), ["month"], columns).write.mode("append").parquet(out)
    merged = distinct.merged(spark.read.parquet(out), [], columns)
    long = merged.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(f"n_{c}").alias("estimate")) for c in columns])).alias("m")).select("m.*")
    exact = None
    for c in columns:
        one = orders.select(c).distinct().agg(F.count(c).alias("n_exact")).select(F.lit(c).alias("measure"), "n_exact")
        exact = one if exact is None else exact.unionByName(one)
    error = F.abs(F.col("estimate") - F.col("n_exact")) <= 4 * distinct.standard_error() * F.col("n_exact") + 1
    return exact.join(long, "measure").select("measure", "n_exact", error.alias("within_error"))
