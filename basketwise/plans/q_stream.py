"""Streaming queries: each runs its stream over the driver's files to the end and reads the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketwise.plans import q_curate
from basketwise.plans import tables as t
from basketwise.plans.q_features import _select
from basketwise.plans.registry import Registry, rounded
from basketwise.session import scratch_path
from basketwise.streaming import incremental as inc

R = Registry()


def _stream(spark, sf, name):
    schema = t.table(spark, sf, name).schema
    return inc.file_stream(spark, sf, schema, "parquet", glob=f"{name}.parquet")


@R.query("stream_dedup", """SELECT user_id, event_type, k, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type, k ORDER BY event_id) AS rn FROM (
    SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k FROM events)) WHERE rn = 1""")
def stream_dedup(spark, sf):
    out = scratch_path(spark, "stream-dedup")
    keyed = _stream(spark, sf, "events").select(
        "user_id", "event_type", (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("k"), "event_id")
    inc.dedup_stream(keyed, ["user_id", "event_type", "k"], F.col("event_id"), f"{out}/rows", f"{out}/checkpoint")
    return inc.read_table(spark, f"{out}/rows")


@R.query("stream_upsert", """SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_upsert(spark, sf):
    out = scratch_path(spark, "stream-upsert")
    order = F.struct("ts", "event_id")
    inc.label_stream(_stream(spark, sf, "events"), "user_id", order, f"{out}/rows", f"{out}/checkpoint")
    return inc.current_labels(spark, f"{out}/rows", "user_id", order).select("user_id", "event_id", "event_type")


@R.query("stream_counters", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counters(spark, sf):
    out = scratch_path(spark, "stream-counters")
    inc.counter_stream(_stream(spark, sf, "events"), ["event_type"], f"{out}/rows", f"{out}/checkpoint")
    return inc.current_counters(spark, f"{out}/rows", ["event_type"])


@R.query("stream_route", f"""WITH {q_curate.JUDGED}
SELECT entity_id, CASE WHEN len(reasons) = 0 THEN 'accepted' ELSE 'rejected' END AS outcome, CAST(len(reasons) AS BIGINT) AS n_reasons FROM judged""")
def stream_route(spark, sf):
    """Orders arrive as a stream and are routed to the accepted or the rejected table."""
    out = scratch_path(spark, "stream-route")

    def judge(batch):
        return q_curate.judged_entities(spark, sf, t.as_entities(batch)).select("entity_id", "rejection_reasons")

    inc.route_stream(_stream(spark, sf, "orders"), judge, out, f"{out}/checkpoint")
    parts = [inc.read_table(spark, f"{out}/{name}").select(
        "entity_id", F.lit(name).alias("outcome"), F.size("rejection_reasons").cast("bigint").alias("n_reasons"))
        for name in ("accepted", "rejected")]
    return parts[0].unionByName(parts[1])


@R.query("stream_features", _select(["structure", "colors"]))
def stream_features(spark, sf):
    """Features of orders as they arrive, joined with the stored lines and items."""
    out = scratch_path(spark, "stream-features")
    arriving = t.as_entities(_stream(spark, sf, "orders"))
    inc.feature_stream(arriving, t.lines(spark, sf), t.items(spark, sf), f"{out}/rows", f"{out}/checkpoint",
                       ["structure", "colors"], t.SPEC)
    return inc.read_table(spark, f"{out}/rows")


@R.query("window_counts", """SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY ALL""")
def window_counts(spark, sf):
    counted = inc.window_counts(t.table(spark, sf, "events"), "ts", ["event_type"], "1 day", "value")
    return rounded(counted.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", "total"), 4)


# Events arrive in three deliveries of ten days. One in 40 comes a delivery late: those of the last two days of a delivery
# still meet the watermark, earlier ones do not.
ARRIVALS = """e AS (
  SELECT *, least((extract(day FROM ts) - 1) // 10, 2) AS tenth FROM events),
arrived AS (SELECT *, least(tenth + CASE WHEN event_id % 40 = 0 THEN 1 ELSE 0 END, 2) AS batch FROM e),
mark AS (SELECT b.batch, max(a.ts) - INTERVAL 2 DAY AS mark FROM (SELECT unnest([1, 2, 3]) AS batch) b JOIN arrived a ON a.batch < b.batch GROUP BY b.batch)"""


def _deliveries(spark, sf, out, run, again=None):
    """Write the three deliveries one after the other and run the stream after each; ``again`` picks rows that are
    delivered once more one delivery later."""
    events = t.table(spark, sf, "events")
    tenth = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    late = F.when(F.col("event_id") % 40 == 0, 1).otherwise(0)
    arrived = events.withColumn("batch", F.least(tenth + late, F.lit(2)).cast("int"))
    reports = []
    for k in range(3):
        rows = arrived.filter(F.col("batch") == k)
        if again is not None and k:
            rows = rows.unionByName(arrived.filter((F.col("batch") == k - 1) & again))
        rows.drop("batch").write.mode("append").parquet(f"{out}/in")
        reports += run(inc.file_stream(spark, f"{out}/in", events.schema, "parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    return reports


@R.query("stream_windows", f"""WITH {ARRIVALS}
SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM arrived LEFT JOIN mark USING (batch)
WHERE (mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark)
  AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT mark FROM mark WHERE batch = 3) GROUP BY ALL""")
def stream_windows(spark, sf):
    """Finished windows over three deliveries: late rows inside the delay count, those beyond it are dropped."""
    out = scratch_path(spark, "stream-windows")
    _deliveries(spark, sf, out, lambda stream: inc.window_stream(
        stream, "ts", ["event_type"], f"{out}/rows", f"{out}/checkpoint", "1 day", "value", "2 days"))
    rows = spark.read.parquet(f"{out}/rows")
    return rounded(rows.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", "total"), 4)


@R.query("stream_unique", f"""WITH {ARRIVALS}
SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM arrived LEFT JOIN mark USING (batch) WHERE mark IS NULL OR ts > mark""")
def stream_unique(spark, sf):
    """Every event once, though a third of each delivery comes again with the next one; late ones beyond the delay drop out."""
    out = scratch_path(spark, "stream-unique")
    _deliveries(spark, sf, out, lambda stream: inc.unique_stream(
        stream, ["event_id"], "ts", f"{out}/rows", f"{out}/checkpoint", "2 days"), again=F.col("event_id") % 3 == 0)
    return spark.read.parquet(f"{out}/rows").select("event_id", F.unix_micros("ts").alias("ts_us"))


@R.query("stream_totals", "SELECT event_type, user_id % 50 AS band, count(*) AS n FROM events GROUP BY ALL")
def stream_totals(spark, sf):
    """Running totals over three deliveries, each run starting anew from the checkpoint."""
    out = scratch_path(spark, "stream-totals")
    _deliveries(spark, sf, out, lambda stream: inc.totals_stream(
        stream.withColumn("band", F.col("user_id") % 50), ["event_type", "band"], f"{out}/rows", f"{out}/checkpoint"))
    return inc.current_totals(spark, f"{out}/rows", ["event_type", "band"])
