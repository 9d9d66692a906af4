"""Curation, label and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketwise.functions import coerce, text
from basketwise.operators import curate, labels, selection
from basketwise.plans import tables as t
from basketwise.plans.registry import Registry, rounded

R = Registry()

RULES = curate.CurationRules(min_views=1000, labels=(2, 3, 4), min_size=20, max_size=200, source="orders")

# the same lines with exclusion facts, as SQL
CLINES = """clines AS (
  SELECT l_orderkey AS entity_id, CAST(l_linenumber AS BIGINT) AS line_id,
    CASE WHEN p_size <> 50 THEN p_partkey END AS item_id, p_name AS item_name,
    CAST(CASE WHEN l_quantity = 50 THEN 0 ELSE l_quantity END AS BIGINT) AS quantity,
    l_linenumber = 1 AS is_lead,
    l_tax = 0.08 AS deleted, l_discount = 0.1 AS companion,
    regexp_replace(lower(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'Side-Board!' ELSE 'Cat ' || l_returnflag END),
      '[^a-z0-9]+', '', 'g') IN ('maybeboard', 'sideboard', 'tokensextras', 'tokensandextras') AS excluded,
    CASE WHEN p_type = 'PROMO' AND p_size > 45 THEN 'banned' ELSE 'legal' END AS legality,
    CAST(p_partkey % 7 = 0 AS INT) + 2 * CAST(p_partkey % 11 = 0 AS INT) + 4 * CAST(p_partkey % 13 = 0 AS INT)
      + 8 * CAST(p_partkey % 17 = 0 AS INT) + 16 * CAST(p_partkey % 19 = 0 AS INT) AS color_mask,
    p_size <= 45 OR regexp_matches(p_name, '(?i)(?:^old |RING$)') AS copies_allowed
  FROM lineitem JOIN part ON l_partkey = p_partkey),
klines AS (SELECT * FROM clines WHERE NOT deleted AND NOT companion AND NOT excluded)"""
JUDGED = f"""{t.ENT}, {CLINES}, per_item AS (
  SELECT entity_id, item_id, sum(quantity) AS qty, bool_or(copies_allowed) AS ok FROM klines GROUP BY ALL),
dup AS (SELECT entity_id, count(*) AS n FROM per_item WHERE item_id IS NOT NULL AND qty > 1 AND NOT ok GROUP BY ALL),
facts AS (
  SELECT entity_id, sum(quantity) AS size, sum(CASE WHEN is_lead THEN quantity ELSE 0 END) AS lead_qty,
    count(*) FILTER (WHERE item_id IS NULL) AS no_item, count(*) FILTER (WHERE quantity <= 0) AS non_positive,
    count(*) FILTER (WHERE legality <> 'legal') AS illegal, bit_or(color_mask) AS mask,
    bit_or(CASE WHEN is_lead THEN color_mask ELSE 0 END) AS lead_mask, count(*) AS n_lines
  FROM klines GROUP BY ALL),
judged AS (
  SELECT e.*, coalesce(f.size, 0) AS size, coalesce(f.n_lines, 0) AS n_lines, list_filter([
    CASE WHEN status = 'P' THEN 'private' END,
    CASE WHEN group_id % 50 = 0 THEN 'unlisted' END,
    CASE WHEN entity_id % 40 = 0 THEN 'not_commander_format' END,
    CASE WHEN y1 NOT IN (2, 3, 4) THEN 'missing_or_invalid_bracket' END,
    CASE WHEN views < 1000 THEN 'low_view_count' END,
    CASE WHEN coalesce(f.size, 0) NOT BETWEEN 20 AND 200 THEN 'mainboard_count_not_100' END,
    CASE WHEN coalesce(f.lead_qty, 0) < 1 THEN 'missing_commander' END,
    CASE WHEN coalesce(f.no_item, 0) > 0 THEN 'missing_oracle_uid' END,
    CASE WHEN coalesce(f.non_positive, 0) > 0 THEN 'non_positive_quantity' END,
    CASE WHEN coalesce(f.illegal, 0) > 0 THEN 'illegal_commander_card' END,
    CASE WHEN coalesce(d.n, 0) > 0 THEN 'duplicate_nonbasic' END,
    CASE WHEN coalesce(f.mask, 0) & ~coalesce(f.lead_mask, 0) <> 0 THEN 'color_identity_violation' END],
    lambda x: x IS NOT NULL) AS reasons
  FROM ent e LEFT JOIN facts f USING (entity_id) LEFT JOIN dup d USING (entity_id))"""


def curated_lines(spark, sf):
    """Lineitem rows as raw basket lines with exclusion reasons."""
    part, line = t.table(spark, sf, "part"), t.table(spark, sf, "lineitem")
    joined = line.join(part, line["l_partkey"] == part["p_partkey"])
    categories = F.array(F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), F.lit("Side-Board!"))
                         .otherwise(F.concat(F.lit("Cat "), "l_returnflag")))
    key = F.col("p_partkey")
    mask = sum(((key % m == 0).cast("int") * (1 << i) for i, m in enumerate((7, 11, 13, 17, 19))), F.lit(0))
    boards = F.array(*[F.lit(b) for b in curate.BOARD_EXCLUDED])
    return joined.select(
        F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").cast("bigint").alias("line_id"),
        F.when(F.col("p_size") != 50, key).alias("item_id"), F.col("p_name").alias("item_name"),
        F.when(F.col("l_quantity") == 50, 0).otherwise(F.col("l_quantity")).cast("bigint").alias("quantity"),
        (F.col("l_linenumber") == 1).alias("is_lead"),
        curate.exclusion_reasons(F.col("l_tax") == 0.08, F.col("l_discount") == 0.1, categories, boards).alias("exclusion"),
        F.when((F.col("p_type") == "PROMO") & (F.col("p_size") > 45), "banned").otherwise("legal").alias("legality"),
        mask.alias("color_mask"),
        ((F.col("p_size") <= 45) | text.matches_any(F.col("p_name"), ("^old ", "RING$"))).alias("copies_allowed"),
    )


def judged_entities(spark, sf, entities=None):
    base = (entities if entities is not None else t.entities(spark, sf)).select(
        "*", (F.col("status") == "P").alias("private"), (F.col("group_id") % 50 == 0).alias("unlisted"),
        F.when(F.col("entity_id") % 40 == 0, 2).otherwise(3).alias("basket_format"), F.col("y1").alias("target_label"),
    )
    facts = curate.line_facts(curate.kept(curated_lines(spark, sf)))
    return base.join(facts, "entity_id", "left").withColumn("rejection_reasons", curate.rejection_reasons(RULES))


@R.query("curate_line_reasons", f"""WITH {CLINES}, tagged AS (
  SELECT entity_id, quantity, unnest(CASE WHEN NOT deleted AND NOT companion AND NOT excluded
      THEN CASE WHEN is_lead THEN ['included', 'lead'] ELSE ['included'] END
      ELSE list_filter([CASE WHEN deleted THEN 'deleted' END, CASE WHEN companion THEN 'companion' END,
        CASE WHEN excluded THEN 'excluded_category' END], lambda x: x IS NOT NULL) END) AS reason FROM clines)
SELECT entity_id, reason, count(*) AS "rows", CAST(sum(quantity) AS BIGINT) AS quantity FROM tagged GROUP BY ALL""")
def curate_line_reasons(spark, sf):
    return curate.extraction_trace(curated_lines(spark, sf))


@R.query("curate_validate_reject", f"""WITH {JUDGED}
SELECT entity_id, array_to_string(reasons, ',') AS rejection_reasons, y1, views, status FROM judged WHERE len(reasons) > 0""")
def curate_validate_reject(spark, sf):
    return judged_entities(spark, sf).filter(F.size("rejection_reasons") > 0).select(
        "entity_id", F.array_join("rejection_reasons", ",").alias("rejection_reasons"), "y1", "views", "status")


@R.query("curate_reason_counts", f"""WITH {JUDGED}
SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM judged) GROUP BY reason""")
def curate_reason_counts(spark, sf):
    return curate.reason_counts(judged_entities(spark, sf))


@R.query("curate_violations", f"""WITH {JUDGED}, bad AS (
  SELECT entity_id, lead_mask FROM facts WHERE mask & ~lead_mask <> 0)
SELECT entity_id, line_id, item_id, reason, detail FROM (
  SELECT entity_id, line_id, item_id, 'missing_oracle_uid' AS reason, NULL AS detail FROM klines WHERE item_id IS NULL
  UNION ALL SELECT entity_id, line_id, item_id, 'non_positive_quantity', CAST(quantity AS VARCHAR) FROM klines WHERE quantity <= 0
  UNION ALL SELECT entity_id, line_id, item_id, 'illegal_commander_card', legality FROM klines WHERE legality <> 'legal'
  UNION ALL SELECT entity_id, min(line_id), item_id, 'duplicate_nonbasic', CAST(sum(quantity) AS VARCHAR) FROM klines
    WHERE item_id IS NOT NULL GROUP BY entity_id, item_id HAVING sum(quantity) > 1 AND NOT bool_or(copies_allowed)
  UNION ALL SELECT entity_id, line_id, item_id, 'color_identity_violation',
    CASE WHEN color_mask & 1 <> 0 THEN 'W' ELSE '' END || CASE WHEN color_mask & 2 <> 0 THEN 'U' ELSE '' END ||
    CASE WHEN color_mask & 4 <> 0 THEN 'B' ELSE '' END || CASE WHEN color_mask & 8 <> 0 THEN 'R' ELSE '' END ||
    CASE WHEN color_mask & 16 <> 0 THEN 'G' ELSE '' END
    FROM klines JOIN bad USING (entity_id) WHERE color_mask & ~lead_mask <> 0)""")
def curate_violations(spark, sf):
    kept = curate.kept(curated_lines(spark, sf))
    return curate.violations(kept, curate.line_facts(kept)).drop("item_name")


@R.query("curate_accept", f"""WITH {JUDGED}, lead AS (
  SELECT entity_id, string_agg(DISTINCT CAST(item_id AS VARCHAR), '|' ORDER BY CAST(item_id AS VARCHAR)) AS lead_items
  FROM klines WHERE is_lead GROUP BY entity_id)
SELECT entity_id, 'orders:' || entity_id || ':' || strftime(order_date, '%Y-%m-%d') AS snapshot_id, y1, views,
  CAST(size AS BIGINT) AS mainboard_count, n_lines, lead_items
FROM judged LEFT JOIN lead USING (entity_id) WHERE len(reasons) = 0""")
def curate_accept(spark, sf):
    passed = judged_entities(spark, sf).filter(F.size("rejection_reasons") == 0)
    lead = curate.kept(curated_lines(spark, sf)).filter("is_lead").join(
        passed.select("entity_id"), "entity_id", "left_semi"
    ).groupBy("entity_id").agg(text.signature(F.collect_set(F.col("item_id").cast("string")), "|").alias("lead_items"))
    return passed.join(lead, "entity_id", "left").select(
        "entity_id",
        curate.snapshot_id("orders", F.col("entity_id"), F.date_format("order_date", "yyyy-MM-dd")).alias("snapshot_id"),
        "y1", "views", "mainboard_count", "n_lines", "lead_items")


@R.query("curate_latest_wins", """WITH e AS (
  SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id END AS id, strftime(ts, '%Y-%m-%d') AS day FROM events)
SELECT event_id, id, day FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY day DESC, event_id) AS rn FROM e WHERE id IS NOT NULL) WHERE rn = 1
UNION ALL SELECT event_id, id, day FROM e WHERE id IS NULL""")
def curate_latest_wins(spark, sf):
    log = t.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("id"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return curate.latest_records(log, "id", [F.col("day")], F.col("event_id"))


@R.query("curate_first_seen_items", """
SELECT item_id, entity_id AS first_seen_entity_id, day AS first_seen_day, line_id FROM (
  SELECT l_partkey AS item_id, l_orderkey AS entity_id, strftime(o_orderdate, '%Y-%m-%d') AS day,
    CAST(l_linenumber AS BIGINT) AS line_id,
    row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate, l_orderkey, l_linenumber) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1""")
def curate_first_seen_items(spark, sf):
    dated = t.lines(spark, sf).join(t.entities(spark, sf).select("entity_id", "order_date"), "entity_id")
    seen = curate.first_seen_items(dated, F.struct("order_date", "entity_id", "line_id"),
                                   carry=["entity_id", "order_date", "line_id"])
    return seen.select("item_id", F.col("entity_id").alias("first_seen_entity_id"),
                       F.date_format("order_date", "yyyy-MM-dd").alias("first_seen_day"), "line_id")


@R.query("curate_fingerprint_dedup", """WITH fp AS (
  SELECT l_orderkey AS entity_id, count(*) AS n_lines,
    sha256(array_to_string(list_sort(list(p_type || ':' || CAST(ceil(l_quantity / 25) AS BIGINT))), '|')) AS fingerprint
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT entity_id, fingerprint, n_lines, first_value(entity_id) OVER w AS keeper_id,
  entity_id <> first_value(entity_id) OVER w AS is_duplicate FROM fp
WINDOW w AS (PARTITION BY fingerprint ORDER BY entity_id)""")
def curate_fingerprint_dedup(spark, sf):
    """Baskets of (type, size class) lines; equal lists keep their lowest id."""
    kinds = t.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_type")
    lines = t.lines(spark, sf).join(kinds, "item_id").select(
        "entity_id", F.col("p_type").alias("item"), F.ceil(F.col("quantity") / 25).alias("quantity"))
    prints = curate.fingerprints(lines, item="item")
    return curate.fingerprint_dedup(prints, "entity_id", F.col("entity_id"))


@R.query("curate_funnel", f"""WITH {JUDGED}, latest AS (
  SELECT entity_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY order_date DESC, entity_id) AS rn FROM ent)
  WHERE rn = 1)
SELECT (SELECT count(*) FROM ent) AS n_read, (SELECT count(*) FROM ent) - count(*) AS n_superseded,
  count(*) FILTER (WHERE len(reasons) = 0) AS n_accepted, count(*) FILTER (WHERE len(reasons) > 0) AS n_rejected
FROM judged JOIN latest USING (entity_id)""")
def curate_funnel(spark, sf):
    ent = t.entities(spark, sf)
    latest = curate.latest_records(ent, "group_id", [F.date_format("order_date", "yyyy-MM-dd HH:mm:ss")], F.col("entity_id"))
    ok = F.size("rejection_reasons") == 0
    judged = judged_entities(spark, sf, latest).agg(
        F.count(F.lit(1)).alias("n_latest"), F.count_if(ok).alias("n_accepted"), F.count_if(~ok).alias("n_rejected"))
    read = ent.agg(F.count(F.lit(1)).alias("n_read"))
    return read.join(judged).select(  # one row each
        "n_read", (F.col("n_read") - F.col("n_latest")).alias("n_superseded"), "n_accepted", "n_rejected")


@R.query("ingest_skip_existing", f"""WITH {t.ENT}
SELECT entity_id, group_id, y1, y2 FROM ent e WHERE order_date >= TIMESTAMP '1998-01-01' AND NOT EXISTS (
  SELECT 1 FROM ent o WHERE o.order_date < TIMESTAMP '1998-01-01'
    AND o.group_id = e.group_id AND o.y1 = e.y1 AND o.y2 = e.y2)""")
def ingest_skip_existing(spark, sf):
    ent = t.entities(spark, sf)
    cut = F.lit("1998-01-01").cast("timestamp")
    fresh = curate.skip_existing(ent.filter(F.col("order_date") >= cut), ent.filter(F.col("order_date") < cut),
                                 ["group_id", "y1", "y2"])
    return fresh.select("entity_id", "group_id", "y1", "y2")


@R.query("text_item_list", """
SELECT l_orderkey AS entity_id,
  string_agg(CAST(l_quantity AS BIGINT) || ' ' || p_name, chr(10) ORDER BY l_linenumber, l_partkey, l_quantity) AS text
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def text_item_list(spark, sf):
    names = t.items(spark, sf).select("item_id", F.col("name").alias("item_name"))
    return selection.item_list_text(t.lines(spark, sf).join(names, "item_id"), ["line_id", "item_id", "quantity"])


PAGE_PATTERNS = {
    "lang": r'<html lang="([a-z]+)"',
    "charset": r'<meta charset="([^"]+)"',
    "title": r"<title>([^<]*)</title>",
    "heading": r"<h1>([^<]*)</h1>",
    "tracker": r"track\((\d+)\)",
    "ad": r"<!-- ad (\d+) -->",
    "missing": r"Power Level\s*([0-9]+(?:\.[0-9]+)?\+?)\s*/\s*10",
}


def _extract_sql(name: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches(html, '{pattern}') THEN regexp_extract(html, '{pattern}', 1) END AS {name}"


@R.query("page_fields", "SELECT page_id, " + ", ".join(_extract_sql(n, p) for n, p in PAGE_PATTERNS.items()) + " FROM pages")
def page_fields(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", *text.extract_fields(F.col("html"), PAGE_PATTERNS))


@R.query("page_field_list", """SELECT page_id, array_to_string(links, '|') AS links, CAST(len(links) AS BIGINT) AS n_links FROM (
  SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), 'href="([^"]*)"', 1) AS links FROM pages)""")
def page_field_list(spark, sf):
    links = text.extract_list(F.col("html"), r"(?s)<nav>(.*?)</nav>", r'href="([^"]*)"')
    return t.table(spark, sf, "pages").select("page_id", links.alias("l")).select(
        "page_id", F.array_join("l", "|").alias("links"), F.size("l").cast("bigint").alias("n_links"))


@R.query("label_default_state", """
SELECT event_id, event_type = 'view' AND json_extract_string(props, '$.k') IN ('10') AND CAST(floor(value) AS BIGINT) < 100
  AS is_default, json_extract_string(props, '$.k') AS k FROM events""")
def label_default_state(spark, sf):
    """Readings equal to a known fingerprint in every field."""
    events = t.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    fields = {"event_type": F.col("event_type"), "k": F.col("k"), "low": F.col("value") < 100}
    return events.select(
        "event_id", text.is_default_state(fields, {"event_type": "view", "k": "10", "low": "true"}).alias("is_default"), "k")


@R.query("label_upsert_latest", f"""WITH {t.ENT}, log AS (
  SELECT user_id, event_id, ts, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 + 1 END AS label,
    CASE WHEN event_type = 'error' THEN 'failed' END AS err FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM log) WHERE rn = 1)
SELECT entity_id, y1, coalesce(label, y2) AS y2,
  CASE WHEN err IS NOT NULL THEN 'failed' WHEN label IS NULL THEN 'missing' ELSE 'ok' END AS state
FROM ent LEFT JOIN latest ON group_id = user_id""")
def label_upsert_latest(spark, sf):
    """Latest attempt per customer wins; failed attempts keep the old label."""
    failed = F.col("event_type") == "error"
    log = t.table(spark, sf, "events").select(
        F.col("user_id").alias("group_id"), "event_id", "ts",
        F.when(~failed, F.get_json_object("props", "$.k").cast("bigint") % 5 + 1).alias("y2"),
        F.when(failed, "failed").alias("error"))
    latest = labels.latest_labels(log, "group_id", F.struct("ts", "event_id")).withColumn("fresh", F.col("y2"))
    updated = labels.upsert(t.entities(spark, sf), latest, "group_id", ["y2", "fresh", "error"],
                            spread=F.col("entity_id"))
    return updated.select("entity_id", "y1", "y2", labels.label_state(F.col("fresh"), F.col("error")).alias("state"))


@R.query("label_targets", """WITH log AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT c_custkey AS group_id, c_mktsegment AS segment FROM customer
WHERE c_acctbal < 0 OR c_custkey NOT IN (SELECT user_id FROM log) """)
def label_targets(spark, sf):
    """Customers without a finished label, plus those whose last attempt failed (negative balance)."""
    people = t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("group_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    done = t.table(spark, sf, "events").filter(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("group_id")).distinct().withColumn("label", F.lit(1))
    state = labels.label_state(F.col("label"), F.when(F.col("balance") < 0, F.lit("failed")))
    joined = people.join(done, "group_id", "left")
    return labels.targets(joined, state, key="group_id").select("group_id", "segment")


@R.query("label_payload_match", """WITH c AS (SELECT conv_id, turn, role, length(text) > 200 AS is_long FROM conversations),
m AS (SELECT a.role = b.role AND a.is_long = b.is_long AS hit FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn + 2 = b.turn)
SELECT count(*) AS n, count(*) FILTER (WHERE hit) AS matched, count(*) FILTER (WHERE NOT hit) AS mismatched,
  round(count(*) FILTER (WHERE hit) / count(*), 6) AS match_share FROM m""")
def label_payload_match(spark, sf):
    """A turn read again two turns later: same role and length class?"""
    turns = t.table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", (F.length("text") > 200).alias("is_long"))

    def keyed(offset):
        return turns.select(F.concat_ws(":", "conv_id", F.col("turn") + offset).alias("key"), "role", "is_long")

    return rounded(labels.stability(labels.compare_payloads(keyed(2), keyed(0), "key", ["role", "is_long"])))


@R.query("sample_coverage", f"""WITH {t.ENT}, pool AS (SELECT entity_id, y1 FROM ent WHERE status <> 'P'),
lead AS (SELECT min(entity_id) AS entity_id FROM pool GROUP BY y1)
SELECT entity_id, y1, entity_id IN (SELECT entity_id FROM lead) AS is_label_lead FROM pool
ORDER BY is_label_lead DESC, entity_id LIMIT 60""")
def sample_coverage(spark, sf):
    ent = t.entities(spark, sf).select("entity_id", "y1", "status")
    return labels.coverage_sample(ent, "entity_id", "y1", 60, exclude=ent.filter(F.col("status") == "P")).drop("status")


@R.query("sample_excluded", f"""WITH {t.ENT}, x AS (SELECT entity_id, group_id FROM ent WHERE total_price > 495000)
SELECT entity_id, group_id, y1 FROM ent WHERE entity_id NOT IN (SELECT entity_id FROM x) AND group_id NOT IN (SELECT group_id FROM x)""")
def sample_excluded(spark, sf):
    """Orders outside an exclusion list, matched by order or by customer."""
    ent = t.entities(spark, sf)
    listed = ent.filter(F.col("total_price") > 495000)
    return labels.without_excluded(ent, listed, ["entity_id", "group_id"]).select("entity_id", "group_id", "y1")


@R.query("sample_per_label", f"""WITH {t.ENT}
SELECT entity_id, y1, rank FROM (SELECT entity_id, y1,
  row_number() OVER (PARTITION BY y1 ORDER BY md5(concat_ws(':', '7', entity_id)), entity_id) AS rank FROM ent) WHERE rank <= 30""")
def sample_per_label(spark, sf):
    return labels.per_label_sample(t.entities(spark, sf).select("entity_id", "y1"), "entity_id", "y1", 30, seed=7)


VARIANTS = {"click": "{k}", "view": "{k}.0", "error": "{k}.5", "signup": "n/a", "purchase": "{k}+"}


@R.query("cast_int_float", """WITH v AS (SELECT event_id, TRY_CAST(CASE event_type WHEN 'click' THEN k WHEN 'view' THEN k || '.0'
  WHEN 'error' THEN k || '.5' WHEN 'signup' THEN 'n/a' ELSE k || '+' END AS DOUBLE) AS x
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events))
SELECT event_id, CAST(CASE WHEN x = floor(x) THEN x END AS BIGINT) AS as_int, round(x, 2) AS as_float FROM v""")
def cast_int_float(spark, sf):
    """Number-like texts in five spellings."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    raw = F.when(kind == "click", k).when(kind == "view", F.concat(k, F.lit(".0"))) \
        .when(kind == "error", F.concat(k, F.lit(".5"))).when(kind == "signup", F.lit("n/a")) \
        .otherwise(F.concat(k, F.lit("+")))
    return t.table(spark, sf, "events").select("event_id", raw.alias("raw")).select(
        "event_id", coerce.as_long(F.col("raw")).alias("as_int"), coerce.as_double(F.col("raw"), 2).alias("as_float"))


@R.query("parse_timestamps", """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS seconds FROM events""")
def parse_timestamps(spark, sf):
    """ISO texts with ``Z``, with an offset, without either, and garbage."""
    kind = F.col("event_type")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(kind == "click", F.concat(iso, F.lit("Z"))).when(kind == "view", F.concat(iso, F.lit("+00:00"))) \
        .when(kind == "error", F.concat(F.lit("on "), iso)).otherwise(iso)
    return t.table(spark, sf, "events").select(
        "event_id", F.unix_timestamp(coerce.as_timestamp(raw)).alias("seconds"))


@R.query("listing_filter", """WITH p AS (SELECT user_id, CAST(epoch(ts) / 86400 AS BIGINT) AS page, value,
  json_extract_string(props, '$.k') AS id FROM events)
SELECT user_id, count(*) AS n_rows, count(*) FILTER (WHERE value >= 20) AS n_candidates, bool_and(value < 20) AS all_below
FROM p GROUP BY user_id""")
def listing_filter(spark, sf):
    """List pages of every user: rows above the threshold, and whether all pages lie wholly below it."""
    page = F.floor(F.col("event_id") / 1000)
    row = F.struct(F.col("event_id").cast("string").alias("id"), F.floor("value").cast("bigint").alias("viewCount"))
    pages = t.table(spark, sf, "events").groupBy(F.col("user_id").alias("bracket"), page.alias("page")).agg(
        F.struct(F.collect_list(row).alias("results")).alias("response"))
    found = selection.listing_candidates(pages, 20).groupBy("bracket").agg(F.count(F.lit(1)).alias("n_candidates"))
    whole = pages.select("bracket", F.size("response.results").alias("n")).groupBy("bracket").agg(F.sum("n").alias("n_rows"))
    below = selection.pages_below(pages, 20).groupBy("bracket").agg(F.bool_and("all_below").alias("all_below"))
    return whole.join(below, "bracket").join(found, "bracket", "left").select(
        F.col("bracket").alias("user_id"), "n_rows", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "all_below")
