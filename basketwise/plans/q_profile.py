"""Quality, profile and divergence queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from basketwise.functions import sets, text
from basketwise.operators import divergence, prep, profile, quality
from basketwise.plans import tables as t
from basketwise.plans.q_features import base_features, feats_cte, rounded_features, stored_base
from basketwise.plans.registry import Registry, rounded

R = Registry()


# ---------------------------------------------------------------- quality


@R.query("quality_report", f"""WITH {t.ENT}, {t.LINES}, s AS (
  SELECT entity_id, coalesce(sum(quantity), 0) AS size FROM ent LEFT JOIN lines USING (entity_id) GROUP BY ALL)
SELECT count(*) AS n_rows, count(DISTINCT entity_id) AS n_ids, CAST(0 AS BIGINT) AS n_repeated_ids,
  CAST(min(size) AS BIGINT) AS min_size, CAST(max(size) AS BIGINT) AS max_size, round(avg(size), 6) AS mean_size,
  count(*) FILTER (WHERE size NOT BETWEEN 20 AND 200) AS n_wrong_size FROM s""")
def quality_report(spark, sf):
    sizes = t.lines(spark, sf).groupBy("entity_id").agg(F.sum("quantity").alias("size"))
    sized = t.entities(spark, sf).join(sizes, "entity_id", "left")
    return rounded(quality.table_report(sized, "entity_id", F.coalesce("size", F.lit(0)).cast("bigint"), (20, 200)))


@R.query("quality_alignment", f"""WITH {t.ENT}, {t.LINES}, a AS (SELECT DISTINCT entity_id FROM ent WHERE status <> 'P'),
b AS (SELECT DISTINCT entity_id FROM lines)
SELECT (SELECT count(*) FROM a WHERE entity_id NOT IN (SELECT entity_id FROM b)) AS n_missing,
  (SELECT count(*) FROM b WHERE entity_id NOT IN (SELECT entity_id FROM a)) AS n_extra,
  (SELECT count(*) FROM a WHERE entity_id IN (SELECT entity_id FROM b)) AS n_common""")
def quality_alignment(spark, sf):
    """Ids of the non-pending orders against the ids that have lines."""
    return quality.alignment(t.entities(spark, sf).filter("status <> 'P'"), t.lines(spark, sf), ["entity_id"])


@R.query("quality_id_difference", f"""WITH {t.ENT}, {t.LINES}
SELECT entity_id FROM ent EXCEPT SELECT entity_id FROM lines""")
def quality_id_difference(spark, sf):
    """Orders without lines, as a set difference."""
    return t.entities(spark, sf).select("entity_id").subtract(t.lines(spark, sf).select("entity_id"))


@R.query("quality_coverage", """SELECT l_partkey AS item_id, count(*) AS n_uses FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 50) GROUP BY l_partkey""")
def quality_coverage(spark, sf):
    """Items used in baskets but absent from a catalogue that lacks one size class."""
    known = t.table(spark, sf, "part").filter("p_size <> 50").select(F.col("p_partkey").alias("item_id"))
    return quality.unreferenced(t.lines(spark, sf), known, "item_id")


@R.query("quality_label_coverage", f"""WITH {t.ENT}
SELECT count(*) FILTER (WHERE status <> 'P' AND views >= 1000) AS n_labelled,
  count(*) FILTER (WHERE status = 'P') AS n_failed,
  count(*) FILTER (WHERE status <> 'P' AND views < 1000) AS n_missing,
  round(avg(CASE WHEN status <> 'P' AND views >= 1000 THEN total_price END), 2) AS mean_score FROM ent""")
def quality_label_coverage(spark, sf):
    ent = t.entities(spark, sf)
    label = F.when(F.col("views") >= 1000, F.col("y2"))
    failed = F.col("status") == "P"
    return rounded(quality.label_coverage(ent, label, failed, F.when(~failed & label.isNotNull(), F.col("total_price"))), 2)


@R.query("quality_identity_histogram", f"""WITH {t.LINES}, {t.ITEMS}, m AS (
  SELECT entity_id, bool_or(c_w) AS w, bool_or(c_u) AS u, bool_or(c_b) AS b, bool_or(c_r) AS r, bool_or(c_g) AS g
  FROM lines JOIN items USING (item_id) GROUP BY ALL), k AS (
  SELECT CASE WHEN w THEN 'W' ELSE '' END || CASE WHEN u THEN 'U' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END ||
    CASE WHEN r THEN 'R' ELSE '' END || CASE WHEN g THEN 'G' ELSE '' END AS key FROM m)
SELECT CASE WHEN key = '' THEN 'C' ELSE key END AS identity, count(*) AS n FROM k GROUP BY ALL""")
def quality_identity_histogram(spark, sf):
    masks = t.items(spark, sf).select("item_id", sets.color_mask(sets.color_symbols(F.col("color_identity"))).alias("mask"))
    per_entity = t.lines(spark, sf).join(masks, "item_id").groupBy("entity_id").agg(F.bit_or("mask").alias("mask"))
    return per_entity.groupBy(sets.mask_key(F.col("mask")).alias("identity")).agg(F.count(F.lit(1)).alias("n"))


@R.query("quality_spans", f"""WITH {t.ENT}, {t.LINES}, lead AS (
  SELECT entity_id, count(*) FILTER (WHERE is_lead) AS n FROM lines GROUP BY ALL)
SELECT 'views' AS metric, CAST(min(views) AS DOUBLE) AS "min", CAST(max(views) AS DOUBLE) AS "max", round(avg(views), 6) AS "mean" FROM ent
UNION ALL SELECT 'updated_at', CAST(min(epoch(order_date)) AS DOUBLE), CAST(max(epoch(order_date)) AS DOUBLE), round(avg(epoch(order_date)), 3) FROM ent
UNION ALL SELECT 'lead_rows', CAST(min(n) AS DOUBLE), CAST(max(n) AS DOUBLE), round(avg(n), 6) FROM lead""")
def quality_spans(spark, sf):
    ent = t.entities(spark, sf)
    lead = t.lines(spark, sf).groupBy("entity_id").agg(F.count_if("is_lead").alias("n"))
    parts = [
        quality.span(ent, "views").select(F.lit("views").alias("metric"), "min", "max", F.round("mean", 6).alias("mean")),
        quality.span(ent.withColumn("s", F.unix_timestamp("order_date")), "s").select(
            F.lit("updated_at").alias("metric"), "min", "max", F.round("mean", 3).alias("mean")),
        quality.span(lead, "n").select(F.lit("lead_rows").alias("metric"), "min", "max", F.round("mean", 6).alias("mean")),
    ]
    merged = reduce(lambda a, b: a.unionByName(b), parts)
    return merged.withColumns({c: F.col(c).cast("double") for c in ("min", "max")})


@R.query("quality_status", f"""WITH {t.ENT}, {t.LINES}, s AS (SELECT entity_id, sum(quantity) AS size FROM lines GROUP BY ALL), c AS (
  SELECT 'unique ids' AS check_name, count(*) = count(DISTINCT entity_id) AS ok FROM ent
  UNION ALL SELECT 'no empty baskets', bool_and(s.size IS NOT NULL) FROM ent LEFT JOIN s USING (entity_id)
  UNION ALL SELECT 'known items', bool_and(p_partkey IS NOT NULL) FROM lines LEFT JOIN part ON item_id = p_partkey
  UNION ALL SELECT 'positive quantities', bool_and(quantity > 0) FROM lines)
SELECT CASE WHEN bool_and(ok) THEN 'ok' ELSE 'issues' END AS status, count(*) FILTER (WHERE NOT ok) AS n_failed FROM c""")
def quality_status(spark, sf):
    ent, lines = t.entities(spark, sf), t.lines(spark, sf)
    ids = quality.table_report(ent, "entity_id", F.lit(1), (1, 1))
    gap = quality.alignment(ent, lines, ["entity_id"])
    unknown = quality.unreferenced(lines, t.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id")), "item_id")
    checks = [
        ids.select(F.lit("unique ids").alias("check_name"), (F.col("n_repeated_ids") == 0).alias("ok")),
        gap.select(F.lit("no empty baskets").alias("check_name"), (F.col("n_missing") == 0).alias("ok")),
        unknown.agg((F.count(F.lit(1)) == 0).alias("ok")).select(F.lit("known items").alias("check_name"), "ok"),
        lines.agg(F.bool_and(F.col("quantity") > 0).alias("ok")).select(F.lit("positive quantities").alias("check_name"), "ok"),
    ]
    return quality.overall_status(reduce(lambda a, b: a.unionByName(b), checks))


@R.query("quality_recompute_diff", f"""WITH {t.ENT}, s AS (
  SELECT l_orderkey AS entity_id, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS fresh FROM lineitem GROUP BY ALL)
SELECT coalesce(e.entity_id, s.entity_id) AS entity_id,
  CASE WHEN s.entity_id IS NULL THEN 'not_recomputed' ELSE 'different' END AS problem, 'total_price' AS "column"
FROM ent e LEFT JOIN s USING (entity_id) WHERE fresh IS NULL OR abs(total_price - fresh) > 200000""")
def quality_recompute_diff(spark, sf):
    """Stored order totals against totals recomputed from the lines, with a wide tolerance."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    fresh = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("entity_id")).agg(
        F.round(F.sum(revenue), 2).alias("total_price"))
    stored = t.entities(spark, sf).select("entity_id", "total_price")
    return quality.recompute_diff(stored, fresh, ["entity_id"], ["total_price"], 200000.0).select(
        "entity_id", "problem", "column")


@R.query("quality_asof_compare", """WITH live AS (SELECT user_id, max(ts) AS at, max_by(event_type, ts) AS kind FROM events GROUP BY ALL),
saved AS (SELECT user_id, max(ts) AS at, max_by(event_type, ts) AS kind FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY ALL)
SELECT user_id, CASE WHEN live.at > saved.at + INTERVAL 12 HOUR THEN 'skipped_newer_live'
  WHEN live.kind = saved.kind THEN 'identical' ELSE 'different' END AS status FROM live JOIN saved USING (user_id)""")
def quality_asof_compare(spark, sf):
    """A saved user state against the live one, compared only where the live one is not newer."""
    events = t.table(spark, sf, "events")

    def state(df):
        return df.groupBy("user_id").agg(F.max("ts").alias("at"), F.max_by("event_type", "ts").alias("kind"))

    saved = state(events.filter(F.col("ts") < F.lit("2024-01-30").cast("timestamp"))).withColumn(
        "at", F.expr("at + INTERVAL 12 HOURS"))
    return quality.compare_if_current(state(events), saved, "user_id", "at", "at", ["kind"])


# ---------------------------------------------------------------- profile


@R.query("model_filter_reasons", f"""WITH {t.ENT}, r AS (SELECT CASE WHEN y1 NOT BETWEEN 2 AND 4 THEN 'y1_out_of_range:' || y1
  WHEN y2 NOT BETWEEN 2 AND 4 THEN 'y2_out_of_range:' || y2 ELSE 'included' END AS reason FROM ent)
SELECT reason, count(*) AS n FROM r GROUP BY ALL""")
def model_filter_reasons(spark, sf):
    ent = t.entities(spark, sf)
    return ent.groupBy(prep.filter_reason(F.col("y1"), F.col("y2"), (2, 3, 4)).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


@R.query("model_excluded", f"""WITH {t.ENT}
SELECT entity_id, y1, y2, CASE WHEN y1 NOT BETWEEN 2 AND 4 THEN 'y1_out_of_range:' || y1 ELSE 'y2_out_of_range:' || y2 END AS reason
FROM ent WHERE y1 NOT BETWEEN 2 AND 4 OR y2 NOT BETWEEN 2 AND 4""")
def model_excluded(spark, sf):
    _, excluded = prep.split_modelling(t.entities(spark, sf), "y1", "y2", (2, 3, 4))
    return excluded.select("entity_id", "y1", "y2", "reason")


@R.query("eda_label_counts", f"""WITH {t.ENT}, v AS (SELECT CASE WHEN views < 1000 THEN 'missing' ELSE CAST(y2 AS VARCHAR) END AS "value" FROM ent)
SELECT "value", count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM v), 6) AS pct FROM v GROUP BY ALL""")
def eda_label_counts(spark, sf):
    ent = t.entities(spark, sf).withColumn("label", F.when(F.col("views") >= 1000, F.col("y2")))
    return rounded(profile.value_counts(ent, "label"))


@R.query("eda_balance", f"""WITH {t.BASE}
SELECT CAST(y1 AS VARCHAR) AS "value", count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM base), 6) AS pct FROM base GROUP BY ALL""")
def eda_balance(spark, sf):
    return rounded(profile.value_counts(t.modelling_base(spark, sf), "y1"))


_COLORS_SQL = feats_cte(["colors"])


@R.query("eda_presence", f"""{_COLORS_SQL}, u AS (
  {" UNION ALL ".join(f"SELECT 'has_{c}' AS flag, has_{c} AS f FROM fbase" for c in sets.COLOR_ORDER)})
SELECT flag, count(*) FILTER (WHERE f) AS n, round(100.0 * count(*) FILTER (WHERE f) / count(*), 6) AS pct FROM u GROUP BY flag""")
def eda_presence(spark, sf):
    return rounded(profile.presence(base_features(spark, sf, ["colors"]), [f"has_{c}" for c in sets.COLOR_ORDER]))


@R.query("eda_color_histogram", f"""{_COLORS_SQL}
SELECT deck_color_count AS "value", count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM fbase), 6) AS pct
FROM fbase GROUP BY ALL""")
def eda_color_histogram(spark, sf):
    return rounded(divergence.distribution(base_features(spark, sf, ["colors"]), "deck_color_count"))


SUMMARY = ["land_count", "nonland_count", "cmc_mean", "cmc_std", "price_total"]


@R.query("eda_summary", f"""{feats_cte(["mana", "curve"], detail=True)}, u AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM fbase" for c in SUMMARY)})
SELECT col AS "column", count(v) AS n, count(*) FILTER (WHERE v IS NULL) AS n_null, round(avg(v), 4) AS "mean",
  round(stddev_samp(v), 4) AS std, round(median(v), 4) AS "median" FROM u GROUP BY col""")
def eda_summary(spark, sf):
    return rounded(profile.column_summary(stored_base(spark, sf, ["mana", "curve", "price"], SUMMARY), SUMMARY), 4)


BUCKETS = [*[f"cmc_{b}_count" for b in range(6)], "cmc_6_plus_count"]


@R.query("eda_curve_by_label", f"""{feats_cte(["curve"])}, u AS (
  {" UNION ALL ".join(f"SELECT y1, '{c}' AS col, {c} AS v FROM fbase" for c in BUCKETS)})
SELECT y1, col AS "column", round(avg(v), 6) AS "mean" FROM u GROUP BY ALL
UNION ALL SELECT CAST(0 AS BIGINT), col, round(avg(v), 6) FROM u GROUP BY ALL""")
def eda_curve_by_label(spark, sf):
    """Mean curve per label; label 0 stands for all rows."""
    base = stored_base(spark, sf, ["curve"], BUCKETS)
    overall = profile.means(base, BUCKETS).select(F.lit(0).cast("bigint").alias("y1"), "column", "mean")
    return rounded(profile.means(base, BUCKETS, ["y1"]).unionByName(overall))


TYPES = ["creature_count", "instant_count", "sorcery_count", "artifact_count", "enchantment_count", "planeswalker_count"]


@R.query("eda_type_means", f"""{feats_cte(["types"])}, u AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v FROM fbase" for c in TYPES)})
SELECT col AS "column", round(avg(v), 6) AS "mean" FROM u GROUP BY ALL""")
def eda_type_means(spark, sf):
    return rounded(profile.means(base_features(spark, sf, ["types"]), TYPES))


FLAG_COLS = ["game_changer_count", "extra_turns_count", "tutor_count", "mass_land_denial_count",
             "two_card_combo_singleton_count"]


@R.query("eda_flags", f"""{feats_cte(["flags"])}, u AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v FROM fbase" for c in FLAG_COLS)})
SELECT col AS "column", round(avg(v), 6) AS "mean", round(100.0 * count(*) FILTER (WHERE v >= 1) / count(*), 6) AS pct_any,
  round(median(v), 6) AS "median" FROM u GROUP BY ALL""")
def eda_flags(spark, sf):
    return rounded(profile.flag_summary(stored_base(spark, sf, ["flags"], FLAG_COLS), FLAG_COLS))


STAT_COLS = ["edhrec_rank_mean", "salt_median", "price_total", "price_std", "unique_card_count"]


@R.query("eda_nulls", f"""{feats_cte(["structure", "popularity"], detail=True)}, u AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS col, {c} IS NULL AS v FROM feats" for c in STAT_COLS)})
SELECT col AS "column", count(*) FILTER (WHERE v) AS n_null, round(100.0 * count(*) FILTER (WHERE v) / count(*), 6) AS pct
FROM u GROUP BY ALL HAVING count(*) FILTER (WHERE v) > 0""")
def eda_nulls(spark, sf):
    return rounded(profile.null_profile(
        rounded_features(spark, sf, ["structure", "popularity", "price"]), STAT_COLS))


OUTLIERS = ["unique_card_count", "land_count", "price_total"]


@R.query("eda_outliers", f"""{feats_cte(["structure", "mana"], detail=True)}, u AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS col, entity_id, CAST({c} AS DOUBLE) AS v FROM feats" for c in OUTLIERS)})
SELECT col AS "column", entity_id, v AS "value", rank FROM (
  SELECT *, row_number() OVER (PARTITION BY col ORDER BY v DESC, entity_id) AS rank FROM u WHERE v IS NOT NULL) WHERE rank <= 3""")
def eda_outliers(spark, sf):
    return profile.top_values(rounded_features(spark, sf, ["structure", "mana", "price"]), OUTLIERS, "entity_id")


BOX = ["land_count", "creature_count", "price_mean"]


@R.query("eda_boxplot", f"""{feats_cte(["mana", "types"], detail=True)}, u AS (
  {" UNION ALL ".join(f"SELECT y1, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM fbase" for c in BOX)}),
q AS (SELECT y1, col, quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3 FROM u GROUP BY ALL)
SELECT y1, col AS "column", round(q1, 4) AS q1, round(med, 4) AS "median", round(q3, 4) AS q3,
  round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_low,
  round(max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
  count(v) AS n FROM u JOIN q USING (y1, col) GROUP BY y1, col, q1, med, q3""")
def eda_boxplot(spark, sf):
    return rounded(profile.boxplot(stored_base(spark, sf, ["mana", "types", "price"], BOX), BOX, "y1"), 4)


@R.query("eda_groups", f"""WITH {t.ENT}, s AS (SELECT group_id, count(*) AS n FROM ent GROUP BY ALL)
SELECT count(*) AS n_groups, count(*) FILTER (WHERE n > 1) AS n_multi, median(n) AS median_size FROM s""")
def eda_groups(spark, sf):
    return profile.group_summary(t.entities(spark, sf), "group_id")


SIGNED = """sig AS (
  SELECT l_orderkey AS entity_id, array_to_string(list_sort(list_distinct(list(p_type))), ' // ') AS signature
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
signed AS (SELECT ent.*, coalesce(signature, '__unknown__') AS signature FROM ent LEFT JOIN sig USING (entity_id))"""


def signed_entities(spark, sf):
    """Entities with the sorted distinct item types of their basket as a group key. The six types
    bound the collected set."""
    kinds = t.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_type")
    sig = t.lines(spark, sf).join(kinds, "item_id").groupBy("entity_id").agg(
        text.signature(F.collect_set("p_type")).alias("signature"))
    return t.entities(spark, sf).join(sig, "entity_id", "left").withColumn(
        "signature", F.coalesce("signature", F.lit("__unknown__")))


@R.query("eda_top_groups", f"""WITH {t.ENT}, {SIGNED}
SELECT signature, count(*) AS n FROM signed GROUP BY ALL ORDER BY n DESC, signature LIMIT 15""")
def eda_top_groups(spark, sf):
    return profile.top_groups(signed_entities(spark, sf), "signature", 15)


@R.query("group_signature", f"""WITH {t.ENT}, {SIGNED} SELECT entity_id, signature, y1, y2 FROM signed""")
def group_signature(spark, sf):
    return signed_entities(spark, sf).select("entity_id", "signature", "y1", "y2")


CORR = ["land_count", "nonland_count", "creature_count", "instant_count", "game_changer_count", "price_mean",
        "cmc_mean", "price_std"]


@R.query("eda_correlation", f"""{feats_cte(["mana", "types", "flags", "curve"], detail=True)}, c AS (
  SELECT {", ".join(f"corr({a}, {b}) AS {a}__{b}" for i, a in enumerate(CORR) for b in CORR[i + 1:])} FROM fbase)
{" UNION ALL ".join(f"SELECT least('{a}', '{b}') AS column_a, greatest('{a}', '{b}') AS column_b, round({a}__{b}, 6) AS r FROM c" for i, a in enumerate(CORR) for b in CORR[i + 1:])}""")
def eda_correlation(spark, sf):
    pairs = profile.correlation(
        stored_base(spark, sf, ["mana", "types", "flags", "curve", "price"], CORR), CORR)
    return rounded(pairs.select(F.least("column_a", "column_b").alias("column_a"),
                                F.greatest("column_a", "column_b").alias("column_b"), "r"))


# ---------------------------------------------------------------- divergence


def base_delta(spark, sf):
    return divergence.with_delta(t.modelling_base(spark, sf))


@R.query("div_agreement", f"""WITH {t.BASE}, d AS (SELECT abs(y2 - y1) AS d FROM base)
SELECT count(*) AS n, count(*) FILTER (WHERE d = 0) AS n_exact, count(*) FILTER (WHERE d <= 1) AS n_within_1,
  count(*) FILTER (WHERE d <= 2) AS n_within_2, round(100.0 * count(*) FILTER (WHERE d = 0) / count(*), 6) AS pct_exact,
  round(100.0 * count(*) FILTER (WHERE d <= 1) / count(*), 6) AS pct_within_1,
  round(100.0 * count(*) FILTER (WHERE d <= 2) / count(*), 6) AS pct_within_2,
  round(avg(d), 6) AS mean_abs_delta, median(d) AS median_abs_delta FROM d""")
def div_agreement(spark, sf):
    return rounded(divergence.agreement(t.modelling_base(spark, sf)))


_CELLS = ", ".join(f"count(*) FILTER (WHERE y2 = {c}) AS n_{c}, round(100.0 * count(*) FILTER (WHERE y2 = {c}) / count(*), 6) AS pct_{c}"
                   for c in (2, 3, 4))


@R.query("div_crosstab", f"WITH {t.BASE} SELECT y1, {_CELLS} FROM base GROUP BY y1")
def div_crosstab(spark, sf):
    return rounded(divergence.crosstab(t.modelling_base(spark, sf), "y1", "y2", (2, 3, 4)))


@R.query("div_delta", f"""WITH {t.BASE}, d AS (SELECT 'delta' AS kind, y2 - y1 AS v FROM base UNION ALL SELECT 'abs_delta', abs(y2 - y1) FROM base)
SELECT kind, v AS "value", count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM base), 6) AS pct FROM d GROUP BY ALL""")
def div_delta(spark, sf):
    base = base_delta(spark, sf)
    parts = [divergence.distribution(base, c).select(F.lit(c).alias("kind"), "value", "n", "pct")
             for c in ("delta", "abs_delta")]
    return rounded(parts[0].unionByName(parts[1]))


@R.query("div_direction", f"""WITH {t.BASE}, d AS (SELECT y2 - y1 AS d FROM base)
SELECT count(*) AS n, count(*) FILTER (WHERE d > 0) AS n_above, count(*) FILTER (WHERE d = 0) AS n_equal,
  count(*) FILTER (WHERE d < 0) AS n_below, round(avg(d), 6) AS mean_delta,
  CASE WHEN count(*) FILTER (WHERE d > 0) > count(*) FILTER (WHERE d < 0) THEN 'reference_above'
    WHEN count(*) FILTER (WHERE d > 0) < count(*) FILTER (WHERE d < 0) THEN 'reference_below' ELSE 'balanced' END AS tendency FROM d""")
def div_direction(spark, sf):
    return rounded(divergence.direction(base_delta(spark, sf)))


_BY = """count(*) AS n, round(100.0 * count(*) FILTER (WHERE delta = 0) / count(*), 6) AS pct_zero,
  round(avg(delta), 6) AS mean_delta, round(avg(abs(delta)), 6) AS mean_abs_delta, median(abs(delta)) AS median_abs_delta"""


@R.query("div_by_discrete", f"""{_COLORS_SQL} SELECT deck_color_count AS bucket, {_BY} FROM fbase GROUP BY deck_color_count""")
def div_by_discrete(spark, sf):
    return rounded(divergence.by_value(base_features(spark, sf, ["colors"]), F.col("deck_color_count")))


@R.query("div_by_quintile", f"""{feats_cte(["structure"], detail=True)},
e AS (SELECT list_sort(list_distinct(quantile_cont(price_total, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM fbase),
b AS (SELECT delta, greatest(len(list_filter(edges, lambda x: x < price_total)), 1) AS bin, edges FROM fbase, e WHERE price_total IS NOT NULL)
SELECT bin, round(edges[bin], 4) AS low, round(edges[bin + 1], 4) AS high, {_BY} FROM b GROUP BY bin, edges""")
def div_by_quintile(spark, sf):
    binned = divergence.by_quantile(stored_base(spark, sf, ["price"], ["price_total"]), "price_total")
    return rounded(rounded(binned, 4, ["low", "high"]), 6)


@R.query("div_by_bucket", f"""{feats_cte(["flags"])}
SELECT CASE WHEN tutor_count >= 4 THEN '4+' ELSE CAST(tutor_count AS VARCHAR) END AS bucket, {_BY} FROM fbase GROUP BY 1""")
def div_by_bucket(spark, sf):
    base = base_features(spark, sf, ["flags"])
    return rounded(divergence.by_value(base, divergence.count_bucket(F.col("tutor_count"))))


MEANS = ["land_count", "creature_count", "game_changer_count", "price_mean"]


@R.query("div_means_by_sign", f"""{feats_cte(["mana", "types", "flags"], detail=True)}, u AS (
  {" UNION ALL ".join(f"SELECT delta, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM fbase" for c in MEANS)})
SELECT CASE WHEN delta > 0 THEN 'above' WHEN delta < 0 THEN 'below' ELSE 'equal' END AS sign, col AS "column",
  round(avg(v), 5) AS "mean" FROM u GROUP BY ALL""")
def div_means_by_sign(spark, sf):
    return rounded(divergence.means_by_sign(base_features(spark, sf, ["mana", "types", "flags", "price"]), MEANS), 5)


EXT = ["land_count", "creature_count", "game_changer_count"]


@R.query("div_extremes", f"""{feats_cte(["mana", "types", "flags"])}, u AS (
  {" UNION ALL ".join(f"SELECT y1, y2, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM feats" for c in EXT)}),
o AS (SELECT y2, col, avg(v) AS m FROM u WHERE y2 IN (1, 5) GROUP BY ALL),
b AS (SELECT col, avg(v) AS m FROM u WHERE y1 BETWEEN 2 AND 4 AND y2 BETWEEN 2 AND 4 GROUP BY ALL)
SELECT o.y2 AS y2, col AS "column", round(o.m, 6) AS mean_outside, round(b.m, 6) AS mean_base, round(o.m - b.m, 6) AS difference
FROM o JOIN b USING (col)""")
def div_extremes(spark, sf):
    feats = rounded_features(spark, sf, ["mana", "types", "flags"])
    base = feats.filter(F.col("y1").between(2, 4) & F.col("y2").between(2, 4))
    return rounded(divergence.extremes(feats, base, "y2", (1, 5), EXT))


@R.query("div_extreme_crosstab", f"""WITH {t.ENT}
SELECT y1, count(*) FILTER (WHERE y2 = 1) AS n_1, count(*) FILTER (WHERE y2 = 5) AS n_5,
  round(100.0 * count(*) FILTER (WHERE y2 = 1) / count(*), 6) AS pct_1, round(100.0 * count(*) FILTER (WHERE y2 = 5) / count(*), 6) AS pct_5
FROM ent WHERE y2 IN (1, 5) GROUP BY y1""")
def div_extreme_crosstab(spark, sf):
    outside = t.entities(spark, sf).filter(F.col("y2").isin(1, 5))
    return rounded(divergence.crosstab(outside, "y1", "y2", (1, 2, 3, 4, 5), (1, 5)))


@R.query("div_extreme_groups", f"""WITH {t.ENT}, {SIGNED}, s AS (SELECT y2, signature, count(*) AS n FROM signed WHERE y2 IN (1, 5) GROUP BY ALL)
SELECT y2, signature, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY y2 ORDER BY n DESC, signature) AS rank FROM s) WHERE rank <= 10""")
def div_extreme_groups(spark, sf):
    return divergence.extreme_groups(signed_entities(spark, sf), "y2", (1, 5), "signature")


@R.query("distinct_counts", f"""WITH {t.ENT}, {t.LINES}
SELECT (SELECT count(DISTINCT entity_id) FROM ent) AS n_entities, (SELECT count(DISTINCT item_id) FROM lines) AS n_items,
  (SELECT count(DISTINCT group_id) FROM ent) AS n_groups""")
def distinct_counts(spark, sf):
    """Exact distinct counts as counts over distributed distinct sets."""
    def n(df, c, name):
        return df.select(c).distinct().agg(F.count(F.lit(1)).alias(name))

    ent = t.entities(spark, sf)
    return n(ent, "entity_id", "n_entities").join(n(t.lines(spark, sf), "item_id", "n_items")).join(
        n(ent, "group_id", "n_groups"))
