"""Feature queries: item lookup, line detail, feature groups, the wide table and the bag."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketwise.functions import sets
from basketwise.operators import features
from basketwise.operators.features import MANA, FLAGS
from basketwise.plans import tables as t
from basketwise.plans.registry import Registry, rounded
from basketwise.session import materialize

R = Registry()

KW = list(t.SPEC.tracked_keywords)
WITH_LINES = f"WITH {t.ENT}, {t.LINES}, {t.ITEMS}, bag AS (SELECT entity_id, item_id, CAST(sum(quantity) AS BIGINT) AS q, CAST(sum(CASE WHEN is_lead THEN quantity ELSE 0 END) AS BIGINT) AS lead_q FROM lines GROUP BY ALL), j AS (SELECT b.entity_id, b.q, b.lead_q, i.* FROM bag b JOIN items i USING (item_id))"


def _bigint(expr: str, alias: str) -> str:
    return f"CAST(coalesce({expr}, 0) AS BIGINT) AS {alias}"


def _sum(cond: str, alias: str) -> str:
    return _bigint(f"sum(CASE WHEN {cond} THEN q ELSE 0 END)", alias)


def _stats(col: str, prefix: str, cond: str = "true") -> list[str]:
    """Mean, median and population deviation over values repeated by quantity."""
    x = f"list(struct_pack(v := {col}, q := q)) FILTER (WHERE {cond} AND {col} IS NOT NULL)"
    flat = f"flatten(list_transform({x}, lambda e: list_resize([e.v], e.q, e.v)))"
    return [
        f"round(list_avg({flat}), 6) AS {prefix}_mean",
        f"round(list_median({flat}), 6) AS {prefix}_median",
        f"round(list_aggregate({flat}, 'stddev_pop'), 6) AS {prefix}_std",
    ]


MANA_SQL = {c: f"(is_land AND p_size % {i + 2} = 0)" for i, c in enumerate(MANA)}
MULTI = " + ".join(f"CAST({MANA_SQL[c]} AS INT)" for c in sets.COLOR_ORDER)
HAS = {c: f"c_{c.lower()}" for c in sets.COLOR_ORDER}

SQL = {
    "structure": [
        "CAST(count(item_id) AS BIGINT) AS unique_card_count",
        _bigint("sum(q - lead_q)", "non_commander_card_count"), _bigint("sum(lead_q)", "commander_card_count"),
        "false AS has_companion",
    ],
    "colors": [
        " + ".join(f"CAST(coalesce(bool_or({HAS[c]}), false) AS BIGINT)" for c in sets.COLOR_ORDER)
        + " AS deck_color_count",
        *[f"coalesce(bool_or({HAS[c]}), false) AS has_{c}" for c in sets.COLOR_ORDER],
    ],
    "mana": [
        _sum("is_land", "land_count"), _sum("NOT is_land", "nonland_count"),
        _sum("is_basic_land", "basic_land_count"), _sum("is_land AND NOT is_basic_land", "nonbasic_land_count"),
        *[_sum(MANA_SQL[c], f"land_mana_production_{c}") for c in MANA],
        _sum(f"({MULTI}) > 1", "lands_that_produce_multiple_colors_count"),
        _sum(MANA_SQL["C"], "lands_that_produce_colorless_count"),
    ],
    "curve": [
        *_stats("cmc", "cmc"), *_stats("cmc", "nonland_cmc", "NOT is_land"),
        *[_sum(f"NOT is_land AND cmc = {b}", f"cmc_{b}_count") for b in range(6)],
        _sum("NOT is_land AND cmc >= 6", "cmc_6_plus_count"),
    ],
    "types": [
        *[_sum(f"is_{x}", f"{x}_count") for x in
          ("creature", "instant", "sorcery", "artifact", "enchantment", "planeswalker")],
        _sum("NOT is_creature AND NOT is_land", "noncreature_spell_count"),
        _sum("NOT is_land AND (is_creature OR is_artifact OR is_enchantment OR is_planeswalker)",
             "nonland_permanent_count"),
    ],
    "flags": [_sum(f"item_id % {10 + i} = 0", f"{f}_count") for i, f in enumerate(FLAGS)],
    "popularity": [*_stats("edhrec_rank", "edhrec_rank"), *_stats("salt", "salt")],
    "keywords_plain": [
        _bigint("sum(q * len(w))", "keyword_total_count"),
        *[_bigint(f"sum(q * len(list_filter(w, lambda x: x = '{k}')))", f"{k}_count") for k in KW],
        _bigint("sum(q * len(list_filter(w, lambda x: starts_with(x, 'gi'))))", "protection_keyword_count"),
    ],
    "subtypes_plain": [
        _sum("is_legendary", "legendary_count"), _sum("is_snow", "snow_count"),
        *[_sum(f"list_contains(sub_types, '{s}')", f"{s.lower()}_subtype_count")
          for s in ("Equipment", "Aura", "Vehicle")],
    ],
    "combos_plain": [
        _sum("len(atomic) > 0", "cards_with_atomic_combos_count"),
        _sum("len(potential) > 0", "cards_with_potential_combos_count"),
        _bigint("sum(q * len(atomic))", "atomic_combo_refs_total"),
        _bigint("sum(q * len(potential))", "potential_combo_refs_total"),
        _bigint("sum(q * len(two_card))", "two_card_combo_ids_total"),
    ],
    "faces": [
        _sum("n_faces > 0", "multiface_card_count"),
        *[_sum(f"layout = {i}", f"layout_{x}_count") for i, x in enumerate(features.TRACKED_LAYOUTS)],
        _sum("n_faces > 0", "cards_with_faces_count"), _bigint("sum(q * n_faces)", "total_face_count"),
        _bigint("max(n_faces)", "max_faces_on_card"),
    ],
}
TAGS = """tagged AS (
  SELECT entity_id, kind, tag, sum(q) AS w FROM (
    SELECT entity_id, q, 'keyword' AS kind, unnest(list_distinct(w)) AS tag FROM j
    UNION ALL SELECT entity_id, q, 'subtype', unnest(sub_types) FROM j
    UNION ALL SELECT entity_id, q, 'atomic', unnest(list_distinct(atomic)) FROM j
    UNION ALL SELECT entity_id, q, 'potential', unnest(list_distinct(potential)) FROM j
    UNION ALL SELECT entity_id, q, 'two_card', unnest(list_distinct(two_card)) FROM j)
  GROUP BY ALL), tg AS (
  SELECT entity_id,
    count(*) FILTER (WHERE kind = 'keyword') AS distinct_keyword_count,
    count(*) FILTER (WHERE kind = 'subtype') AS distinct_subtype_count,
    CAST(coalesce(max(w) FILTER (WHERE kind = 'subtype'), 0) AS BIGINT) AS most_common_subtype_count,
    count(*) FILTER (WHERE kind = 'atomic') AS unique_atomic_combo_refs_count,
    count(*) FILTER (WHERE kind = 'potential') AS unique_potential_combo_refs_count,
    count(*) FILTER (WHERE kind = 'two_card') AS unique_two_card_combo_ids_count
  FROM tagged GROUP BY entity_id)"""
TAG_COLS = {
    "keywords": ["distinct_keyword_count"],
    "subtypes": ["distinct_subtype_count", "most_common_subtype_count"],
    "combos": ["unique_atomic_combo_refs_count", "unique_potential_combo_refs_count",
               "unique_two_card_combo_ids_count"],
}
DETAILED = f"""{t.DETAIL}, dj AS (
  SELECT l.entity_id, l.quantity AS q, d.rarity, d.price FROM lines l LEFT JOIN detail d USING (entity_id, line_id)),
 dt AS (SELECT entity_id,
  {", ".join(_sum(f"rarity = '{r}'", f"{r}_count") for r in features.RARITIES)},
  round(sum(price * q), 4) AS price_total, {", ".join(_stats("price", "price"))}
  FROM dj GROUP BY entity_id)"""
DETAIL_COLS = ["price_total", "price_mean", "price_median", "price_std",
               *[f"{r}_count" for r in features.RARITIES]]


def _parts(parts: list[str], tag_cols: list[str] = (), detail: bool = False, carry: str = "") -> tuple[str, str]:
    """(common tables, final select) for some feature groups over all orders, empty ones included."""
    sql = WITH_LINES
    plain = [c for p in parts for c in SQL[p]]
    joins, extra = "", []
    if tag_cols:
        sql += f", {TAGS}"
        joins += " LEFT JOIN tg USING (entity_id)"
        extra += [f"coalesce(tg.{c}, 0) AS {c}" for c in tag_cols]
    if detail:
        sql += f", {DETAILED}"
        joins += " LEFT JOIN dt USING (entity_id)"
        extra += [f"dt.{c} AS {c}" if c.startswith("price") else f"coalesce(dt.{c}, 0) AS {c}" for c in DETAIL_COLS]
    names = [c.rsplit(" AS ", 1)[1] for c in plain]
    if plain:
        sql += (f", f AS (SELECT e.entity_id, {', '.join(plain)} FROM ent e LEFT JOIN j USING (entity_id) "
                "GROUP BY e.entity_id)")
        joins = " JOIN f USING (entity_id)" + joins
    columns = ", ".join([f"f.{n} AS {n}" for n in names] + extra)
    return sql, f"SELECT entity_id, {carry}{columns} FROM ent{joins}"


def _select(*args, **kwargs) -> str:
    return " ".join(_parts(*args, **kwargs))


CARRY = ["group_id", "y1", "y2", "views", "status"]


def feats_cte(parts: list[str], tag_cols: list[str] = (), detail: bool = False) -> str:
    """``WITH … feats AS (…), fbase AS (…)``: features of all orders and of the modelling base."""
    ctes, select = _parts(parts, tag_cols, detail, carry=", ".join(CARRY) + ", ")
    return (f"{ctes}, feats AS ({select}), "
            "fbase AS (SELECT *, y2 - y1 AS delta FROM feats WHERE y1 BETWEEN 2 AND 4 AND y2 BETWEEN 2 AND 4)")


def _group(groups: list[str]):
    def run(spark, sf):
        needs_detail = {"price", "rarity"} & set(groups)
        df = features.basket_features(
            t.entities(spark, sf), t.lines(spark, sf), t.items(spark, sf),
            t.detail(spark, sf) if needs_detail else None, groups, spec=t.SPEC,
        )
        if "price_total" in df.columns:
            df = df.withColumn("price_total", F.round("price_total", 4))
        return rounded(df)
    return run


@R.query("item_lookup", f"""WITH {t.LINES}, {t.ITEMS}
SELECT l.entity_id, l.line_id, l.item_id, l.quantity, i.name, i.cmc FROM lines l LEFT JOIN items i USING (item_id)""")
def item_lookup(spark, sf):
    """Lines with the attributes of their item."""
    lookup = t.items(spark, sf).select("item_id", "name", "cmc")
    return t.lines(spark, sf).join(lookup, "item_id", "left").select(
        "entity_id", "line_id", "item_id", "quantity", "name", "cmc")


@R.query("line_detail_join", f"""WITH {t.LINES}, {t.DETAIL}
SELECT entity_id, line_id, item_id, quantity, rarity, round(price, 6) AS price
FROM lines LEFT JOIN detail USING (entity_id, line_id)""")
def line_detail_join(spark, sf):
    """Lines with rarity and price by the composite key; prices fall back vendor by vendor."""
    joined = features.join_detail(t.lines(spark, sf), t.detail(spark, sf))
    return rounded(joined.select(
        "entity_id", "line_id", "item_id", "quantity", F.lower("rarity").alias("rarity"),
        features.price_of(F.col("prices")).alias("price")))


R.query("feat_structure", _select(["structure", "colors"]))(_group(["structure", "colors"]))
R.query("feat_mana_base", _select(["mana"]))(_group(["mana"]))
R.query("feat_curve", _select(["curve"]))(_group(["curve"]))
R.query("feat_types", _select(["types"]))(_group(["types"]))
R.query("feat_flags", _select(["flags"]))(_group(["flags"]))
R.query("feat_combo_sets", _select(["combos_plain"], TAG_COLS["combos"]))(_group(["combos"]))
R.query("feat_popularity_price", _select(["popularity"], detail=True))(_group(["popularity", "price", "rarity"]))
R.query("feat_keywords", _select(["keywords_plain"], TAG_COLS["keywords"]))(_group(["keywords"]))
R.query("feat_subtypes", _select(["subtypes_plain"], TAG_COLS["subtypes"]))(_group(["subtypes"]))
R.query("feat_faces", _select(["faces"]))(_group(["faces"]))


def wide_features(spark, sf, groups=None, rows=None):
    """All feature groups with labels and metadata; shared by the analysis queries. ``rows`` are the lines to use, if not all."""
    return features.basket_features(
        t.entities(spark, sf), t.lines(spark, sf, rows), t.items(spark, sf), t.detail(spark, sf, rows), groups,
        spec=t.SPEC, carry=CARRY, store=groups is None,
    )


def rounded_features(spark, sf, groups, rows=None):
    df = wide_features(spark, sf, groups, rows)
    if "price_total" in df.columns:
        df = df.withColumn("price_total", F.round("price_total", 4))
    return rounded(df)


def base_features(spark, sf, groups, rows=None):
    """Features of the modelling base with the label difference; ``rows`` are its lines, where they are stored."""
    return rounded_features(spark, sf, groups, rows).filter(
        F.col("y1").between(2, 4) & F.col("y2").between(2, 4)).withColumn("delta", F.col("y2") - F.col("y1"))


def stored_base(spark, sf, groups, columns):
    """The needed columns of the base, written once for analyses that read them several times."""
    return materialize(base_features(spark, sf, groups).select("entity_id", "y1", "y2", "delta", *columns), "base")


@R.query("feature_wide", _select(
    ["structure", "colors", "mana", "curve", "types", "flags", "combos_plain", "popularity", "keywords_plain",
     "subtypes_plain", "faces"],
    TAG_COLS["keywords"] + TAG_COLS["subtypes"] + TAG_COLS["combos"], detail=True,
    carry="group_id, y1, y2, views, status, CAST(f.commander_card_count + f.non_commander_card_count AS BIGINT) AS mainboard_count, "))
def feature_wide(spark, sf):
    """The flagship: 105 features of every basket (103 measures, views and basket size), one row each."""
    size = F.col("commander_card_count") + F.col("non_commander_card_count")
    wide = wide_features(spark, sf).withColumns({"price_total": F.round("price_total", 4), "mainboard_count": size})
    return rounded(wide)


@R.query("bag_long", f"""WITH {t.LINES}
SELECT entity_id, item_id, CAST(sum(quantity) AS BIGINT) AS quantity,
  CAST(sum(CASE WHEN is_lead THEN quantity ELSE 0 END) AS BIGINT) AS lead_quantity
FROM lines WHERE quantity > 0 GROUP BY ALL""")
def bag_long(spark, sf):
    return features.bag_long(t.lines(spark, sf))


@R.query("bag_map", f"""WITH {t.LINES}, bag AS (
  SELECT entity_id, item_id, sum(quantity) AS q FROM lines WHERE quantity > 0 GROUP BY ALL)
SELECT entity_id, CAST(count(*) AS BIGINT) AS n_items,
  string_agg(item_id || ':' || q, ',' ORDER BY item_id) AS counts FROM bag GROUP BY entity_id""")
def bag_map(spark, sf):
    """The bag as one map per basket, printed in item order."""
    maps = features.bag_map(features.bag_long(t.lines(spark, sf)))
    entries = F.array_sort(F.map_entries("counts"))
    return maps.select(
        "entity_id", F.size("counts").cast("bigint").alias("n_items"),
        F.array_join(F.transform(entries, lambda e: F.concat(
            e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",").alias("counts"))
