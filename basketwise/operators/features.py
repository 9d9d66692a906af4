"""Quantity-weighted basket features and the bag of items.

Everything that depends on the item alone (is it a land, how many keywords, which price bucket…)
is computed once per item; a basket feature is then ``sum(quantity * item measure)``. Lines are
first combined to (entity, item), which shrinks the join input, makes ``unique_card_count`` a plain
count and spreads a hot basket over its items before the final per-entity aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.functions import sets
from basketwise.functions.coerce import finite, weighted_mean, weighted_pop_std
from basketwise.operators.curate import is_basic
from basketwise.session import materialize

# Keywords and layouts that get a column of their own, price vendors by preference.
TRACKED_KEYWORDS = (
    "Flying", "Trample", "Haste", "Hexproof", "Ward", "Indestructible", "Lifelink", "Menace",
    "Vigilance", "Deathtouch", "Flash", "Equip", "Annihilator", "Cascade",
)
TRACKED_LAYOUTS = ("normal", "transform", "modal_dfc", "split", "adventure")
PRICE_VENDORS = ("tcg", "ck", "cm", "scg", "mp", "cardTrader")
CARD_TYPES = ("Creature", "Instant", "Sorcery", "Artifact", "Enchantment", "Planeswalker")
SUBTYPE_COLUMNS = ("Equipment", "Aura", "Vehicle")
MANA = ("W", "U", "B", "R", "G", "C")
FLAGS = ("game_changer", "extra_turns", "tutor", "mass_land_denial", "two_card_combo_singleton")
RARITIES = ("common", "uncommon", "rare", "mythic")


@dataclass(frozen=True)
class FeatureSpec:
    tracked_keywords: Sequence[str] = TRACKED_KEYWORDS
    tracked_layouts: Sequence[str] = TRACKED_LAYOUTS
    protection_prefix: str = "Protection"
    price_vendors: Sequence[str] = PRICE_VENDORS


def feature_groups(spec: FeatureSpec = FeatureSpec()) -> dict[str, list[str]]:
    """Feature columns by group, in output order."""
    return {
        "structure": ["unique_card_count", "non_commander_card_count", "commander_card_count", "has_companion"],
        "colors": ["deck_color_count", *[f"has_{c}" for c in sets.COLOR_ORDER]],
        "mana": ["land_count", "nonland_count", "basic_land_count", "nonbasic_land_count",
                 *[f"land_mana_production_{c}" for c in MANA],
                 "lands_that_produce_multiple_colors_count", "lands_that_produce_colorless_count"],
        "curve": ["cmc_mean", "cmc_median", "cmc_std", "nonland_cmc_mean", "nonland_cmc_median",
                  "nonland_cmc_std", *[f"cmc_{b}_count" for b in range(6)], "cmc_6_plus_count"],
        "types": [*[f"{t.lower()}_count" for t in CARD_TYPES], "noncreature_spell_count",
                  "nonland_permanent_count"],
        "flags": [f"{f}_count" for f in FLAGS],
        "combos": ["cards_with_atomic_combos_count", "cards_with_potential_combos_count",
                   "atomic_combo_refs_total", "potential_combo_refs_total",
                   "unique_atomic_combo_refs_count", "unique_potential_combo_refs_count",
                   "two_card_combo_ids_total", "unique_two_card_combo_ids_count"],
        "popularity": [f"{c}_{s}" for c in ("edhrec_rank", "salt") for s in ("mean", "median", "std")],
        "price": ["price_total", "price_mean", "price_median", "price_std"],
        "rarity": [f"{r}_count" for r in RARITIES],
        "keywords": ["keyword_total_count", "distinct_keyword_count",
                     *[f"{k.lower()}_count" for k in spec.tracked_keywords], "protection_keyword_count"],
        "subtypes": ["legendary_count", "snow_count", "distinct_subtype_count", "most_common_subtype_count",
                     *[f"{s.lower()}_subtype_count" for s in SUBTYPE_COLUMNS]],
        "faces": ["multiface_card_count", *[f"layout_{x}_count" for x in spec.tracked_layouts],
                  "cards_with_faces_count", "total_face_count", "max_faces_on_card"],
    }


def feature_columns(spec: FeatureSpec = FeatureSpec()) -> list[str]:
    return [c for cols in feature_groups(spec).values() for c in cols]


def usable_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(
        F.col("item_id").isNotNull() & (F.col("item_id").cast("string") != "") & (F.col("quantity") > 0)
    )


def bag_long(lines: DataFrame, entity: str = "entity_id") -> DataFrame:
    """``(entity, item_id, quantity, lead_quantity)``, one row per distinct item of a basket."""
    lead = F.when(F.col("is_lead"), F.col("quantity")).otherwise(0) if "is_lead" in lines.columns else F.lit(0)
    return usable_lines(lines).groupBy(entity, "item_id").agg(
        F.sum("quantity").cast("bigint").alias("quantity"),
        F.sum(lead).cast("bigint").alias("lead_quantity"),
    )


def bag_map(bag: DataFrame, entity: str = "entity_id") -> DataFrame:
    """``(entity, counts)``: one map per basket. The long form (:func:`bag_long`) is the one without a bound on rows."""
    return bag.groupBy(entity).agg(
        F.map_from_entries(F.collect_list(F.struct("item_id", "quantity"))).alias("counts")
    )


def price_of(prices: Column, vendors: Sequence[str] = PRICE_VENDORS) -> Column:
    """First positive vendor price."""
    found = [F.try_element_at(prices, F.lit(v)) for v in vendors]
    return F.coalesce(*[F.when(p > 0, p.cast("double")) for p in found])


def cost_bucket(cost: Column) -> Column:
    """0, 1..5 by whole part, 6 for six and more."""
    return F.when(cost <= 0, 0).when(cost >= 6, 6).otherwise(F.floor(cost)).cast("int")


def cost_value(cost: Column) -> Column:
    return F.coalesce(finite(cost.cast("double")), F.lit(0.0))


def item_measures(items: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """Numeric measures and tags per item, computed once on the dimension.

    ``m_*`` columns are whole numbers to be summed by quantity, ``v_*`` are values for statistics.
    """

    def has(array: str, value: str) -> str:
        return f"coalesce(array_contains({array}, '{value}'), false)"

    def num(cond: str) -> str:
        return f"cast(coalesce({cond}, false) AS bigint)"

    def count(array: str) -> str:
        return f"cast(coalesce(size({array}), 0) AS bigint)"

    flat = items.select(
        "*",
        F.expr(has("types", "Land")).alias("is_land"),
        is_basic(F.col("name"), F.col("super_types"), F.col("types")).alias("is_basic"),
        sets.color_symbols(F.col("color_identity")).alias("colours"),
        F.expr("array_distinct(coalesce(sub_types, cast(array() AS array<string>)))").alias("subs"),
        F.expr("coalesce(keywords, cast(array() AS array<string>))").alias("kws"),
        cost_value(F.col("cmc")).alias("v_cmc"),
        *[F.expr(f"coalesce(try_element_at(mana_production, '{c}'), 0) <> 0 AND {has('types', 'Land')}")
          .alias(f"makes_{c}") for c in MANA],
    )
    coloured = " + ".join(f"cast(makes_{c} AS int)" for c in sets.COLOR_ORDER)
    spell = " OR ".join(has("types", x) for x in ("Creature", "Artifact", "Enchantment", "Planeswalker"))
    exprs = {
        "m_land": num("is_land"), "m_nonland": num("NOT is_land"),
        "m_basic_land": num("is_land AND is_basic"), "m_nonbasic_land": num("is_land AND NOT is_basic"),
        "m_multi_land": num(f"({coloured}) > 1"), "m_colorless_land": num("makes_C"),
        "m_noncreature_spell": num(f"NOT is_land AND NOT {has('types', 'Creature')}"),
        "m_nonland_permanent": num(f"NOT is_land AND ({spell})"),
        "m_legendary": num(has("super_types", "Legendary")), "m_snow": num(has("super_types", "Snow")),
        "m_keywords": count("kws"),
        "m_protection": count(f"filter(kws, k -> startswith(k, '{spec.protection_prefix}'))"),
        "m_atomic": count("atomic_combos"), "m_potential": count("potential_combos"),
        "m_two_card": count("two_card_combo_ids"),
        "m_faces": count("faces"), "m_multiface": num("size(faces) > 0"),
        "v_rank": "cast(edhrec_rank AS double)", "v_salt": "cast(salt AS double)",
    }
    exprs |= {f"m_mana_{c}": num(f"makes_{c}") for c in MANA}
    exprs |= {f"m_has_{c}": num(f"array_contains(colours, '{c}')") for c in sets.COLOR_ORDER}
    exprs |= {f"m_type_{n}": num(has("types", n)) for n in CARD_TYPES}
    exprs |= {f"m_flag_{f}": num(f) for f in FLAGS}
    exprs |= {f"m_kw_{i}": count(f"filter(kws, k -> k = '{w}')") for i, w in enumerate(spec.tracked_keywords)}
    exprs |= {f"m_sub_{x}": num(f"array_contains(subs, '{x}')") for x in SUBTYPE_COLUMNS}
    exprs |= {f"m_layout_{x}": num(f"layout = '{x}'") for x in spec.tracked_layouts}
    families = {"keyword": "kws", "subtype": "subs", "atomic": "atomic_combos",
                "potential": "potential_combos", "two_card": "two_card_combo_ids"}
    tags = ", ".join(
        f"transform(array_distinct(coalesce({c}, cast(array() AS array<string>))), "
        f"x -> named_struct('kind', '{k}', 'tag', x))" for k, c in families.items()
    )
    return flat.select(
        "item_id", "v_cmc", cost_bucket(F.col("v_cmc")).alias("v_bucket"),
        *[F.expr(e).alias(n) for n, e in exprs.items()], F.expr(f"concat({tags})").alias("tags"),
    )


# what a line counts as when its item is not in the item table
_UNKNOWN_ITEM = {"m_nonland": 1, "m_noncreature_spell": 1, "v_cmc": 0.0, "v_bucket": 0}


def attach_items(bag: DataFrame, measures: DataFrame) -> DataFrame:
    """Left join on the item id; unknown items count as empty attributes. The item table is shuffled: the size that Spark
    would go by is that of the packed file, while its measures and tags take up a hundred times as much in memory."""
    plain = [c for c in measures.columns if c not in ("item_id", "tags", "v_rank", "v_salt")]
    return bag.join(measures.hint("merge"), "item_id", "left").select(
        *bag.columns, "v_rank", "v_salt",
        *[F.expr(f"coalesce({c}, {_UNKNOWN_ITEM.get(c, 0)})").alias(c) for c in plain],
    )


def _moments(value: str, weight: str, prefix: str, where: str = "true") -> list[Column]:
    on = f"FILTER (WHERE {value} IS NOT NULL AND {where})"
    return [
        F.expr(f"sum({weight}) {on}").alias(f"__{prefix}_q"),
        F.expr(f"sum({value} * {weight}) {on}").alias(f"__{prefix}_qx"),
        F.expr(f"sum({value} * {value} * {weight}) {on}").alias(f"__{prefix}_qxx"),
    ]


def _median(value: str, weight: str, prefix: str, where: str = "true") -> Column:
    """Exact weighted median. Its state is one entry per distinct value, so it is bounded by the
    values the catalogue can take, not by the size of the basket."""
    return F.expr(f"percentile({value}, 0.5, {weight}) FILTER (WHERE {where})").alias(f"{prefix}_median")


def _moment_columns(prefix: str, total: bool = False) -> dict[str, Column]:
    q, qx, qxx = (F.col(f"__{prefix}_{s}") for s in ("q", "qx", "qxx"))
    out = {f"{prefix}_mean": weighted_mean(qx, q), f"{prefix}_std": weighted_pop_std(q, qx, qxx)}
    return {f"{prefix}_total": qx, **out} if total else out


_STATISTICS = {  # prefix: (value, filter)
    "cmc": ("v_cmc", "true"), "nonland_cmc": ("v_cmc", "m_nonland = 1"),
    "edhrec_rank": ("v_rank", "true"), "salt": ("v_salt", "true"),
}


def item_features(bag_items: DataFrame, entity: str = "entity_id",
                  spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """All features that are sums over item measures, one row per entity."""

    def total(measure: str, alias: str) -> Column:
        return F.expr(f"sum(quantity * {measure})").alias(alias)

    def where(cond: str, alias: str) -> Column:
        return F.expr(f"sum(if({cond}, quantity, 0L))").alias(alias)

    aggs = [
        F.count(F.lit(1)).alias("unique_card_count"),
        F.expr("sum(quantity - lead_quantity)").alias("non_commander_card_count"),
        F.sum("lead_quantity").alias("commander_card_count"),
        *[F.expr(f"max(m_has_{c}) = 1").alias(f"has_{c}") for c in sets.COLOR_ORDER],
        total("m_land", "land_count"), total("m_nonland", "nonland_count"),
        total("m_basic_land", "basic_land_count"), total("m_nonbasic_land", "nonbasic_land_count"),
        *[total(f"m_mana_{c}", f"land_mana_production_{c}") for c in MANA],
        total("m_multi_land", "lands_that_produce_multiple_colors_count"),
        total("m_colorless_land", "lands_that_produce_colorless_count"),
        *[where(f"m_nonland = 1 AND v_bucket = {b}", f"cmc_{b}_count" if b < 6 else "cmc_6_plus_count")
          for b in range(7)],
        *[total(f"m_type_{n}", f"{n.lower()}_count") for n in CARD_TYPES],
        total("m_noncreature_spell", "noncreature_spell_count"),
        total("m_nonland_permanent", "nonland_permanent_count"),
        *[total(f"m_flag_{f}", f"{f}_count") for f in FLAGS],
        where("m_atomic > 0", "cards_with_atomic_combos_count"),
        where("m_potential > 0", "cards_with_potential_combos_count"),
        total("m_atomic", "atomic_combo_refs_total"), total("m_potential", "potential_combo_refs_total"),
        total("m_two_card", "two_card_combo_ids_total"),
        total("m_keywords", "keyword_total_count"),
        *[total(f"m_kw_{i}", f"{k.lower()}_count") for i, k in enumerate(spec.tracked_keywords)],
        total("m_protection", "protection_keyword_count"),
        total("m_legendary", "legendary_count"), total("m_snow", "snow_count"),
        *[total(f"m_sub_{s}", f"{s.lower()}_subtype_count") for s in SUBTYPE_COLUMNS],
        total("m_multiface", "multiface_card_count"), total("m_multiface", "cards_with_faces_count"),
        *[total(f"m_layout_{x}", f"layout_{x}_count") for x in spec.tracked_layouts],
        total("m_faces", "total_face_count"), F.max("m_faces").alias("max_faces_on_card"),
        *[m for p, (v, cond) in _STATISTICS.items() for m in _moments(v, "quantity", p, cond)],
    ]
    derived: dict[str, Column] = {}
    for p in _STATISTICS:
        derived |= _moment_columns(p)
    derived["deck_color_count"] = F.expr(" + ".join(f"cast(has_{c} AS bigint)" for c in sets.COLOR_ORDER))
    derived["has_companion"] = F.lit(False)
    return bag_items.groupBy(entity).agg(*aggs).withColumns(derived)


def item_medians(bag_items: DataFrame, wanted: Sequence[str], entity: str = "entity_id") -> DataFrame:
    """Weighted medians, apart from the sums so that those keep their generated hash aggregate."""
    chosen = {p: s for p, s in _STATISTICS.items() if f"{p}_median" in wanted}
    return bag_items.groupBy(entity).agg(*[_median(v, "quantity", p, cond) for p, (v, cond) in chosen.items()])


_TAG_KINDS = {  # what a column counts
    "distinct_keyword_count": "keyword", "distinct_subtype_count": "subtype", "most_common_subtype_count": "subtype",
    "unique_atomic_combo_refs_count": "atomic", "unique_potential_combo_refs_count": "potential",
    "unique_two_card_combo_ids_count": "two_card",
}


def tag_features(bag: DataFrame, measures: DataFrame, entity: str = "entity_id",
                 wanted: Sequence[str] = tuple(_TAG_KINDS)) -> DataFrame:
    """Distinct keyword, subtype and combo counts. The families of the ``wanted`` columns share one exploded aggregate,
    keyed by (entity, kind, tag), so a hot basket is spread over its tags."""
    kinds = sorted({_TAG_KINDS[c] for c in wanted})
    tagged = measures.select("item_id", F.filter("tags", lambda x: x["kind"].isin(kinds)).alias("tags")) \
        .filter(F.size("tags") > 0)
    per_tag = (
        bag.select(entity, "item_id", "quantity").join(tagged.hint("merge"), "item_id")
        .select(entity, "quantity", F.inline("tags"))
        .groupBy(entity, "kind", "tag")
        .agg(F.sum("quantity").alias("w"))
    )

    def distinct(kind: str, alias: str) -> Column:
        return F.count_if(F.col("kind") == kind).alias(alias)

    return per_tag.groupBy(entity).agg(
        distinct("keyword", "distinct_keyword_count"),
        distinct("subtype", "distinct_subtype_count"),
        F.coalesce(F.max(F.when(F.col("kind") == "subtype", F.col("w"))), F.lit(0)).cast("bigint")
        .alias("most_common_subtype_count"),
        distinct("atomic", "unique_atomic_combo_refs_count"),
        distinct("potential", "unique_potential_combo_refs_count"),
        distinct("two_card", "unique_two_card_combo_ids_count"),
    ).select(entity, *wanted)


def join_detail(lines: DataFrame, detail: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Lines with rarity and prices by the composite (entity, line) key; ``detail`` has one row per key."""
    return usable_lines(lines).join(detail, [entity, "line_id"], "left")


def one_detail_per_line(detail: DataFrame, order: Column, entity: str = "entity_id") -> DataFrame:
    """Collapse repeated (entity, line) keys to their first row, so the join cannot fan out."""
    rest = [c for c in detail.columns if c not in (entity, "line_id")]
    return (
        detail.groupBy(entity, "line_id")
        .agg(F.min_by(F.struct(*rest), order).alias("__d"))
        .select(entity, "line_id", "__d.*")
    )


def detail_features(detailed: DataFrame, entity: str = "entity_id",
                    spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """Rarity counts and price statistics. Equal (rarity, price) lines are combined first."""
    priced = detailed.select(
        entity, F.lower("rarity").alias("rarity"), price_of(F.col("prices"), spec.price_vendors).alias("price"),
        "quantity",
    ).groupBy(entity, "rarity", "price").agg(F.sum("quantity").alias("quantity"))
    return priced.groupBy(entity).agg(
        *[F.expr(f"sum(if(rarity = '{r}', quantity, 0L))").alias(f"{r}_count") for r in RARITIES],
        *_moments("price", "quantity", "price"), _median("price", "quantity", "price"),
    ).withColumns(_moment_columns("price", total=True))


def basket_features(entities: DataFrame, lines: DataFrame, items: DataFrame, detail: DataFrame | None = None,
                    groups: Sequence[str] | None = None, entity: str = "entity_id",
                    spec: FeatureSpec = FeatureSpec(), carry: Sequence[str] = (),
                    bag: DataFrame | None = None, store: bool = False) -> DataFrame:
    """Feature table: one row per entity, also for empty baskets (counts 0, statistics NULL).

    With ``store`` the lines with their detail and the bag with its item measures are written once to the shared folder;
    sums, medians, tags and prices then read those instead of scanning and joining again.

    ``groups`` limits the work to some feature groups. Pass the stored ``bag`` (see
    :func:`bag_long`) to avoid a second pass over the lines.
    """
    by_group = feature_groups(spec)
    wanted = [c for g in (groups or by_group) for c in by_group[g]]
    detailed = join_detail(lines, detail, entity) if detail is not None else None
    if store and detailed is not None:
        detailed = materialize(detailed, "detailed-lines")
        lines = detailed
    bag = bag if bag is not None else bag_long(lines, entity)
    measures = item_measures(items, spec)
    out = entities.select(entity, *carry)
    tag_names = set(_TAG_KINDS)
    detail_names = set(by_group["price"]) | set(by_group["rarity"])
    medians = [f"{p}_median" for p in _STATISTICS if f"{p}_median" in wanted]
    from_items = [c for c in wanted if c not in tag_names | detail_names and c not in medians]
    bag_items = attach_items(bag, measures)
    if store:
        bag_items = materialize(bag_items, "bag-items")
        bag = bag_items.select(*bag.columns)
    if from_items:
        out = out.join(item_features(bag_items, entity, spec).select(entity, *from_items), entity, "left")
    if medians:
        out = out.join(item_medians(bag_items, medians, entity), entity, "left")
    from_tags = [c for c in wanted if c in tag_names]
    if from_tags:
        out = out.join(tag_features(bag, measures, entity, from_tags), entity, "left")
    from_detail = [c for c in wanted if c in detail_names]
    if from_detail and detail is not None:
        part = detail_features(detailed, entity, spec)
        out = out.join(part.select(entity, *from_detail), entity, "left")
    return out.select(entity, *carry, *[_or_empty(c, by_group, out.columns) for c in wanted])


def _or_empty(name: str, by_group: dict[str, list[str]], present: list[str]) -> Column:
    """What an entity without lines gets: counts 0, flags false, statistics NULL."""
    if name not in present:
        return F.lit(None).cast("double").alias(name) if name in by_group["price"] else F.lit(0).cast("bigint").alias(name)
    if name.startswith("has_"):
        return F.expr(f"coalesce({name}, false)").alias(name)
    statistic = name in by_group["price"] or name.endswith(("_mean", "_median", "_std"))
    return F.col(name) if statistic else F.expr(f"coalesce({name}, 0L)").alias(name)
