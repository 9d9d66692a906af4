"""Raw nested records to accepted baskets, rejected baskets and first-seen items."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.functions import sets, text
from basketwise.functions.coerce import as_double, as_long
from basketwise.functions.skew import HOT_ROWS, join_group_values
from basketwise.session import materialize

# Board names that never belong to a basket, the lead category, basic item names.
BOARD_EXCLUDED = ("maybeboard", "sideboard", "tokensextras", "tokensandextras")
LEAD_CATEGORY = "commander"
EXCLUSIONS = ("deleted", "companion", "excluded_category")
BASIC_NAMES = ("Plains", "Island", "Swamp", "Mountain", "Forest", "Wastes")
# Rejection codes in the order in which they are reported.
REASONS = (
    "private", "unlisted", "not_commander_format", "missing_or_invalid_bracket", "low_view_count",
    "mainboard_count_not_100", "missing_commander", "missing_oracle_uid", "non_positive_quantity",
    "illegal_commander_card", "duplicate_nonbasic", "color_identity_violation",
)


@dataclass(frozen=True)
class CurationRules:
    min_views: int = 1000
    labels: Sequence[int] = (2, 3, 4)
    basket_format: int = 3
    min_size: int = 100
    max_size: int = 100
    source: str = "source"


# ---------------------------------------------------------------- records


def latest_records(df: DataFrame, id_col: str, recency: Sequence[Column], position: Column) -> DataFrame:
    """Most recent record per id; equal recency keeps the earliest position.

    Recency is the first of ``recency`` that is neither NULL nor empty, compared as text; none at all ranks lowest.
    Records without an id pass through. ``max_by`` combines on the map side, so an id that owns a third of the log costs
    one row per task instead of one huge sort.
    """
    key = F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in recency], F.lit(""))
    keyed = df.withColumn("__key", key).withColumn("__pos", position)
    row = F.struct(*[F.col(c) for c in df.columns])
    per_key = keyed.filter(F.col(id_col).isNotNull()).groupBy(id_col, "__key").agg(
        F.min_by(row, F.col("__pos")).alias("__row")
    )
    best = per_key.groupBy(id_col).agg(F.max_by("__row", "__key").alias("__row")).select("__row.*")
    return best.unionByName(df.filter(F.col(id_col).isNull()))


def pick_rows(stored: DataFrame, chosen: DataFrame, row_id: str) -> DataFrame:
    """The rows of ``stored`` whose ``row_id`` is in ``chosen``, without moving wide rows.

    ``row_id`` comes from ``monotonically_increasing_id``, so the ids of one part follow each other: one bit a row, in maps
    of 32,768 rows (4 KB). Spark broadcasts these maps while their size allows, beyond that the rows are shuffled once.
    """
    bucket, place = F.shiftright(row_id, 15), F.col(row_id) % 32768
    bits = materialize(chosen.groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(place).alias("__bits")), "picked")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pow(F.lit(2), place % 8).cast("int")
    return stored.withColumn("__bucket", bucket).join(bits, "__bucket").filter(byte.bitwiseAND(bit) != 0) \
        .drop("__bucket", "__bits")


def unwrap(raw: DataFrame) -> DataFrame:
    """Add ``payload`` and ``fetch_reason`` (NULL when usable)."""
    candidates = [F.col(c) for c in ("response", "payload") if c in raw.columns]
    payload = F.coalesce(*candidates)
    reason = (
        F.when(F.col("status").isNotNull() & ~as_long(F.col("status")).eqNullSafe(200), F.lit("fetch_status_not_200"))
        .when(payload.isNull() | payload["cards"].isNull(), F.lit("missing_deck_payload"))
    )
    rest = [c for c in raw.columns if c not in ("response", "payload")]
    return raw.select(*rest, payload.alias("payload"), reason.alias("fetch_reason"))


def snapshot_id(source: str, raw_id: Column, fetched_at: Column) -> Column:
    """``source:id:time`` with the id as it was fetched, whole number or not, so that records without a usable id stay
    apart."""
    return F.concat_ws(":", F.lit(source), raw_id.cast("string"), fetched_at)


def owner_id(owner: Column) -> Column:
    """Id, else name, of an owner that is raw JSON: an object or the id itself."""
    inside = F.coalesce(F.get_json_object(owner, "$.id"), F.get_json_object(owner, "$.username"))
    return F.when(F.startswith(owner, F.lit("{")), inside).otherwise(owner)


def whole_id(c: Column) -> Column:
    """Whole-number id of any size in the type's range, NULL for anything else."""
    return F.coalesce(c.try_cast("bigint").cast("bigint"), as_long(c))


def metadata_only(payload: Column) -> Column:
    """Payload without its bulky members."""
    return payload.dropFields("cards", "featured", "customFeatured", "cardPackage")


def excluded_categories(categories: Column) -> Column:
    """Board names plus the record's own categories that are not part of the basket."""
    return _with_own(categories, BOARD_EXCLUDED, lambda c: c["includedInDeck"].eqNullSafe(False))


def lead_categories(categories: Column) -> Column:
    return _with_own(categories, (LEAD_CATEGORY,), lambda c: c["isPremier"].eqNullSafe(True))


def _with_own(categories: Column, fixed: Sequence[str], wanted: Callable[[Column], Column]) -> Column:
    """The fixed names and the wanted ones of the record, sorted; without own categories nothing has to be sorted."""
    own = F.transform(F.filter(categories, wanted), lambda c: text.normalize(c["name"]))
    known = F.array(*[F.lit(b) for b in sorted(fixed)])
    return F.when(F.size(categories) > 0, F.array_sort(F.array_union(known, own))).otherwise(known)


def exclusion_reasons(deleted: Column, companion: Column, categories: Column, excluded: Column) -> Column:
    """All reasons why a line is not part of the basket, possibly none."""
    return _exclusions(deleted, companion, normalized(categories), excluded)


def normalized(categories: Column) -> Column:
    return F.transform(F.coalesce(categories, F.array().cast("array<string>")), text.normalize)


def _exclusions(deleted: Column, companion: Column, names: Column, excluded: Column) -> Column:
    none = F.array().cast("array<string>")
    hits = (deleted, companion, F.coalesce(F.arrays_overlap(names, excluded), F.lit(False)))
    return F.concat(*[F.when(c, F.array(F.lit(x))).otherwise(none) for c, x in zip(hits, EXCLUSIONS)])


def raw_lines(records: DataFrame) -> DataFrame:
    """One row per line of usable records, with item attributes and exclusion reasons.

    ``record_id`` names the record: an id may be missing, and then it cannot tell records apart.
    """
    cats = F.col("payload.categories")
    # in a step of its own, or Spark works out a record's categories again for each of its lines
    judging = records.filter(F.col("fetch_reason").isNull()).select(
        "record_id", "entity_id", "fetched_at",
        excluded_categories(cats).alias("excluded"), lead_categories(cats).alias("lead"), F.col("payload.cards").alias("cards"),
    )
    item = F.col("line.card.oracleCard")
    categories = F.coalesce(F.col("line.categories"), F.array().cast("array<string>"))
    exploded = judging.select(
        "record_id", "entity_id", "fetched_at", "excluded", "lead", F.posexplode("cards").alias("line_number", "line"),
    ).withColumn("names", normalized(F.col("line.categories")))
    return exploded.select(
        "record_id", "entity_id", "fetched_at", "line_number",
        F.col("line.id").alias("line_id"),
        item["uid"].alias("item_id"), item["name"].alias("item_name"),
        F.coalesce(as_long(F.col("line.quantity")), F.lit(0)).cast("bigint").alias("quantity"),
        categories.alias("categories"),
        F.coalesce(F.arrays_overlap("names", "lead"), F.lit(False)).alias("is_lead"),
        F.col("line.customCmc").alias("custom_cmc"), F.col("line.modifier").alias("modifier"),
        F.col("line.notes").alias("notes"),
        _exclusions(F.col("line.deletedAt").isNotNull(), F.col("line.companion").eqNullSafe(True),
                    F.col("names"), F.col("excluded")).alias("exclusion"),
        F.try_element_at(item["legalities"], F.lit("commander")).alias("legality"),
        sets.color_bits(item["colorIdentity"]).alias("color_mask"),
        (is_basic(item["name"], item["superTypes"], item["types"]) | text.matches_any(item["text"]))
        .alias("copies_allowed"),
        F.when(item.isNotNull(), item.withField("cmc", as_double(item["cmc"]))).alias("item"),
        F.col("line.card.rarity").alias("rarity"), F.col("line.card.prices").alias("prices"),
    )


def is_basic(name: Column, super_types: Column, types: Column) -> Column:
    return F.coalesce(name.isin(*BASIC_NAMES), F.lit(False)) | (
        sets.has(super_types, "Basic") & sets.has(types, "Land")
    )


def kept(lines: DataFrame) -> DataFrame:
    return lines.filter(F.size("exclusion") == 0)


# ---------------------------------------------------------------- checks


def extraction_trace(lines: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Long trace ``(entity, reason, rows, quantity)``; kept lines count under ``included``,
    kept lead lines also under ``lead``. A line with two reasons counts in both."""
    labels = F.when(
        F.size("exclusion") == 0,
        F.when(F.col("is_lead"), F.array(F.lit("included"), F.lit("lead"))).otherwise(F.array(F.lit("included"))),
    ).otherwise(F.col("exclusion"))
    return (
        lines.select(entity, "quantity", F.explode(labels).alias("reason"))
        .groupBy(entity, "reason")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("quantity").cast("bigint").alias("quantity"))
    )


def trace_maps(trace: DataFrame, entity: str = "entity_id") -> DataFrame:
    """The trace as one row per entity; reasons come from a fixed list, so the maps stay small."""
    excluded = ~F.col("reason").isin("included", "lead")
    entry = F.when(excluded, F.struct("reason", "rows"))
    weight = F.when(excluded, F.struct("reason", "quantity"))

    def one(label: str, col: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("reason") == label, F.col(col))), F.lit(0))

    return trace.groupBy(entity).agg(
        F.map_from_entries(F.collect_list(entry)).alias("excluded_rows"),
        F.map_from_entries(F.collect_list(weight)).alias("excluded_quantity"),
        one("included", "rows").alias("included_rows"),
        one("included", "quantity").alias("included_quantity"),
        one("lead", "rows").alias("lead_rows"),
        one("lead", "quantity").alias("lead_quantity"),
    )


def trace_of_lines(lines: DataFrame, entity: str = "entity_id") -> DataFrame:
    """:func:`trace_maps` of the lines' trace in one aggregate: the reasons of :func:`exclusion_reasons` are a fixed list."""
    inside = F.size("exclusion") == 0

    def rows(cond: Column, alias: str) -> Column:
        return F.count_if(cond).alias(alias)

    def weight(cond: Column, alias: str) -> Column:
        return F.sum(F.when(cond, F.col("quantity"))).cast("bigint").alias(alias)

    def as_map(of: str) -> Column:
        return F.map_from_entries(F.array_compact(F.array(*[
            F.when(F.col(f"__{x}_rows") > 0, F.struct(F.lit(x).alias("reason"), F.col(f"__{x}_{of}").alias(of)))
            for x in EXCLUSIONS])))

    hits = {x: F.array_contains("exclusion", x) for x in EXCLUSIONS}
    lead = inside & F.col("is_lead")
    return lines.groupBy(entity).agg(
        *[f(c, f"__{x}_{of}") for x, c in hits.items() for f, of in ((rows, "rows"), (weight, "quantity"))],
        rows(inside, "included_rows"), weight(inside, "included_quantity"),
        rows(lead, "lead_rows"), weight(lead, "lead_quantity"),
    ).select(entity, as_map("rows").alias("excluded_rows"), as_map("quantity").alias("excluded_quantity"), "included_rows",
             F.coalesce("included_quantity", F.lit(0)).alias("included_quantity"), "lead_rows",
             F.coalesce("lead_quantity", F.lit(0)).alias("lead_quantity"))


def line_facts(lines: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Everything the rules need to know about an entity's kept lines, in one two-level aggregate.

    The (entity, item) level spreads a hot entity over its items; colour sets are bit masks, so
    "is every line inside the lead's colours" is a comparison of two ``bit_or`` values.
    """
    no_item = F.col("item_id").isNull() | (F.col("item_id").cast("string") == "")
    lead = F.col("is_lead")
    per_item = lines.groupBy(entity, "item_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("quantity").alias("qty"),
        F.sum(F.when(lead, F.col("quantity")).otherwise(0)).alias("lead_qty"),
        F.count_if(no_item).alias("no_item"),
        F.count_if(F.col("quantity") <= 0).alias("non_positive"),
        F.count_if(~F.col("legality").eqNullSafe("legal")).alias("illegal"),
        F.bool_or("copies_allowed").alias("copies_allowed"),
        F.bit_or("color_mask").alias("mask"),
        F.bit_or(F.when(lead, F.col("color_mask")).otherwise(F.lit(0))).alias("lead_mask"),
    )
    duplicated = (F.col("no_item") == 0) & (F.col("qty") > 1) & ~F.col("copies_allowed")
    return per_item.groupBy(entity).agg(
        F.sum("rows").alias("n_lines"),
        F.sum("qty").alias("mainboard_count"),
        F.sum("lead_qty").alias("lead_quantity"),
        F.sum("no_item").alias("n_no_item"),
        F.sum("non_positive").alias("n_non_positive"),
        F.sum("illegal").alias("n_illegal"),
        F.count_if(duplicated).alias("n_duplicated"),
        F.bit_or("mask").alias("mask"),
        F.bit_or("lead_mask").alias("lead_mask"),
    )


def rejection_reasons(rules: CurationRules, codes: Sequence[str] = REASONS) -> Column:
    """Array of codes that apply, in report order. Expects entity columns ``private``, ``unlisted``,
    ``basket_format``, ``target_label``, ``views`` and the columns of :func:`line_facts`."""

    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    outside = n("mask") != n("mask").bitwiseAND(n("lead_mask"))
    failed = (
        ~F.col("private").eqNullSafe(False),
        ~F.col("unlisted").eqNullSafe(False),
        ~F.col("basket_format").eqNullSafe(rules.basket_format),
        ~F.coalesce(F.col("target_label").isin(*rules.labels), F.lit(False)),
        n("views") < rules.min_views,
        ~n("mainboard_count").between(rules.min_size, rules.max_size),
        n("lead_quantity") < 1,
        n("n_no_item") > 0,
        n("n_non_positive") > 0,
        n("n_illegal") > 0,
        n("n_duplicated") > 0,
        outside,
    )
    return F.array_compact(F.array(*[F.when(f, F.lit(c)) for f, c in zip(failed, codes)]))


def violations(lines: DataFrame, facts: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Offending lines in long form ``(entity, reason, line_id, item_id, item_name, detail)``.

    Long rows instead of nested lists: a basket with millions of bad lines stays distributed.
    """
    no_item = F.col("item_id").isNull() | (F.col("item_id").cast("string") == "")

    def hit(cond: Column, reason: str, detail: Column) -> Column:
        return F.when(cond, F.struct(F.lit(reason).alias("reason"), detail.cast("string").alias("detail")))

    per_line = F.array_compact(F.array(
        hit(no_item, "missing_oracle_uid", F.lit(None)),
        hit(F.col("quantity") <= 0, "non_positive_quantity", F.col("quantity")),
        hit(~F.col("legality").eqNullSafe("legal"), "illegal_commander_card", F.col("legality")),
    ))
    direct = lines.select(entity, "line_id", "item_id", "item_name", F.inline(per_line))
    copies = (
        lines.filter(~no_item)
        .groupBy(entity, "item_id")
        .agg(F.sum("quantity").alias("qty"), F.bool_or("copies_allowed").alias("ok"),
             F.min("line_id").alias("line_id"), F.min("item_name").alias("item_name"))
        .filter((F.col("qty") > 1) & ~F.col("ok"))
        .select(entity, "line_id", "item_id", "item_name",
                F.lit("duplicate_nonbasic").alias("reason"), F.col("qty").cast("string").alias("detail"))
    )
    bad = facts.filter(F.col("mask") != F.col("mask").bitwiseAND(F.col("lead_mask"))).select(
        entity, "n_lines", F.col("lead_mask").alias("lead_mask")
    )
    colours = (
        join_group_values(lines, bad, [entity], "n_lines", F.col("line_id"))
        .filter(F.col("color_mask") != F.col("color_mask").bitwiseAND(F.col("lead_mask")))
        .select(entity, "line_id", "item_id", "item_name",
                F.lit("color_identity_violation").alias("reason"),
                sets.mask_key(F.col("color_mask")).alias("detail"))
    )
    return direct.unionByName(copies).unionByName(colours)


# ---------------------------------------------------------------- fingerprints


def fingerprints(lines: DataFrame, entity: str = "entity_id", item: str = "item_id",
                 quantity: str = "quantity") -> DataFrame:
    """``(entity, fingerprint, n_lines)``: SHA-256 of the sorted ``item:qty`` texts joined by ``|``.

    One form for every basket, so values stay comparable over runs and rule changes. A basket's list of short
    texts is one row; lines without an item are left out.
    """
    clean = lines.filter(F.col(item).isNotNull() & (F.col(item).cast("string") != ""))
    part = F.concat(F.col(item).cast("string"), F.lit(":"), F.col(quantity).cast("string"))
    return clean.groupBy(entity).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(part)), "|"), 256).alias("fingerprint"),
        F.count(F.lit(1)).alias("n_lines"))


def fingerprint_dedup(prints: DataFrame, entity: str, order: Column, history: DataFrame | None = None,
                      hot_limit: int = HOT_ROWS, unique: str | None = None) -> DataFrame:
    """Add ``keeper_id`` and ``is_duplicate``. ``history`` rows ``(entity, fingerprint)`` win over new ones.

    ``unique`` names a column that tells rows apart where ``entity`` may be NULL.
    """
    unique = unique or entity
    new = prints.withColumn("__order", F.struct(F.lit(1).alias("new"), order.alias("o")))
    seen = new.select("fingerprint", F.struct(F.col(entity).alias("id"), F.col(unique).alias("key")).alias("__keeper"), "__order")
    if history is not None:
        null_order = F.lit(None).cast(new.schema["__order"].dataType["o"].dataType)
        no_key = F.lit(None).cast(prints.schema[unique].dataType)
        seen = seen.unionByName(history.select(
            "fingerprint", F.struct(F.col(entity).alias("id"), no_key.alias("key")).alias("__keeper"),
            F.struct(F.lit(0).alias("new"), null_order.alias("o")).alias("__order"),
        ))
    keepers = seen.groupBy("fingerprint").agg(
        F.min_by("__keeper", F.struct("__order", "__keeper")).alias("__keeper"),
        F.min(F.col("__order.new")).alias("__from_history"),
        F.count(F.lit(1)).alias("__copies"),
    )
    joined = join_group_values(new, keepers, ["fingerprint"], "__copies", F.col(unique), hot_limit)
    duplicate = (F.col("__from_history") == 0) | ~F.col("__keeper.key").eqNullSafe(F.col(unique))
    return joined.withColumn("keeper_id", F.col("__keeper.id")).withColumn("is_duplicate", duplicate).drop(
        "__order", "__from_history", "__copies", "__keeper")


def first_seen_items(lines: DataFrame, order: Column, item: str = "item_id",
                     carry: Sequence[str] = ()) -> DataFrame:
    """One row per item with the attributes of its first line."""
    payload = F.struct(*[F.col(c) for c in carry])
    return (
        lines.filter(F.col(item).isNotNull())
        .groupBy(item)
        .agg(F.min_by(payload, order).alias("__first"))
        .select(item, "__first.*")
    )


# ---------------------------------------------------------------- whole step


def curate(raw: DataFrame, rules: CurationRules, position: str = "position",
           history: DataFrame | None = None, ingested_at: str | None = None,
           known_items: DataFrame | None = None, known_rejected: DataFrame | None = None) -> dict[str, DataFrame]:
    """Raw fetch log to ``accepted``, ``rejected``, ``items``, ``lines`` and ``violations``.

    ``history`` holds ``(entity_id, snapshot_id, fingerprint)`` of earlier runs: known ids and snapshots are skipped,
    known baskets rejected as duplicates. ``known_rejected`` (``snapshot_id``) are skipped, so a record that is
    delivered again changes nothing, whether it was accepted or rejected and whether or not its id is a whole number.
    A record without any id is named by its address. ``known_items`` (``item_id``) are not written again. ``ingested_at`` stands in for a missing fetch time, once the latest record of
    every id is chosen: an undated record never wins over a dated one.

    Records, lines, judgements and the deduplicated baskets are each stored once in the shared
    folder: five outputs hang off them, and without a stored stage every output would parse the raw
    log again. Everything is keyed by the stored record, since ids may be missing. Latest and known records are told by
    these keys; a record itself is not shuffled for that.
    """
    raw_id = F.col("deck_id").cast("string")
    dated = F.coalesce(F.nullif("fetched_at", F.lit("")), F.lit(ingested_at))
    keyed = raw.withColumns({
        "entity_id": whole_id(raw_id), "__updated": F.col("response.updatedAt"), "__fetched": F.col("fetched_at"),
        "snapshot_id": snapshot_id(rules.source, F.coalesce(F.nullif(raw_id, F.lit("")), F.col("detail_url"), F.lit("")), dated),
        "fetched_at": dated, "record_id": F.monotonically_increasing_id()}).drop("deck_id")
    # the number of lines is stored, so that judging records does not read their lines
    stored = materialize(unwrap(keyed).withColumn("__total", F.size("payload.cards").cast("bigint")), "curate-records")
    # which records win and are new is decided on their keys alone
    skips = [(known, key) for known, key in ((history, "entity_id"), (history, "snapshot_id"), (known_rejected, "snapshot_id"))
             if known is not None and key in known.columns]
    carried = {"record_id": None, "entity_id": None, **{key: None for _, key in skips}}
    keys = stored.select(*carried, "__updated", "__fetched", F.col(position).alias("__position"))
    latest = latest_records(keys, "entity_id", [F.col("__updated"), F.col("__fetched")],
                            F.struct("__position", "record_id")).select(*carried)
    for known, key in skips:
        latest = skip_existing(latest, known, [key])
    unwrapped = pick_rows(stored, latest, "record_id").drop("__updated", "__fetched")
    usable = unwrapped.filter(F.col("fetch_reason").isNull())
    all_lines = materialize(raw_lines(unwrapped), "curate-lines")
    lines = kept(all_lines)
    facts = materialize(line_facts(lines, "record_id"), "curate-facts")
    p = F.col("payload")
    entities = usable.select(
        "record_id", "entity_id", "snapshot_id",
        F.col("detail_url").alias("source_url"), "fetched_at", F.col(position).alias("position"),
        p["updatedAt"].alias("updated_at"), p["name"].alias("name"),
        as_long(p["edhBracket"]).alias("target_label"), as_long(p["viewCount"]).alias("views"),
        p["private"].alias("private"), p["unlisted"].alias("unlisted"), as_long(p["deckFormat"]).alias("basket_format"),
        owner_id(p["owner"]).alias("owner_id"),
        excluded_categories(p["categories"]).alias("excluded_categories"),
        lead_categories(p["categories"]).alias("lead_categories"),
        F.col("__total").alias("total_lines"),
    )
    trace_columns = ["excluded_rows", "excluded_quantity", "included_rows", "included_quantity", "lead_rows"]
    trace = trace_of_lines(all_lines, "record_id").select("record_id", *trace_columns)
    judged = materialize(
        entities.join(facts, "record_id", "left").join(trace, "record_id", "left")
        .withColumn("rejection_reasons", rejection_reasons(rules)), "curate-judged")
    passed = judged.filter(F.size("rejection_reasons") == 0)
    # a passed basket holds at most max_size copies, so its line list is bounded
    passed_lines = pick_rows(lines, passed, "record_id")
    nested = passed_lines.groupBy("record_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(
                "line_number", "line_id", "item_id", "item_name", "quantity", "categories", "is_lead",
                "custom_cmc", "modifier", "notes"))),
            lambda s: s.dropFields("line_number"),
        ).alias("mainboard"),
        F.sort_array(F.collect_set(F.when(F.col("is_lead"), F.col("item_id")))).alias("lead_item_ids"),
        sets.mask_key(F.bit_or(F.when(F.col("is_lead"), F.col("color_mask")).otherwise(F.lit(0)))).alias("color_identity"),
    )
    ranked = passed.join(fingerprints(passed_lines, "record_id").drop("n_lines"), "record_id")
    deduped = materialize(
        fingerprint_dedup(ranked, "entity_id", F.col("position"), history, unique="record_id"), "curate-deduped")
    first = deduped.filter(~F.col("is_duplicate"))
    metadata = pick_rows(usable, first, "record_id").select("record_id", F.to_json(metadata_only(p)).alias("raw_metadata"))
    accepted = (
        first.join(nested, "record_id").join(metadata, "record_id")
        .drop("is_duplicate", "keeper_id", "rejection_reasons", "position", "record_id")
    )
    summary = F.struct("name", "private", "unlisted", "basket_format", "target_label", "views")
    base = ["entity_id", "snapshot_id", "fetched_at", "source_url"]
    failed = judged.filter(F.size("rejection_reasons") > 0).select(
        *base, "rejection_reasons", summary.alias("raw_summary"), F.lit(None).cast("bigint").alias("duplicate_of"),
        F.struct(*trace_columns).alias("trace"),
    )
    duplicates = deduped.filter("is_duplicate").select(
        *base, F.array(F.lit("duplicate_card_list")).alias("rejection_reasons"),
        summary.alias("raw_summary"), F.col("keeper_id").alias("duplicate_of"), F.struct(*trace_columns).alias("trace"),
    )
    unusable = unwrapped.filter(F.col("fetch_reason").isNotNull()).select(
        "entity_id", "snapshot_id", "fetched_at", F.col("detail_url").alias("source_url"),
        F.array("fetch_reason").alias("rejection_reasons"),
        F.lit(None).cast(failed.schema["raw_summary"].dataType).alias("raw_summary"),
        F.lit(None).cast("bigint").alias("duplicate_of"),
        F.lit(None).cast(failed.schema["trace"].dataType).alias("trace"),
    )
    accepted_lines = pick_rows(lines, first, "record_id").drop("entity_id", "fetched_at").join(
        first.select(
            "record_id", "entity_id", "snapshot_id", "fetched_at", F.col("source_url").alias("__url")), "record_id") \
        .drop("record_id")
    items = first_seen_items(
        accepted_lines, F.struct("fetched_at", "entity_id", "line_number", "__url"),
        carry=["item_name", "entity_id", "fetched_at", "item", "__url"],
    ).withColumnsRenamed({"entity_id": "first_seen_entity_id", "fetched_at": "first_seen_fetched_at",
                          "__url": "first_seen_source_url"})
    if known_items is not None:
        items = skip_existing(items, known_items, ["item_id"])
    names = judged.select("record_id", "entity_id", "snapshot_id")
    return {
        "accepted": accepted,
        "rejected": failed.unionByName(duplicates).unionByName(unusable),
        "items": items,
        "lines": accepted_lines.drop("__url"),
        "violations": violations(lines.drop("entity_id"), facts, "record_id").join(names, "record_id").drop("record_id"),
    }


def reason_counts(rejected: DataFrame, reasons: str = "rejection_reasons") -> DataFrame:
    return rejected.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def skip_existing(incoming: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys have not been processed yet."""
    return incoming.join(done.select(*keys).distinct(), list(keys), "left_anti")
