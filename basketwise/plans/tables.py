"""The driver's star schema read as baskets: orders are entities, lineitem lines, part items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketwise.functions.ranking import md5_order, spread_rank
from basketwise.operators import features
from basketwise.session import materialize

TRACKED_WORDS = (
    "blue", "new", "cold", "small", "hot", "old", "red", "large",
    "ring", "widget", "bolt", "gear", "plate", "rod", "gizmo", "anvil",
)
SPEC = features.FeatureSpec(tracked_keywords=TRACKED_WORDS[:14], protection_prefix="gi")
MODELS = {
    "df_logit": 62, "df_tree": 60, "df_forest": 66, "df_bayes": 55,
    "bc_logit": 58, "bc_tree": 50, "bc_bayes": 52,
}
REPEATS = 3
FOLDS = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return as_entities(table(spark, sf, "orders"))


def as_entities(orders: DataFrame) -> DataFrame:
    """Orders, stored or arriving, as labelled entities."""
    price = F.col("o_totalprice")
    return orders.select(
        F.col("o_orderkey").alias("entity_id"),
        F.col("o_custkey").alias("group_id"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("y1"),
        F.when(price < 100000, 1).when(price < 200000, 2).when(price < 300000, 3).when(price < 400000, 4)
        .otherwise(5).cast("bigint").alias("y2"),
        F.floor(price / 100).cast("bigint").alias("views"),
        price.alias("total_price"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("status"),
    )


def modelling_base(spark: SparkSession, sf: str) -> DataFrame:
    return entities(spark, sf).filter(F.col("y1").between(2, 4) & F.col("y2").between(2, 4))


def base_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of lineitem whose order is in the modelling base, for :func:`lines` and :func:`detail`; stored once, so that
    nothing is combined, joined or shuffled for other orders. The keys grow with the data and are never broadcast."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_discount")
    keys = modelling_base(spark, sf).select(F.col("entity_id").alias("l_orderkey"))
    return materialize(rows.join(keys.hint("merge"), "l_orderkey", "left_semi"), "base-lines")


def lines(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    return (table(spark, sf, "lineitem") if rows is None else rows).select(
        F.col("l_orderkey").alias("entity_id"),
        F.col("l_linenumber").cast("bigint").alias("line_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (F.col("l_linenumber") == 1).alias("is_lead"),
    )


def detail(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """One (rarity, prices) row per (entity, line): the pair repeats in lineitem, the cheapest wins."""
    rows = (table(spark, sf, "lineitem") if rows is None else rows).select(
        F.col("l_orderkey").alias("entity_id"),
        F.col("l_linenumber").cast("bigint").alias("line_id"),
        F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"),
        F.col("l_discount").alias("discount"),
    )
    first = features.one_detail_per_line(rows, F.struct("price", "flag", "discount"))
    rarity = F.when(F.col("flag") == "A", "Common").when(F.col("flag") == "N", "Uncommon").otherwise("Rare")
    prices = F.create_map(
        F.lit("tcg"), F.when(F.col("discount") > 0.05, F.lit(0.0)).otherwise(F.col("price")),
        F.lit("ck"), F.when(F.col("discount") > 0.08, F.lit(0.0)).otherwise(F.col("price") / 2),
    )
    return first.select("entity_id", "line_id", rarity.alias("rarity"), prices.alias("prices"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    key, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    words = F.split("p_name", " ")

    def only(cond: Column, array: Column) -> Column:
        return F.when(cond, array)

    def keep(*pairs: tuple[Column, str]) -> Column:
        return F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]))

    return table(spark, sf, "part").select(
        key.alias("item_id"), F.col("p_name").alias("name"),
        keep((kind == "ECONOMY", "Land"), (kind.isin("STANDARD", "LARGE"), "Creature"), (kind == "SMALL", "Instant"),
             (size % 7 == 0, "Sorcery"), (kind.isin("LARGE"), "Artifact"), (kind == "MEDIUM", "Enchantment"),
             (kind == "PROMO", "Planeswalker")).alias("types"),
        keep((size <= 10, "Basic"), (words[0] == "old", "Legendary"), (words[0] == "cold", "Snow")).alias("super_types"),
        F.array_compact(F.array(F.col("p_brand"), F.when(size % 4 == 0, F.lit("Equipment")),
                                F.when(size % 6 == 0, F.lit("Aura")), F.when(size % 9 == 0, F.lit("Vehicle")),
                                F.when(size % 2 == 0, words[1]))).alias("sub_types"),
        keep((key % 2 == 0, "W"), (key % 3 == 0, "Blue"), (key % 5 == 0, "B"), (key % 7 == 0, "Red"),
             (key % 11 == 0, "G"), (key % 13 == 0, "Purple")).alias("color_identity"),
        (size % 9).cast("double").alias("cmc"),
        F.element_at(F.array(*[F.lit(x) for x in features.TRACKED_LAYOUTS], F.lit("saga")),
                     (size % 6 + 1).cast("int")).alias("layout"),
        words.alias("keywords"),
        F.create_map(*[v for i, c in enumerate(features.MANA) for v in
                       (F.lit(c), F.when(size % (i + 2) == 0, 1.0).otherwise(0.0))]).alias("mana_production"),
        (key % 10 == 0).alias("game_changer"), (key % 11 == 0).alias("extra_turns"),
        (key % 12 == 0).alias("tutor"), (key % 13 == 0).alias("mass_land_denial"),
        (key % 14 == 0).alias("two_card_combo_singleton"),
        only(size % 2 == 0, words).alias("atomic_combos"),
        only(size % 3 == 0, F.array(F.col("p_brand"), words[0])).alias("potential_combos"),
        only(size % 5 == 0, F.array(F.col("p_type"))).alias("two_card_combo_ids"),
        F.when(size % 10 != 0, size.cast("double")).alias("edhrec_rank"),
        (F.sqrt("p_retailprice") / 10).alias("salt"),
        F.when(size % 8 == 0, F.when(size % 16 == 0, F.array(words[0], words[1], F.col("p_brand")))
               .otherwise(words)).alias("faces"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold rows of seven hash "models": 3 repeats x 5 stratified folds over the modelling base."""
    base = modelling_base(spark, sf).select("entity_id", "group_id", "y1", "y2", "views")
    repeated = base.withColumn(
        "repeat_seed", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(REPEATS).cast("bigint")))
    ).withColumn("digest", md5_order(F.col("repeat_seed"), "entity_id"))
    folded = spread_rank(repeated, ["repeat_seed", "y1"], "digest", ["entity_id"], out="rank").withColumn(
        "outer_fold", (F.col("rank") - 1) % FOLDS + 1
    )
    model = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model_id"), F.lit(a).alias("skill")) for m, a in MODELS.items()
    ]))
    digest = F.md5(F.concat_ws(":", "m.model_id", "repeat_seed", "entity_id"))
    draw = F.conv(F.substring(digest, 1, 4), 16, 10).cast("bigint") % 100
    other = F.conv(F.substring(digest, 5, 4), 16, 10).cast("bigint") % 3 + 2
    pred = F.when(draw < F.col("m.skill"), F.col("y1")).when(draw < F.col("m.skill") + 20, F.col("y2")).otherwise(other)
    return folded.withColumn("m", model).select(
        F.col("m.model_id").alias("model_id"),
        F.regexp_extract("m.model_id", "^(df|bc)_(.*)$", 1).alias("representation"),
        F.regexp_extract("m.model_id", "^(df|bc)_(.*)$", 2).alias("algorithm"),
        "repeat_seed", "outer_fold",
        F.concat(F.lit("r"), F.col("repeat_seed"), F.lit("_f"), F.col("outer_fold")).alias("fold_id"),
        "entity_id", "group_id", F.col("y1").alias("y_true"), pred.cast("bigint").alias("y_pred"), "y2",
    )


# ---------------------------------------------------------------- the same tables as SQL


ENT = """ent AS (
  SELECT o_orderkey AS entity_id, o_custkey AS group_id,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS y1,
         CAST(CASE WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 200000 THEN 2
              WHEN o_totalprice < 300000 THEN 3 WHEN o_totalprice < 400000 THEN 4 ELSE 5 END AS BIGINT) AS y2,
         CAST(floor(o_totalprice / 100) AS BIGINT) AS views, o_totalprice AS total_price,
         o_orderdate AS order_date, o_orderstatus AS status
  FROM orders)"""
BASE = ENT + """, base AS (SELECT * FROM ent WHERE y1 BETWEEN 2 AND 4 AND y2 BETWEEN 2 AND 4)"""
LINES = """lines AS (
  SELECT l_orderkey AS entity_id, CAST(l_linenumber AS BIGINT) AS line_id, l_partkey AS item_id,
         CAST(l_quantity AS BIGINT) AS quantity, l_linenumber = 1 AS is_lead
  FROM lineitem)"""
DETAIL = """detail AS (
  SELECT entity_id, line_id,
         CASE flag WHEN 'A' THEN 'common' WHEN 'N' THEN 'uncommon' ELSE 'rare' END AS rarity,
         CASE WHEN discount <= 0.05 AND price > 0 THEN price
              WHEN discount <= 0.08 AND price > 0 THEN price / 2 END AS price
  FROM (SELECT l_orderkey AS entity_id, CAST(l_linenumber AS BIGINT) AS line_id, l_extendedprice AS price,
               l_returnflag AS flag, l_discount AS discount,
               row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                  ORDER BY l_extendedprice, l_returnflag, l_discount) AS rn
        FROM lineitem) WHERE rn = 1)"""
ITEMS = """words AS (SELECT *, string_split(p_name, ' ') AS w FROM part), items AS (
  SELECT p_partkey AS item_id, p_name AS name, p_type, p_brand, p_size, w,
    p_type = 'ECONOMY' AS is_land, p_type IN ('STANDARD', 'LARGE') AS is_creature,
    p_type = 'SMALL' AS is_instant, p_size % 7 = 0 AS is_sorcery, p_type = 'LARGE' AS is_artifact,
    p_type = 'MEDIUM' AS is_enchantment, p_type = 'PROMO' AS is_planeswalker,
    p_type = 'ECONOMY' AND p_size <= 10 AS is_basic_land,
    w[1] = 'old' AS is_legendary, w[1] = 'cold' AS is_snow,
    list_distinct(list_filter([p_brand, CASE WHEN p_size % 4 = 0 THEN 'Equipment' END,
      CASE WHEN p_size % 6 = 0 THEN 'Aura' END, CASE WHEN p_size % 9 = 0 THEN 'Vehicle' END,
      CASE WHEN p_size % 2 = 0 THEN w[2] END], lambda x: x IS NOT NULL)) AS sub_types,
    p_partkey % 2 = 0 AS c_w, p_partkey % 3 = 0 AS c_u, p_partkey % 5 = 0 AS c_b,
    p_partkey % 7 = 0 AS c_r, p_partkey % 11 = 0 AS c_g,
    CAST(p_size % 9 AS DOUBLE) AS cmc, p_size % 6 AS layout,
    CASE WHEN p_size % 10 <> 0 THEN CAST(p_size AS DOUBLE) END AS edhrec_rank,
    sqrt(p_retailprice) / 10 AS salt,
    CASE WHEN p_size % 2 = 0 THEN w ELSE [] END AS atomic,
    CASE WHEN p_size % 3 = 0 THEN [p_brand, w[1]] ELSE [] END AS potential,
    CASE WHEN p_size % 5 = 0 THEN [p_type] ELSE [] END AS two_card,
    CASE WHEN p_size % 16 = 0 THEN 3 WHEN p_size % 8 = 0 THEN 2 ELSE 0 END AS n_faces
  FROM words)"""
_MODEL_ROWS = ", ".join(f"('{m}', {a})" for m, a in MODELS.items())
FOLDED_PREDS = f"""folded AS (
  SELECT *, (row_number() OVER (PARTITION BY repeat_seed, y1
             ORDER BY md5(concat_ws(':', repeat_seed, entity_id)), entity_id) - 1) % {FOLDS} + 1 AS outer_fold
  FROM base, (SELECT CAST(unnest(range(1, {REPEATS + 1})) AS BIGINT) AS repeat_seed)),
models AS (SELECT * FROM (VALUES {_MODEL_ROWS}) AS t(model_id, skill)),
drawn AS (
  SELECT *, md5(concat_ws(':', model_id, repeat_seed, entity_id)) AS h FROM folded, models),
preds AS (
  SELECT model_id, substr(model_id, 1, 2) AS representation, substr(model_id, 4) AS algorithm,
    repeat_seed, CAST(outer_fold AS BIGINT) AS outer_fold,
    'r' || repeat_seed || '_f' || outer_fold AS fold_id, entity_id, group_id, y1 AS y_true,
    CAST(CASE WHEN CAST('0x' || substr(h, 1, 4) AS BIGINT) % 100 < skill THEN y1
      WHEN CAST('0x' || substr(h, 1, 4) AS BIGINT) % 100 < skill + 20 THEN y2
      ELSE CAST('0x' || substr(h, 5, 4) AS BIGINT) % 3 + 2 END AS BIGINT) AS y_pred, y2
  FROM drawn)"""
PREDS = f"{BASE}, {FOLDED_PREDS}"
