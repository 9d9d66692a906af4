import pytest
from pyspark.sql import functions as F

from basketwise.operators import features
from conftest import rows

ITEMS = ("item_id string, name string, types array<string>, super_types array<string>, sub_types array<string>, "
         "color_identity array<string>, cmc double, layout string, keywords array<string>, mana_production map<string,double>, "
         "game_changer boolean, extra_turns boolean, tutor boolean, mass_land_denial boolean, two_card_combo_singleton boolean, "
         "atomic_combos array<string>, potential_combos array<string>, two_card_combo_ids array<string>, edhrec_rank double, "
         "salt double, faces array<string>")


def item(i, types, cmc=None, mana=None, sup=(), sub=(), kw=(), colors=(), combos=(), layout="normal", faces=(), rank=None):
    return (i, i, list(types), list(sup), list(sub), list(colors), cmc, layout, list(kw), mana or {}, False, None, True, False,
            False, list(combos), [], [], rank, None, list(faces))


@pytest.fixture(scope="module")
def basket(spark):
    items = spark.createDataFrame([
        item("A", ["Land"], mana={"W": 1.0}, sup=["Basic"]),
        item("B", ["Land"], mana={"W": 1.0, "U": 1.0, "C": 1.0, "R": 0.0}),
        item("C", ["Creature"], 3.0, sup=["Legendary"], sub=["Elf", "Elf"], kw=["Flying", "Flying", "Protection from red"],
             colors=["White", "U"], combos=["x", "y"], rank=10.0),
        item("D", ["Instant"], 7.0, combos=["y"], faces=["f", "b"], layout="transform", rank=30.0),
    ], ITEMS)
    lines = spark.createDataFrame(
        [(1, 1, "A", 2, False), (1, 2, "B", 1, False), (1, 3, "C", 1, True), (1, 4, "D", 2, False), (1, 5, "A", 0, False),
         (1, 6, None, 3, False), (3, 1, "ghost", 2, False)],
        "entity_id long, line_id long, item_id string, quantity long, is_lead boolean")
    detail = spark.createDataFrame(
        [(1, 1, "Common", {"tcg": 0.0, "ck": 2.0}), (1, 3, "RARE", {"tcg": 5.0}), (1, 4, "rare", {})],
        "entity_id long, line_id long, rarity string, prices map<string,double>")
    entities = spark.createDataFrame([(1,), (2,), (3,)], "entity_id long")
    out = features.basket_features(entities, lines, items, detail)
    return {r["entity_id"]: r.asDict() for r in out.collect()}, out, lines


def test_counts_and_statistics(basket):
    f = basket[0][1]
    expected = {
        "land_count": 3, "nonland_count": 3, "basic_land_count": 2, "nonbasic_land_count": 1, "land_mana_production_W": 3,
        "land_mana_production_U": 1, "land_mana_production_C": 1, "land_mana_production_R": 0,
        "lands_that_produce_multiple_colors_count": 1, "lands_that_produce_colorless_count": 1, "cmc_3_count": 1,
        "cmc_6_plus_count": 2, "flying_count": 2, "protection_keyword_count": 1, "keyword_total_count": 3,
        "distinct_keyword_count": 2, "unique_card_count": 4, "commander_card_count": 1, "non_commander_card_count": 5,
        "has_W": True, "has_U": True, "has_B": False, "deck_color_count": 2, "legendary_count": 1, "distinct_subtype_count": 1,
        "most_common_subtype_count": 1, "tutor_count": 6, "atomic_combo_refs_total": 4, "unique_atomic_combo_refs_count": 2,
        "cards_with_atomic_combos_count": 3, "total_face_count": 4, "max_faces_on_card": 2, "layout_transform_count": 2,
        "common_count": 2, "rare_count": 3, "price_total": 9.0, "price_median": 2.0, "cmc_median": 1.5,
        "nonland_cmc_median": 7.0, "noncreature_spell_count": 2, "nonland_permanent_count": 1, "has_companion": False,
        "edhrec_rank_median": 30.0, "salt_mean": None,
    }
    assert {k: f[k] for k in expected} == expected
    assert f["cmc_mean"] == pytest.approx(2.833333, abs=1e-6) and f["cmc_std"] == pytest.approx(3.131382, abs=1e-6)
    assert f["nonland_cmc_mean"] == pytest.approx(5.666667, abs=1e-6) and f["price_mean"] == pytest.approx(3.0)


def test_empty_basket_unknown_item_and_width(basket):
    data, out, _ = basket
    empty, ghost = data[2], data[3]
    assert empty["land_count"] == 0 and empty["has_W"] is False and empty["cmc_mean"] is None and empty["price_total"] is None
    assert ghost["nonland_count"] == 2 and ghost["cmc_0_count"] == 2 and ghost["noncreature_spell_count"] == 2
    assert len(out.columns) == 1 + len(features.feature_columns())
    assert features.feature_columns()[:2] == ["unique_card_count", "non_commander_card_count"]


def test_bag_is_one_row_per_basket(spark, basket):
    lines = spark.createDataFrame([(1, f"i{k}", 1) for k in range(50)] + [(2, "i0", 3)], "entity_id long, item_id string, quantity long")
    bag = features.bag_long(lines)
    maps = features.bag_map(bag)
    assert rows(maps, "entity_id") == [(1,), (2,)] and maps.select("entity_id", F.explode("counts")).count() == 51


def test_cost_rules(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (5.9,), (6.0,), (None,)], "c double")
    assert [r[0] for r in df.select(features.cost_bucket(features.cost_value(F.col("c")))).collect()] == [0, 0, 5, 6, 0]


def test_item_tables_are_not_broadcast_and_only_wanted_tags_exploded(spark, basket):
    """Whatever the size of the packed item file: measures and tags are a hundred times as large in memory."""
    from basketwise.plans import tables as t

    sf = "/root/testdata/sf0.001"
    measures = features.item_measures(t.items(spark, sf), t.SPEC)
    bag = features.bag_long(t.lines(spark, sf))
    for joined in (features.attach_items(bag, measures), features.tag_features(bag, measures, wanted=["distinct_keyword_count"])):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    every, one = (features.tag_features(bag, measures, **k) for k in ({}, {"wanted": ["distinct_keyword_count"]}))
    assert one.columns == ["entity_id", "distinct_keyword_count"]
    assert rows(one) == rows(every.filter("distinct_keyword_count > 0"), *one.columns)
