import pytest
from pyspark.sql import functions as F

from basketwise.operators import curate, selection
from basketwise.sources import jsonl
from basketwise.sources.schemas import RAW_DETAILS
from basketwise.streaming import incremental as inc
from conftest import rows
from decks import deck, line, record, write

RULES = curate.CurationRules()


def run(spark, path, records, history=None):
    raw = jsonl.with_file_order(jsonl.read_jsonl(spark, write(path, records), RAW_DETAILS))
    return curate.curate(raw, RULES, history=history, ingested_at="2025-03-01T00:00:00Z")


def reasons(tables):
    return {r["entity_id"]: r["rejection_reasons"] for r in tables["rejected"].collect()}


def test_accepts_two_leads_renamed_categories_and_excluded_zones(spark, tmp_path):
    two = deck(98, lead=[line("a", 500, categories=("Commander",), colorIdentity=["White"]),
                         line("b", 501, categories=("Commander",), colorIdentity=["Blue"])])
    renamed = deck(99, lead=[line("baba", 500, categories=("My Baeba!",))], categories=[
        {"name": "My Baeba!", "includedInDeck": True, "isPremier": True}])
    zones = deck(99, lead=[line("zed", 700, categories=("Commander",))], cards=[line(f"z{i}", i) for i in range(98)], extra=[
        line("tok", 600, categories=("Tokens",)),
        line("m", 601, categories=("Maybeboard",), legalities={"commander": "banned"}), line("s", 602, categories=("Sideboard",)),
        line("t", 603, categories=("Tokens & Extras",)), line("c", 604, companion=True), line("d", 605, deleted="2024"),
        line("x", 606, categories=("Cuts",))], categories=[{"name": "Cuts", "includedInDeck": False, "isPremier": False}])
    out = run(spark, tmp_path / "a.jsonl", [record(1, two), record(2, renamed), record(3, zones)])
    got = {r["entity_id"]: r for r in out["accepted"].collect()}
    assert set(got) == {1, 2, 3} and out["rejected"].count() == 0
    assert got[1]["lead_item_ids"] == ["a", "b"] and got[1]["mainboard_count"] == 100
    assert got[2]["lead_item_ids"] == ["baba"] and "mybaeba" in got[2]["lead_categories"]
    assert got[3]["excluded_rows"] == {"excluded_category": 4, "companion": 1, "deleted": 1}
    assert got[3]["mainboard_count"] == 100 and len(got[3]["mainboard"]) == 100
    assert got[1]["snapshot_id"] == "source:1:2025-02-01T00:00:00Z" and got[1]["owner_id"] == "7"


@pytest.mark.filterwarnings("ignore")
def test_every_rejection_reason(spark, tmp_path):
    cards98 = [line(f"card-{i}", i + 1) for i in range(98)]
    cases = {
        "private": deck(private=True), "low_view_count": deck(viewCount=999),
        "missing_or_invalid_bracket": deck(edhBracket=5), "not_commander_format": deck(deckFormat=1),
        "unlisted": deck(unlisted=True),
        "illegal_commander_card": deck(cards=cards98 + [line("ban", 999, legalities={"commander": "banned"})]),
        "duplicate_nonbasic": deck(cards=cards98[:97] + [line("dup", 999, quantity=2)]),
        "color_identity_violation": deck(
            lead=[line("w", 0, categories=("Commander",), colorIdentity=["White"])],
            cards=cards98 + [line("blue", 999, colorIdentity=["Blue"])]),
        "mainboard_count_not_100": deck(98), "missing_commander": deck(99, lead=[line("plain", 777)]),
        "missing_oracle_uid": deck(cards=cards98 + [line("", 999)]),
        "non_positive_quantity": deck(cards=cards98 + [line("one", 998), line("zero", 999, quantity=0)]),
    }
    records = [record(i, d) for i, d in enumerate(cases.values(), 1)]
    records += [record(50, deck(), status=404), record(51, {**deck(), "cards": None})]
    out = run(spark, tmp_path / "b.jsonl", records)
    got = reasons(out)
    for i, code in enumerate(cases, 1):
        assert got[i] == [code], code
    assert got[50] == ["fetch_status_not_200"] and got[51] == ["missing_deck_payload"]
    bad = {(r["entity_id"], r["reason"]) for r in out["violations"].collect()}
    order = {c: i for i, c in enumerate(cases, 1)}
    for code in ("illegal_commander_card", "duplicate_nonbasic", "color_identity_violation", "missing_oracle_uid"):
        assert (order[code], code) in bad
    counts = dict(rows(curate.reason_counts(out["rejected"]), "reason", "n"))
    assert counts["private"] == 1 and counts["fetch_status_not_200"] == 1


def test_copies_duplicates_latest_and_rerun(spark, tmp_path):
    plains = deck(cards=[line("plains", 1, quantity=99, name="Plains", types=["Land"], superTypes=["Basic"])])
    many = deck(cards=[line("rats", 1, quantity=99, text="A deck can have any number of cards named Rats.")])
    records = [record(1, plains), record(2, many), record(3, plains),
               record(4, deck(name="old", updatedAt="2025-01-01")), record(4, deck(name="new", updatedAt="2025-01-02")),
               record(4, deck(name="tie", updatedAt="2025-01-02"))]
    out = run(spark, tmp_path / "c.jsonl", records)
    accepted = {r["entity_id"]: r["name"] for r in out["accepted"].collect()}
    assert accepted == {1: "Deck", 2: "Deck", 4: "new"}
    dup = out["rejected"].collect()
    assert [(r["entity_id"], r["rejection_reasons"], r["duplicate_of"]) for r in dup] == [(3, ["duplicate_card_list"], 1)]
    assert out["items"].filter("item_id = 'plains'").first()["first_seen_entity_id"] == 1
    history = out["accepted"].select("entity_id", "fingerprint")
    again = run(spark, tmp_path / "d.jsonl", [*records, record(9, plains)], history)
    assert again["accepted"].count() == 0
    assert {(r["entity_id"], r["duplicate_of"]) for r in again["rejected"].collect()} == {(3, 1), (9, 1)}


def test_stream_equals_batch_and_second_run_adds_nothing(spark, tmp_path):
    plains = deck(cards=[line("plains", 1, quantity=99, name="Plains", types=["Land"], superTypes=["Basic"])])
    first, second = [record(1, plains), record(2, deck(private=True))], [record(3, plains), record(4, deck())]
    write(tmp_path / "in" / "a.jsonl", first)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def go():
        stream = inc.file_stream(spark, str(tmp_path / "in"), RAW_DETAILS)
        inc.curate_stream(stream, RULES, out, ckpt, "2025-03-01")

    go()
    go()
    assert rows(inc.read_table(spark, f"{out}/accepted"), "entity_id") == [(1,)]
    write(tmp_path / "in" / "b.jsonl", second)
    go()
    batch = run(spark, tmp_path / "all.jsonl", first + second)
    for name, cols in (("accepted", ["entity_id", "fingerprint"]), ("rejected", ["entity_id", "rejection_reasons", "duplicate_of"])):
        assert rows(inc.read_table(spark, f"{out}/{name}"), *cols) == rows(batch[name], *cols)


def test_records_without_whole_ids_stay_apart_over_batches(spark, tmp_path):
    """Two id-less records of one day: neither hides the other, and a second delivery changes nothing."""
    def lost(name, own):
        return {**record(1, own), "deck_id": name, "detail_url": f"u/{name}", "fetched_at": "2025-02-01T00:00:00Z"}

    one, two, none = lost("x1", deck(private=True)), lost("x2", deck()), {**lost("x3", deck(unlisted=True)), "deck_id": None}
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for k, arriving in enumerate(([one], [two, one, none], [two, one, none, lost("x4", deck())])):
        write(tmp_path / "in" / f"{k}.jsonl", arriving)
        inc.curate_stream(inc.file_stream(spark, str(tmp_path / "in"), RAW_DETAILS), RULES, out, ckpt, "2025-03-01")
    accepted = rows(inc.read_table(spark, f"{out}/accepted"), "entity_id", "snapshot_id")
    assert accepted == [(None, "source:x2:2025-02-01T00:00:00Z")]
    assert rows(inc.read_table(spark, f"{out}/rejected"), "source_url", "rejection_reasons") == [
        ("u/x1", ["private"]), ("u/x3", ["unlisted"]), ("u/x4", ["duplicate_card_list"])]


def test_fingerprints_have_one_form(spark):
    data = [(1, "a", 1), (1, "b", 2), (2, "b", 2), (2, "a", 1), (3, "a", 1), (3, "b", 3), (4, "a", 1), (4, "a", 1)]
    lines = spark.createDataFrame(data, "entity_id long, item_id string, quantity int")
    import hashlib

    got = {r["entity_id"]: r["fingerprint"] for r in curate.fingerprints(lines).collect()}
    assert got[1] == got[2] and len({got[1], got[3], got[4]}) == 3
    assert got[1] == hashlib.sha256(b"a:1|b:2").hexdigest()


def test_hot_fingerprint_is_joined_in_slices(spark):
    prints = spark.range(1000).select(F.col("id").alias("entity_id"), F.when(F.col("id") % 3 == 0, "hot")
                                      .otherwise(F.col("id").cast("string")).alias("fingerprint"))
    got = curate.fingerprint_dedup(prints, "entity_id", F.col("entity_id"), hot_limit=50)
    assert got.count() == 1000
    assert got.filter("is_duplicate").count() == 333
    assert got.filter("fingerprint = 'hot'").agg(F.min("keeper_id"), F.max("keeper_id")).first() == (0, 0)


def test_item_list_and_candidates(spark):
    lines = spark.createDataFrame([(1, 0, "Sol Ring", 1), (1, 1, "Forest", 8), (1, 2, "Skip", 0), (1, 3, None, 4)],
                                  "entity_id long, line_id long, item_name string, quantity long")
    assert rows(selection.item_list_text(lines, ["line_id"]), "text") == [("1 Sol Ring\n8 Forest",)]
    pages = spark.createDataFrame(
        [(2, 1, {"results": [{"id": "5", "viewCount": 10}, {"id": "x", "viewCount": 2000}]}),
         (2, 2, {"results": [{"id": "6", "viewCount": 1500}]})],
        "bracket int, page int, response struct<results array<struct<id string, viewCount bigint>>>")
    assert rows(selection.listing_candidates(pages, 1000), "entity_id") == [(6,)]
    assert rows(selection.pages_below(pages, 1000), "page", "all_below") == [(1, False), (2, False)]


def test_undated_record_loses_and_odd_types_pass(spark, tmp_path):
    """A record without any time ranks lowest; scalar owners, ids that are no numbers and text costs are read."""
    undated = {k: v for k, v in deck(name="undated").items() if k != "updatedAt"}
    records = [record(1, undated, fetched=None), record(1, {**undated, "name": "dated", "owner": 5}),
               record(2, {**deck(name="blank"), "updatedAt": ""}, fetched="2025-01-01"),
               record(2, {**deck(98, extra=[line("other", 500)], name="later"), "updatedAt": ""}, fetched="2025-02-01"),
               record("abc", deck(97, extra=[line("x", 500), line("y", 501, cmc="not a cost")], owner="bob")),
               record(None, deck(97, extra=[line("x", 500), line("z", 501)], edhBracket="3", viewCount="2000"))]
    out = run(spark, tmp_path / "odd.jsonl", records)
    got = sorted((r["name"], r["entity_id"], r["owner_id"]) for r in out["accepted"].collect())
    assert out["rejected"].count() == 0
    assert [g[0] for g in got] == ["Deck", "Deck", "dated", "later"] and {g[1] for g in got} == {None, 1, 2}
    assert {g[2] for g in got} == {"5", "7", "bob"}
    costs = {r["item_id"]: r["item"]["cmc"] for r in out["items"].collect()}
    assert costs["y"] is None and costs["x"] == 1.0


def test_rejects_carry_their_trace_and_accepted_their_metadata(spark, tmp_path):
    out = run(spark, tmp_path / "t.jsonl", [record(1, deck(private=True, extra=[line("s", 900, categories=("Sideboard",))])), record(2, deck())])
    bad = out["rejected"].first()
    assert bad["trace"]["excluded_rows"] == {"excluded_category": 1} and bad["trace"]["included_rows"] == 100
    import json

    good = json.loads(out["accepted"].first()["raw_metadata"])
    assert good["name"] == "Deck" and "cards" not in good


def test_broken_lines_are_set_aside(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"deck_id": 1, "response": {"private": "no", "owner": 5}}\n\n{"deck_id": oops\n[1]\n{"deck_id": "abc"}\n')
    good, broken = jsonl.read_jsonl_quarantine(spark, str(path), RAW_DETAILS)
    assert [(r["deck_id"], r["response"] and r["response"]["owner"]) for r in good.collect()] == [("1", "5"), ("abc", None)]
    assert [r["line"] for r in broken.orderBy("line_order").collect()] == ['{"deck_id": oops', "[1]"]


def test_items_and_rejects_are_written_once_over_batches(spark, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    other = deck(98, extra=[line("new", 500)])
    for name, records in (("a", [record(1, deck()), record(2, deck(private=True))]), ("b", [record(2, deck(private=True)), record(3, other)])):
        write(tmp_path / "in" / f"{name}.jsonl", records)
        inc.curate_stream(inc.file_stream(spark, str(tmp_path / "in"), RAW_DETAILS), RULES, out, ckpt, "2025-03-01")
    items = inc.read_table(spark, f"{out}/items")
    assert items.count() == items.select("item_id").distinct().count() == 101
    assert rows(inc.read_table(spark, f"{out}/rejected"), "entity_id") == [(2,)]
    assert rows(inc.read_table(spark, f"{out}/accepted"), "entity_id") == [(1,), (3,)]
    assert inc.read_table(spark, f"{out}/violations").count() == 0


def test_items_name_the_record_that_showed_them_first(spark, tmp_path):
    other = deck(n=98, extra=[line("late", 500)], owner={"id": 8, "username": "y"})
    tables = run(spark, tmp_path / "in" / "a.jsonl", [
        record("x101", deck(), fetched="2025-01-01T00:00:00Z"), record(202, other)])
    first = {r["item_id"]: (r["first_seen_entity_id"], r["first_seen_source_url"]) for r in tables["items"].collect()}
    assert first["card-1"] == (None, "u/x101") and first["late"] == (202, "u/202")


def test_records_are_not_shuffled_to_find_the_latest(spark, tmp_path, monkeypatch):
    """Latest and known records are told by their keys: no step that groups or joins sees a payload."""
    seen = []
    for name in ("latest_records", "skip_existing"):
        whole = getattr(curate, name)
        monkeypatch.setattr(curate, name, lambda df, *a, f=whole: seen.append(df.columns) or f(df, *a))
    history = spark.createDataFrame([(2, "source:2:2025-02-01T00:00:00Z", "f")], "entity_id long, snapshot_id string, fingerprint string")
    old = record(1, deck(private=True, updatedAt="2024-01-01T00:00:00Z"))
    out = run(spark, tmp_path / "n.jsonl", [old, record(1, deck()), record(2, deck()), {**record(3, deck()), "deck_id": None}], history)
    assert rows(out["accepted"], "entity_id") == [(1,)]
    assert rows(out["rejected"], "entity_id", "rejection_reasons") == [(None, ["duplicate_card_list"])]
    assert len(seen) == 3 and not any({"payload", "response"} & set(columns) for columns in seen)


def test_picked_rows_are_the_chosen_ones(spark):
    many = spark.range(0, 70_000, 1, 2).select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("v"))
    chosen = many.filter("v % 7 = 0 or v in (34999, 35000, 69999)")
    assert rows(curate.pick_rows(many, chosen, "row")) == rows(chosen)
    assert curate.pick_rows(many, chosen.limit(0), "row").count() == 0


def test_trace_of_lines_is_the_trace_by_reason(spark):
    data = [(1, 2, True, []), (1, 3, False, []), (1, 1, False, ["deleted", "companion"]), (1, None, False, ["companion"]),
            (2, 5, False, ["excluded_category"]), (3, None, False, [])]
    lines = spark.createDataFrame(data, "entity_id long, quantity long, is_lead boolean, exclusion array<string>")
    by_reason = curate.trace_maps(curate.extraction_trace(lines))
    assert {r["entity_id"]: r.asDict() for r in curate.trace_of_lines(lines).collect()} == {
        r["entity_id"]: r.asDict() for r in by_reason.collect()}
