import random
import re

import pytest

from basketwise.llm import minhash
from basketwise.llm.components import connected_components


def brute(texts, shingle):
    def grams(t):
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        if not words:
            return set()
        return {tuple(words[i:i + shingle]) for i in range(len(words) - shingle + 1)} or {tuple(words)}

    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("shingle", [2, 5])
def test_components_match_all_pairs(make_docs, shingle):
    rng = random.Random(shingle)
    texts = [None, "", "One", "one", "one two", "ONE two", "x" * 50]
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 160))]
        for _ in range(rng.randrange(1, 14)):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(4000)}"
            texts.append(" ".join(own) if rng.random() < 0.8 else "\t".join(w.upper() for w in own))
    got = minhash.near_duplicates(make_docs(texts).repartition(3), minhash.NearDupSpec(shingle=shingle))
    assert sorted(map(tuple, got.collect())) == brute(texts, shingle)


def test_links_below_a_hub_are_found(make_docs):
    """b is near to c but neither is near to the bucket's smallest a: the chain must still be found."""
    words = [f"k{i}" for i in range(300)]
    a = words[:]
    b = words[:225] + [f"b{i}" for i in range(75)]
    c = b[:295] + [f"c{i}" for i in range(5)]
    texts = [" ".join(x) for x in (a, b, c)]
    got = minhash.near_duplicates(make_docs(texts))
    assert sorted(map(tuple, got.select("doc_id", "component_id").collect())) == [(0, 0), (1, 1), (2, 1)]


def test_large_group_of_copies(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 2 = 0, 'the same few words again', "
                                        "concat('word ', id, ' and ', id * 7)) as text")
    got = minhash.near_duplicates(docs)
    assert got.filter("kept").count() == 2001 and got.filter("component_id = 0").count() == 2000


def test_odd_rows(odd_docs, no_docs):
    got = sorted(map(tuple, minhash.near_duplicates(odd_docs).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 977, 5, True),
                          (6, 977, 5, False), (7, 1, 7, True), (8, 1, 8, True), (8, 1, 8, True),
                          (None, 1, None, True), (None, 0, None, True)], key=str)
    assert minhash.near_duplicates(no_docs).count() == 0
    kept = minhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 10


def test_star_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_group_without_one_centre(make_docs):
    """Edits from a small vocabulary: many members are near to some others, few to all, some to none."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(60)}" for _ in range(150)]
    texts = []
    for _ in range(150):
        own = list(base)
        for _ in range(rng.randrange(1, 22)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(60)}"
        texts.append(" ".join(own))
    want = brute(texts, 2)
    got = minhash.near_duplicates(make_docs(texts), minhash.NearDupSpec(shingle=2, ranked=40))
    assert sorted(map(tuple, got.collect())) == want and 5 < sum(r[3] for r in want) < 140


def thue_morse(bits, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(1 << bits))


def test_words_with_regular_bytes_stay_apart(make_docs):
    """Words that collide under every polynomial modulo a power of two, and regular sequences of two words."""
    texts = [thue_morse(11, "x", "y"), thue_morse(11, "y", "x"), thue_morse(11, "x ", "y "), thue_morse(11, "y ", "x "),
             "q" * 255, "q" * 256, "q" * 257, "q" * 258, "aaaaaaaa", "aaaaaaaa\0", "aaaaaaa"]
    for shingle in (2, 5, 20):
        got = minhash.near_duplicates(make_docs(texts), minhash.NearDupSpec(shingle=shingle))
        assert sorted(map(tuple, got.collect())) == brute(texts, shingle)


def test_rows_that_share_an_id_are_one_vertex(spark):
    words = [f"v{i}" for i in range(200)]
    other = [f"o{i}" for i in range(200)]
    rows = [(5, " ".join(other)), (5, " ".join(words)), (7, " ".join(words[:198] + ["z", "z2"])), (8, " ".join(other[2:])),
            (9, "alone here now"), (4, " ".join(words)), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shingle in (2, 5):
        got = minhash.near_duplicates(docs, minhash.NearDupSpec(shingle=shingle)).filter("n_shingles > 0")
        assert {(r[0], r[2]) for r in got.collect()} == {(5, 4), (7, 4), (8, 4), (9, 9), (4, 4)}
