import random
import re

import pytest

from basketwise.llm import ngram_join


def grams(text, shingle):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return set()
    return {tuple(words[i:i + shingle]) for i in range(len(words) - shingle + 1)} or {tuple(words)}


def brute(texts, shingle, percent):
    sets = [grams(t, shingle) for t in texts]
    root, pairs = list(range(len(texts))), set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                pairs.add((j, i))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)], pairs


def families(seed, shingle):
    rng = random.Random(seed)
    texts = [None, "", " \n", "One", "one", "one two", "ONE two", "a b c", "a b c d", "x" * 400]
    for _ in range(10):
        base = [f"w{rng.randrange(40 if rng.random() < 0.3 else 4000)}" for _ in range(rng.randrange(12, 200))]
        for _ in range(rng.randrange(1, 16)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // (4 * shingle))):
                own[rng.randrange(len(own))] = f"w{rng.randrange(4000)}"
            if rng.random() < 0.3:
                own = own[rng.randrange(0, 3):]
            texts.append(" ".join(own) if rng.random() < 0.8 else "\t".join(w.upper() for w in own))
    return texts


@pytest.mark.parametrize("shingle,percent,bits", [(3, 90, 24), (5, 80, 10), (1, 70, 21)])
def test_same_as_all_pairs(make_docs, shingle, percent, bits):
    texts = families(percent, shingle)
    want, pairs = brute(texts, shingle, percent)
    docs, spec = make_docs(texts).repartition(3), ngram_join.JoinSpec(shingle, percent, bits)
    assert sorted(map(tuple, ngram_join.linked_documents(docs, spec).collect())) == want
    found, member = ngram_join.links(docs, spec)
    members = {}
    for doc, cls in member.collect():
        members.setdefault(cls, []).append(doc)
    got = {tuple(sorted((a, b))) for u, v, _ in found.collect() for a in members[u] for b in members[v]}
    got |= {(a, b) for own in members.values() for a in own for b in own if a < b}
    assert got == pairs


def test_group_without_one_centre(make_docs):
    rng = random.Random(5)
    base = [f"w{rng.randrange(60)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(60)}"
        texts.append(" ".join(own))
    want, _ = brute(texts, 3, 90)
    got = ngram_join.linked_documents(make_docs(texts), ngram_join.JoinSpec(3, 90))
    assert sorted(map(tuple, got.collect())) == want and 5 < len({r[2] for r in want}) < 110


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted(map(tuple, ngram_join.linked_documents(odd_docs).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 977, 5), (6, 977, 5), (7, 1, 7), (8, 1, 8),
                          (8, 1, 8), (None, 1, None), (None, 0, None)], key=str)
    assert ngram_join.linked_documents(no_docs).count() == 0 and ngram_join.links(no_docs)[0].count() == 0
    words, other = ([f"{c}{i}" for i in range(200)] for c in "vo")
    rows = [(5, " ".join(other)), (5, " ".join(words)), (7, " ".join(words[:198] + ["z", "y"])),
            (8, " ".join(other[2:])), (9, "alone here now"), (4, " ".join(words))]
    shared = ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r[0], r[2]) for r in shared.collect()} == {(5, 4), (7, 4), (8, 4), (9, 9), (4, 4)}
