import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from basketwise.llm import substring


def brute(rows, size):
    seen, out = set(), []
    for doc_id, text in sorted(rows):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            key = tuple(words[i:i + size])
            if key in seen:
                gone[i:i + size] = [True] * size
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = [[f"p{k}_{i}" for i in range(rng.randrange(15, 45))] for k in range(8)]
    texts = [None, "", " ", "one two", "again " * 90]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 40))]
            own = rng.choice(shared)
            cut = rng.randrange(0, 5)
            words += own[cut:]
        texts.append(rng.choice([" ", "\n", "  \t"]).join(words))
    return texts + texts[20:24]


# the small sketches are full: everything goes through the exact pass and nothing may be lost
@pytest.mark.parametrize("bits,rows,fan", [(26, 3, 256), (6, 1, 2), (12, 3, 2)])
def test_same_as_brute_force(make_docs, bits, rows, fan):
    texts = passages(bits)
    spec = substring.RepeatSpec(bits=bits, rows=rows, merge_fan_in=fan)
    got = substring.remove_repeats(make_docs(texts).repartition(5), spec).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted(map(tuple, got.collect())) == brute(list(enumerate(texts)), 20)


def test_sketch_never_misses(spark, make_docs):
    texts = passages(3)
    spec = substring.RepeatSpec(bits=16)
    bits = substring.window_sketch(make_docs(texts).repartition(4), spec)
    assert bits.shape == (3, (1 << 16) // 8) and bits.any()


def test_odd_rows(odd_docs, no_docs):
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring.remove_repeats(odd_docs).collect()}
    assert got[(5, 60_000)] == 60_000 - 977 and got[(6, 60_000)] == 60_000 and got[(None, 5)] == 0 and got[(1, 0)] == 0
    assert substring.remove_repeats(no_docs).count() == 0
    out = substring.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] is None and rows[3]["text"] == " \n\t " and rows[6]["text"] == "" and rows[6]["n_chars"] == 0
    assert rows[5]["n_chars"] == len(rows[5]["text"]) < 60_000


def test_text_longer_than_a_segment(make_docs):
    words = [f"word{i}" for i in range(200_000)]
    texts = [" ".join(words), " ".join(words[150_000:150_030]) + " tail"]
    got = substring.remove_repeats(make_docs(texts)).select("doc_id", "n_words", "n_removed")
    assert sorted(map(tuple, got.collect())) == [(0, 200_000, 0), (1, 31, 30)]


def test_words_with_regular_bytes_are_not_mixed_up(make_docs):
    def word(a, b):
        return "".join(b if bin(i).count("1") % 2 else a for i in range(1 << 11))

    common = [f"w{i}" for i in range(19)]
    texts = [" ".join([*common, word("x", "y")]), " ".join([*common, word("y", "x")]),
             word("p ", "q "), word("q ", "p "), " ".join([*common, word("y", "x")])]
    got = substring.remove_repeats(make_docs(texts)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted(map(tuple, got.collect())) == brute(list(enumerate(texts)), 20)
