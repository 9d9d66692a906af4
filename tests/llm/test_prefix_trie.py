import hashlib
import random
import zlib

import pytest

from basketwise.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a string, n_convs string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "",
                                          hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    talks = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        talks[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    digest = lambda p: hashlib.sha256(
        ",".join(str(c) for c in sorted(members[p]) if len(talks[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p))
                  for p, m in members.items())


def talk(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 30), *range(100, 112), *range(205, 215), 1234567]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "hé", "yes", None, f"t{c % 3}"])))
    rows += [(c, None, "user", "first") for c in (3, 4, 105)] + [(7, 2, "user", x) for x in ("b", "a", "a", None)]
    rows += [(None, 1, "user", "lost"), (300, 1, None, None)]
    rows += [(c, t, "user", f"copy {t}") for c in range(400, 440) for t in range(6)]
    rows += [(c, t, "user", f"deep {t if t < 150 or c == 500 else t + c}") for c in (500, 501, 502) for t in range(160)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height,ids", [(3, 4), (8, 10_000)])
def test_same_as_brute_force(spark, height, ids):
    rows = talk(height)
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4)
    got = prefix_trie.trie(frame, prefix_trie.TrieSpec(height=height, ids_per_chunk=ids))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_odd_rows(spark):
    make = lambda rows: spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    assert prefix_trie.trie(make([])).count() == 0
    assert prefix_trie.trie(make([(None, None, None, None)])).count() == 0
    # 1 takes its first turns from 0, which has no rows, and loses its own: a turnless conversation
    rows = [(1, 0, "user", "hello"), (-5, 1, "user", "🙂" * 70_000)]
    assert sorted(map(tuple, prefix_trie.trie(make(rows)).collect())) == brute(rows)
