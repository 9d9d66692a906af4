import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketwise.llm import bpe, curve_packing

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


def odd_texts(n=400):
    rng = random.Random(2)
    fixed = ["", "  ", "a\t\t\n\nb", " \n \n x", "\x1cab\x1d c", "日本語 のテキスト  です", "it's we'll  don't", "a" * 1000, " " * 300,
             "x y  z", "é ́", "🙂🙂 👩‍👩‍👧", "abc" * 300 + " 123456789" * 5, "<|endoftext|>", "Straße, ÀÉ İstanbul ŉ ſ"]
    return fixed + ["".join(rng.choice(" \n\tab'sé1!\x1c\x85 ") for _ in range(rng.randrange(60))) for _ in range(n)] + [
        "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(200, 600))) for _ in range(5)]


def test_encoding_equals_the_library(make_docs):
    texts = odd_texts()
    vocab = bpe.load_vocabulary(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    rows = bpe.encode_documents(make_docs([*texts, None]).repartition(3), RANKS, P.PATTERN).collect()
    got = {r["doc_id"]: r for r in rows}
    for i, text in enumerate([*texts, None]):
        want = library.encode_ordinary(text or "")
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want)
        assert bytes(got[i]["decoded"]) == (text or "").encode()


def test_long_piece_equals_matrix():
    vocab = bpe.load_vocabulary(RANKS)
    rng = random.Random(5)
    pieces = ["".join(rng.choice("the and ing ation".replace(" ", "")) for _ in range(rng.randrange(1, 250))).encode()
              for _ in range(60)]
    short = bpe.encode_pieces(pieces, vocab)
    long = bpe.encode_pieces(pieces, vocab, long_piece=0)
    assert all(np.array_equal(a, b) for a, b in zip(short, long))


def test_odd_rows(odd_docs, no_docs):
    got = bpe.encode_documents(odd_docs, RANKS, P.PATTERN, ids_as_text=True)
    assert got.count() == odd_docs.count() and got.filter("doc_id = 1").first()["ids_text"] == ""
    assert bpe.encode_documents(no_docs, RANKS, P.PATTERN).count() == 0
    pieces = curve_packing.pack(odd_docs, WORDS).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    assert sum(r["doc_id"] == 8 and r["start"] == 0 for r in pieces) == 2
    assert curve_packing.pack(no_docs, WORDS).count() == 0


def test_packing_keeps_every_id_once(make_docs):
    rng = random.Random(9)
    texts = [None, "", *odd_texts(80)] + [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 3000)))
                                          for _ in range(40)] + ["same words here"] * 300
    spec = curve_packing.PackSpec(rows_per_slice=50)
    rows = curve_packing.pack(make_docs(texts).repartition(4), WORDS, spec).withColumn("crc", F.crc32("ids")).collect()
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    want = [np.array([*e.ids, 2], dtype="<u4") for e in library.encode_batch([t or "" for t in texts],
                                                                              add_special_tokens=False)]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        own = want[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert bytes(r["ids"]) == own.tobytes() and r["crc"] == zlib.crc32(own.tobytes())
        assert r["doc_tokens"] == len(want[r["doc_id"]])
    for i, ids in enumerate(want):
        spans = sorted((r["start"], r["length"]) for r in by_doc[i])
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) == len(ids)
    total = sum(map(len, want))
    assert sorted(by_sequence) == list(range(-(-total // 4096)))
    for k, spans in by_sequence.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == min(4096, total - 4096 * k)


def test_hilbert_steps_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = curve_packing.hilbert_keys(grid, 3)
    path = grid[np.argsort(key)]
    assert sorted(key) == list(range(512)) and set(np.abs(np.diff(path, axis=0)).sum(1)) == {1}
