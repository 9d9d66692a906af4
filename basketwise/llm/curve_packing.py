"""Packing of tokenized documents into fixed sequences along a Hilbert curve."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketwise.llm.ordered import add_slices, running_start
from basketwise.llm.tables import id_text
from basketwise.session import scratch_path


@dataclass(frozen=True)
class PackSpec:
    """Sequences of ``length`` ids; every document ends with ``end_id``. Documents become points: token counts in
    ``hashed`` buckets, projected to ``dims`` coordinates of ``bits`` bits each."""

    length: int = 4096
    end_id: int = 2
    hashed: int = 512
    dims: int = 3
    bits: int = 10
    seed: int = 23
    rows_per_slice: int = 2000


TIE_BITS = 22  # dims * bits + TIE_BITS stays within the 53 bits that a double holds exactly


class WordIds(dict):
    """Word (bytes) -> its ids (little-endian, 32 bits each), found on first use and remembered.

    At ``remember`` words a new generation begins; the one before is kept beside it, so words in use stay known.

    Exact for tokenizers that drop white space and never join characters across it. Where the tokenizer
    lower-cases and takes runs of letters as one unit, a word of plain letters with punctuation after it goes
    to the merge table directly, so that "Word", "word" and "word," are merged once.
    """

    LETTERS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-&(-/:-@\\[-`{-~]*)")
    MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # the marks of LETTERS; an apostrophe may begin a unit of its own

    def __init__(self, path: str, remember: int = 200_000) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.remember, self.marks, self.older = remember, {}, {}
        shape = str(self.tokenizer.normalizer) + str(self.tokenizer.pre_tokenizer)
        self.plain = all(x in shape for x in ("Lowercase()", r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "ByteLevel("))
        # the byte-level alphabet: visible bytes stand for themselves, the rest follow from 256 on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in seen]
        self.alphabet = {**{b: chr(b) for b in seen}, **{b: chr(256 + k) for k, b in enumerate(rest)}}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.find(word)
        self[word] = ids
        return ids

    def find(self, word: bytes) -> bytes:
        core = word.rstrip(self.MARKS) if self.plain else b""
        if core.isalpha():  # ASCII letters, as most words: told apart without decoding or matching
            letters, marks = core.lower(), word[len(core):]
        else:
            text = word.decode()
            found = self.LETTERS.fullmatch(text) if self.plain else None
            if found is None:
                own = self.tokenizer.encode(text, add_special_tokens=False).ids
                return struct.pack(f"<{len(own)}I", *own)
            letters, marks = found[1].lower().encode(), found[2].encode()
        if letters == word:  # one unit: straight to the merge table
            spelled = word.decode() if word.isascii() else word.decode("latin-1").translate(self.alphabet)
            own = [t.id for t in self.merge(spelled)]
            return struct.pack(f"<{len(own)}I", *own)
        ids = self[letters]
        if marks:
            if marks not in self.marks:
                own = self.tokenizer.encode(marks.decode(), add_special_tokens=False).ids
                self.marks[marks] = struct.pack(f"<{len(own)}I", *own)
            ids += self.marks[marks]
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if len(self) > self.remember:
            self.older = dict(self)
            self.clear()
            self.marks.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, (text or "").encode().split())), dtype="<u4")


_tokenizers: dict[str, WordIds] = {}


def _tokenizer(path: str) -> WordIds:
    """One per worker process, so later tasks find its words in place."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of every row of small unsigned coordinates on the Hilbert curve through their grid."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:  # undo the rotations and reflections of each level, coarse to fine
        p = q - one
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= one
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        flip = np.where((x[dims - 1] & q) > 0, flip ^ (q - one), flip)
        q >>= one
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def document_points(ids: list[np.ndarray], spec: PackSpec) -> np.ndarray:
    """Grid coordinates of documents: hashed counts on a log scale, unit length, random projection."""
    rng = np.random.default_rng(spec.seed)
    away = rng.standard_normal((spec.hashed, spec.dims))
    vectors = np.zeros((len(ids), spec.hashed))
    shift = np.uint32(32 - (spec.hashed - 1).bit_length())
    for k, own in enumerate(ids):
        vectors[k] = np.bincount((own.astype(np.uint32) * np.uint32(2654435761)) >> shift, minlength=spec.hashed)
    vectors = np.log1p(vectors)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    spot = (vectors / np.maximum(norm, 1e-12)) @ away
    side = 1 << spec.bits
    return np.clip(((1 + spot / (1 + np.abs(spot))) / 2 * side).astype(np.int64), 0, side - 1)


TOKEN_SCHEMA = "row_key long, doc_id long, curve long, n long, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenize(docs: DataFrame, vocab_path: str, spec: PackSpec) -> DataFrame:
    """Per row: a stable row key, its place on the curve, its ids (little-endian, 2 or 4 bytes each)."""
    wide = "<u4" if Tokenizer.from_file(vocab_path).get_vocab_size() > 1 << 16 else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocab_path)
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                names = part.column(0).to_pylist()
                ids = list(map(tokenizer.encode, part.column(1).to_pylist()))
                tie = [hash((0 if i is None else i, spec.seed)) & ((1 << TIE_BITS) - 1) for i in names]
                curve = (hilbert_keys(document_points(ids, spec), spec.bits) << TIE_BITS) + np.array(tie, np.int64)
                end = np.array([spec.end_id], dtype=wide).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + len(ids))), part.column(0), pa.array(curve),
                     pa.array([len(x) + 1 for x in ids], pa.int64()),
                     pa.array([x.astype(wide).tobytes() + end for x in ids], pa.binary())],
                    names=["row_key", "doc_id", "curve", "n", "ids"])
                key += len(ids)

    return id_text(docs).mapInArrow(run, TOKEN_SCHEMA)


def pack(docs: DataFrame, vocab_path: str, spec: PackSpec = PackSpec()) -> DataFrame:
    """Pieces of documents in sequences: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    Documents stand in the order of their curve keys (ties: a hash of doc_id, then the row) and are laid end
    to end; every ``length`` ids start a new sequence, so only the last one is short. ``ids`` are
    little-endian unsigned 32-bit numbers. A null or empty text is its end id alone. Each input row is
    packed, repeated rows and rows without doc_id too; other columns are ignored; an empty table gives no
    pieces. Running offsets come from sums per key slice, never from one task over all rows.
    """
    session = docs.sparkSession
    path = scratch_path(session, "tokens")
    tokenize(docs, vocab_path, spec).write.option("compression", "zstd").parquet(path)
    tokens = session.read.schema(TOKEN_SCHEMA).parquet(path)
    wide = "<u4" if Tokenizer.from_file(vocab_path).get_vocab_size() > 1 << 16 else "<u2"
    order = add_slices(tokens.select("row_key", "curve", "n"), "curve", spec.rows_per_slice, "slice")
    placed = running_start(order, "slice", ["curve", "row_key"], "n", "at").select("row_key", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = spec.length
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                out = []
                for doc, at, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    ids = np.frombuffer(raw.as_buffer(), dtype=wide).astype("<u4")
                    start = 0
                    while start < len(ids):
                        length = min(len(ids) - start, size - (at + start) % size)
                        out.append((doc, start, length, len(ids), (at + start) // size, (at + start) % size,
                                    ids[start:start + length].tobytes()))
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in list(zip(*out))[:6]]
                    + [pa.array([o[6] for o in out], pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return tokens.select("row_key", "doc_id", "ids").join(placed.hint("shuffle_hash"), "row_key").select(
        "doc_id", "at", "ids").mapInArrow(cut, PIECE_SCHEMA)
