"""Byte-level BPE over padded numpy matrices, and decoding."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from basketwise.llm.tables import id_text

NONE = np.int64(1) << 40
CHUNK = re.compile("[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = regex.compile(r"[^\S \n]|[\x1c-\x1f\x85]")


@dataclass
class Vocabulary:
    """Ranks of byte strings, and the merge table (left id, right id) -> merged id as a hashed array.

    A pair can merge if the joined bytes are in the vocabulary; its rank is the joined id. All splits of all entries
    are listed once, so a round looks pairs up by number and never touches bytes.
    """

    ranks: dict[bytes, int]
    tokens: list[bytes] = field(init=False)
    byte_ids: np.ndarray = field(init=False)
    keys: np.ndarray = field(init=False)
    merged: np.ndarray = field(init=False)
    shift: int = field(init=False)

    def __post_init__(self) -> None:
        ranks = self.ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: r for t, r in ranks.items()
                 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        bits = max(4, len(pairs).bit_length() + 2)
        self.shift = 64 - bits
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.merged = np.full(1 << bits, NONE, dtype=np.int64)
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        values = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        slots = self._slot(keys)
        while len(keys):  # open addressing: whoever does not get its slot tries the next one
            free = self.keys[slots] == -1
            _, first = np.unique(slots[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slots[won]], self.merged[slots[won]] = keys[won], values[won]
            left = np.ones(len(keys), dtype=bool)
            left[won] = False
            keys, values = keys[left], values[left]
            slots = (slots[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of every pair, NONE where the pair does not merge."""
        keys = ((left << 32) | right).ravel()
        out = np.full(len(keys), NONE, dtype=np.int64)
        at, slots = np.arange(len(keys)), self._slot(keys)
        while len(at):
            held = self.keys[slots]
            hit = held == keys[at]
            out[at[hit]] = self.merged[slots[hit]]
            more = ~hit & (held != -1)
            at, slots = at[more], (slots[more] + 1) & (len(self.keys) - 1)
        return out.reshape(left.shape)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a file of base64 token and rank per line (a local file of every worker)."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def _encode_long(piece: bytes, vocab: Vocabulary) -> list[int]:
    """One very long piece: the same order of merges from a heap, so the time stays near linear."""
    import heapq

    ids = vocab.byte_ids[np.frombuffer(piece, np.uint8)]
    first = vocab.pair_rank(ids[:-1], ids[1:])
    heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first < NONE)]
    heapq.heapify(heap)
    part: list = ids.tolist()
    size = [1] * len(part)
    before = list(range(-1, len(part) - 1))
    after = [*range(1, len(part)), -1]
    tokens, ranks = vocab.tokens, vocab.ranks

    def rank(i: int, j: int) -> int | None:
        return ranks.get(tokens[part[i]] + tokens[part[j]])

    while heap:
        best, i = heapq.heappop(heap)
        j = after[i] if part[i] is not None else -1
        if j < 0 or rank(i, j) != best:
            continue
        part[i], part[j] = best, None
        size[i] += size[j]
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (found := rank(left, right)) is not None:
                heapq.heappush(heap, (found, left))
    return [p for p in part if p is not None]


def encode_pieces(pieces: list[bytes], vocab: Vocabulary, long_piece: int = 256, cells: int = 1 << 20) -> list[np.ndarray]:
    """Ids of every piece. Pieces of like length share a matrix; in a round each row merges its leftmost pair
    of smallest rank, rows that cannot merge leave, and rows are closed up again."""
    out: list = [None] * len(pieces)
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    for i in np.flatnonzero(sizes > long_piece):
        out[i] = np.array(_encode_long(pieces[i], vocab), dtype=np.int64)
    for i in np.flatnonzero(sizes == 0):
        out[i] = np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((sizes > 0) & (sizes <= long_piece))
    short = short[np.argsort(sizes[short], kind="stable")]
    at = 0
    while at < len(short):
        width = int(sizes[short[at]])
        bucket = max(2, 1 << (width - 1).bit_length()) if width > 2 else 2
        end = min(int(np.searchsorted(sizes[short], bucket, side="right")), at + max(1, cells // bucket))
        own = short[at:end]
        at = end
        raw = np.frombuffer(b"".join(pieces[i].ljust(bucket, b"\0") for i in own), np.uint8).reshape(-1, bucket)
        count = sizes[own]
        ids = np.where(np.arange(bucket) < count[:, None], vocab.byte_ids[raw], -1)
        ranks = np.full(ids.shape, NONE, dtype=np.int64)
        real = ids[:, 1:] >= 0
        ranks[:, :-1][real] = vocab.pair_rank(ids[:, :-1][real], ids[:, 1:][real])
        while len(own):
            best = ranks.argmin(axis=1)
            row = np.arange(len(own))
            low = ranks[row, best]
            done = low >= NONE
            for k in np.flatnonzero(done):
                out[own[k]] = ids[k, :count[k]]
            if done.any():  # finished rows leave the matrix, and columns that nobody needs go
                live = ~done
                own, count, best, low = own[live], count[live], best[live], low[live]
                if not len(own):
                    break
                ids, ranks = ids[live][:, :count.max()], ranks[live][:, :count.max()]
                row = np.arange(len(own))
            ids[row, best] = low
            gone = np.arange(ids.shape[1] - 1) > best[:, None]
            ids[:, :-1] = np.where(gone, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(gone, ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, NONE
            count = count - 1
            for left in (best - 1, best):
                ok = np.flatnonzero((left >= 0) & (left + 1 < count))
                ranks[ok, left[ok]] = vocab.pair_rank(ids[ok, left[ok]], ids[ok, left[ok] + 1])
            last = np.flatnonzero(best + 1 >= count)
            ranks[last, best[last]] = NONE
    return out


def split_pieces(text: str, pattern: regex.Pattern) -> Iterable[str]:
    return pattern.findall(text)


def decode(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    """Bytes of a sequence of ids."""
    return b"".join(map(vocab.tokens.__getitem__, ids.tolist()))


class Encoder:
    """Encodes texts; chunks between blanks are split and merged once and remembered up to ``remember`` chunks.

    A chunk is a run of blanks and line ends with the visible run after it. The pattern never joins
    characters over the start of such a run, unless other white space is near: those texts are split whole.
    """

    def __init__(self, vocab: Vocabulary, pattern: str, remember: int = 400_000) -> None:
        self.vocab, self.pattern, self.remember = vocab, regex.compile(pattern), remember
        self.known: dict[str, tuple[bytes, str]] = {}
        self.decimals = [str(i) for i in range(len(vocab.tokens))]

    def learn(self, chunks: list[str]) -> None:
        split = [[p.encode() for p in split_pieces(c, self.pattern)] for c in chunks]
        pieces = list({p for s in split for p in s})
        ids = dict(zip(pieces, [own.tolist() for own in encode_pieces(pieces, self.vocab)]))
        for chunk, s in zip(chunks, split):
            own = ids[s[0]] if len(s) == 1 else [i for p in s for i in ids[p]]
            self.known[chunk] = array("I", own).tobytes(), " ".join([self.decimals[i] for i in own])

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """(ids, decimal ids joined by a blank) of every text."""
        chunks = [list(split_pieces(t, self.pattern)) if OTHER_SPACE.search(t) else CHUNK.findall(t)
                  for t in (t or "" for t in texts)]
        known = self.known
        if len(known) > self.remember:
            known.clear()
        self.learn(list({x for c in chunks for x in c if x not in known}))
        for c in chunks:
            parts = [known[x] for x in c]
            yield np.frombuffer(b"".join([p[0] for p in parts]), dtype=np.uint32), " ".join([p[1] for p in parts])


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(vocab_path: str, pattern: str) -> Encoder:
    """One per worker process: later tasks find the vocabulary and the known chunks in place."""
    key = (vocab_path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(load_vocabulary(vocab_path), pattern)
    return _encoders[key]


ENCODED_SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded binary"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_text string, decoded binary"


def encode_documents(docs: DataFrame, vocab_path: str, pattern: str, ids_as_text: bool = False) -> DataFrame:
    """Ids of every whole text and the bytes they decode to: ``doc_id, n_tokens, ids, decoded``.

    With ``ids_as_text`` the ids come as decimals joined by a blank in ``ids_text``. A null text counts as
    empty and has no ids. Rows are independent: repeated rows, null ids and extra columns change nothing.
    ``vocab_path`` must be readable on the workers; every worker process loads it once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocab_path, pattern)
        vocab = encoder.vocab
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # at most about 2 MB of text together
                end, size = at, 0
                while end < batch.num_rows and (end == at or size < 2_000_000):
                    size += len(batch.column(1)[end].as_buffer() or b"") if batch.column(1)[end].is_valid else 0
                    end += 1
                part = batch.slice(at, end - at)
                at = end
                count, ids, decoded = [], [], []
                for own, text in encoder.encode_batch(part.column(1).to_pylist()):
                    count.append(len(own))
                    ids.append(text if ids_as_text else own.astype(np.int32))
                    decoded.append(decode(own, vocab))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count, pa.int64()),
                     pa.array(ids, pa.string() if ids_as_text else pa.list_(pa.int32())), pa.array(decoded, pa.binary())],
                    names=["doc_id", "n_tokens", "ids_text" if ids_as_text else "ids", "decoded"])

    return id_text(docs).mapInArrow(run, DIGEST_SCHEMA if ids_as_text else ENCODED_SCHEMA)
