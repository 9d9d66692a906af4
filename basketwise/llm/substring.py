"""Exact removal of repeated word windows behind a count-min prefilter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.llm import sketch
from basketwise.llm.tables import small_batches
from basketwise.llm.words import BASES, U64, Words, column_words, windows


@dataclass(frozen=True)
class RepeatSpec:
    """``window`` consecutive words are compared. The sketch has ``rows`` x 2**``bits`` cells.

    The sketch is what bounds memory: rows * 2**bits / 8 bytes are broadcast, 24 MB for the defaults, whatever
    the input. A fuller sketch only lets more windows through to the exact pass; none is lost.
    """

    window: int = 20
    gram: int = 8
    bits: int = 26
    rows: int = 3
    merge_fan_in: int = 256

    @property
    def sketch(self) -> sketch.SketchSpec:
        return sketch.SketchSpec(self.bits, self.rows, self.merge_fan_in)


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:]) if len(x) > span else x[:0]
        span *= 2
    rest = size - span
    return (np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]) if rest else x


def _anchors(words: Words, spec: RepeatSpec) -> tuple[np.ndarray, np.ndarray]:
    """For every word: does a window start here, and the anchor of that window.

    The anchor is the smallest hash of the ``gram``-word runs inside the window. Equal windows have equal
    anchors, and neighbouring windows mostly share one, so the sketch has to hold about a seventh of them.
    """
    hashes = words.hashes[0]
    n = len(hashes)
    starts = np.zeros(n, dtype=bool)
    row = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    if n >= spec.window:
        starts[:n - spec.window + 1] = row[:n - spec.window + 1] == row[spec.window - 1:]
    anchor = np.zeros(n, dtype=U64)
    low = _sliding_min(windows(hashes, spec.gram), spec.window - spec.gram + 1)
    anchor[:len(low)] = low
    return starts, anchor


def window_sketch(docs: DataFrame, spec: RepeatSpec) -> np.ndarray:
    """Sketch bits of the anchors that occur twice or more in the whole table."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for words in column_words(batch.column(0)):
            starts, anchor = _anchors(words, spec)
            anchor = anchor[starts]
            if len(anchor):
                row = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))[starts]
                new = np.ones(len(anchor), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                yield anchor[new]

    return sketch.build(docs.select(F.col("text").cast("string")), hashes, spec.sketch, at_least=2)


def _maybe_repeated(anchor: np.ndarray, bits: np.ndarray, spec: RepeatSpec) -> np.ndarray:
    """Which windows the sketch cannot rule out; looks every run of equal anchors up once."""
    if not len(anchor):
        return np.zeros(0, dtype=bool)
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = anchor[1:] != anchor[:-1]
    return sketch.maybe(anchor[new], bits, spec.sketch)[np.cumsum(new) - 1]


def remove_repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec(), keep_spacing: bool = False) -> DataFrame:
    """Drop every word that lies in a window of ``spec.window`` words whose sequence also starts earlier.

    Earlier means a smaller doc_id, or the same document and an earlier start. Windows are judged on the
    input. Gives ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one space) and ``rest``, a struct
    of all other input columns, one row per input row; with ``keep_spacing`` a text that loses nothing is returned as
    it was, null included. A null or empty text has no words. Texts
    shorter than a window lose nothing. Rows without doc_id neither remove nor lose anything; rows that share a
    doc_id do not remove from one another. An empty table gives an empty result.

    The sketch names the windows that may repeat. Those are grouped exactly (128-bit hashes) to the smallest
    doc_id, combined before the shuffle, so a passage in a third of all documents costs one row per task.
    What returns to a document is the list of windows that it is first to have; it drops the others.
    """
    session = docs.sparkSession
    small_batches(session)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.struct(*(others or [F.lit(0).alias("none")])).alias("rest"))
    # a fixed number of bytes whatever the data, see RepeatSpec
    shared = session.sparkContext.broadcast(window_sketch(rows, spec))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for words in column_words(batch.column(1), seeds=2):
                starts, anchor = _anchors(words, spec)
                at = np.flatnonzero(starts)
                at = at[_maybe_repeated(anchor[at], bits, spec)]
                if len(at):
                    row = np.searchsorted(words.bounds, at, side="right") - 1 + words.first
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(windows(h, spec.window, BASES[2 - k])[at].view(np.int64))
                         for k, h in enumerate(words.hashes)] + [pa.array(ids[row].astype(np.int64))],
                        names=["a", "b", "doc_id"])

    found = rows.filter("doc_id is not null").select("doc_id", "text").mapInArrow(
        candidates, "a long, b long, doc_id long")
    first = (found.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"))
             .groupBy("doc_id").agg(F.collect_list("a").alias("first")))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids, firsts = batch.column(0), batch.column(3)
            for words in column_words(batch.column(1)):
                starts, anchor = _anchors(words, spec)
                keys = windows(words.hashes[0], spec.window, BASES[2]).view(np.int64)
                total, lost, kept = [], [], []
                for k in range(len(words.bounds) - 1):
                    lo, hi = int(words.bounds[k]), int(words.bounds[k + 1])
                    r = words.first + k
                    n = hi - lo - spec.window + 1
                    text = batch.column(1)[r].as_py()
                    own = text.encode().split() if text else []
                    total.append(hi - lo)
                    gone = np.zeros(hi - lo, dtype=bool)
                    if n > 0 and ids[r].is_valid:
                        key = keys[lo:lo + n]
                        _, head, inverse = np.unique(key, return_index=True, return_inverse=True)
                        again = head[inverse] != np.arange(n)
                        maybe = _maybe_repeated(anchor[lo:lo + n], bits, spec)
                        if maybe.any():
                            mine = firsts[r].values.to_numpy() if firsts[r].is_valid else np.zeros(0, np.int64)
                            again |= maybe & ~np.isin(key, mine)
                        if again.any():
                            edge = np.zeros(hi - lo + 1, dtype=np.int64)
                            edge[:n] += again
                            edge[spec.window:] -= again
                            gone = np.cumsum(edge[:-1]) > 0
                            own = [own[i] for i in np.flatnonzero(~gone)]
                    lost.append(int(gone.sum()))
                    same = keep_spacing and not gone.any()
                    kept.append((text.encode() if text is not None else None) if same else b" ".join(own))
                part = slice(words.first, words.first + len(total))
                yield pa.RecordBatch.from_arrays(
                    [ids[part], pa.array(total, pa.int64()), pa.array(lost, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string()), batch.column(2)[part]],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "rest"])

    joined = rows.join(first.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "rest", "first")
    kind = rows.schema["rest"].dataType.simpleString()
    return joined.mapInArrow(
        drop, f"doc_id long, n_words long, n_removed long, kept_text string, rest {kind}")


def without_repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """``docs`` with repeated windows cut out of ``text`` and ``n_chars`` (if present) counted anew.

    A text that loses nothing stays as it is, white space included; one that loses all becomes empty.
    """
    out = remove_repeats(docs, spec, keep_spacing=True)
    kept = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed = F.col("n_removed") > 0
        kept["n_chars"] = F.when(changed, F.char_length("kept_text").cast("bigint")).otherwise(F.col("rest.n_chars"))
    return out.select(*(kept.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))
