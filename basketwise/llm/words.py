"""Word and window hashes of whole Arrow text columns with numpy.

Words are maximal runs of bytes outside space and 0x09-0x0D. Every word gets one 64-bit hash per seed: its bytes go
eight at a time through a bijective mixer, all words of a segment together, so no Python object is made per word. The
mixer is not linear in any ring, so regular words (repeats, Thue-Morse sequences) collide no more often than others.
Runs of words are hashed the same way from their halves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEGMENT = 1 << 18
U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
LONG_WORD = 256
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


class Words(NamedTuple):
    """Words of rows ``first .. first + len(bounds) - 2``: row r has words bounds[r] .. bounds[r + 1]."""

    first: int
    bounds: np.ndarray
    hashes: tuple[np.ndarray, ...]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def word_spans(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every word of ``raw``; a word never crosses a position in ``cuts``."""
    inside = ~SPACE[raw]
    first = np.ones(len(raw) + 1, dtype=bool)
    np.logical_not(inside, out=first[1:])
    first[cuts] = True
    starts = np.flatnonzero(inside & first[:-1])
    ends = np.flatnonzero(inside & np.append(first[1:-1] | ~inside[1:], True)) + 1 if len(raw) else starts
    return starts, ends


def _hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """One hash a word; those over ``LONG_WORD`` bytes, which are rare, go through xxHash one by one."""
    size = ends - starts
    out = mix(size.astype(U64) + U64(key))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    live = np.flatnonzero(size <= LONG_WORD)
    at, left = starts[live], size[live]
    while len(live):
        out[live] = mix(out[live] ^ (eight[at] & LOW_BYTES[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k]:ends[k]].tobytes(), seed=key)
    return out


def _long_text(raw: np.ndarray, seeds: int, lower: bool) -> tuple[np.ndarray, ...]:
    """Hashes of one text longer than a segment, cut at white space."""
    parts: list[list[np.ndarray]] = [[] for _ in range(seeds)]
    at = 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT)
        while end < len(raw):
            gaps = np.flatnonzero(SPACE[raw[max(at, end - SEGMENT):end]])
            if len(gaps):
                end = max(at, end - SEGMENT) + int(gaps[-1]) + 1
                break
            end = min(len(raw), end + SEGMENT)
        piece = LOWER[raw[at:end]] if lower else raw[at:end]
        starts, ends = word_spans(piece, np.zeros(1, np.int64))
        for k in range(seeds):
            parts[k].append(_hash_words(piece, starts, ends, BASES[k]))
        at = end
    return tuple(np.concatenate(p) for p in parts)


def column_words(column: pa.Array, seeds: int = 1, lower: bool = False) -> Iterator[Words]:
    """Hashed words of a text column, about one segment of bytes at a time."""
    data, at = text_buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + SEGMENT, side="right")) - 1)
        raw = data[at[row]:at[stop]]
        if len(raw) > SEGMENT:
            hashes = _long_text(raw, seeds, lower)
            yield Words(row, np.array([0, len(hashes[0])]), hashes)
        else:
            if lower:
                raw = LOWER[raw]
            cuts = at[row:stop + 1] - at[row]
            starts, ends = word_spans(raw, cuts)
            yield Words(row, np.searchsorted(starts, cuts), tuple(
                _hash_words(raw, starts, ends, BASES[k]) for k in range(seeds)))
        row = stop


def windows(hashes: np.ndarray, size: int, key: int = BASES[0]) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words, joined from runs of 1, 2, 4 ... words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total, at, span, runs = None, 0, 1, hashes
    while True:
        if size & span:
            part = runs[at:at + n]
            total = part if total is None else mix(total * U64(key) + part)
            at += span
        if span * 2 > size:
            return mix(total + U64(size))
        runs = mix(runs[:-span] * U64(key) + runs[span:])
        span *= 2
