"""Merged count-min sketches and id filters of fixed size.

Every input partition makes its own sketch; sketches are merged by block of cells on the executors; the
driver only receives the wanted cells of ``rows * 2**bits``, in a few pieces, whatever the input and its partitions.
Counts stop at two, which is all that "occurs" and "occurs again" need. Collisions only ever add counts, so a clear bit
is certain.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.llm.tables import materialize, small_batches
from basketwise.llm.words import BASES, U64, mix


@dataclass(frozen=True)
class SketchSpec:
    bits: int = 26
    rows: int = 1
    merge_fan_in: int = 256

    @property
    def block_bits(self) -> int:
        return min(20, self.bits)


SCHEMA = "sketch_row int, block int, part int, once binary, twice binary"
PIECES = 8  # in which the driver reads a sketch, each in a job of its own


def _pack(cells: np.ndarray) -> bytes:
    """Sorted cell numbers as compressed differences, byte plane by byte plane."""
    steps = np.diff(cells.astype(np.uint32), prepend=np.uint32(0))
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def _cells(hashes: np.ndarray, row: int, spec: SketchSpec) -> np.ndarray:
    return (mix(hashes + U64(BASES[row % 3] * (row + 1) % (1 << 64))) >> U64(64 - spec.bits)).astype(np.uint32)


def _emit(cells: np.ndarray, counts: np.ndarray, row: int, part: int, spec: SketchSpec) -> Iterator[tuple]:
    edges = np.searchsorted(cells, np.arange((1 << (spec.bits - spec.block_bits)) + 1, dtype=np.int64) << spec.block_bits)
    for block in range(len(edges) - 1):
        lo, hi = edges[block], edges[block + 1]
        if hi > lo:
            own = cells[lo:hi] - np.uint32(block << spec.block_bits)
            many = counts[lo:hi] > 1
            yield row, block, part, _pack(own[~many]), _pack(own[many])


def build(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], spec: SketchSpec,
          at_least: int) -> np.ndarray:
    """Bit (r, c): cell c of row r counts ``at_least`` (1 or 2) of the 64-bit ``hashes`` of all rows of ``df``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        merged, merged_counts, waiting = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), 0

        def fold() -> None:
            nonlocal merged, merged_counts, held, waiting
            values = np.concatenate([merged, *held])
            weight = np.concatenate([merged_counts, np.ones(len(values) - len(merged), np.int64)])
            merged, inverse = np.unique(values, return_inverse=True)
            merged_counts = np.minimum(np.bincount(inverse, weight, len(merged)), 2).astype(np.int64)
            held, waiting = [], 0

        for batch in batches:
            for found in hashes(batch):
                held.append(found)
                waiting += len(found)
                if waiting > 500_000:
                    fold()
        fold()
        part = TaskContext.get().partitionId()
        for r in range(spec.rows if len(merged) else 0):
            cells, inverse = np.unique(_cells(merged, r, spec), return_inverse=True)
            rows = list(zip(*_emit(cells, np.bincount(inverse, merged_counts, len(cells)), r, part, spec)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                names=["sketch_row", "block", "part", "once", "twice"])

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        # two bit maps hold the merged counts of a block, whatever the number of sketches
        seen, again = (np.zeros(1 << spec.block_bits, dtype=bool) for _ in range(2))
        for once, twice in zip(rows["once"], rows["twice"]):
            one, two = _unpack(once), _unpack(twice)
            again[two] = True
            again[one[seen[one]]] = True
            seen[one] = True
            seen[two] = True
        return pd.DataFrame([(key[0], key[1], int(rows["part"].iloc[0]), _pack(np.flatnonzero(seen & ~again)),
                              _pack(np.flatnonzero(again)))], columns=rows.columns)

    parts = materialize(df.mapInArrow(sketch, SCHEMA), "sketch")
    most = parts.agg(F.max("part")).first()[0]
    while most is not None and most >= spec.merge_fan_in:
        parts = materialize(
            parts.withColumn("part", F.floor(F.col("part") / spec.merge_fan_in).cast("int"))
            .groupBy("sketch_row", "block", "part").applyInPandas(merge, SCHEMA), "sketch")
        most = most // spec.merge_fan_in
    bits = np.zeros((spec.rows, (1 << spec.bits) // 8), dtype=np.uint8)
    width = (1 << spec.block_bits) // 8
    wanted = ["twice", "once"][:3 - at_least]
    merged = parts.groupBy("sketch_row", "block").applyInPandas(merge, SCHEMA) if most else parts
    # stored first: an iterator over the merge itself is a job for each shuffle partition, which merge one after the other
    stored = materialize(merged.select("sketch_row", "block", *wanted), "sketch").coalesce(PIECES)
    for r, block, *cells in stored.toLocalIterator():  # one piece of bounded size at a time
        own = np.zeros(1 << spec.block_bits, dtype=bool)
        for blob in cells:
            own[_unpack(bytes(blob))] = True
        bits[r, block * width:(block + 1) * width] = np.packbits(own, bitorder="little")
    return bits


def maybe(hashes: np.ndarray, bits: np.ndarray, spec: SketchSpec) -> np.ndarray:
    """For which hashes all cells have their bit set; never false for one that was counted often enough."""
    out = np.ones(len(hashes), dtype=bool)
    for r in range(spec.rows):
        cell = _cells(hashes, r, spec)
        out &= (bits[r][cell >> np.uint32(3)] >> (cell & np.uint32(7)).astype(np.uint8)) & 1 > 0
    return out


def id_hashes(column: pa.Array) -> np.ndarray:
    """Hashes of a column of ids; nulls are left out."""
    return mix(column.drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(U64) + U64(BASES[0]))


def id_filter(ids: DataFrame, spec: SketchSpec = SketchSpec()) -> np.ndarray:
    """Bits for the ids in the only column of ``ids``."""
    return build(ids, lambda batch: iter([id_hashes(batch.column(0))]), spec, at_least=1)


def rows_maybe_in(df: DataFrame, id_at: int, bits: np.ndarray, spec: SketchSpec = SketchSpec(),
                  wanted: bool = True) -> DataFrame:
    """Rows whose id may be among those of the filter (or, with ``wanted`` false, surely is not). Null ids never are."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(id_at)
            keep = np.zeros(batch.num_rows, dtype=bool)
            keep[column.is_valid().to_numpy(zero_copy_only=False)] = maybe(id_hashes(column), shared.value, spec)
            yield batch.filter(pa.array(keep == wanted))

    return df.mapInArrow(run, df.schema)
