"""Exact Jaccard join of word n-gram sets: rare-first prefixes with length, positional and suffix filters."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.llm import sketch
from basketwise.llm.components import connected_components
from basketwise.llm.minhash import document_sets
from basketwise.llm.tables import id_text, materialize
from basketwise.llm.words import U64

BLOCK_BITS = 20
FAN_IN = 256


@dataclass(frozen=True)
class JoinSpec:
    """Links need ``100 * |A & B| >= percent * |A | B|`` on sets of ``shingle`` consecutive words.

    ``cell_bits`` sizes the table of n-gram frequencies that is broadcast, one byte for each of 2**cell_bits cells
    whatever the input. It only decides the order of n-grams (an n-gram is never taken for rarer than it is); any
    order gives the same links.
    """

    shingle: int = 5
    percent: int = 80
    cell_bits: int = 24


SURVEY = "doc_id long, n_shingles long, set_a long, set_b long, block int, part int, counts binary"
PREFIXES = "doc_id long, set_a long, set_b long, size int, prefix binary, spread binary"


def _halves(digests: list[tuple]) -> list[pa.Array]:
    return [pa.array([d[k] for d in digests], pa.uint64()).view(pa.int64()) for k in (0, 1)]


def _survey(docs: DataFrame, spec: JoinSpec) -> DataFrame:
    """One pass over the texts: a row for every document and, at the end of a partition, the counts of its n-grams by
    cell, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << spec.cell_bits, dtype=np.uint32)
        held: list[np.ndarray] = []
        waiting = 0

        def fold() -> None:
            nonlocal held, waiting
            if held:
                cells, counts = np.unique(np.concatenate(held) >> U64(64 - spec.cell_bits), return_counts=True)
                total[cells.astype(np.int64)] += counts.astype(np.uint32)
            held, waiting = [], 0

        for batch in batches:
            names = batch.column(0).to_pylist()
            ids, sizes, digests = [], [], []
            for row, found, digest in document_sets(batch.column(1), spec.shingle, digests=True):
                ids.append(names[row])
                sizes.append(len(found))
                digests.append(digest)
                held.append(found)
                waiting += len(found)
                if waiting > 500_000:
                    fold()
            gone = pa.nulls(len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *_halves(digests), gone, gone,
                 pa.nulls(len(ids), pa.binary())], names=SURVEY.replace(",", "").split()[::2])
        fold()
        part = TaskContext.get().partitionId()
        width = min(1 << BLOCK_BITS, len(total))
        for block in range(len(total) // width):
            own = total[block * width:(block + 1) * width]
            if own.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, none, none, pa.array([block], pa.int32()), pa.array([part], pa.int32()),
                     pa.array([_pack(own)], pa.binary())], names=SURVEY.replace(",", "").split()[::2])

    return materialize(id_text(docs).mapInArrow(run, SURVEY), "survey")


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _frequencies(blocks: DataFrame, spec: JoinSpec) -> np.ndarray:
    """Byte per cell that grows with the count of the cell: 0 none, 1 once, then four steps for every doubling.

    Counts of partitions are added up on the executors, at most ``FAN_IN`` at a time; the driver gets the bytes.
    """

    def total(rows: pd.DataFrame) -> np.ndarray:
        out = np.zeros(len(_unpack(rows["counts"].iloc[0])), dtype=np.uint64)
        for blob in rows["counts"]:
            out += _unpack(blob)
        return np.minimum(out, (1 << 32) - 1).astype(np.uint32)

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "part": [key[1]], "counts": [_pack(total(rows))]})

    def level(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        count = total(rows).astype(np.float64)
        steps = np.where(count > 0, 1 + np.floor(4 * np.log2(np.maximum(count, 1))), 0).astype(np.uint8)
        return pd.DataFrame({"block": [key[0]], "levels": [zlib.compress(steps.tobytes(), 1)]})

    most = blocks.agg(F.max("part")).first()[0]
    while most is not None and most >= FAN_IN:
        blocks = materialize(
            blocks.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part")
            .applyInPandas(add, "block int, part int, counts binary"), "counts")
        most //= FAN_IN
    width = min(1 << BLOCK_BITS, 1 << spec.cell_bits)
    out = np.zeros(1 << spec.cell_bits, dtype=np.uint8)
    for block, levels in blocks.groupBy("block").applyInPandas(level, "block int, levels binary").toLocalIterator():
        out[block * width:(block + 1) * width] = np.frombuffer(zlib.decompress(levels), np.uint8)
    return out


def _spread(elements: np.ndarray) -> np.ndarray:
    """How many elements lie in each of 16 fixed ranges of hashes."""
    return np.bincount((elements >> U64(60)).astype(np.int64), minlength=16).astype(np.int32)


def _prefixes(docs: DataFrame, levels: np.ndarray, spec: JoinSpec) -> DataFrame:
    """Per document: the rarest n-grams of its set, as many as a partner must share one of, and the spread of all."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 2**cell_bits bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            names = batch.column(0).to_pylist()
            ids, digests, sizes, first, spreads = [], [], [], [], []
            for row, own, digest in document_sets(batch.column(1), spec.shingle, digests=True):
                if len(own) and names[row] is not None:
                    often = level[(own >> U64(64 - spec.cell_bits)).astype(np.int64)]
                    keep = len(own) + (-spec.percent * len(own)) // 100 + 1
                    ids.append(names[row])
                    digests.append(digest)
                    sizes.append(len(own))
                    first.append(own[np.lexsort((own, often))[:keep]].tobytes())
                    spreads.append(_spread(own).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *_halves(digests), pa.array(sizes, pa.int32()),
                 pa.array(first, pa.binary()), pa.array(spreads, pa.binary())],
                names=PREFIXES.replace(",", "").split()[::2])

    return id_text(docs).mapInArrow(run, PREFIXES)


def _entries(reps: DataFrame) -> DataFrame:
    """``element, u, pos, size`` of every prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [np.frombuffer(p.as_buffer(), dtype=U64) for p in batch.column(2)]
            length = np.array([len(p) for p in own])
            flat = np.concatenate(own)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
            columns = (flat.view(np.int64), np.repeat(batch.column(0).to_numpy(), length), pos.astype(np.int32),
                       np.repeat(batch.column(1).to_numpy(), length))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["element", "u", "pos", "size"])

    return reps.select("cls", "size", "prefix").mapInArrow(run, "element long, u long, pos int, size int")


def _room(a: str, b: str, spec: JoinSpec) -> Column:
    """Length and positional filter for columns ``size<a>, pos<a>, size<b>, pos<b>`` of a first shared n-gram."""
    p = spec.percent
    return F.expr(f"100 * least(size{a}, size{b}) >= {p} * greatest(size{a}, size{b}) and "
                  f"{100 + p} * least(size{a} - pos{a}, size{b} - pos{b}) >= {p} * (size{a} + size{b})")


def _once(met: DataFrame) -> DataFrame:
    """One row per pair (u > v): the places of its first shared n-gram."""
    turned = F.col("u") < F.col("v")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return (met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"),
                       F.struct(pick("pos1", "pos2").alias("pu"), pick("pos2", "pos1").alias("pv")).alias("at"))
            .groupBy("u", "v").agg(F.min("at").alias("at")).select("u", "v", "at.pu", "at.pv"))


def _suffix_filter(pairs: DataFrame, reps: DataFrame, spec: JoinSpec) -> DataFrame:
    """Pairs (u, v) whose n-grams behind the first shared one leave room for the similarity in every range of hashes.

    Before the first shared n-gram nothing is shared, so what two sets share is that one and, in each range, at most
    the smaller number of what either has left there.
    """
    side = lambda c: reps.select(F.col("cls").alias(c), *(F.col(x).alias(x + c) for x in ("size", "prefix", "spread")))

    def left(batch: pa.RecordBatch, c: str) -> np.ndarray:
        spread = np.frombuffer(b"".join(batch.column("spread" + c).to_pylist()), np.int32).reshape(-1, 16).copy()
        own = [np.frombuffer(p.as_buffer(), dtype=U64)[:at + 1]
               for p, at in zip(batch.column("prefix" + c), batch.column("p" + c).to_pylist())]
        row = np.repeat(np.arange(len(own)), [len(p) for p in own])
        np.subtract.at(spread, (row, (np.concatenate(own) >> U64(60)).astype(np.int64)), 1)
        return spread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                most = 1 + np.minimum(left(batch, "u"), left(batch, "v")).sum(axis=1).astype(np.int64)
                sizes = batch.column("sizeu").to_numpy().astype(np.int64) + batch.column("sizev").to_numpy()
                yield batch.select(["u", "v"]).filter(pa.array((100 + spec.percent) * most >= spec.percent * sizes))

    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(run, "u long, v long")


def _sets(docs: DataFrame, wanted: DataFrame, spec: JoinSpec) -> DataFrame:
    """``cls, elements`` (the full sorted set) of the classes in ``wanted`` (cls, rep, set_a, set_b), from the whole
    texts of their representatives; a filter of fixed size keeps most other texts from being cut up."""
    bits = docs.sparkSession.sparkContext.broadcast(sketch.id_filter(wanted.select("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.filter(batch.column(0).is_valid())
            known = known.filter(pa.array(sketch.maybe(sketch.id_hashes(known.column(0)), bits.value, sketch.SketchSpec())))
            names = known.column(0).to_pylist()
            for first in range(0, known.num_rows, 500):
                rows = list(document_sets(known.column(1).slice(first, 500), spec.shingle, digests=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[first + r] for r, _, _ in rows], pa.int64()), *_halves([d for _, _, d in rows]),
                     pa.array([s.tobytes() for _, s, _ in rows], pa.binary())],
                    names=["rep", "set_a", "set_b", "elements"])

    found = id_text(docs).mapInArrow(run, "rep long, set_a long, set_b long, elements binary")
    keys = ["rep", "set_a", "set_b"]
    return materialize(found.join(wanted, keys).dropDuplicates(keys).select("cls", "elements"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, spec: JoinSpec) -> DataFrame:
    """``u, v, jaccard`` of the pairs whose full sets are similar enough; stored."""
    ends = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls"))).distinct()
    sets = _sets(docs, classes.join(ends, "cls", "left_semi"), spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, share = [], []
            for x, y in zip(batch.column("eu"), batch.column("ev")):
                a, b = (np.frombuffer(e.as_buffer(), dtype=U64) for e in (x, y))
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                keep.append(100 * both >= spec.percent * (len(a) + len(b) - both))
                share.append(both / (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("v"), pa.array(share, pa.float64())],
                names=["u", "v", "jaccard"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sets.select(F.col("cls").alias(c), F.col("elements").alias("e" + c))
    return materialize(pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(
        run, "u long, v long, jaccard double"), "links")


def _partners(entries: DataFrame, spec: JoinSpec, other: str) -> DataFrame:
    """Pairs of ``entries`` (element, u, pos, size and more) that share an n-gram and pass the filters.

    Sizes fall into classes as wide as a link allows, and only neighbouring classes meet. A hot n-gram's rows are split
    by Spark's skew join. ``other`` is the condition on the two sides, named with 1 and 2.
    """
    width = math.log(100 / spec.percent) * 1.0001 if spec.percent < 100 else 1.0
    sized = entries.withColumn("class", F.floor(F.log("size") / F.lit(width)).cast("int"))
    side = lambda s, at: sized.select(
        "element", at.alias("class"), *(F.col(c).alias(c + s) for c in entries.columns if c != "element"))
    near = F.explode(F.array(*(F.col("class") + k for k in (-1, 0, 1))))
    return (side("1", F.col("class")).join(side("2", near), ["element", "class"])
            .filter(F.expr(f"u1 > u2 and {other}") & _room("1", "2", spec))
            .select(F.col("u1").alias("u"), F.col("u2").alias("v"), "pos1", "pos2"))


@dataclass(frozen=True)
class Prepared:
    """What both forms of the join start from: documents, classes of equal sets, their prefixes, shared entries."""

    documents: DataFrame
    classes: DataFrame
    reps: DataFrame
    met: DataFrame


def prepare(docs: DataFrame, spec: JoinSpec) -> Prepared:
    survey = _survey(docs, spec)
    rows = survey.filter("block is null").select("doc_id", "n_shingles", "set_a", "set_b")
    known = rows.filter("doc_id is not null and n_shingles > 0")
    classes = materialize(
        known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
        .withColumn("cls", F.monotonically_increasing_id()), "classes")
    levels = _frequencies(survey.filter("block is not null").select("block", "part", "counts"), spec)
    keys = ["doc_id", "set_a", "set_b"]
    reps = materialize(
        _prefixes(docs, levels, spec).join(classes.withColumnRenamed("rep", "doc_id"), keys).dropDuplicates(keys)
        .select("cls", "size", "prefix", "spread"), "reps")
    entries = _entries(reps)
    # the member that has the n-gram earliest has the fewest rarer ones: the likeliest centre of a group of near copies
    # (stored, so that the join with it can split a hot n-gram)
    shared = materialize(entries.groupBy("element").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "u", "size")).alias("pivot")).filter("n > 1"), "shared")
    met = materialize(entries.join(shared, "element").select(
        "element", "u", "pos", "size", F.col("pivot.u").alias("v"), F.col("pivot.pos").alias("pos_v"),
        F.col("pivot.size").alias("size_v")), "met")
    return Prepared(rows, classes, reps, met)


def links(docs: DataFrame, spec: JoinSpec = JoinSpec()) -> tuple[DataFrame, DataFrame]:
    """All links: ``(u, v, jaccard)`` between classes of equal sets (u > v), and the members ``(doc_id, cls)``.

    The number of pairs is the result itself, so a group of many different near copies gives many; use
    :func:`linked_documents` where only the groups are wanted. Rows as there; documents without a word or without
    doc_id are in no class.
    """
    made = prepare(docs, spec)
    pairs = _once(_partners(made.met.select("element", "u", "pos", "size"), spec, "true"))
    found = _verified(materialize(_suffix_filter(pairs, made.reps, spec), "pairs"), docs, made.classes, spec)
    return found, made.documents.join(made.classes, ["set_a", "set_b"]).select("doc_id", "cls").distinct()


def linked_documents(docs: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the smallest doc_id reachable over links, itself included. Texts that are null, empty or only
    white space have an empty set and are linked with nothing. Rows that share a doc_id are one vertex with the links
    of all its texts; rows without doc_id have no component (null). Repeated rows give repeated rows, other columns are
    ignored, an empty table gives no rows. Ties need no rule: a link is a condition on exact counts.

    Plan: documents with equal sets form a class with one representative, so copies cost one grouped minimum. N-grams
    are ordered by how often all texts have them, the rarest first; each class hands out the prefix a partner must share
    an n-gram of, with its place and the size of the set. First every class meets only the class that stands earliest
    in each shared n-gram; pairs pass the length, positional and suffix filters and are verified on full sets. Then
    classes of different components that share a prefix n-gram meet, pass the same filters and are verified, each pair
    once. A pair inside one component cannot change the result; all others are looked at, so no link is lost.
    """
    made = prepare(docs, spec)
    classes = made.classes
    near = made.met.filter("u <> v").select(
        "u", "v", F.col("pos").alias("pos1"), F.col("pos_v").alias("pos2"), F.col("size").alias("size1"),
        F.col("size_v").alias("size2")).filter(_room("1", "2", spec))
    tried = materialize(_once(near).select("u", "v", "pu", "pv"), "tried")
    first = _verified(materialize(_suffix_filter(tried, made.reps, spec), "pairs"), docs, classes, spec)

    name = lambda c: classes.select(F.col("cls").alias(c), F.col("rep").alias("rep_" + c))
    as_reps = lambda pairs: pairs.select("u", "v").join(name("u"), "u").join(name("v"), "v").select(
        F.col("rep_u").alias("u"), F.col("rep_v").alias("v"))
    known = made.documents.filter("doc_id is not null and n_shingles > 0")
    several = known.groupBy("doc_id").agg(*(f(c).alias(f.__name__ + c) for c in ("set_a", "set_b") for f in (F.min, F.max))) \
        .filter("minset_a <> maxset_a or minset_b <> maxset_b").select("doc_id")
    same_id = known.join(several, "doc_id", "left_semi").join(classes, ["set_a", "set_b"]).select(
        F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    so_far = materialize(connected_components(as_reps(first).unionByName(same_id)), "components")

    place = classes.join(so_far.withColumnRenamed("vertex", "rep"), "rep", "left").select(
        F.col("cls").alias("u"), F.coalesce("component", "rep").alias("c"))
    here = made.met.select("element", "u", "pos", "size").join(place, "u")
    mixed = materialize(here.groupBy("element").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
                        .filter("lo <> hi").select("element"), "mixed")
    open_entries = materialize(here.join(mixed, "element"), "open")
    crossed = _once(_partners(open_entries, spec, "c1 <> c2")).join(tried.select("u", "v"), ["u", "v"], "left_anti")
    rest = materialize(_suffix_filter(crossed, made.reps, spec), "pairs")
    final = so_far
    if not rest.isEmpty():
        again = as_reps(_verified(rest, docs, classes, spec))
        final = connected_components(again.unionByName(
            so_far.filter("vertex <> component").select(F.col("vertex").alias("u"), F.col("component").alias("v"))))
    member = classes.join(final.withColumnRenamed("vertex", "rep"), "rep", "left").select(
        "set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    out = made.documents.join(member, ["set_a", "set_b"], "left")
    return out.select("doc_id", "n_shingles",
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
