"""Near-duplicate documents: many universal hash minima, banding, verification, star components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.llm import sketch
from basketwise.llm.components import connected_components
from basketwise.llm.tables import id_text, materialize
from basketwise.llm.words import BASES, U64, column_words, mix, windows


@dataclass(frozen=True)
class NearDupSpec:
    """Links need ``100 * |A & B| >= percent * |A | B|`` on sets of ``shingle`` consecutive words.

    ``bands`` x ``rows`` hash minima: a pair at similarity 0.8 shares no band with probability
    (1 - 0.8**rows)**bands, 1.3e-7 for the defaults. ``sketch_floor`` is the share of equal minima (one byte
    each) under which a pair is not verified; 0.63 lies six deviations below 0.8. ``ranked`` bounds the list of
    frequent shingles that the exact second pass broadcasts.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    sketch_floor: float = 0.63
    ranked: int = 1 << 18
    seed: int = 11


SIGNATURE_SCHEMA = ("doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary")


def document_sets(column: pa.Array, shingle: int, digests: bool = False) -> Iterator[tuple[int, np.ndarray, tuple]]:
    """(row, sorted distinct shingle hashes, digest); a text shorter than a shingle is one shingle of all its words.

    The digest is two 64-bit numbers from independently keyed hashes of all distinct shingles (None for an empty set,
    or if not asked for).
    """
    for words in column_words(column, seeds=1 + digests, lower=True):
        grams = [windows(h, shingle) for h in words.hashes]
        for k in range(len(words.bounds) - 1):
            lo, hi = int(words.bounds[k]), int(words.bounds[k + 1])
            if hi == lo:
                yield words.first + k, np.zeros(0, dtype=U64), (None, None)
                continue
            own = [g[lo:hi - shingle + 1] for g in grams] if hi - lo >= shingle else \
                [windows(h[lo:hi], hi - lo) for h in words.hashes]
            if digests:
                found, at = np.unique(own[0], return_index=True)
                with np.errstate(over="ignore"):
                    second = mix(own[1][at] + found).sum(dtype=U64)
                yield words.first + k, found, (xxhash.xxh3_64_intdigest(found.tobytes()), int(second))
            else:
                yield words.first + k, np.unique(own[0]), (None, None)


def _coefficients(spec: NearDupSpec) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the multiply-shift family x -> (a x + b mod 2**64) >> 32."""
    rng = np.random.default_rng(spec.seed)
    n = spec.bands * spec.rows
    return rng.integers(0, 1 << 63, n, dtype=U64) * U64(2) + U64(1), rng.integers(0, 1 << 63, n, dtype=U64)


def minima(sets: list[np.ndarray], spec: NearDupSpec) -> np.ndarray:
    """One row of ``bands * rows`` minima (32 bits) for each non-empty set."""
    a, b = _coefficients(spec)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), len(a)), dtype=np.uint32)
    for k in range(len(a)):
        out[:, k] = np.minimum.reduceat(flat * a[k] + b[k], starts) >> U64(32)
    return out


def signatures(docs: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Per document: set size, 128-bit digest of the set, band keys, and one byte of every minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids, sets, digests):
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            if full:
                low = minima([sets[i] for i in full], spec)
                total = np.zeros((len(full), spec.bands), dtype=U64) + np.arange(spec.bands, dtype=U64)
                for r in range(spec.rows):
                    total = mix(total * U64(BASES[2]) + low[:, r::spec.rows])
                total, low = total.view(np.int64), low.astype(np.uint8)
                for j, i in enumerate(full):
                    keys[i], sketch[i] = total[j], low[j].tobytes()
            half = lambda k: pa.array([d[k] for d in digests], pa.uint64()).view(pa.int64())
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), half(0), half(1),
                pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            ids, sets, digests, size = [], [], [], 0
            for row, found, digest in document_sets(batch.column(1), spec.shingle, digests=True):
                ids.append(names[row])
                sets.append(found)
                digests.append(digest)
                size += len(found)
                if size > 100_000 or len(ids) >= 2000:
                    yield flush(ids, sets, digests)
                    ids, sets, digests, size = [], [], [], 0
            if ids:
                yield flush(ids, sets, digests)

    return id_text(docs).mapInArrow(run, SIGNATURE_SCHEMA)


def _with_sketch_match(pairs: DataFrame, reps: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Signature verification: pairs whose sizes and equal minima allow the wanted similarity."""
    side = lambda c: reps.select(
        F.col("doc_id").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))
    both = pairs.join(side("u"), "u").filter("su is not null").join(side("v"), "v").filter(
        100 * F.least("nu", "nv") >= spec.percent * F.greatest("nu", "nv"))
    names = pairs.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            width = spec.bands * spec.rows
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width)
                           for c in ("su", "sv"))
            share = (left == right).mean(axis=1)
            keep = pa.array(share >= spec.sketch_floor)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(share, pa.float64())],
                names=[*names, "share"]).filter(keep)

    kinds = ", ".join(f"{n} {t}" for n, t in pairs.dtypes)
    return both.select(*names, "su", "sv").mapInArrow(run, f"{kinds}, share double")


def _sets(docs: DataFrame, wanted: DataFrame, spec: NearDupSpec, label: str) -> DataFrame:
    """``doc_id, elements`` (sorted shingle hashes) of the documents whose id is in ``wanted``.

    A filter of fixed size keeps most other texts from being cut up, so texts are never shuffled; the few that pass
    it by chance fall out in the joins that follow.
    """
    bits = docs.sparkSession.sparkContext.broadcast(sketch.id_filter(wanted))

    def as_sets(batches):
        for batch in batches:
            known = batch.filter(batch.column(0).is_valid())
            batch = known.filter(pa.array(sketch.maybe(sketch.id_hashes(known.column(0)), bits.value, sketch.SketchSpec())))
            names = batch.column(0).to_pylist()
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                rows = list(document_sets(part.column(1), spec.shingle))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[first + r] for r, _, _ in rows], pa.int64()),
                     pa.array([s.tobytes() for _, s, _ in rows], pa.binary())], names=["doc_id", "elements"])

    return materialize(id_text(docs).mapInArrow(as_sets, "doc_id long, elements binary"), label)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()


def _prefixes(sets: DataFrame, spec: NearDupSpec) -> DataFrame:
    """``u, element, pos, size``: the first shingles of every set in one common order, the rarest first.

    A pair with the wanted similarity shares at least ``percent`` of the larger set, so the first element that both
    sets have lies among these. Any fixed order is right; the more frequent an element, the later it should come,
    so the ``ranked`` most frequent ones (a fixed number, which bounds the broadcast) go last.
    """

    def elements(batches):
        for batch in batches:
            for e in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(e.as_buffer(), dtype=np.int64))], names=["element"])

    counts = (sets.select("elements").mapInArrow(elements, "element long").groupBy("element")
              .agg(F.count(F.lit(1)).alias("n")).filter("n > 2").orderBy(F.desc("n"), "element").limit(spec.ranked).toArrow())
    known = counts.column("element").to_numpy()
    at = np.argsort(known)
    shared = sets.sparkSession.sparkContext.broadcast((known[at], counts.column("n").to_numpy()[at]))

    def first(batches):
        known, often = shared.value
        for batch in batches:
            ids, found, places, sizes = [], [], [], []
            for u, e in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(e.as_buffer(), dtype=np.int64)
                spot = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                count = np.where(known[spot] == own, often[spot], 0) if len(known) else np.zeros(len(own), np.int64)
                keep = len(own) + (-spec.percent * len(own)) // 100 + 1
                found.append(own[np.lexsort((own, count))[:keep]])
                ids.append(np.full(len(found[-1]), u))
                places.append(np.arange(len(found[-1])))
                sizes.append(np.full(len(found[-1]), len(own)))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in (ids, found, places, sizes)],
                    names=["u", "element", "pos", "size"])

    return sets.select("doc_id", "elements").mapInArrow(first, "u long, element long, pos long, size long")


def _confirmed(pairs: DataFrame, sets: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Pairs (u, v) whose full shingle sets are similar enough."""

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("eu"), batch.column("ev")):
                p, q = (np.frombuffer(e.as_buffer(), dtype=U64) for e in (x, y))
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum()) if len(q) else 0
                keep.append(100 * both >= spec.percent * (len(p) + len(q) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("elements").alias(f"e{c}"))
    return (pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").select("u", "v", "eu", "ev")
            .mapInArrow(similar, "u long, v long"))


def near_duplicates(docs: DataFrame, spec: NearDupSpec = NearDupSpec()) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest doc_id reachable over links, ``kept`` marks that document. Texts that
    are null, empty or only white space have no shingles, are linked with nothing and are kept. Rows that share
    a doc_id are one vertex with the links of all its texts (those without a word still stand alone); rows without
    doc_id get a null component and are kept. Other columns are ignored; an empty table gives no rows.

    Plan: (1) documents with equal sets form a class, its smallest id stands for it, so copies cost one grouped
    minimum, and classes that share a doc_id are linked; (2) in each band bucket every member is paired with one pivot only, the member that meets most others;
    pairs are checked on the one-byte sketches, the best pair of every member on full sets, and components are
    formed; (3) for documents in buckets that still hold several components, an exact prefix join finds the pairs
    across components whose rarest shingles leave room for the similarity, checked the same way. A pair inside one
    component cannot change the result, and no bucket is capped. By chance a link whose two sets share no bucket is not
    seen, see :class:`NearDupSpec` for how rarely.
    """
    sig = materialize(signatures(docs, spec), "signatures")
    known = sig.filter("doc_id is not null and n_shingles > 0")
    classes = materialize(known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    reps = materialize(
        known.join(classes.withColumnRenamed("rep", "doc_id"), ["set_a", "set_b", "doc_id"], "left_semi")
        .dropDuplicates(["doc_id", "set_a", "set_b"]).drop("set_a", "set_b"), "reps")
    several = known.groupBy("doc_id").agg(*(f(c).alias(f.__name__ + c) for c in ("set_a", "set_b") for f in (F.min, F.max))) \
        .filter("minset_a <> maxset_a or minset_b <> maxset_b").select("doc_id")
    same_id = known.join(several, "doc_id", "left_semi").join(classes, ["set_a", "set_b"]).select(
        F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    keys = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = materialize(keys.join(shared, "band").select("band", F.col("doc_id").alias("u"), "n"), "met")
    wide = met.join(met.groupBy("u").agg(F.sum("n").alias("meets")), "u")
    pivots = wide.groupBy("band").agg(F.max(F.struct("meets", (-F.col("u")).alias("minus"))).alias("top")).select(
        "band", (-F.col("top.minus")).alias("v"))
    buckets = materialize(met.join(pivots, "band").select("band", "u", "v", "n"), "buckets")
    stars = materialize(
        _with_sketch_match(buckets.filter("u <> v").select("u", "v").distinct(), reps, spec), "stars")
    best = stars.groupBy("u").agg(F.max("share").alias("share"))
    first = materialize(stars.join(best, ["u", "share"]).groupBy("u").agg(F.min("v").alias("v")), "first")
    linked = materialize(
        _confirmed(first, _sets(docs, _ends(first), spec, "sets"), spec).unionByName(same_id), "links")
    so_far = materialize(connected_components(linked), "components")

    here = buckets.join(so_far.select(F.col("vertex").alias("u"), "component"), "u", "left").select(
        "band", "u", "v", "n", F.coalesce("component", "u").alias("c"))
    mixed = here.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("band")
    open_ids = materialize(here.join(mixed, "band").select("u", "c").distinct(), "mixed")
    sets = _sets(docs, open_ids.select(F.col("u").alias("doc_id")), spec, "sets")
    entries = _prefixes(sets, spec).join(open_ids, "u")
    split = entries.groupBy("element").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("element")
    entries = materialize(entries.join(split, "element"), "prefixes")
    # |A & B| is at most what either set has from the shared element on; the similarity needs p / (1 + p) * (|A| + |B|)
    left, right = (entries.select("element", *(F.col(c).alias(c + s) for c in ("u", "c", "size", "pos"))) for s in "12")
    crossed = left.join(right, "element").filter(F.expr(
        f"u1 > u2 and c1 <> c2 and (100 + {spec.percent}) * least(size1 - pos1, size2 - pos2) >= {spec.percent} * (size1 + size2)")) \
        .select(F.col("u1").alias("u"), F.col("u2").alias("v")).distinct()
    tried = first.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    more = materialize(_with_sketch_match(crossed.join(tried, ["u", "v"], "left_anti"), reps, spec).select("u", "v"), "more")
    again = materialize(_confirmed(more, sets, spec), "links")
    final = so_far
    if not again.isEmpty():
        final = connected_components(again.unionByName(
            so_far.filter("vertex <> component").select(F.col("vertex").alias("u"), F.col("component").alias("v"))))
    member = (classes.join(final.select(F.col("vertex").alias("rep"), "component"), "rep", "left")
              .select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id")))
    out = sig.select("doc_id", "n_shingles", "set_a", "set_b").join(member, ["set_a", "set_b"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"),
                      F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, spec: NearDupSpec = NearDupSpec()) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id; all columns stay.

    A filter of fixed size lets the texts of documents that surely stay pass by; only the others meet the list
    of ids in a join, so a text is shuffled only where it may go.
    """
    gone = materialize(near_duplicates(docs, spec).filter("not kept").select("doc_id").distinct(), "gone")
    ids = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    bits, at = sketch.id_filter(gone), docs.columns.index("doc_id")
    unsure = sketch.rows_maybe_in(ids, at, bits).join(gone, "doc_id", "left_anti").select(*docs.columns)
    sure = sketch.rows_maybe_in(ids, at, bits, wanted=False)
    return sure.unionByName(unsure).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
