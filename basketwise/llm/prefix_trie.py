"""Prefix trie of conversations: nodes by prefix digest, subtree totals rolled up band by band of depths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketwise.llm.ordered import add_slices
from basketwise.llm.tables import materialize, small_batches

HEAD = -1


@dataclass(frozen=True)
class TrieSpec:
    """``height``: depths per band, which is how far a node is exploded to ancestors. ``family``: the first turns of
    conversation c come from c - c % family, crc32(c) % ``heads`` of them. ``ids_per_chunk``: conversation ids that
    are joined to one string before the strings of a node are hashed in order."""

    height: int = 8
    family: int = 100
    heads: int = 6
    ids_per_chunk: int = 10_000


def _before(df: DataFrame, value: dict[str, Column]) -> DataFrame:
    """Per (conv_id, part): every aggregate in ``value`` over the parts before this one, given one row per part."""
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return df.select("conv_id", "part", *(F.coalesce(c.over(earlier), F.lit(0)).alias(n) for n, c in value.items()))


def _turns(talk: DataFrame) -> DataFrame:
    """``conv_id, part, nth, role, digest, size`` of every turn, numbered from 1 in its conversation; stored.

    Texts stay where they are: only their SHA-256 and length in code points go on. Rows are range-partitioned in
    their order, so a conversation of any length is numbered by several tasks.
    """
    rows = talk.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id is not null")
    rows = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"),
                       F.char_length("text").cast("bigint").alias("size"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ranged = materialize(
        rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    here = ranged.withColumn("own", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    start = _before(ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("rows")), {"start": F.sum("rows")})
    return materialize(here.join(start, ["conv_id", "part"]).select(
        "conv_id", "part", (F.col("start") + F.col("own")).alias("nth"), "role", "digest", "size"), "numbered")


def _rebuilt(turns: DataFrame, spec: TrieSpec) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id, length``) and their rebuilt turns ``conv_id, part, depth, role, digest, size``."""
    count = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows"))
    base = count.select(F.col("conv_id").alias("base"), F.col("rows").alias("base_rows"))
    talks = count.select(
        "conv_id", "rows", (F.col("conv_id") - F.col("conv_id") % spec.family).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % spec.heads).alias("h")).join(base, "base", "left")
    talks = materialize(talks.select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_rows", F.lit(0))).alias("taken"),
        F.greatest(F.col("rows") - F.col("h"), F.lit(0)).alias("kept")), "talks")
    own = turns.join(talks, "conv_id").filter("nth > h").select(
        "conv_id", "part", (F.col("taken") + F.col("nth") - F.col("h")).alias("depth"), "role", "digest", "size")
    # a base hands fewer than `heads` turns to fewer than 2 * `family` conversations
    head = turns.filter(F.col("nth") < spec.heads).withColumnRenamed("conv_id", "base").drop("part").join(talks, "base") \
        .filter("nth <= taken").select(
            "conv_id", F.lit(HEAD).alias("part"), F.col("nth").alias("depth"), "role", "digest", "size")
    return talks.select("conv_id", (F.col("taken") + F.col("kept")).alias("length")), own.unionByName(head)


def _paths(talks: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``conv_id, depth, a, b, size, up_a, up_b``: the digest (a, b) of every prefix and of the prefix one turn shorter;
    stored.

    A turn's digest covers its depth, role and text; that of a prefix is the exclusive or of its turns, which the
    parts of a long conversation form side by side. 120 bits of SHA-256 name a node.
    """
    told = F.sha2(F.concat_ws(":", "depth", F.length("role"), "role", "digest"), 256)
    half = lambda at: F.conv(F.substring("told", at, 15), 16, 10).cast("bigint")
    turns = rebuilt.withColumn("told", told).select("conv_id", "part", "depth", "size", half(1).alias("fa"), half(16).alias("fb"))
    start = _before(turns.groupBy("conv_id", "part").agg(F.bit_xor("fa").alias("ga"), F.bit_xor("fb").alias("gb")),
                    {"sa": F.bit_xor("ga"), "sb": F.bit_xor("gb")})
    upto = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    known = turns.withColumns({"wa": F.bit_xor("fa").over(upto), "wb": F.bit_xor("fb").over(upto)}).join(
        start, ["conv_id", "part"])
    xor = lambda *names: F.expr(" ^ ".join(names))
    known = known.select("conv_id", "depth", xor("sa", "wa").alias("a"), xor("sb", "wb").alias("b"), "size",
                         xor("sa", "wa", "fa").alias("up_a"), xor("sb", "wb", "fb").alias("up_b"))
    none = F.lit(0).cast("bigint")
    root = talks.select("conv_id", none.alias("depth"), none.alias("a"), none.alias("b"), none.alias("size"),
                        F.lit(None).cast("bigint").alias("up_a"), F.lit(None).cast("bigint").alias("up_b"))
    return materialize(known.unionByName(root), "paths")


def _ancestors(paths: DataFrame, nodes: DataFrame, height: int, step: int) -> DataFrame:
    """``a, b, root, above_a, above_b``: nodes whose depth is a multiple of ``step``, each with its proper ancestors of
    that kind in the band of its parent, at most ``height``; ``root`` marks nodes that begin a band.

    The path of a node's smallest member is its path, and that member is the smallest of all deeper nodes on it too.
    Bands of one conversation are groups of at most height + 1 rows.
    """
    first = nodes.select("conv_id", "depth", F.lit(True).alias("first"))
    unit = paths.filter(F.col("depth") % step == 0).join(first, ["conv_id", "depth"], "left").select(
        "conv_id", F.expr(f"depth div {step}").alias("u"), "a", "b", F.coalesce("first", F.lit(False)).alias("first"))
    own = F.expr(f"u div {height}")
    begins = (F.col("u") % height == 0) & (F.col("u") > 0)
    banded = unit.withColumn("band", F.explode(F.when(begins, F.array(own - 1, own)).otherwise(F.array(own))))
    line = banded.groupBy("conv_id", "band").agg(
        F.sort_array(F.collect_list(F.struct("u", "a", "b", "first"))).alias("line"), F.max("first").alias("any")).filter("any")
    low = line.select(F.posexplode("line").alias("at", "x"), "line").filter("at > 0 and x.first")
    return low.select("x.a", "x.b", (F.col("x.u") % height == 0).alias("root"),
                      F.explode(F.slice("line", 1, F.col("at"))).alias("y")).select(
        "a", "b", "root", F.col("y.a").alias("above_a"), F.col("y.b").alias("above_b"))


def subtree_sums(values: DataFrame, paths: DataFrame, nodes: DataFrame, names: list[str], height: int,
                 step: int = 1) -> DataFrame:
    """``a, b, depth, *names``: sums of ``names`` over the subtree of each node of ``values``.

    Nodes are exploded to their ancestors in their own band of ``height`` depths only. What begins a band then has the
    total of its band; these band roots form a trie ``height`` times lower, whose totals come from the same step again;
    the completed totals go to the ancestors in the band above. A trie of depth D takes log(D) / log(height) rounds.
    """
    above = materialize(_ancestors(paths, nodes, height, step), "above")

    def lifted(totals: DataFrame, root: bool) -> DataFrame:
        return above.filter(F.col("root") == root).join(totals.drop("depth"), ["a", "b"]).select(
            F.col("above_a").alias("a"), F.col("above_b").alias("b"), F.lit(None).cast("bigint").alias("depth"), *names)

    def added(parts: DataFrame) -> DataFrame:
        return materialize(parts.groupBy("a", "b").agg(
            F.max("depth").alias("depth"), *(F.sum(n).alias(n) for n in names)), "totals")

    inside = added(values.unionByName(lifted(values, False)))
    if above.filter("root").isEmpty():
        return inside
    roots = inside.filter(F.col("depth") % (step * height) == 0)
    totals = subtree_sums(roots, paths, nodes, names, height, step * height)
    return added(inside.unionByName(lifted(totals, True)))


def _ends(paths: DataFrame, talks: DataFrame, spec: TrieSpec) -> DataFrame:
    """``a, b, ends_sha256`` of the nodes at which conversations end.

    Ids are cut into slices of the id order; a slice of a node becomes one string in parallel, then the strings of a
    node stream through one hash, which keeps a state of fixed size.
    """
    last = paths.join(talks.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("a", "b", "conv_id")
    sliced = add_slices(materialize(last, "ends"), "conv_id", spec.ids_per_chunk, "slice")
    chunks = sliced.groupBy("a", "b", "slice").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if now == (a, b):
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield _rows(out)
        yield _rows([] if now is None else [(*now, state.hexdigest())])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))],
                                          names=["a", "b", "ends_sha256"])

    return chunks.repartition("a", "b").sortWithinPartitions("a", "b", "slice").mapInArrow(
        run, "a long, b long, ends_sha256 string")


def trie(talk: DataFrame, spec: TrieSpec = TrieSpec()) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    ``talk`` has ``conv_id, turn, role, text``. A conversation's turns are ordered by turn (null first; equal turns by
    role, then by the SHA-256 of the text); null role or text is empty. Conversation c is rebuilt as the first h turns
    of conversation c - c % family (all if it has fewer, none if it has no rows), then its own turns after the first
    h, h = crc32(c) % heads. A node is a distinct sequence of first turns, the root has none; members are the rebuilt
    conversations that begin with it, also those without any turn. ``conv_id`` is the smallest member; ``n_leaves``
    counts nodes without child in the subtree; ``saved_tokens`` sums (n_convs - 1) times the code points of the last
    text over the subtree; ``ends_sha256`` covers the ids of members that end here. Rows without conv_id are ignored,
    repeated rows are further turns, other columns are ignored, an empty table gives no rows.

    Every shuffled row has a fixed size, and every group but a node's end ids, see :func:`_ends`, is a partial
    aggregate, a band or a slice, so neither a long conversation nor one that a third of all repeat meets in one task.
    """
    small_batches(talk.sparkSession)
    turns = _turns(talk)
    talks, rebuilt = _rebuilt(turns, spec)
    talks = materialize(talks, "lengths")
    paths = _paths(talks, rebuilt)
    nodes = materialize(paths.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.min("size").alias("size"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b")), "nodes")
    below = nodes.filter("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(below, ["a", "b"], "left").fillna(0, ["n_children"]), "nodes")
    values = nodes.select("a", "b", "depth", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    totals = subtree_sums(values, paths, nodes, ["n_leaves", "saved_tokens"], spec.height).drop("depth")
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(totals, ["a", "b"]).join(_ends(paths, talks, spec), ["a", "b"], "left")
            .join(parents, ["up_a", "up_b"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
