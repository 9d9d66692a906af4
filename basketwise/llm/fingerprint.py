"""Document fingerprints: a Merkle tree over paragraphs and sections, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketwise.llm.ordered import add_slices

# a leaf ends after a line end, or inside a paragraph after a clause, so one long line still has many leaves
LEAF_END = r"(?<=\n)|(?<=[.!?;:,|] )"
# a section ends after a blank line or after a leaf whose digest ends in 0-3: on average every fourth leaf
SECTION_END = "(?<=[0-3]) "
BLANK_LINE = "1:" + "0" * 32


def leaves(text: Column) -> Column:
    """Array of ``<code points>:<128-bit digest>``, one for each leaf; their texts joined are the text."""
    return F.transform(
        F.filter(F.split(text, LEAF_END, -1), lambda x: x != ""),
        lambda x: F.when(x == "\n", F.lit(BLANK_LINE)).otherwise(
            F.concat(F.char_length(x), F.lit(":"), F.substring(F.sha2(x, 256), 1, 32))))


def sections(leaf: Column) -> Column:
    """Digests of the sections of an array of leaves."""
    return F.transform(F.split(F.array_join(leaf, " "), SECTION_END, -1), lambda x: F.sha2(x, 256))


def root(leaf: Column) -> Column:
    """Root digest: equal if and only if (up to hash collisions) the texts are equal."""
    return F.sha2(F.array_join(sections(leaf), " "), 256)


def _weight(leaf: Column) -> Column:
    return F.aggregate(leaf, F.lit(0).cast("bigint"),
                       lambda s, x: s + F.substring_index(x, ":", 1).cast("bigint"))


def likeness(a: Column, b: Column) -> Column:
    """Code points in leaves that both trees have, as a share of both: 2 |A & B| / (|A| + |B|) over distinct
    leaves; 1 for equal trees (two empty ones too), 0 if no leaf is shared."""
    total = _weight(F.array_distinct(a)) + _weight(F.array_distinct(b))
    shared = F.lit(2.0) * _weight(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(shared / F.nullif(total, F.lit(0)), F.lit(0.0)))


def first_change(a: Column, b: Column) -> Column:
    """Code points of ``a`` before the first leaf in which the trees differ; null for equal trees."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at > 0, _weight(F.slice(a, 1, (at - 1).cast("int"))))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``leaf`` (array), ``section`` (array) and ``fingerprint`` (root); a null text counts as empty."""
    return (docs.withColumn("leaf", leaves(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
            .withColumn("section", sections(F.col("leaf"))).withColumn("fingerprint", root(F.col("leaf"))))


def with_next(docs: DataFrame, rows_per_slice: int = 1000) -> DataFrame:
    """``doc_id, text, slice, guest``: documents in slices of the doc_id order, each slice closed by a guest row.

    The guest is a copy of the first document of the next slice (after the last: of the first), so that a window
    within a slice sees every next document and the texts are shuffled once. Null texts are empty. Rows
    without doc_id have no next document; they are spread by a hash of their text.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = add_slices(base, "doc_id", rows_per_slice, "slice")
    spread = -1 - F.pmod(F.xxhash64("text"), F.lit(1009)).cast("int")
    rows = cut.withColumn("slice", F.when(F.col("doc_id").isNull(), spread).otherwise(F.col("slice")))
    # one row per slice, a bounded number: a single window and a broadcast are safe
    first = cut.filter("doc_id is not null").groupBy("slice").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("slice")
    after = first.select("slice", F.coalesce(
        F.lead("first").over(order),
        F.min("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("doc_id"))
    guests = base.join(F.broadcast(after), "doc_id").select("doc_id", "text", "slice", F.lit(True).alias("guest"))
    return rows.select("doc_id", "text", "slice", F.lit(False).alias("guest")).unionByName(guests)


def compare_with_edit(docs: DataFrame, rows_per_slice: int = 1000) -> DataFrame:
    """Fingerprint every text, its edited text, and the likeness to the edited and to the next text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document by doc_id (after the last: the first). Rows that share a doc_id are ordered by text. Rows without
    doc_id have no next document: their edit drops the tail and ``near_next`` is null. Other columns
    are ignored; an empty table gives no rows. ``edited_from`` is the code point at which the first
    differing leaf begins, null if the edit changed nothing.
    """
    order = Window.partitionBy("slice").orderBy("guest", "doc_id", "text")
    known = F.col("doc_id").isNotNull()
    # texts meet in the first window; leaves are made behind its shuffle and reuse its order in the second
    rows = with_next(docs, rows_per_slice).withColumn("next_text", F.when(known, F.lead("text").over(order)))
    rows = rows.withColumn("leaf", leaves(F.col("text"))).withColumn(
        "next_leaf", F.when(known, F.lead("leaf").over(order))).filter("not guest")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half),
                      F.coalesce(F.col("next_text"), F.lit("")).substr(F.lit(1), half))
    return (rows.withColumn("edited", edited).withColumn("edited_leaf", leaves(F.col("edited")))
            .select("doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                    root(F.col("leaf")).alias("fingerprint"), root(F.col("edited_leaf")).alias("edited_fingerprint"),
                    likeness(F.col("leaf"), F.col("edited_leaf")).alias("near_edited"),
                    F.when(known, likeness(F.col("leaf"), F.col("next_leaf"))).alias("near_next"),
                    first_change(F.col("leaf"), F.col("edited_leaf")).alias("edited_from")))
