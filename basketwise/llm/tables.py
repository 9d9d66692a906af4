"""Small shared steps of the text operators: typed input columns, stored intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketwise.session import materialize

__all__ = ["documents", "id_text", "materialize", "small_batches", "smallest_hashes", "table"]

BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to 1,000 rows and 8 MB, which bounds what a Python worker and its task hold of
    long texts. Smaller settings stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    held = spark.conf.get(size).rstrip("b")
    if not (held.isdigit() and 0 < int(held) <= BATCH_BYTES):
        spark.conf.set(size, str(BATCH_BYTES))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (string), so that other columns cannot clash; texts go to Python in small
    batches."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def smallest_hashes(rows: DataFrame, group: str, hashed: Column, ties: list[str], k: int) -> DataFrame:
    """The ``k`` rows of smallest ``hashed`` (a 64-bit hash) of every value of ``group``, with ``place`` from 1; a
    documented sample for fitting, from a few groups (their counts are broadcast).

    The size of a group says under which hash its first k rows surely lie, so about 8 k rows of a group are ranked
    however many it has. Where repeated rows leave too few of them, the bound is raised until there are enough.
    """
    keyed = rows.withColumn("__hash", hashed)
    counts = materialize(keyed.groupBy(group).agg(F.count(F.lit(1)).alias("__n")), "counts")
    spread = 8 * k
    while True:
        below = F.col("__hash") / F.lit(2.0 ** 64) + 0.5 <= F.lit(float(spread)) / F.col("__n")
        near = materialize(keyed.join(F.broadcast(counts), group).filter(below), "near")
        short = counts.join(near.groupBy(group).agg(F.count(F.lit(1)).alias("__m")), group, "left").filter(
            F.coalesce("__m", F.lit(0)) < F.least("__n", F.lit(k)))
        if short.isEmpty():
            break
        spread *= 8
    order = Window.partitionBy(group).orderBy("__hash", *ties)
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("__hash", "__n")
