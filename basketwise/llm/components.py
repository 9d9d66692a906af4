"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.llm.tables import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands its smaller neighbours and itself to the smallest of them (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(vertex, component)`` for each vertex that has an edge; component is its smallest vertex.

    ``edges`` has columns ``u`` and ``v`` (long) in any direction; loops, nulls and repeats are ignored, an
    empty table gives an empty result. Each round is two grouped minima and two joins, is written to the
    shared folder (so a lost executor costs one round) and halves what is left to move; rounds end when
    the edge set no longer changes.
    """
    now = materialize(
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    state = _state(now)
    while state[0]:
        now = materialize(_small_star(materialize(_large_star(now), "star")), "star")
        new = _state(now)
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
