"""Picking rows for people: list texts, first lines, search, scenarios, capped queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.functions.coerce import as_long
from basketwise.functions.ranking import top_per_group

# Label distance and flag count that make a row worth showing.
LARGE_DELTA = 2
MANY_FLAGS = 5


def item_list_text(lines: DataFrame, order: Sequence[str], entity: str = "entity_id", name: str = "item_name",
                   quantity: str = "quantity") -> DataFrame:
    """``(entity, text)`` with one ``"{qty} {name}"`` per line, in order; one row per entity.

    Lines without a name or with a quantity below one are left out.
    """
    listed = lines.filter(F.col(name).isNotNull() & (F.col(name) != "") & (F.col(quantity) > 0)).select(
        entity, F.struct(*order, F.concat_ws(" ", F.col(quantity).cast("string"), name).alias("text")).alias("__line"),
    )
    return listed.groupBy(entity).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("__line")), lambda x: x["text"]), "\n").alias("text")
    )


def first_lines(lines: DataFrame, order: Sequence[str], n: int = 18, entity: str = "entity_id") -> DataFrame:
    """First ``n`` lines per entity in file order. ``row_number <= n`` trims before the shuffle."""
    return top_per_group(lines, [entity], [F.col(c) for c in order], n, out="line_rank")


def search(df: DataFrame, columns: Sequence[str], needle: str) -> DataFrame:
    """Case-insensitive substring search over several columns."""
    hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return df.filter(F.contains(hay, F.lit(needle.strip().lower())))


def scenario_pick(df: DataFrame, id_col: str = "entity_id", views: str = "views", delta: str = "delta",
                  flags: str = "game_changer_count", n: int = 12) -> DataFrame:
    """A mixed show-case: the most viewed row of each kind, then the most viewed rest, ``n`` in all.

    Kinds: labels agree, reference above, reference below, two apart, many flagged items. A row that
    leads several kinds keeps its first; the five leads come from one aggregate without a sort.
    """
    kinds = {
        "agree": f"{delta} = 0", "above": f"{delta} > 0", "below": f"{delta} < 0",
        "large": f"abs({delta}) = {LARGE_DELTA}", "flagged": f"{flags} >= {MANY_FLAGS}",
    }
    best = [
        F.expr(f"max_by({id_col}, named_struct('v', {views}, 'i', -{id_col})) FILTER (WHERE {cond})").alias(k)
        for k, cond in kinds.items()
    ]
    ordered = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(k).alias("kind"), F.col(k).alias(id_col))
                        for i, k in enumerate(kinds)])
    leads = (
        df.agg(*best).select(F.inline(ordered)).filter(F.col(id_col).isNotNull())
        .groupBy(id_col).agg(F.min("priority").alias("priority"), F.min_by("kind", "priority").alias("kind"))
    )
    return (
        df.join(F.broadcast(leads), id_col, "left")  # at most five rows
        .withColumn("kind", F.coalesce("kind", F.lit("fill")))
        .orderBy(F.coalesce("priority", F.lit(len(kinds))), F.col(views).desc(), id_col)
        .limit(n).drop("priority")
    )


def by_delta(df: DataFrame, sign: Column, views: str = "views", n: int = 12, id_col: str = "entity_id") -> DataFrame:
    """Most viewed rows whose label difference has the wanted sign."""
    return df.filter(sign).orderBy(F.col(views).desc(), id_col).limit(n)


def capped(df: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    """First ``n`` rows of a work queue; all rows without a cap."""
    return df.orderBy(*order).limit(n) if n else df


def listing_candidates(pages: DataFrame, min_views: int) -> DataFrame:
    """Rows of fetched list pages worth fetching in detail: whole-number id and enough views."""
    rows = pages.select("bracket", "page", F.explode("response.results").alias("r"))
    return rows.select("bracket", "page", as_long(F.col("r.id")).alias("entity_id"), F.col("r.viewCount").alias("views")) \
        .filter(F.col("entity_id").isNotNull() & (F.coalesce("views", F.lit(0)) >= min_views))


def pages_below(pages: DataFrame, min_views: int) -> DataFrame:
    """Per list page: is every row below the view threshold (so the listing can stop there)?"""
    return pages.select(
        "bracket", "page",
        F.forall("response.results", lambda r: F.coalesce(r["viewCount"], F.lit(0)) < min_views).alias("all_below"),
    )
