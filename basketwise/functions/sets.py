"""Small array and colour-set helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour names and symbols of the input format, and their canonical order.
COLOR_SYMBOLS = {
    "White": "W", "Blue": "U", "Black": "B", "Red": "R", "Green": "G",
    "W": "W", "U": "U", "B": "B", "R": "R", "G": "G",
}
COLOR_ORDER = ("W", "U", "B", "R", "G")


def color_symbols(c: Column) -> Column:
    """Distinct known symbols of a colour array; unknown names are dropped."""
    lookup = F.create_map(*[F.lit(v) for pair in COLOR_SYMBOLS.items() for v in pair])
    mapped = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.try_element_at(lookup, x))
    return F.array_distinct(F.filter(mapped, lambda x: x.isNotNull()))


def color_mask(symbols: Column) -> Column:
    """Bit set of symbols, so that unions are ``bit_or`` and subset tests are ``&``."""
    bits = [
        F.when(F.array_contains(symbols, s), F.lit(1 << i)).otherwise(F.lit(0))
        for i, s in enumerate(COLOR_ORDER)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def color_bits(c: Column) -> Column:
    """``color_mask(color_symbols(c))`` without a list of symbols in between."""
    bits = [
        F.when(reduce(lambda a, b: a | b, [F.array_contains(c, name) for name, symbol in COLOR_SYMBOLS.items() if symbol == s]),
               F.lit(1 << i)).otherwise(F.lit(0))
        for i, s in enumerate(COLOR_ORDER)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def mask_key(mask: Column, empty: str = "C") -> Column:
    """Canonical text of a colour bit set, e.g. ``WU``; ``C`` for none, ``unknown`` for NULL."""
    text = F.concat(*[
        F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(s)).otherwise(F.lit(""))
        for i, s in enumerate(COLOR_ORDER)
    ])
    return F.when(mask.isNull(), F.lit("unknown")).when(text == "", F.lit(empty)).otherwise(text)


def has(array: Column, value: str) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def length(array: Column) -> Column:
    """Array length with NULL as 0."""
    return F.coalesce(F.greatest(F.size(array), F.lit(0)), F.lit(0)).cast("bigint")
