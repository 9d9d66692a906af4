"""Text normalisation, list text and field extraction from rendered pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of a rendered score page and the pattern that finds each.
SCORE_PAGE_PATTERNS = {
    "commander_bracket": r"Commander Bracket[^0-9]{0,12}([1-5])",
    "power_level": r"Power Level\s*([0-9]+(?:\.[0-9]+)?\+?)\s*/\s*10",
    "tipping_point": r"Tipping Point\s*([0-9]+)",
    "efficiency": r"Efficiency\s*([0-9]+(?:\.[0-9]+)?)\s*/\s*10",
    "impact": r"Impact\s*([0-9]+(?:\.[0-9]+)?)",
    "score": r"Score\s*([0-9]+)\s*/\s*1000",
    "average_playability": r"Average Playability\s*([0-9]+(?:\.[0-9]+)?)%",
}
# The warning block that lists unresolved names, and one line of it.
UNRESOLVED_BLOCK = (
    r"(?i)ERROR:\s*Not all card data was loaded.*?check your formatting[^\n]*\n+([\s\S]*?)(?:Analyze List|Reset All|\z)"
)
UNRESOLVED_LINE = r"(?m)^\s*\d+\s+(.+?)\s*$"
# The reading a score page shows before it has computed anything.
DEFAULT_STATE = {
    "commander_bracket": "4",
    "power_level": "5.55",
    "score": "447",
    "impact": "516.00",
    "efficiency": "4.82",
    "average_playability": "51.8",
}
# Item texts that lift the one-copy rule.
MULTIPLE_COPIES_TEXTS = (
    r"a deck can have any number of cards named",
    r"a deck can have up to [a-z0-9 -]+ cards named",
)


def normalize(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def matches_any(c: Column, patterns=MULTIPLE_COPIES_TEXTS) -> Column:
    return F.coalesce(F.rlike(c, F.lit("(?i)(?:" + "|".join(patterns) + ")")), F.lit(False))


def extract_fields(c: Column, patterns: dict[str, str]) -> list[Column]:
    """First capture group of each pattern, NULL without a match."""
    return [
        F.when(F.rlike(c, F.lit(p)), F.regexp_extract(c, p, 1)).alias(name)
        for name, p in patterns.items()
    ]


def extract_list(c: Column, block: str, line: str) -> Column:
    """All ``line`` captures inside the first ``block`` capture."""
    inner = F.regexp_extract(c, block, 1)
    return F.transform(F.regexp_extract_all(inner, F.lit(line), F.lit(1)), F.trim)


def is_default_state(fields: dict[str, Column], fingerprint: dict[str, str] = DEFAULT_STATE) -> Column:
    """True when every field equals the known fingerprint, compared as text."""
    hit = F.lit(True)
    for name, value in fingerprint.items():
        hit = hit & fields[name].cast("string").eqNullSafe(F.lit(value))
    return hit


def signature(names: Column, sep: str = " // ") -> Column:
    """Sorted distinct names as one key."""
    return F.array_join(F.array_sort(F.array_distinct(names)), sep)


def id_signature(ids: Column, sep: str = "|", default: str = "__unknown__") -> Column:
    """Sorted ids (copies kept) as one key, with a default for none."""
    return F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, F.array_join(F.array_sort(ids), sep)) \
        .otherwise(F.lit(default))
