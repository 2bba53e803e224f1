"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FILE_COUNTRIES, NULL_SPELLINGS, TIER_ORDER, TYPE_LABELS


def normal_text(c: Column) -> Column:
    """Collapse whitespace, strip and upper-case. Printable ASCII without blanks has nothing to replace."""
    text = c.cast("string")
    collapsed = F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    return F.upper(F.when(text.rlike(r"\A[!-~]*+\z"), text).otherwise(collapsed))


def present(c: Column) -> Column:
    """Null for a spelling of a missing value."""
    return F.when(~c.isin(NULL_SPELLINGS), c)


def clean_text(c: Column) -> Column:
    """Normal text, or null for a spelling of a missing value."""
    return present(normal_text(c))


def country_from_file(file_name: Column) -> Column:
    """Country named by the first known token of a file name, else null."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    tokens = F.split(F.upper(stem), r"[_\-\s]+")
    known = F.create_map(*[F.lit(x) for pair in FILE_COUNTRIES.items() for x in pair])
    named = F.filter(F.transform(tokens, lambda t: F.try_element_at(known, t)), lambda v: v.isNotNull())
    return F.get(named, F.lit(0))


def type_label(c: Column) -> Column:
    """Label of a movement type; null for an unknown type."""
    labels = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    return F.try_element_at(labels, c)


def tier_rank(c: Column) -> Column:
    """1-based position in the tier order, 0 when the tier is not listed."""
    return F.array_position(F.array(*[F.lit(t) for t in TIER_ORDER]), c)


def contains_term(cols: list[Column], term: str) -> Column:
    """Case-insensitive substring search over several columns."""
    needle = term.strip().lower()
    found = F.lit(False)
    for c in cols:
        found = found | F.coalesce(F.lower(c.cast("string")).contains(needle), F.lit(False))
    return found
