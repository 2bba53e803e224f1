"""Expressions over short history arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_items(a: Column, k: int) -> Column:
    """The last ``k`` items, or all of a shorter array."""
    return F.slice(a, F.greatest(F.size(a) - F.lit(k - 1), F.lit(1)), F.lit(k))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def mean_of(a: Column) -> Column:
    """Mean of the items; null for an empty array."""
    return F.try_divide(_total(a), F.size(a).cast("double"))


def population_std(a: Column) -> Column:
    """Population standard deviation; null for an empty array."""
    mean = mean_of(a)
    spread = F.aggregate(
        a, F.lit(0.0),
        lambda acc, x: acc + (x.cast("double") - mean) * (x.cast("double") - mean),
    )
    return F.sqrt(F.try_divide(spread, F.size(a).cast("double")))


def from_end(a: Column, k: int) -> Column:
    """Item ``k`` places from the end (1 = last), else the first item."""
    return F.coalesce(F.try_element_at(a, F.lit(-k)), F.try_element_at(a, F.lit(1)))
