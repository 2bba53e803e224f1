"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$"


def to_number(c: Column) -> Column:
    """Double, or null when the text is not a number. A type suffix, as in ``5d``, is not part of one."""
    text = F.trim(c.cast("string"))
    return F.nanvl(F.when(text.rlike(NUMBER), text.try_cast("double")), F.lit(None).cast("double"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio that is null for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def growth(c: Column, over: WindowSpec) -> Column:
    """Relative change against the previous row of the window."""
    return safe_ratio(c, F.lag(c, 1).over(over)) - F.lit(1.0)


def units_of_money(c: Column) -> Column:
    """Sum of amounts in exact decimal arithmetic: independent of row and task order."""
    return F.sum(c.cast("decimal(20,4)")).cast("double")


def rounded_even(c: Column, digits: int = 0) -> Column:
    """Half-even rounding on the scaled double."""
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def clip(c: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Bound a value; null bounds do not bound."""
    out = c
    if low is not None:
        out = F.greatest(out, low)
    if high is not None:
        out = F.least(out, high)
    return F.when(c.isNotNull(), out)


def exact_mean(c: Column) -> Column:
    """Mean whose sum is exact to six decimals, so it does not depend on row order."""
    return F.try_divide(F.sum(c.cast("decimal(20,6)")).cast("double"), F.count(c).cast("double"))
