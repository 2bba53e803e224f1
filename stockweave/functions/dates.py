"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_from_key(c: Column) -> Column:
    """``YYYYMMDD`` number to date; null when it is no calendar day."""
    key = c.try_cast("bigint").cast("string")
    dashed = F.concat(F.substring(key, 1, 4), F.lit("-"), F.substring(key, 5, 2), F.lit("-"), F.substring(key, 7, 12))
    return dashed.try_cast("date")


def date_key(c: Column) -> Column:
    """Date to its ``YYYYMMDD`` number."""
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("bigint")


def week_start(c: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", c).cast("date")


def week_ending_monday(c: Column) -> Column:
    """Last day of a week that runs Tuesday to Monday."""
    return F.next_day(F.date_sub(c, 1), "MON")


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def month_days(c: Column) -> Column:
    """Days in the month of a ``yyyy-MM`` text."""
    return F.dayofmonth(F.last_day(F.to_date(F.concat(c, F.lit("-01")))))


def calendar_columns(df: DataFrame, day: str = "FECHA") -> DataFrame:
    """ANIO, MES, MES_NOMBRE and YEAR_MONTH of a date column."""
    d = F.col(day)
    return df.withColumns({
        "ANIO": F.year(d),
        "MES": F.month(d),
        "MES_NOMBRE": F.date_format(d, "MMMM"),
        "YEAR_MONTH": year_month(d),
    })
