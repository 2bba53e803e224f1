"""Top rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each group.

    The filter on ``row_number`` lets the optimizer keep ``n`` rows per group and task
    before the shuffle, so a group may be of any size.
    """
    position = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    name = rank or "_rank"
    out = df.withColumn(name, position).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows overall: each task keeps ``n`` rows, the driver plan merges them."""
    return df.orderBy(*order).limit(n)


def latest_slice(df: DataFrame, by: str) -> DataFrame:
    """Rows that hold the greatest value of ``by``."""
    newest = df.agg(F.max(by)).scalar()
    return df.filter(F.col(by) == newest)
