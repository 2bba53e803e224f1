"""Registry: one entry holds a Spark query, its SQL twin and the shared output columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CleaningParams
from . import tables

PARAMS = CleaningParams(date_min=date(1996, 1, 1), date_cut=date(2001, 7, 1))
COUNTRIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


class Tables:
    """The driver's tables in the data model of the plans."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def movements(self) -> DataFrame:
        return tables.movements(self.read)

    @cached_property
    def sales(self) -> DataFrame:
        from ..plans.sales import prepared_sales

        return prepared_sales(self.movements)

    @cached_property
    def stock(self) -> DataFrame:
        from ..plans.sales import prepared_stock

        return prepared_stock(self.movements)

    @cached_property
    def raw(self) -> DataFrame:
        return tables.raw_movements(self.read)

    @cached_property
    def devices(self) -> DataFrame:
        return tables.devices(self.read)

    @cached_property
    def warehouses(self) -> DataFrame:
        return tables.warehouses(self.read)

    @cached_property
    def typed(self) -> DataFrame:
        """Movements keyed by brand/type, the series grain."""
        return tables.series_grain(self.movements)

    @cached_property
    def events(self) -> DataFrame:
        return tables.events(self.read)


@dataclass(frozen=True)
class Entry:
    run: Callable[[Tables], DataFrame]
    sql: str | None
    columns: list[tuple[str, str]]


REGISTRY: dict[str, Entry] = {}

SPARK_TYPES = {"s": "string", "l": "bigint", "t": "date", "b": "boolean"}
SQL_TYPES = {"s": "VARCHAR", "l": "BIGINT", "t": "DATE", "b": "BOOLEAN"}


def _parse(columns: str) -> list[tuple[str, str]]:
    """``"PAIS s, UNIDADES d2"`` -> pairs; quotes allow spaces in names."""
    pairs = []
    for item in columns.split(","):
        name, kind = item.strip().rsplit(" ", 1)
        pairs.append((name.strip().strip('"'), kind))
    return pairs


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind.startswith("d"):
        scale = float(10 ** int(kind[1:]))
        return (F.floor(c.cast("double") * scale + 0.5) / F.lit(scale)).alias(name)
    return c.cast(SPARK_TYPES[kind]).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind.startswith("d"):
        scale = f"CAST(1{'0' * int(kind[1:])} AS DOUBLE)"
        return f'floor(CAST("{name}" AS DOUBLE) * {scale} + 0.5) / {scale} AS "{name}"'
    return f'CAST("{name}" AS {SQL_TYPES[kind]}) AS "{name}"'


def _means(sql: str) -> str:
    """Write ``exact_avg(x)`` out as an exact decimal sum over a count."""
    return re.sub(
        r"exact_avg\((\w+)\)",
        r"(CAST(sum(CAST(\1 AS DECIMAL(20,6))) AS DOUBLE) / nullif(count(\1), 0))", sql)


def query(name: str, columns: str, sql: str | None = None, ctes: str = ""):
    """Register a query. ``columns`` fixes names, types and printed digits on both sides.

    ``sql`` is a SELECT over the shared views of ``tables.BASE_SQL`` plus ``ctes``.
    """
    spec = _parse(columns)

    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        text = None
        if sql is not None:
            views = tables.BASE_SQL + (f",\n{ctes}" if ctes else "")
            shown = ", ".join(_sql_column(n, k) for n, k in spec)
            text = _means(f"WITH {views}\nSELECT {shown} FROM (\n{sql}\n) AS q")
        REGISTRY[name] = Entry(fn, text, spec)
        return fn

    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    entry = REGISTRY[name]
    df = entry.run(Tables(spark, folder))
    return df.select(*[_spark_column(n, k) for n, k in entry.columns])
