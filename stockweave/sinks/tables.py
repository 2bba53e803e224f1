"""Writers of the fact, KPI tables and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACT_PARTITIONS = ["TIPO_TRANSACCION", "PAIS"]


def write_fact(df: DataFrame, folder: str) -> None:
    """The clean fact as Parquet by type and country.

    The rebalance hint gives files of advisory size: small partitions are merged and a
    country that holds a third of the rows is split over tasks.
    """
    df.hint("rebalance", *FACT_PARTITIONS).write.mode("overwrite").partitionBy(*FACT_PARTITIONS).parquet(folder)


def _write(df: DataFrame, path: str, fmt: str, by: list[str]) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv", by_country: bool = False) -> None:
    """One folder per table; ``by_country`` adds a level per country."""
    for name, df in tables.items():
        _write(df, f"{folder}/{name}", fmt, ["PAIS"] if by_country and "PAIS" in df.columns else [])


def write_report(sheets: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """A report folder with one table per sheet."""
    write_tables(sheets, folder, fmt)


def read_result(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A result table; an absent or unreadable one is empty."""
    empty = spark.createDataFrame([], schema)
    try:
        found = spark.read.schema(schema).format(fmt).option("ignoreCorruptFiles", True).option("header", True).load(path)
        found.take(1)
    except Exception:  # noqa: BLE001  any failure to read counts as no results yet
        return empty
    return found.select(*[F.col(c) for c in empty.columns])
