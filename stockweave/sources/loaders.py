"""Movements, catalogues and the clean fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.columns import with_missing
from ..schemas import (
    DEVICE_COLUMNS, DEVICE_HINTS, DEVICE_SCHEMA, MOVEMENT_COLUMNS, WAREHOUSE_COLUMNS, WAREHOUSE_HINTS, WAREHOUSE_SCHEMA,
)
from .files import BEYOND, find_files, read_files


def load_movements(spark: SparkSession, folder: str) -> DataFrame:
    """Raw movements of every file under a folder; lines that do not fit their header are left out."""
    df = read_files(spark, find_files(spark, folder))
    if df is None:
        raise FileNotFoundError(f"no movement files under {folder}")
    return with_missing(_accepted(df), MOVEMENT_COLUMNS)


def rejected_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines left out by ``load_movements``: fields as read, the first surplus one, source."""
    df = read_files(spark, find_files(spark, folder))
    if df is None or BEYOND not in df.columns:
        return spark.createDataFrame([], f"SOURCE_FILE string, {BEYOND} string")
    return df.filter(F.col(BEYOND).isNotNull())


def load_devices(spark: SparkSession, folder: str) -> DataFrame:
    return _catalogue(spark, folder, DEVICE_HINTS, DEVICE_COLUMNS, DEVICE_SCHEMA)


def load_warehouses(spark: SparkSession, folder: str) -> DataFrame:
    return _catalogue(spark, folder, WAREHOUSE_HINTS, WAREHOUSE_COLUMNS, WAREHOUSE_SCHEMA)


def _accepted(df: DataFrame) -> DataFrame:
    if BEYOND not in df.columns:
        return df
    return df.filter(F.col(BEYOND).isNull()).drop(BEYOND)


def _catalogue(spark: SparkSession, folder: str, hints, columns, schema) -> DataFrame:
    df = read_files(spark, find_files(spark, folder, hints))
    if df is None:
        return spark.createDataFrame([], schema)
    return with_missing(_accepted(df), columns)


def load_fact(spark: SparkSession, folder: str, kind: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The clean fact; type and columns reach the scan as partition filter and read schema."""
    df = spark.read.parquet(folder)
    if kind is not None:
        df = df.filter(F.col("TIPO_TRANSACCION") == kind)
    return df.select(*columns) if columns else df
