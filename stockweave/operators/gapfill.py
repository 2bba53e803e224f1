"""Daily gap fill of stock snapshots without a calendar join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar_columns
from ..functions.dates import date_key
from .columns import stack_frames

STOCK_KEYS = ["PAIS", "CODIGO_SKU", "CODIGO_BODEGA"]
REFERENCE = ["COSTO", "PRECIO_UNITARIO", "SOURCE_FILE", "SOURCE_COUNTRY"]


def stock_runs(inventory: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per snapshot day: units hold from DESDE to HASTA inclusive.

    The first run of a key carries PRIMERA = true; MIN_FECHA is the first day of the whole
    table, from which the key counts as empty until DESDE. Daily pre-aggregation bounds a
    key to one row per day before the window, whatever its share of the raw rows.
    """
    keys = keys or STOCK_KEYS
    reference = [c for c in REFERENCE if c in inventory.columns]
    daily = inventory.groupBy(*keys, "FECHA").agg(
        F.sum("VALUE").alias("VALUE"),
        *([F.min(F.struct(*reference)).alias("_ref")] if reference else []),
    )
    span = inventory.agg(F.min("FECHA").alias("lo"), F.max("FECHA").alias("hi"))
    first_day = span.select("lo").scalar()
    last_day = span.select("hi").scalar()
    by_day = Window.partitionBy(*keys).orderBy("FECHA")
    runs = daily.select(
        *keys,
        F.col("FECHA").alias("DESDE"),
        F.coalesce(F.date_sub(F.lead("FECHA").over(by_day), 1), last_day).alias("HASTA"),
        first_day.alias("MIN_FECHA"),
        (F.row_number().over(by_day) == 1).alias("PRIMERA"),
        "VALUE",
        *([F.first("_ref").over(by_day).alias("_ref")] if reference else []),
    )
    return runs.select(
        *[c for c in runs.columns if c != "_ref"],
        *[F.col("_ref")[c].alias(c) for c in reference],
    )


def filled_days(inventory: DataFrame, keys: list[str] | None = None, as_int: bool = True) -> DataFrame:
    """Every key on every day of the table's date range: last known units, 0 before the first."""
    keys = keys or STOCK_KEYS
    runs = stock_runs(inventory, keys)
    units = F.col("VALUE").cast("bigint").cast("double") if as_int else F.col("VALUE")
    start = F.when(F.col("PRIMERA"), F.col("MIN_FECHA")).otherwise(F.col("DESDE"))
    extra = [c for c in REFERENCE if c in runs.columns]
    days = runs.select(
        *keys, *extra, "DESDE", units.alias("_units"),
        F.explode(F.sequence(start, F.col("HASTA"))).alias("FECHA"),
    )
    value = F.when(F.col("FECHA") < F.col("DESDE"), F.lit(0.0)).otherwise(F.col("_units"))
    return days.select(*keys, "FECHA", value.alias("VALUE"), *extra)


def with_filled_inventory(df: DataFrame) -> DataFrame:
    """Replace the stock rows of a movement table by their gap-filled series.

    Cost, price and source come from the earliest row of the key; columns the series does
    not know are null.
    """
    is_stock = F.col("TIPO_TRANSACCION") == "INVENTORY"
    filled = calendar_columns(filled_days(df.filter(is_stock))).withColumns({
        "TIPO_TRANSACCION": F.lit("INVENTORY"),
        "FECHA_VENTA_INVENTARIO": date_key(F.col("FECHA")).cast("double"),
        "ANOMES": (F.year("FECHA") * 100 + F.month("FECHA")).cast("double"),
    })
    kept = [c for c in filled.columns if c in df.columns]
    return stack_frames([df.filter(~is_stock), filled.select(*kept)])


def filled_prices(df: DataFrame) -> DataFrame:
    """(TIPO_TRANSACCION, PRECIO_UNITARIO, VECES) of the gap-filled table, without its days.

    A stock key has the price of its earliest row on each of the VECES days of the range.
    """
    is_stock = F.col("TIPO_TRANSACCION") == "INVENTORY"
    inventory = df.filter(is_stock)
    reference = [c for c in REFERENCE if c in df.columns]
    span = inventory.agg((F.datediff(F.max("FECHA"), F.min("FECHA")) + 1).cast("bigint")).scalar()
    first = inventory.groupBy(*STOCK_KEYS).agg(F.min(F.struct("FECHA", *reference)).alias("_ref"))
    held = first.select(F.lit("INVENTORY").alias("TIPO_TRANSACCION"), F.col("_ref.PRECIO_UNITARIO"), span.alias("VECES"))
    moved = df.filter(~is_stock).select("TIPO_TRANSACCION", "PRECIO_UNITARIO", F.lit(1).cast("bigint").alias("VECES"))
    return moved.unionByName(held)


def stockout_from_runs(inventory: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Days and empty days per key of the gap-filled series, without building its rows."""
    keys = keys or STOCK_KEYS
    runs = stock_runs(inventory, keys)
    length = F.datediff("HASTA", "DESDE") + 1
    lead = F.when(F.col("PRIMERA"), F.datediff("DESDE", "MIN_FECHA")).otherwise(0)
    empty = F.when(F.col("VALUE").cast("bigint") == 0, length).otherwise(0) + lead
    out = runs.groupBy(*keys).agg(
        F.sum(length + lead).alias("DIAS_TOTALES"), F.sum(empty).alias("DIAS_STOCKOUT"),
    )
    return out.withColumn("STOCKOUT_RATE", F.try_divide("DIAS_STOCKOUT", "DIAS_TOTALES"))
