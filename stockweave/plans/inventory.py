"""Inventory KPIs: snapshots, days on hand, turnover, stockout and fill rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safe_ratio
from ..functions.dates import month_days
from ..operators.ranking import top_per_group


def _day_then_value() -> Column:
    """Orders rows by day, then units, in a type a hash aggregate can hold."""
    day = F.unix_date("FECHA").cast("decimal(12,0)") * F.lit(10**13).cast("decimal(14,0)")
    return (day + F.col("VALUE").cast("decimal(20,4)")).cast("decimal(38,4)")


def snapshot_by_position(stock: DataFrame) -> DataFrame:
    """Month stock as the sum over (warehouse, SKU) of first, last and mean snapshot."""
    order = _day_then_value()
    base = stock.groupBy("PAIS", "CODIGO_BODEGA", "CODIGO_SKU", "YEAR_MONTH").agg(
        F.min_by("VALUE", order).alias("i"),
        F.max_by("VALUE", order).alias("c"),
        F.avg("VALUE").alias("p"),
    )
    month = base.groupBy("PAIS", "YEAR_MONTH").agg(
        F.sum("i").alias("INV_INICIAL"), F.sum("c").alias("INV_CIERRE"), F.sum("p").alias("INV_PROMEDIO"),
    )
    return month.withColumn("DIAS_MES", month_days(F.col("YEAR_MONTH")))


def snapshot_by_day(stock: DataFrame) -> DataFrame:
    """Month stock as first, last and mean of the country's daily totals."""
    daily = stock.groupBy("PAIS", "FECHA", "YEAR_MONTH").agg(F.sum("VALUE").alias("d"))
    month = daily.groupBy("PAIS", "YEAR_MONTH").agg(
        F.min_by("d", "FECHA").alias("INV_INICIAL"),
        F.max_by("d", "FECHA").alias("INV_CIERRE"),
        F.avg("d").alias("INV_PROMEDIO"),
    )
    return month.withColumn("DIAS_MES", month_days(F.col("YEAR_MONTH")))


def monthly_ratios(sales: DataFrame, snapshot: DataFrame, days: int | None = None) -> DataFrame:
    """DOH, turnover and sell-through of months with sales.

    ``days`` fixes the month length (30); by default the calendar month counts.
    """
    sold = sales.groupBy("PAIS", "YEAR_MONTH").agg(F.sum("VALUE").alias("VENTAS_UNIDADES"))
    k = sold.join(snapshot, ["PAIS", "YEAR_MONTH"], "left")
    length = F.lit(float(days)) if days else F.col("DIAS_MES").cast("double")
    sold_units = F.col("VENTAS_UNIDADES")
    closing = F.when(F.col("INV_CIERRE") != 0, F.col("INV_CIERRE"))
    return k.withColumns({
        "DOH": safe_ratio(F.col("INV_PROMEDIO"), sold_units) * length,
        "STOCK_TURNOVER": safe_ratio(sold_units, F.col("INV_PROMEDIO")),
        "SELL_THROUGH": safe_ratio(sold_units, sold_units + closing),
    })


def stockout_rate(stock: DataFrame) -> DataFrame:
    """Days and zero-stock rows per (SKU, warehouse)."""
    so = stock.groupBy("PAIS", "CODIGO_SKU", "CODIGO_BODEGA").agg(
        F.countDistinct("FECHA").alias("DIAS_TOTALES"),
        F.count_if(F.col("VALUE") == 0).alias("DIAS_STOCKOUT"),
    )
    return so.withColumn("STOCKOUT_RATE", safe_ratio(F.col("DIAS_STOCKOUT"), F.col("DIAS_TOTALES")))


def fill_rate_by_sku(sales: DataFrame, stock: DataFrame) -> DataFrame:
    """Days with sales over days with stock, per SKU."""
    held = stock.groupBy("PAIS", "CODIGO_SKU").agg(F.countDistinct("FECHA").alias("DIAS_INVENTARIO"))
    sold = sales.groupBy("PAIS", "CODIGO_SKU").agg(F.countDistinct("FECHA").alias("DIAS_CON_VENTAS"))
    fr = held.join(sold, ["PAIS", "CODIGO_SKU"], "left").withColumn(
        "DIAS_CON_VENTAS", F.coalesce("DIAS_CON_VENTAS", F.lit(0))
    )
    return fr.withColumn("FILL_RATE", safe_ratio(F.col("DIAS_CON_VENTAS"), F.col("DIAS_INVENTARIO")))


def fill_rate_by_month(sales: DataFrame, stock: DataFrame) -> DataFrame:
    """SKUs sold over SKUs held, per month."""
    keys = ["PAIS", "YEAR_MONTH", "CODIGO_SKU"]
    held = stock.groupBy(*keys).agg(F.sum("VALUE").alias("h")).filter("h > 0")
    sold = sales.groupBy(*keys).agg(F.sum("VALUE").alias("v")).filter("v > 0")
    both = held.join(sold, keys, "left")
    # (PAIS, month, SKU) is unique here, so a plain count is the distinct count.
    fr = both.groupBy("PAIS", "YEAR_MONTH").agg(
        F.count("CODIGO_SKU").alias("SKUS_CON_INVENTARIO"),
        F.count_if(F.col("v").isNotNull()).alias("SKUS_CON_VENTA"),
    )
    return fr.withColumn("FILL_RATE", safe_ratio(F.col("SKUS_CON_VENTA"), F.col("SKUS_CON_INVENTARIO")))


def country_inventory(ratios: DataFrame) -> DataFrame:
    """Mean DOH, totals, turnover and sell-through per country, from the monthly ratios."""
    c = ratios.groupBy("PAIS").agg(
        F.avg("DOH").alias("DOH_PROM"),
        F.sum("VENTAS_UNIDADES").alias("VENTAS_TOT"),
        F.sum("INV_PROMEDIO").alias("INV_PROM_TOT"),
        F.sum("INV_CIERRE").alias("INV_CIERRE_TOT"),
    )
    closing = F.when(F.col("INV_CIERRE_TOT") != 0, F.col("INV_CIERRE_TOT"))
    return c.withColumns({
        "TURNOVER_GLOBAL": safe_ratio(F.col("VENTAS_TOT"), F.col("INV_PROM_TOT")),
        "SELL_THROUGH_GLOBAL": safe_ratio(F.col("VENTAS_TOT"), F.col("VENTAS_TOT") + closing),
    })


def country_stockout(rates: DataFrame) -> DataFrame:
    """Mean rate, distinct SKUs with a stockout and (SKU, warehouse) rows with one."""
    hit = F.col("STOCKOUT_RATE") > 0
    return rates.groupBy("PAIS").agg(
        F.avg("STOCKOUT_RATE").alias("STOCKOUT_RATE_PROM"),
        F.countDistinct(F.when(hit, F.col("CODIGO_SKU"))).alias("SKUS_CON_STOCKOUT"),
        F.count_if(hit).alias("FILAS_CON_STOCKOUT"),
    )


def country_fill_rate(rates: DataFrame) -> DataFrame:
    return rates.groupBy("PAIS").agg(F.avg("FILL_RATE").alias("FILL_RATE_PROM"))


def last_month_diagnosis(sales: DataFrame, stock: DataFrame) -> DataFrame:
    """SKUs held in each country's last stock month: units, attributes and whether they sold."""
    last = stock.groupBy("PAIS").agg(F.max("YEAR_MONTH").alias("YEAR_MONTH"))  # a row per country
    keys = ["PAIS", "YEAR_MONTH"]

    def earliest(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("FECHA", c))).alias(c)

    held = stock.join(last, keys, "left_semi").groupBy(*keys, "CODIGO_SKU").agg(
        F.sum("VALUE").alias("INV_TOTAL"), *[earliest(c) for c in ("MODELO", "MARCA", "TIER", "ESTADO")]
    )
    sold = sales.join(last, keys, "left_semi").groupBy(*keys, "CODIGO_SKU").agg(
        F.sum("VALUE").alias("VENTAS_MES")
    )
    out = held.join(sold, [*keys, "CODIGO_SKU"], "left")
    did_sell = F.coalesce(F.col("VENTAS_MES") > 0, F.lit(False))
    return out.withColumns({
        "VENDIO": did_sell,
        "TIPO_SKU": F.when(did_sell, "Con venta").otherwise("Sin venta en el mes"),
    })


def dead_stock(diagnosis: DataFrame, n: int = 15) -> DataFrame:
    """Unsold SKUs with most units, per country."""
    unsold = diagnosis.filter(~F.col("VENDIO"))
    return top_per_group(unsold, ["PAIS"], [F.desc("INV_TOTAL"), F.asc("CODIGO_SKU")], n).select(
        "PAIS", "CODIGO_SKU", "MODELO", "MARCA", "TIER", "ESTADO", "INV_TOTAL"
    )


def diagnosis_totals(diagnosis: DataFrame) -> DataFrame:
    """Held, sold and unsold SKUs per country with shares."""
    t = diagnosis.groupBy("PAIS", "YEAR_MONTH").agg(
        F.count("*").alias("SKUS"),
        F.count_if("VENDIO").alias("CON_VENTA"),
        F.sum("INV_TOTAL").alias("INV"),
        F.sum(F.when(~F.col("VENDIO"), F.col("INV_TOTAL")).otherwise(0.0)).alias("INV_SIN_VENTA"),
    )
    return t.withColumns({
        "SIN_VENTA": F.col("SKUS") - F.col("CON_VENTA"),
        "PCT_CON_VENTA": safe_ratio(F.col("CON_VENTA"), F.col("SKUS")),
        "PCT_INV_SIN_VENTA": safe_ratio(F.col("INV_SIN_VENTA"), F.col("INV")),
    })


def diagnosis_by(diagnosis: DataFrame, *columns: str) -> DataFrame:
    """SKUs and units per country and the given columns."""
    return diagnosis.groupBy("PAIS", *columns).agg(
        F.countDistinct("CODIGO_SKU").alias("SKUS"), F.sum("INV_TOTAL").alias("INV")
    )
