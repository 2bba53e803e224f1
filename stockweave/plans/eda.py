"""Exploratory series, correlations and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe_ratio, units_of_money, week_ending_monday, week_start
from ..operators.slices import Running, sliced, with_running


def country_summary(sales: DataFrame) -> DataFrame:
    keys = ["PAIS", "CODIGO_SKU", "CODIGO_BODEGA"]
    fine = sales.groupBy(*keys).agg(  # keeps both distinct counts off the raw rows
        F.count("VALUE").alias("n"), F.sum("VALUE").alias("v"),
        F.sum(F.col("COSTO").cast("decimal(20,4)")).alias("c"),
        F.min("FECHA").alias("lo"), F.max("FECHA").alias("hi"),
    )
    out = fine.groupBy("PAIS").agg(
        F.sum("n").alias("TRANSACCIONES"), F.sum("v").alias("UNIDADES"),
        F.sum("c").cast("double").alias("COSTO_TOTAL"),
        F.countDistinct("CODIGO_SKU").alias("SKU_UNICOS"),
        F.countDistinct("CODIGO_BODEGA").alias("BODEGAS_UNICAS"),
        F.min("lo").alias("FECHA_INICIO"), F.max("hi").alias("FECHA_FIN"),
    )
    days = F.datediff("FECHA_FIN", "FECHA_INICIO")
    return out.withColumns({"PERIODO_DIAS": days, "UNIDADES_DIA": safe_ratio(F.col("UNIDADES"), days)})


def daily_stock(stock: DataFrame) -> DataFrame:
    return stock.groupBy("FECHA", "PAIS", "CODIGO_SKU", "CODIGO_BODEGA").agg(F.sum("VALUE").alias("VALUE"))


def sku_coverage(stock: DataFrame) -> DataFrame:
    """First, last and number of snapshot days per SKU."""
    return stock.groupBy("CODIGO_SKU").agg(
        F.min("FECHA").alias("PRIMERA"), F.max("FECHA").alias("ULTIMA"),
        F.countDistinct("FECHA").alias("DIAS_DISTINTOS"),
    )


def coverage_counts(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.count_if(F.col("DIAS_DISTINTOS") == 1).alias("UN_DIA"),
        F.count_if(F.col("DIAS_DISTINTOS") < 5).alias("MENOS_DE_5"),
    )


def weekly_stock_and_sales(stock: DataFrame, sales: DataFrame) -> DataFrame:
    """Weeks in which a SKU has both stock rows and sales."""
    keys = ["SEMANA", "CODIGO_SKU", "PAIS"]

    def weekly(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(week_start(F.col("FECHA")).alias("SEMANA"), "CODIGO_SKU", "PAIS").agg(
            F.sum("VALUE").alias(name))

    return weekly(stock, "STOCK").join(weekly(sales, "VENTAS"), keys)


def correlations(weekly: DataFrame, min_rows: int = 10) -> DataFrame:
    """Pearson r of stock and sales per country (more than ``min_rows``) and overall (PAIS null), with t."""
    both = weekly.groupingSets([["PAIS"], []], "PAIS").agg(
        F.grouping("PAIS").alias("ES_GLOBAL"), F.corr("STOCK", "VENTAS").alias("R"),
        F.count(F.lit(1)).alias("N"),
    )
    t = F.col("R") * F.sqrt(safe_ratio(F.col("N") - 2, 1 - F.col("R") * F.col("R")))
    return both.filter((F.col("ES_GLOBAL") == 1) | (F.col("N") > min_rows)).withColumn("T", t)


def log_trend(weekly: DataFrame) -> DataFrame:
    """Slope and intercept of ln(sales) on ln(stock)."""
    pos = weekly.filter((F.col("STOCK") > 0) & (F.col("VENTAS") > 0))
    x, y = F.ln(F.col("STOCK")), F.ln(F.col("VENTAS"))
    return pos.agg(F.regr_slope(y, x).alias("PENDIENTE"), F.regr_intercept(y, x).alias("CORTE"))


def sales_after_empty_week(weekly: DataFrame) -> DataFrame:
    """Sales in a week whose previous row for the SKU had no stock."""
    by_week = Window.partitionBy("PAIS", "CODIGO_SKU").orderBy("SEMANA")
    return weekly.withColumn("STOCK_LAG1", F.lag("STOCK").over(by_week)).filter(
        (F.col("STOCK_LAG1") == 0) & (F.col("VENTAS") > 0))


def sales_by_sku(sales: DataFrame) -> DataFrame:
    return sales.groupBy("CODIGO_SKU", "PAIS").agg(
        F.sum("VALUE").alias("UNIDADES"), F.count("VALUE").alias("TRANSAC"))


def pareto(sales: DataFrame) -> DataFrame:
    """SKUs by units: share, cumulative share and rank over all countries.

    The cumulative sum runs over range slices, so the list of SKUs is never in one task.
    """
    totals = sales.groupBy("CODIGO_SKU").agg(F.sum("VALUE").alias("UNIDADES"))
    order = [F.desc("UNIDADES"), F.asc("CODIGO_SKU")]
    rows = sliced(totals, [], order)
    ranked = with_running(rows, [], order, {
        "_acum": Running("sum", F.col("UNIDADES")),
        "RANK": Running("sum", F.lit(1).cast("bigint")),
    })
    whole = rows.agg(F.sum("UNIDADES")).scalar()
    out = ranked.withColumn("_total", whole)
    return out.select(
        "CODIGO_SKU", "UNIDADES",
        (safe_ratio(F.col("UNIDADES"), F.col("_total")) * 100).alias("PCT"),
        (safe_ratio(F.col("_acum"), F.col("_total")) * 100).alias("PCT_ACUM"), "RANK",
    )


def pareto_head(ranked: DataFrame, share: float = 80.0) -> DataFrame:
    """How many SKUs stay within ``share`` percent of the units."""
    out = ranked.agg(
        F.count(F.lit(1)).alias("SKUS"), F.count_if(F.col("PCT_ACUM") <= share).alias("SKUS_80"))
    return out.withColumn("PCT_SKUS_80", safe_ratio(F.col("SKUS_80"), F.col("SKUS")) * 100)


def monthly_series(sales: DataFrame) -> DataFrame:
    """Units per calendar month without gaps (0 where nothing sold)."""
    m = sales.groupBy(F.trunc("FECHA", "MM").alias("MES")).agg(F.sum("VALUE").alias("u"))
    months = m.agg(F.min("MES").alias("lo"), F.max("MES").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("MES"))
    return months.join(m, "MES", "left").select("MES", F.coalesce("u", F.lit(0.0)).alias("UNIDADES"))


def yearly_series(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.year("FECHA").alias("ANIO")).agg(F.sum("VALUE").alias("UNIDADES"))


def monthly_by_country(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.trunc("FECHA", "MM").alias("MES"), "PAIS").agg(F.sum("VALUE").alias("UNIDADES"))


def weekly_by_country(sales: DataFrame) -> DataFrame:
    """Weeks that end on Monday, with ISO week number and calendar year of that Monday."""
    w = sales.groupBy(week_ending_monday(F.col("FECHA")).alias("SEMANA"), "PAIS").agg(
        F.sum("VALUE").alias("UNIDADES"))
    return w.withColumns({"SEMANA_NUM": F.weekofyear("SEMANA"), "ANO": F.year("SEMANA")})


def season_pattern(weekly: DataFrame) -> DataFrame:
    return weekly.groupBy("PAIS", "SEMANA_NUM").agg(F.avg("UNIDADES").alias("UNIDADES"))


def year_week_pivot(weekly: DataFrame) -> DataFrame:
    """Year by week-of-year units, one row per country and year."""
    return weekly.groupBy("PAIS", "ANO").pivot("SEMANA_NUM", list(range(1, 54))).agg(F.sum("UNIDADES"))


def with_devices(df: DataFrame, devices: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on the given keys; on the SKU alone a SKU listed in two countries fans out.

    Both sides are grouped, so the merge costs little; the optimizer takes a catalogue for as large
    as its compressed file and would broadcast millions of rows.
    """
    listed = devices.select(*keys, *[c for c in devices.columns if c not in df.columns])
    return df.join(listed.hint("merge"), keys, "left")


def cost_summary(df: DataFrame) -> DataFrame:
    return df.agg(units_of_money(F.col("COSTO")).alias("COSTO_TOTAL"), F.max("COSTO").alias("MAXIMO"))
