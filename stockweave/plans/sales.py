"""Sales KPIs per country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact_mean, growth, safe_ratio, to_number, units_of_money
from ..operators.cleaning import with_revenue
from ..operators.columns import require_columns

SALES_COLUMNS = [
    "PAIS", "FECHA", "YEAR_MONTH", "ANIO", "MES", "VALUE", "PRECIO_UNITARIO", "COSTO",
    "CODIGO_SKU", "MARCA", "MODELO", "TIER", "ESTADO", "CODIGO_BODEGA",
]
STOCK_COLUMNS = [
    "PAIS", "FECHA", "YEAR_MONTH", "VALUE", "CODIGO_SKU", "CODIGO_BODEGA",
    "MARCA", "MODELO", "TIER", "ESTADO",
]

def _units() -> Column:
    return F.sum("VALUE")


def prepared_sales(fact: DataFrame) -> DataFrame:
    """SALES rows with only the columns the KPIs read; missing numbers count as 0."""
    require_columns(fact, [c for c in SALES_COLUMNS if c not in ("COSTO", "ESTADO", "CODIGO_BODEGA")], "sales")
    rows = fact
    if "TIPO_TRANSACCION" in fact.columns:
        rows = fact.filter(F.col("TIPO_TRANSACCION") == "SALES")
    rows = rows.select(*[c for c in SALES_COLUMNS if c in fact.columns])
    numbers = [c for c in ("VALUE", "PRECIO_UNITARIO", "COSTO") if c in rows.columns]
    return with_revenue(rows.withColumns({c: F.coalesce(to_number(F.col(c)), F.lit(0.0)) for c in numbers}))


def prepared_stock(fact: DataFrame) -> DataFrame:
    """INVENTORY rows with only the columns the KPIs read."""
    require_columns(fact, [c for c in STOCK_COLUMNS if c != "ESTADO"], "inventory")
    rows = fact
    if "TIPO_TRANSACCION" in fact.columns:
        rows = fact.filter(F.col("TIPO_TRANSACCION") == "INVENTORY")
    rows = rows.select(*[c for c in STOCK_COLUMNS if c in fact.columns])
    if "ESTADO" not in rows.columns:
        rows = rows.withColumn("ESTADO", F.lit(None).cast("string"))
    return rows.withColumn("VALUE", F.coalesce(to_number(F.col("VALUE")), F.lit(0.0)))


def headline(sales: DataFrame, stock: DataFrame) -> DataFrame:
    """Units, revenue, price per unit and sell-through per country, one KPI per row."""
    sold = sales.groupBy("PAIS").agg(_units().alias("u"), units_of_money(F.col("INGRESO_TOTAL")).alias("r"))
    held = stock.groupBy("PAIS").agg(F.avg("VALUE").alias("inv"))
    both = sold.join(held, "PAIS", "left")
    asp = F.when(F.col("u") > 0, safe_ratio(F.col("r"), F.col("u")))
    through = F.when(F.col("inv") > 0, safe_ratio(F.col("u"), F.col("u") + F.col("inv")))

    def kpi(name: str, value: Column, unit: str) -> Column:
        return F.struct(
            F.lit(name).alias("KPI"), value.cast("double").alias("VALOR"), F.lit(unit).alias("UNIDAD")
        )

    rows = F.array(
        kpi("Unidades vendidas", F.col("u"), "ud"),
        kpi("Ingresos totales", F.col("r"), "USD"),
        kpi("ASP", asp, "USD/ud"),
        kpi("Sell-through Rate", through, "%"),
    )
    return both.select("PAIS", F.inline(rows))


def headline_by_country(long: DataFrame) -> DataFrame:
    """One row per country with a column per KPI and the country's share of the whole."""
    names = ["Unidades vendidas", "Ingresos totales", "ASP", "Sell-through Rate"]
    wide = long.groupBy("PAIS").pivot("KPI", names).agg(F.first("VALOR"))
    # One row per country: the total runs over a handful of rows.
    everything = Window.partitionBy()
    return wide.withColumns({
        "PARTICIPACION_INGRESOS": safe_ratio(
            F.col("Ingresos totales"), F.sum("Ingresos totales").over(everything)),
        "PARTICIPACION_UNIDADES": safe_ratio(
            F.col("Unidades vendidas"), F.sum("Unidades vendidas").over(everything)),
    })


def monthly(sales: DataFrame) -> DataFrame:
    """Monthly sales with growth against the previous present month and year."""
    m = sales.groupBy("PAIS", "ANIO", "MES", "YEAR_MONTH").agg(
        _units().alias("UNIDADES"),
        units_of_money(F.col("INGRESO_TOTAL")).alias("INGRESOS"),
        exact_mean(F.col("PRECIO_UNITARIO")).alias("ASP"),
        F.countDistinct("CODIGO_SKU").alias("SKUS_ACTIVOS"),
    )
    by_month = Window.partitionBy("PAIS").orderBy("YEAR_MONTH")
    by_year = Window.partitionBy("PAIS", "MES").orderBy("ANIO")
    return m.withColumns({
        "CRECIMIENTO_UNID_MOM": growth(F.col("UNIDADES"), by_month),
        "CRECIMIENTO_INGRESOS_MOM": growth(F.col("INGRESOS"), by_month),
        "CRECIMIENTO_INGRESOS_YOY": growth(F.col("INGRESOS"), by_year),
        "CRECIMIENTO_UNID_YOY": growth(F.col("UNIDADES"), by_year),
    })


def annual(sales: DataFrame) -> DataFrame:
    a = sales.groupBy("PAIS", "ANIO").agg(
        _units().alias("UNIDADES"), units_of_money(F.col("INGRESO_TOTAL")).alias("INGRESOS")
    )
    by_year = Window.partitionBy("PAIS").orderBy("ANIO")
    return a.withColumns({
        "CRECIMIENTO_INGRESOS_YOY": growth(F.col("INGRESOS"), by_year),
        "CRECIMIENTO_UNID_YOY": growth(F.col("UNIDADES"), by_year),
    })


def annual_pivot(by_year: DataFrame, countries: list[str]) -> DataFrame:
    """Revenue by year, one column per listed country."""
    return by_year.groupBy("ANIO").pivot("PAIS", list(countries)).agg(F.sum("INGRESOS"))


def global_series(by_month: DataFrame) -> DataFrame:
    """All countries together per month, from the country result."""
    g = by_month.groupBy("YEAR_MONTH").agg(
        F.sum("UNIDADES").alias("UNIDADES"), units_of_money(F.col("INGRESOS")).alias("INGRESOS")
    )
    # One row per month of the calendar.
    return g.withColumn("CRECIMIENTO_INGRESOS_MOM", growth(F.col("INGRESOS"), Window.orderBy("YEAR_MONTH")))


def country_and_global(sales: DataFrame) -> DataFrame:
    """Monthly units and revenue per country and over all countries (PAIS null) in one scan."""
    return sales.groupingSets([["PAIS", "YEAR_MONTH"], ["YEAR_MONTH"]], "PAIS", "YEAR_MONTH").agg(
        F.grouping("PAIS").alias("ES_GLOBAL"),
        _units().alias("UNIDADES"),
        units_of_money(F.col("INGRESO_TOTAL")).alias("INGRESOS"),
    )


def executive(sales: DataFrame, stock: DataFrame | None = None) -> DataFrame:
    """Monthly table with active SKUs and warehouses, growth and stock of the month.

    INV_SUMA_MES sums every snapshot row of the month (also under its usual name
    INV_CIERRE); INV_CIERRE_REAL sums the snapshots of the month's last day.
    """
    keys = ["PAIS", "ANIO", "YEAR_MONTH"]
    # One pre-aggregation keeps both distinct counts off the raw rows.
    fine = sales.groupBy(*keys, "CODIGO_SKU", "CODIGO_BODEGA").agg(
        _units().alias("u"),
        F.sum(F.col("INGRESO_TOTAL").cast("decimal(20,4)")).alias("r"),
        F.sum(F.col("PRECIO_UNITARIO").cast("decimal(20,6)")).alias("p"),
        F.count("PRECIO_UNITARIO").alias("n"),
    )
    t = fine.groupBy(*keys).agg(
        F.sum("u").alias("UNIDADES"),
        F.sum("r").cast("double").alias("INGRESOS"),
        safe_ratio(F.sum("p"), F.sum("n")).alias("ASP"),
        F.countDistinct("CODIGO_SKU").alias("SKUS_ACTIVOS"),
        F.countDistinct("CODIGO_BODEGA").alias("BODEGAS_ACTIVAS"),
    )
    t = t.withColumn(
        "CRECIMIENTO_INGRESOS_MOM",
        growth(F.col("INGRESOS"), Window.partitionBy("PAIS").orderBy("YEAR_MONTH")),
    )
    if stock is None:
        return t
    daily = stock.groupBy("PAIS", "YEAR_MONTH", "FECHA").agg(F.sum("VALUE").alias("d"))
    inv = daily.groupBy("PAIS", "YEAR_MONTH").agg(
        F.sum("d").alias("INV_SUMA_MES"), F.max_by("d", "FECHA").alias("INV_CIERRE_REAL")
    ).withColumn("INV_CIERRE", F.col("INV_SUMA_MES"))
    return t.join(inv, ["PAIS", "YEAR_MONTH"], "left")
