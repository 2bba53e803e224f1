"""Brand, tier and model KPIs per country and over all countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact_mean, safe_ratio, units_of_money
from ..operators.ranking import top_per_group, top_rows


def with_shares(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Share of units and revenue within ``groups``.

    Runs over one row per brand or tier, a catalogue-sized set, not over movements.
    """
    within = Window.partitionBy(*(groups or []))
    return df.withColumns({
        "PARTICIPACION_UNIDADES": safe_ratio(F.col("UNIDADES"), F.sum("UNIDADES").over(within)),
        "PARTICIPACION_INGRESOS": safe_ratio(F.col("INGRESOS"), F.sum("INGRESOS").over(within)),
    })


def _measures():
    return [
        F.sum("VALUE").alias("UNIDADES"),
        units_of_money(F.col("INGRESO_TOTAL")).alias("INGRESOS"),
        exact_mean(F.col("PRECIO_UNITARIO")).alias("ASP"),
    ]


def by_attribute(sales: DataFrame, column: str, drop_null: bool = False) -> DataFrame:
    """KPIs per country and brand (or tier) with shares of the country."""
    rows = sales.dropna(subset=[column]) if drop_null else sales
    k = rows.groupBy("PAIS", column).agg(*_measures(), F.countDistinct("MODELO").alias("MODELOS"))
    return with_shares(k, ["PAIS"])


def brands(sales: DataFrame) -> DataFrame:
    return by_attribute(sales, "MARCA")


def tiers(sales: DataFrame, drop_null: bool = False) -> DataFrame:
    return by_attribute(sales, "TIER", drop_null)


def models(sales: DataFrame) -> DataFrame:
    return sales.groupBy("PAIS", "MODELO", "MARCA", "TIER").agg(*_measures())


def _model_order() -> list[Column]:
    return [F.desc("UNIDADES"), F.asc("MODELO"), F.asc("MARCA"), F.asc("TIER")]


def top_models(sales: DataFrame, n: int = 15) -> DataFrame:
    return top_per_group(models(sales), ["PAIS"], _model_order(), n)


def top_brands(brand_kpis: DataFrame, n: int = 8) -> DataFrame:
    named = brand_kpis.dropna(subset=["MARCA"])
    return top_per_group(named, ["PAIS"], [F.desc("UNIDADES"), F.asc("MARCA")], n)


def ranking(country_kpis: DataFrame, columns: list[str], shares: bool = True) -> DataFrame:
    """Countries added up: units, revenue, mean of the country prices, countries, shares."""
    r = country_kpis.groupBy(*columns).agg(
        F.sum("UNIDADES").alias("UNIDADES"),
        units_of_money(F.col("INGRESOS")).alias("INGRESOS"),
        F.avg("ASP").alias("ASP"),
        F.countDistinct("PAIS").alias("PAISES"),
    )
    return with_shares(r) if shares else r


def top_global_models(sales: DataFrame, n: int = 20, per_country: int = 15) -> DataFrame:
    """Best models overall among the countries' best."""
    r = ranking(top_models(sales, per_country), ["MODELO", "MARCA", "TIER"], shares=False)
    return top_rows(r, _model_order(), n)
