"""Weekly demand series, model features and the temporal split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact_mean, rounded_even, week_start
from ..functions.numbers import clip

LAGS = [1, 2, 4, 8, 13]
CALENDAR = ["SEMANA_ANO", "MES", "TRIMESTRE", "ANO", "SEMANA_SIN", "SEMANA_COS", "MES_SIN", "MES_COS"]
MEMORY = [f"LAG_{k}W" for k in LAGS] + ["ROLLING_4W_MEAN", "ROLLING_4W_STD", "ROLLING_8W_MEAN"]

SKU_KEYS = ["PAIS", "CODIGO_SKU"]
SKU_CATEGORIES = ["PAIS", "FAMILIA", "MARCA"]
SKU_TARGET = "DEMANDA"
SKU_FEATURES = [*CALENDAR, *MEMORY, "PRECIO_PROM", "COSTO_PROM", "NUM_TRANSAC", "PAIS_ENC", "FAMILIA_ENC", "MARCA_ENC"]

RANGE_KEYS = ["PAIS", "MARCA", "TIER"]
RANGE_CATEGORIES = ["PAIS", "MARCA", "TIER"]
RANGE_TARGET = "DEMANDA_GAMA"
RANGE_FEATURES = [*CALENDAR, *MEMORY, "PRECIO_PROM", "COSTO_PROM", "NUM_SKUS", "PAIS_ENC", "MARCA_ENC", "TIER_ENC"]


def cyclic(c: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle."""
    angle = F.lit(2.0) * F.pi() * c / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def weekly_demand(sales: DataFrame) -> DataFrame:
    """Demand per week, SKU, family, model, brand and country; rows with a null key are left out."""
    keys = ["CODIGO_SKU", "FAMILIA", "MODELO", "MARCA", "PAIS"]
    return sales.dropna(subset=[*keys, "FECHA"]).groupBy(week_start(F.col("FECHA")).alias("YEAR_WEEK"), *keys).agg(
        F.sum("VALUE").alias("DEMANDA"),
        F.count("VALUE").alias("NUM_TRANSAC"),
        exact_mean(F.col("PRECIO_UNITARIO")).alias("PRECIO_PROM"),
        exact_mean(F.col("COSTO")).alias("COSTO_PROM"),
    )


def weekly_range_demand(sales: DataFrame) -> DataFrame:
    """Demand per week, brand, tier and country; NUM_SKUS counts rows."""
    keys = ["MARCA", "TIER", "PAIS"]
    return sales.dropna(subset=[*keys, "FECHA"]).groupBy(week_start(F.col("FECHA")).alias("YEAR_WEEK"), *keys).agg(
        F.sum("VALUE").alias("DEMANDA_GAMA"),
        F.count("VALUE").alias("NUM_SKUS"),
        exact_mean(F.col("PRECIO_UNITARIO")).alias("PRECIO_PROM"),
        exact_mean(F.col("COSTO")).alias("COSTO_PROM"),
    )


def dense_weeks(weekly: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Add the missing weeks of each key with zero demand."""
    by_week = Window.partitionBy(*keys).orderBy("YEAR_WEEK")
    until = F.coalesce(F.date_sub(F.lead("YEAR_WEEK").over(by_week), 7), F.col("YEAR_WEEK"))
    weeks = weekly.withColumn("_until", until)
    out = weeks.withColumn("_week", F.explode(F.sequence("YEAR_WEEK", "_until", F.expr("interval 7 days"))))
    demand = F.when(F.col("_week") == F.col("YEAR_WEEK"), F.col(target)).otherwise(F.lit(0.0))
    return out.withColumn(target, demand).withColumn("YEAR_WEEK", F.col("_week")).drop("_week", "_until")


def with_calendar(df: DataFrame) -> DataFrame:
    w = F.col("YEAR_WEEK")
    week_sin, week_cos = cyclic(F.weekofyear(w), 52)
    month_sin, month_cos = cyclic(F.month(w), 12)
    return df.withColumns({
        "SEMANA_ANO": F.weekofyear(w), "MES": F.month(w), "TRIMESTRE": F.quarter(w), "ANO": F.year(w),
        "SEMANA_SIN": week_sin, "SEMANA_COS": week_cos, "MES_SIN": month_sin, "MES_COS": month_cos,
    })


def with_memory(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Lags and rolling statistics of earlier rows of the series.

    A series has one row per week (and model), so its window is bounded by the calendar.
    """
    ties = [c for c in ("FAMILIA", "MODELO", "MARCA") if c in df.columns and c not in keys]
    rows = Window.partitionBy(*keys).orderBy("YEAR_WEEK", *ties)
    last4, last8 = rows.rowsBetween(-4, -1), rows.rowsBetween(-8, -1)
    return df.withColumns({
        **{f"LAG_{k}W": F.lag(target, k).over(rows) for k in LAGS},
        "ROLLING_4W_MEAN": F.avg(target).over(last4),
        "ROLLING_4W_STD": F.coalesce(F.stddev_samp(target).over(last4), F.lit(0.0)),
        "ROLLING_8W_MEAN": F.avg(target).over(last8),
    })


def with_codes(df: DataFrame, categories: list[str]) -> DataFrame:
    """Alphabetical 0-based code per category value, in ``<name>_ENC``.

    Values come from the product catalogue, so each code list is catalogue-sized; the
    fitted pipelines of ``forecast`` do the same with a string indexer.
    """
    out = df
    for c in categories:
        values = df.select(c).distinct()
        codes = values.withColumn(f"{c}_ENC", F.row_number().over(Window.orderBy(c)) - 1)
        out = out.join(codes, c, "left")
    return out


def sku_features(weekly: DataFrame) -> DataFrame:
    return with_codes(with_memory(with_calendar(weekly), SKU_KEYS, SKU_TARGET), SKU_CATEGORIES)


def range_features(weekly: DataFrame) -> DataFrame:
    return with_codes(with_memory(with_calendar(weekly), RANGE_KEYS, RANGE_TARGET), RANGE_CATEGORIES)


def model_rows(features: DataFrame, columns: list[str], target: str, extra: list[str]) -> DataFrame:
    """Rows with every feature present."""
    names = list(dict.fromkeys([*columns, target, "YEAR_WEEK", *extra]))
    return features.select(*[c for c in names if c in features.columns]).dropna()


def split_week(rows: DataFrame, fraction: float = 0.80) -> DataFrame:
    """The week at the ``fraction`` row quantile (nearest row), as one row.

    Ranks come from rows per week, never from a sort of the rows.
    """
    weeks = rows.groupBy("YEAR_WEEK").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("YEAR_WEEK").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = weeks.withColumns({
        "c": F.sum("n").over(upto),
        "total": F.sum("n").over(Window.partitionBy()),
    })
    position = F.rint((F.col("total") - 1) * F.lit(fraction))
    return ranked.filter(F.col("c") > position).agg(F.min("YEAR_WEEK").alias("CORTE"))


def with_side(rows: DataFrame, fraction: float = 0.80) -> DataFrame:
    """Mark each row TRAIN (up to the split week) or TEST."""
    cut = split_week(rows, fraction).scalar()
    return rows.withColumn("LADO", F.when(F.col("YEAR_WEEK") <= cut, "TRAIN").otherwise("TEST"))


def split_summary(sided: DataFrame) -> DataFrame:
    return sided.groupBy("LADO").agg(
        F.min("YEAR_WEEK").alias("INICIO"), F.max("YEAR_WEEK").alias("FIN"), F.count(F.lit(1)).alias("MUESTRAS"))


def range_reference(weekly_range: DataFrame) -> DataFrame:
    """Mean, maximum, deviation and weeks of demand per country, brand and tier."""
    return weekly_range.groupBy("PAIS", "MARCA", "TIER").agg(
        rounded_even(F.avg("DEMANDA_GAMA"), 1).alias("DEMANDA_SEMANAL_PROM"),
        rounded_even(F.max("DEMANDA_GAMA"), 1).alias("DEMANDA_SEMANAL_MAX"),
        rounded_even(F.stddev_samp("DEMANDA_GAMA"), 1).alias("DEMANDA_SEMANAL_STD"),
        F.count("DEMANDA_GAMA").alias("SEMANAS_CON_DATOS"),
        rounded_even(exact_mean(F.col("PRECIO_PROM")), 1).alias("PRECIO_PROM"),
    )


def new_sku_forecast(new_skus: DataFrame, reference: DataFrame, weeks: int = 4) -> DataFrame:
    """Expected demand, its one-deviation range and cover stock for SKUs without history."""
    mean, std = F.col("DEMANDA_SEMANAL_PROM"), F.coalesce("DEMANDA_SEMANAL_STD", F.lit(0.0))
    out = new_skus.join(reference, ["PAIS", "MARCA", "TIER"], "left")
    return out.select(
        *new_skus.columns, mean.alias("DEMANDA_ESPERADA"),
        clip(mean - std, F.lit(0.0)).alias("RANGO_MIN"), (mean + std).alias("RANGO_MAX"),
        (mean * weeks).alias("STOCK_SUGERIDO"),
    )
