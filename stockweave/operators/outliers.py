"""Interquartile-range bounds, capping and listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CleaningParams
from .quantiles import exact_quantiles


def iqr_bounds(
    df: DataFrame, keys: list[str], value: str, factor: float = 1.5, repeat: str | None = None, few: bool = False
) -> DataFrame:
    """N, Q1, Q3 and the lower / upper bound per key."""
    q = exact_quantiles(df, keys, value, {"Q1": 0.25, "Q3": 0.75}, repeat=repeat, few=few)
    spread = F.col("Q3") - F.col("Q1")
    return q.withColumns({
        "LIM_INF": F.col("Q1") - factor * spread,
        "LIM_SUP": F.col("Q3") + factor * spread,
    })


def price_bounds(
    df: DataFrame, params: CleaningParams = CleaningParams(), repeat: str | None = None
) -> DataFrame:
    """Bounds per movement type; types with few prices or no spread have no row."""
    known = df.filter(F.col("TIPO_TRANSACCION").isin(list(params.types)))
    bounds = iqr_bounds(known, ["TIPO_TRANSACCION"], "PRECIO_UNITARIO", params.iqr_factor, repeat, few=True)
    usable = (F.col("N") >= params.iqr_min_rows) & (F.col("Q3") > F.col("Q1"))
    return bounds.filter(usable).withColumn("LIM_INF", F.greatest("LIM_INF", F.lit(0.0)))


def capped_prices(
    df: DataFrame, params: CleaningParams = CleaningParams(), bounds: DataFrame | None = None
) -> DataFrame:
    """Cap the unit price per movement type and flag the capped rows in ES_OUTLIER.

    ``bounds`` are those of ``df`` unless given.
    """
    limits = (bounds if bounds is not None else price_bounds(df, params)).select(
        "TIPO_TRANSACCION", "LIM_INF", "LIM_SUP")
    # limits has at most one row per listed type, so the broadcast is bounded.
    out = df.join(F.broadcast(limits), "TIPO_TRANSACCION", "left")
    price = F.col("PRECIO_UNITARIO")
    outside = (price < F.col("LIM_INF")) | (price > F.col("LIM_SUP"))
    capped = F.when(price.isNull() | F.col("LIM_SUP").isNull(), price).otherwise(
        F.least(F.greatest(price, F.col("LIM_INF")), F.col("LIM_SUP"))
    )
    return (
        out.withColumn("ES_OUTLIER", F.coalesce(outside, F.lit(False)))
        .withColumn("PRECIO_UNITARIO", capped)
        .select(*df.columns, "ES_OUTLIER")
    )


def outlier_rows(df: DataFrame, value: str = "PRECIO_UNITARIO", factor: float = 1.5) -> DataFrame:
    """Rows outside the bounds of the whole table."""
    limits = iqr_bounds(df, [], value, factor).select(F.struct("LIM_INF", "LIM_SUP")).scalar()
    out = df.withColumn("_lim", limits)
    low, high = F.col("_lim.LIM_INF"), F.col("_lim.LIM_SUP")
    return out.filter((F.col(value) < low) | (F.col(value) > high)).drop("_lim")
