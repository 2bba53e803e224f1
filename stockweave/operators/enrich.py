"""Catalogue preparation and enrichment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean_text
from ..schemas import DEVICE_COLUMNS, WAREHOUSE_COLUMNS
from ..session import stored
from .cleaning import first_of_copies
from .columns import canonical_columns, with_missing
from .slices import dealt


def catalogue(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Normalised catalogue, one row per (PAIS, key); rows without either are dropped."""
    out = with_missing(canonical_columns(df), columns)
    out = dealt(out, columns).withColumns({c: clean_text(F.col(c)) for c in columns})
    if "SOURCE_COUNTRY" in out.columns:
        out = out.withColumn("PAIS", F.coalesce("PAIS", clean_text(F.col("SOURCE_COUNTRY"))))
    order = [c for c in ["SOURCE_FILE"] if c in out.columns]
    out = out.dropna(subset=["PAIS", key]).select(*columns, *order)
    return first_of_copies(out, ["PAIS", key], order).select(*columns)


def device_catalogue(df: DataFrame) -> DataFrame:
    return catalogue(df, DEVICE_COLUMNS, "CODIGO_SKU")


def warehouse_catalogue(df: DataFrame) -> DataFrame:
    return catalogue(df, WAREHOUSE_COLUMNS, "CODIGO_BODEGA")


def filled_from(fact: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """Left join where a value of the fact wins and the catalogue fills its nulls.

    No broadcast hint: a catalogue grows with the business, so the optimizer's and AQE's
    size checks choose between broadcast and a skew-split sort-merge join.
    """
    attributes = [c for c in dim.columns if c not in keys]
    renamed = dim.select(*keys, *[F.col(c).alias(f"_dim_{c}") for c in attributes])
    out = fact.join(renamed, keys, "left")
    filled = [
        (F.coalesce(F.col(c), F.col(f"_dim_{c}")) if c in fact.columns else F.col(f"_dim_{c}")).alias(c)
        for c in attributes
    ]
    return out.select(*[c for c in fact.columns if c not in attributes], *filled)


def enriched(fact: DataFrame, devices: DataFrame | None, warehouses: DataFrame | None) -> DataFrame:
    """The fact with both catalogues' values.

    The catalogues are stored first: of a plan the optimizer knows only the size of the compressed
    files below it, by which it would broadcast millions of rows.
    """
    out = fact
    if devices is not None:
        out = filled_from(out, stored(devices, "devices"), ["PAIS", "CODIGO_SKU"])
    if warehouses is not None:
        out = filled_from(out, stored(warehouses, "warehouses"), ["PAIS", "CODIGO_BODEGA"])
    return out


def match_rates(df: DataFrame) -> DataFrame:
    """Share of fact rows that found a device and a warehouse."""
    def rate(c: str):
        known = F.col(c).isNotNull().cast("double") if c in df.columns else F.lit(0.0)
        return F.coalesce(F.avg(known), F.lit(0.0))

    one = df.agg(rate("MODELO").alias("dev"), rate("NOMBRE_BODEGA").alias("bod"))
    pairs = F.array(
        F.struct(F.lit("pct_match_devices").alias("metrica"), F.col("dev").alias("valor")),
        F.struct(F.lit("pct_match_bodegas").alias("metrica"), F.col("bod").alias("valor")),
    )
    return one.select(F.inline(pairs))
