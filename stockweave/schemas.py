"""Declared schemas, fixed reference values and tunable parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Header spellings accepted in input files -> canonical name.
# --------------------------------------------------------------------------
HEADER_ALIASES = {
    "FECHA": "FECHA_VENTA_INVENTARIO",
    "DATE": "FECHA_VENTA_INVENTARIO",
    "FECHA_VENTA": "FECHA_VENTA_INVENTARIO",
    "FECHA_INVENTARIO": "FECHA_VENTA_INVENTARIO",
    "FECHA_VENTA_INVENTARIO": "FECHA_VENTA_INVENTARIO",
    "TIPO_TRANSACCION": "TIPO_TRANSACCION",
    "TIPO_DE_TRANSACCION": "TIPO_TRANSACCION",
    "TRANSACCION": "TIPO_TRANSACCION",
    "VALUE": "VALUE",
    "UNIDADES": "VALUE",
    "UNITS": "VALUE",
    "CANTIDAD": "VALUE",
    "COSTO": "COSTO",
    "COST": "COSTO",
    "PRECIO_UNITARIO": "PRECIO_UNITARIO",
    "PRECIO": "PRECIO_UNITARIO",
    "UNIT_PRICE": "PRECIO_UNITARIO",
    "CODIGO_SKU": "CODIGO_SKU",
    "COD_SKU": "CODIGO_SKU",
    "SKU": "CODIGO_SKU",
    "SKU_CODE": "CODIGO_SKU",
    "FAMILY": "FAMILIA",
    "FAMILIA": "FAMILIA",
    "MODEL_NAME": "MODELO",
    "MODEL": "MODELO",
    "MODELO": "MODELO",
    "BRAND": "MARCA",
    "MARCA": "MARCA",
    "TIER": "TIER",
    "STATUS": "ESTADO",
    "ESTADO": "ESTADO",
    "CODIGO_BODEGA": "CODIGO_BODEGA",
    "COD_BODEGA": "CODIGO_BODEGA",
    "BODEGA": "CODIGO_BODEGA",
    "WAREHOUSE": "CODIGO_BODEGA",
    "WAREHOUSE_ID": "CODIGO_BODEGA",
    "NOMBRE_BODEGA": "NOMBRE_BODEGA",
    "UBICACION": "UBICACION",
    "TIPO_BODEGA": "TIPO_BODEGA",
    "PAIS": "PAIS",
    "COUNTRY": "PAIS",
    "COUNTRY_NAME": "PAIS",
    "CANAL": "CANAL",
    "CHANNEL": "CANAL",
    "CANAL_VENTA": "CANAL",
    "ANOMES": "ANOMES",
}

# File-name token -> country.
FILE_COUNTRIES = {
    "PANAMA": "PANAMA",
    "HONDURAS": "HONDURAS",
    "NICARAGUA": "NICARAGUA",
    "PARAGUAY": "PARAGUAY",
    "COLOMBIA": "COLOMBIA",
    "ELSALVADOR": "EL SALVADOR",
    "COSTARICA": "COSTA RICA",
    "HN": "HONDURAS",
    "SV": "EL SALVADOR",
    "PA": "PANAMA",
    "PY": "PARAGUAY",
    "NI": "NICARAGUA",
    "CO": "COLOMBIA",
    "CR": "COSTA RICA",
}

# Text spellings of a missing value (after upper-casing).
NULL_SPELLINGS = ["<NA>", "NAN", "NONE", ""]

# Movement types kept by the cleaning plan, and their labels.
USEFUL_TYPES = ["SALES", "INVENTORY", "TRANSITS"]
TYPE_LABELS = {
    "SALES": "VENTA",
    "INVENTORY": "INVENTARIO_BODEGA",
    "CENTRAL INVENTORY": "INVENTARIO_CENTRAL",
    "SERVICE LEVEL": "NIVEL_SERVICIO",
    "TRANSITS": "TRANSITO",
}

# Commercial tiers from lowest to highest.
TIER_ORDER = [
    "ENTRY", "LOW", "MID LOW", "MID", "MID HIGH", "HIGH", "FLAGSHIP",
    "ULTRA HIGH", "MODEMS", "CPE HOME", "CPE CORPO", "DATA CARDS",
]

# File-name hints of the two catalogues.
DEVICE_HINTS = ["device", "devices", "sku", "catalogo_sku", "catalogo_devices", "maestro_sku"]
WAREHOUSE_HINTS = [
    "bodega", "bodegas", "warehouse", "warehouses", "canal", "canales",
    "catalogo_bodega", "maestro_bodega",
]

# Delimiters tried on a delimited file, in this order.
DELIMITERS = [";", ",", "|", "\t"]

# --------------------------------------------------------------------------
# Schemas
# --------------------------------------------------------------------------
TEXT_COLUMNS = [
    "PAIS", "TIPO_TRANSACCION", "CODIGO_SKU", "CODIGO_BODEGA", "CANAL", "MARCA", "TIER",
    "MODELO", "FAMILIA", "ESTADO", "NOMBRE_BODEGA", "UBICACION", "TIPO_BODEGA",
    "SOURCE_FILE", "SOURCE_COUNTRY",
]
NUMBER_COLUMNS = ["VALUE", "COSTO", "PRECIO_UNITARIO", "FECHA_VENTA_INVENTARIO", "ANOMES"]


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


MOVEMENT_COLUMNS = [
    "PAIS", "FECHA_VENTA_INVENTARIO", "ANOMES", "TIPO_TRANSACCION",
    "CODIGO_SKU", "CODIGO_BODEGA", "VALUE", "COSTO",
]
DEVICE_COLUMNS = ["PAIS", "CODIGO_SKU", "FAMILIA", "MODELO", "MARCA", "TIER", "ESTADO"]
WAREHOUSE_COLUMNS = ["PAIS", "CODIGO_BODEGA", "NOMBRE_BODEGA", "UBICACION", "TIPO_BODEGA"]

RAW_MOVEMENT_SCHEMA = _text_schema(MOVEMENT_COLUMNS)
DEVICE_SCHEMA = _text_schema(DEVICE_COLUMNS)
WAREHOUSE_SCHEMA = _text_schema(WAREHOUSE_COLUMNS)

# Preferred column order of the clean fact; other columns follow.
CLEAN_FACT_ORDER = [
    "FECHA", "FECHA_VENTA_INVENTARIO", "ANIO", "MES", "MES_NOMBRE", "YEAR_MONTH", "ANOMES",
    "PAIS", "CANAL", "TIPO_TRANSACCION",
    "CODIGO_SKU", "FAMILIA", "MODELO", "MARCA", "TIER", "ESTADO",
    "CODIGO_BODEGA", "NOMBRE_BODEGA", "UBICACION", "TIPO_BODEGA",
    "VALUE", "PRECIO_UNITARIO", "INGRESO_TOTAL", "COSTO",
    "SOURCE_FILE", "SOURCE_COUNTRY",
]

EVENT_SCHEMA = T.StructType([
    T.StructField("evento_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("fecha_original", T.DateType()),
    T.StructField("tipo_evento", T.StringType()),
    T.StructField("pais", T.StringType()),
    T.StructField("codigo_sku", T.StringType()),
    T.StructField("familia", T.StringType()),
    T.StructField("modelo", T.StringType()),
    T.StructField("marca", T.StringType()),
    T.StructField("tier", T.StringType()),
    T.StructField("estado", T.StringType()),
    T.StructField("codigo_bodega", T.StringType()),
    T.StructField("value", T.LongType()),
    T.StructField("precio_unitario", T.DoubleType()),
    T.StructField("costo", T.DoubleType()),
    T.StructField("fuente", T.StringType()),
])


# --------------------------------------------------------------------------
# Parameters
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class CleaningParams:
    """Thresholds of the cleaning plan."""

    types: tuple[str, ...] = tuple(USEFUL_TYPES)
    min_price: float = 1.0
    date_min: date = date(2021, 1, 1)
    date_cut: date = date(2025, 12, 15)
    iqr_factor: float = 1.5
    iqr_min_rows: int = 5
    keep_zero_inventory: bool = False


@dataclass(frozen=True)
class ForecastParams:
    """Model sizes; the defaults are the full training sizes."""

    train_fraction: float = 0.80
    forest_trees: int = 300
    forest_depth: int = 12
    forest_min_leaf: int = 5
    boost_rounds: int = 500
    boost_step: float = 0.05
    boost_depth: int = 6
    boost_subsample: float = 0.8
    boost_features: float = 0.8
    boost_min_leaf: int = 5
    boost_l1: float = 0.1
    boost_l2: float = 1.0
    range_min_leaf: int = 3
    seed: int = 42


@dataclass(frozen=True)
class StreamParams:
    """Thresholds of the event-stream rules."""

    window_events: int = 20
    interval_seconds: int = 3
    min_history: int = 4
    history_size: int = 13
    doh_low: float = 7.0
    doh_over: float = 90.0
    cover_over: float = 120.0
    doh_none: float = 999.0
    min_weekly_demand: float = 1.0
    cover_weeks: int = 4
    lead_windows: int = 5
    lead_days: float | None = None
    idle_windows: int = 4
    candidates: int = 20
    muted_states: tuple[str, ...] = field(default=("EOL",))
