"""Row-level cleaning of movements: types, required values, price, dates, copies."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar_columns, date_from_key, safe_ratio, to_number
from ..functions.dates import date_key
from ..functions.text import normal_text, present
from ..schemas import NUMBER_COLUMNS, TEXT_COLUMNS, CleaningParams

# Sorted in this order: amounts settle most comparisons, countries and types few.
COPY_KEYS = [
    "COSTO", "CODIGO_SKU", "FECHA_VENTA_INVENTARIO", "CODIGO_BODEGA", "VALUE",
    "PAIS", "TIPO_TRANSACCION",
]
REQUIRED_TEXTS = ["PAIS", "CODIGO_SKU", "CODIGO_BODEGA"]
REQUIRED_NUMBERS = ["VALUE", "COSTO", "FECHA_VENTA_INVENTARIO"]
REQUIRED = REQUIRED_TEXTS + REQUIRED_NUMBERS


def computed_once(df: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
    """Replace columns by costly expressions so that later filters do not repeat them.

    A filter over a plain projection is pushed below it with a copy of each expression it
    names; a filter over generated columns stays above and reads their values.
    """
    fields = [changes[c].alias(c) if c in changes else F.col(c) for c in df.columns]
    new = [e.alias(c) for c, e in changes.items() if c not in df.columns]
    return df.select(F.inline(F.array(F.struct(*fields, *new))))


def typed(
    df: DataFrame, country_names: Mapping[str, str] | None = None, columns: Iterable[str] | None = None
) -> DataFrame:
    """Normalise text, coerce numbers, fill the country from the source file.

    ``country_names`` maps spellings of a country to one form (``{"PY": "PARAGUAY"}``), so
    that codes in the data and names taken from file names meet in joins. ``columns`` leaves all
    others as they are, for a later call: ``PAIS`` goes with ``SOURCE_COUNTRY``.
    """
    chosen = [c for c in (df.columns if columns is None else columns) if c in df.columns]
    texts = [c for c in TEXT_COLUMNS if c in chosen]
    changes = {c: normal_text(F.col(c)) for c in texts}
    changes |= {c: to_number(F.col(c)) for c in NUMBER_COLUMNS if c in chosen}
    out = computed_once(df, changes).withColumns({c: present(F.col(c)) for c in texts})
    if "PAIS" in chosen:
        country = F.col("PAIS")
        if "SOURCE_COUNTRY" in out.columns:
            country = F.coalesce(country, F.col("SOURCE_COUNTRY"))
        if country_names:
            names = F.create_map(*[F.lit(x) for kv in country_names.items() for x in kv])
            country = F.coalesce(F.try_element_at(names, country), country)
        out = out.withColumn("PAIS", country)
    return out


def of_types(df: DataFrame, types: Iterable[str] = CleaningParams.types) -> DataFrame:
    return df.filter(F.col("TIPO_TRANSACCION").isin(list(types)))


def with_required(
    df: DataFrame, keep_zero_inventory: bool = False, required: Iterable[str] = REQUIRED
) -> DataFrame:
    """Drop rows lacking a required value or with a non-positive amount.

    ``keep_zero_inventory`` keeps stock snapshots of zero units.
    """
    positive = (F.col("VALUE") > 0) & (F.col("COSTO") > 0)
    if keep_zero_inventory:
        empty_stock = (F.col("TIPO_TRANSACCION") == "INVENTORY") & (F.col("VALUE") == 0)
        positive = positive | empty_stock
    return df.dropna(subset=list(required)).filter(positive)


def with_unit_price(df: DataFrame, min_price: float = 1.0, keep_zero_inventory: bool = False) -> DataFrame:
    """Unit price from the line total; rows at or below ``min_price`` go."""
    out = df.withColumn("PRECIO_UNITARIO", safe_ratio(F.col("COSTO"), F.col("VALUE")))
    keep = F.col("PRECIO_UNITARIO") > min_price
    if keep_zero_inventory:
        keep = keep | ((F.col("TIPO_TRANSACCION") == "INVENTORY") & (F.col("VALUE") == 0))
    return out.filter(keep)


def with_day(df: DataFrame, params: CleaningParams = CleaningParams()) -> DataFrame:
    """Parse the date key and keep ``date_min`` <= day < ``date_cut``."""
    key = F.col("FECHA_VENTA_INVENTARIO")
    rows = df.filter((key >= _key_of(params.date_min)) & (key < _key_of(params.date_cut)))
    return rows.withColumn("FECHA", date_from_key(key)).filter(F.col("FECHA").isNotNull())


def with_dates(df: DataFrame, params: CleaningParams = CleaningParams()) -> DataFrame:
    """``with_day`` plus the calendar columns."""
    return calendar_columns(with_day(df, params))


def _key_of(day: date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


def before_cut(df: DataFrame, params: CleaningParams = CleaningParams()) -> DataFrame:
    return df.filter(F.col("FECHA") < F.lit(params.date_cut))


def first_of_copies(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the least by ``order``, then by the remaining columns.

    A minimum over a struct combines on the map side, so a key copied in a third of all
    rows shuffles one row per task, where a ranking window would sort them in one task.
    Such a minimum sorts rows by the keys in their order, so a key of many values goes first.
    """
    lead = [c for c in (order or []) if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in lead]
    if not lead and not rest:
        return df.distinct()
    best = F.min(F.struct(*lead, *rest)).alias("_first")
    return df.groupBy(*keys).agg(best).select(
        *[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns]
    )


def without_copies(df: DataFrame) -> DataFrame:
    """Movements without repeats; the copy from the first source file stays."""
    keys = [c for c in COPY_KEYS if c in df.columns]
    order = [c for c in ["SOURCE_FILE"] if c in df.columns]
    return first_of_copies(df, keys, order)


def with_revenue(df: DataFrame) -> DataFrame:
    return df.withColumn("INGRESO_TOTAL", F.col("VALUE") * F.col("PRECIO_UNITARIO"))


def with_margin(df: DataFrame) -> DataFrame:
    """Revenue, gross margin and margin share (null without revenue)."""
    out = with_revenue(df).withColumn("MARGEN_BRUTO", F.col("INGRESO_TOTAL") - F.col("COSTO"))
    share = F.when(F.col("INGRESO_TOTAL") > 0, safe_ratio(F.col("MARGEN_BRUTO"), F.col("INGRESO_TOTAL")))
    return out.withColumn("MARGEN_PCT", share)


def not_muted(state: Column, muted: Iterable[str] = ("EOL",)) -> Column:
    """False for muted life-cycle states; a missing state is not muted."""
    return ~F.coalesce(F.upper(F.trim(state)).isin(list(muted)), F.lit(False))


def step_counts(df: DataFrame, params: CleaningParams = CleaningParams()) -> DataFrame:
    """Rows removed by each row filter and as copies, from one scan of typed movements.

    Counted by the first test that fails, or else by the copy keys, so a key or a reason of a third
    of all rows shuffles one row per task. Task retries don't change the counts.
    """
    price = safe_ratio(F.col("COSTO"), F.col("VALUE"))
    day = date_from_key(F.col("FECHA_VENTA_INVENTARIO"))
    has_required = F.lit(True)
    for c in REQUIRED:
        has_required = has_required & F.col(c).isNotNull()
    tests = [
        ("tipos", F.coalesce(F.col("TIPO_TRANSACCION").isin(list(params.types)), F.lit(False))),
        ("nulos_ceros", has_required & F.coalesce((F.col("VALUE") > 0) & (F.col("COSTO") > 0), F.lit(False))),
        ("precio", F.coalesce(price > params.min_price, F.lit(False))),
        ("fecha_invalida", day.isNotNull()),
        ("fecha_minima", F.coalesce(day >= F.lit(params.date_min), F.lit(False))),
        ("fecha_corte", F.coalesce(day < F.lit(params.date_cut), F.lit(False))),
    ]
    keys = [c for c in COPY_KEYS if c in df.columns]
    failed = F.coalesce(*[F.when(~t, F.lit(n)) for n, t in tests]).alias("_failed")
    rows = df.select(failed, *keys).select("_failed", F.when(F.col("_failed").isNull(), F.struct(*keys)).alias("_key"))
    groups = rows.groupBy("_failed", "_key").agg(F.count(F.lit(1)).alias("_n"))
    alive, names = F.col("_failed").isNull(), [n for n, _ in tests]
    one = groups.agg(
        *[F.sum(F.when(F.col("_failed") == n, F.col("_n"))).alias(n) for n in names],
        F.sum(F.when(alive, F.col("_n") - 1)).alias("copias"), F.count_if(alive).alias("restantes"))
    pairs = F.array(*[F.struct(F.lit(n).alias("PASO"), F.coalesce(n, F.lit(0)).alias("FILAS")) for n in one.columns])
    return one.select(F.inline(pairs))


__all__ = [
    "before_cut", "computed_once", "date_key", "first_of_copies", "not_muted", "of_types", "step_counts", "typed",
    "with_dates", "with_day", "with_margin", "with_required", "with_revenue", "with_unit_price", "without_copies",
]
