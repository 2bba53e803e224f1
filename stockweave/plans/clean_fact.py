"""The cleaning plan: raw movements and catalogues to the enriched clean fact."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..functions import calendar_columns
from ..operators import cleaning
from ..operators.columns import canonical_columns, preferred_order, with_missing
from ..operators.enrich import device_catalogue, enriched, warehouse_catalogue
from ..operators.gapfill import filled_prices, with_filled_inventory
from ..operators.outliers import capped_prices, price_bounds
from ..schemas import CLEAN_FACT_ORDER, MOVEMENT_COLUMNS, NUMBER_COLUMNS, CleaningParams
from ..session import stored


def cleaned(
    raw: DataFrame, params: CleaningParams = CleaningParams(), country_names: Mapping[str, str] | None = None
) -> DataFrame:
    """Typed, filtered, priced, dated movements without copies.

    Type and numbers come first and drop rows before the other texts are cleaned. All at once was
    more code than the JVM compiles for one method of a task: over Parquet files it ran uncompiled.
    """
    df = with_missing(canonical_columns(raw), MOVEMENT_COLUMNS)
    first = ["TIPO_TRANSACCION", *NUMBER_COLUMNS]
    others = [c for c in df.columns if c not in first]
    df = cleaning.of_types(cleaning.typed(df, columns=first), params.types)
    df = cleaning.with_required(df, params.keep_zero_inventory, cleaning.REQUIRED_NUMBERS)
    df = cleaning.with_unit_price(df, params.min_price, params.keep_zero_inventory)
    df = cleaning.typed(cleaning.with_day(df, params), country_names, others)
    return calendar_columns(cleaning.without_copies(df.dropna(subset=cleaning.REQUIRED_TEXTS)))


def clean_fact(
    raw: DataFrame,
    devices: DataFrame | None = None,
    warehouses: DataFrame | None = None,
    params: CleaningParams = CleaningParams(),
    fill_gaps: bool = True,
    country_names: Mapping[str, str] | None = None,
) -> DataFrame:
    """The whole plan.

    The de-duplicated movements are stored once: gap fill, price bounds and the result each
    read some of their columns, and the parsing of the raw text is not repeated. Price
    bounds come from the keys and the number of days, not from the filled rows.
    """
    base = stored(cleaned(raw, params, country_names), "movements")
    if fill_gaps:
        bounds = price_bounds(filled_prices(base), params, "VECES")
        df = capped_prices(with_filled_inventory(base), params, bounds)
    else:
        df = capped_prices(base, params)
    df = enriched(
        df,
        device_catalogue(devices) if devices is not None else None,
        warehouse_catalogue(warehouses) if warehouses is not None else None,
    )
    return preferred_order(df, CLEAN_FACT_ORDER)
