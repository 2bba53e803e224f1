"""Sets of KPI tables and report sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import stored
from . import inventory, product, sales


def kpi_tables(s: DataFrame, iv: DataFrame, notebook: bool = False) -> dict[str, DataFrame]:
    """The per-country KPI tables. ``notebook`` takes the day-total, 30-day, monthly variants.

    ``s`` and ``iv`` come from ``prepared_sales`` and ``prepared_stock``; persist them
    before writing, since every table reads them.
    """
    snap = inventory.snapshot_by_day(iv) if notebook else inventory.snapshot_by_position(iv)
    diagnosis = inventory.last_month_diagnosis(s, iv)
    return {
        "kpi_ventas_generales": sales.headline(s, iv),
        "kpi_ventas_mensuales": sales.monthly(s),
        "kpi_ventas_anuales": sales.annual(s),
        "kpi_doh_turnover_sellthrough": inventory.monthly_ratios(s, snap, 30 if notebook else None),
        "kpi_stockout_rate": inventory.stockout_rate(iv),
        "kpi_fill_rate": inventory.fill_rate_by_month(s, iv) if notebook else inventory.fill_rate_by_sku(s, iv),
        "inventario_snapshot_mes": snap,
        "kpi_por_marca": product.brands(s),
        "top_modelos": product.top_models(s),
        "kpi_por_tier": product.tiers(s, drop_null=notebook),
        "diagnostico_fill_rate": diagnosis,
        "dead_stock_ultimo_mes": inventory.dead_stock(diagnosis),
    }


def global_tables(tables: dict[str, DataFrame], s: DataFrame, iv: DataFrame) -> dict[str, DataFrame]:
    """Summaries over countries, from the per-country tables."""
    return {
        "global_resumen_inventario_pais": inventory.country_inventory(tables["kpi_doh_turnover_sellthrough"]),
        "global_stockout_rate_pais": inventory.country_stockout(tables["kpi_stockout_rate"]),
        "global_fill_rate_pais": inventory.country_fill_rate(tables["kpi_fill_rate"]),
        "global_serie_mensual": sales.global_series(tables["kpi_ventas_mensuales"]),
        "global_ranking_marcas": product.ranking(tables["kpi_por_marca"], ["MARCA"]),
        "global_kpi_tier": product.ranking(tables["kpi_por_tier"], ["TIER"]),
        "global_top20_modelos": product.top_global_models(s),
        "global_tabla_ejecutiva": sales.executive(s, iv),
    }


def stored_tables(s: DataFrame, iv: DataFrame, notebook: bool = False) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables and summaries, each worked out once: written, summed up and shown in a sheet, they are read back."""
    tables = {name: stored(df, name) for name, df in kpi_tables(s, iv, notebook).items()}
    return tables, {name: stored(df, name) for name, df in global_tables(tables, s, iv).items()}


def report_sheets(tables: dict[str, DataFrame], summaries: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The sheets of the KPI report."""
    return {
        "ejecutivo_global": summaries["global_tabla_ejecutiva"],
        "ventas_generales": tables["kpi_ventas_generales"],
        "inventario_pais": summaries["global_resumen_inventario_pais"],
        "stockout_fill_rate": summaries["global_stockout_rate_pais"],
        "top_marcas": tables["kpi_por_marca"],
        "top_modelos": tables["top_modelos"],
        "kpi_tier": tables["kpi_por_tier"],
        "dead_stock": tables["dead_stock_ultimo_mes"],
    }
