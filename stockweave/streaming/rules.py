"""KPIs, alerts, replenishment and substitutes over the state table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import last_items, mean_of, population_std, rounded_even
from ..operators.cleaning import not_muted
from ..schemas import StreamParams
from .events import KEYS

P = StreamParams()


def kpi_columns(stock: Column, sold: Column, price: Column, weekly: Column, p: StreamParams = P) -> dict[str, Column]:
    """The KPI expressions from stock, units sold, price and reference weekly demand."""
    from_history = F.when(weekly > 0, weekly / 7.0).otherwise(F.lit(0.0))
    from_stream = F.when(sold > 0, sold / 30.0).otherwise(F.lit(0.0))
    daily = F.greatest(from_history, from_stream)
    on_hand = rounded_even(F.try_divide(stock.cast("double"), F.when(daily > 0, daily)), 1)
    reach = (sold + stock).cast("double")
    return {
        "stock_actual": stock, "ventas_acum": sold,
        "dem_semanal_ref": rounded_even(weekly, 1),
        "doh": F.coalesce(on_hand, F.lit(p.doh_none)),
        "sell_through": F.coalesce(rounded_even(F.try_divide(sold.cast("double"), F.when(reach > 0, reach)), 3), F.lit(0.0)),
        "ingreso_acum": rounded_even(sold * price, 2),
        "precio_prom": rounded_even(price, 2),
    }


def kpis(state: DataFrame, p: StreamParams = P) -> DataFrame:
    """One KPI row per key of the state; every other state column is kept."""
    weekly = F.when(F.size("historial") >= 2, mean_of(last_items(F.col("historial"), 4))).otherwise(F.lit(0.0))
    columns = kpi_columns(F.col("stock"), F.col("ventas"), F.col("precio"), weekly, p)
    return state.withColumns(columns)


KPI_FIELDS = [
    "pais", "codigo_sku", "familia", "marca", "tier", "stock_actual", "ventas_acum", "dem_semanal_ref", "doh",
    "sell_through", "ingreso_acum", "precio_prom",
]


def in_transit() -> Column:
    return F.aggregate("en_camino", F.lit(0).cast("bigint"), lambda acc, x: acc + x["cantidad"])


def _fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", rounded_even(c.cast("double"), digits))


def alerts(kpi: DataFrame, predictions: DataFrame | None = None, p: StreamParams = P, keep: tuple[str, ...] = ()) -> DataFrame:
    """Alert rows of unmuted keys; with ``predictions`` also cover shortfalls. ``keep``: further columns of both to carry."""
    stock, sold, doh, weekly = (F.col(c) for c in ("stock_actual", "ventas_acum", "doh", "dem_semanal_ref"))
    mean = F.coalesce(mean_of(F.col("historial")), F.lit(0.0))
    std = F.coalesce(population_std(F.col("historial")), F.lit(0.0))
    coming = in_transit()
    future = stock + coming
    cover = F.coalesce(F.try_divide(future.cast("double"), F.when(weekly > 0, weekly / 7.0)), F.lit(p.doh_none))

    out_of_stock = (stock == 0) & (sold > 0)
    low = ~out_of_stock & (doh > 0) & (doh < p.doh_low)
    demand = weekly >= p.min_weekly_demand
    over = (doh > p.doh_over) & (stock > 0) & demand
    over_soon = ~over & (cover > p.cover_over) & (coming > 0) & demand
    spike = (mean > 0) & (std > 0) & (sold > mean + 2 * std)

    def alert(test: Column, kind: str, detail: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("tipo_alerta"), detail.alias("detalle")))

    found = F.array_compact(F.array(
        alert(out_of_stock, "STOCKOUT", F.concat(F.lit("Stock = 0 con "), sold.cast("string"), F.lit(" uds vendidas"))),
        alert(low, "DOH_BAJO", F.concat(F.lit("DOH = "), _fixed(doh, 1), F.lit(f" dias (umbral: {p.doh_low:.0f})"))),
        alert(over, "SOBRESTOCK", F.concat(
            F.lit("DOH = "), _fixed(doh, 0), F.lit(" dias | dem. semanal ref: "), _fixed(weekly, 1), F.lit(" uds"))),
        alert(over_soon, "SOBRESTOCK", F.concat(
            F.lit("Cobertura futura "), _fixed(cover, 0), F.lit(" dias (stock+tránsito="), future.cast("string"), F.lit(" uds)"))),
        alert(spike, "PICO_DEMANDA", F.concat(
            F.lit("Ventas "), sold.cast("string"), F.lit(" uds -- promedio historico "), _fixed(mean, 1), F.lit(" uds (+"),
            _fixed(F.try_divide(sold - mean, mean) * 100, 0), F.lit("%)"))),
    ))
    fields = [*keep, *KEYS, "marca", "modelo"]
    live = kpi.filter(not_muted(F.col("estado"), p.muted_states))
    out = live.select(*fields, F.inline(found))
    if predictions is None:
        return out
    short = predictions.filter(~F.col("cobertura_ok") & (F.col("stock_actual") > 0)).select(
        *fields, F.lit("COBERTURA_INSUFICIENTE").alias("tipo_alerta"),
        F.concat(F.lit("Stock "), F.col("stock_actual").cast("string"), F.lit(" uds -- demanda predicha "),
                 _fixed(F.col("demanda_pred_7d"), 1), F.lit(" uds proxima semana")).alias("detalle"))
    return out.unionByName(short)


def order_quantity(stock: Column, weekly: Column, coming: Column, p: StreamParams = P) -> Column:
    """Units to order: cover target minus what will be there, at most twice the target."""
    if p.lead_days is not None:
        share = p.lead_days / 7.0
    else:
        share = p.lead_windows / (7 * 24 * 3600 / p.interval_seconds)
    used = F.greatest(F.lit(1.0), weekly * F.lit(share))
    on_arrival = F.greatest(F.lit(0.0), stock.cast("double") - used) + coming.cast("double")
    target = weekly * F.lit(float(p.cover_weeks))
    units = F.greatest(F.lit(0).cast("bigint"), (target - on_arrival).cast("bigint"))
    return F.when(weekly > 0, F.least(units, (target * 2).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


NEED_STOCK = ("STOCKOUT", "COBERTURA_INSUFICIENTE", "DOH_BAJO")


def transit_orders(
    state: DataFrame, alert_rows: DataFrame, predictions: DataFrame | None, window: int | Column, p: StreamParams = P
) -> DataFrame:
    """A suggested transit for each alerted key that has none on its way."""
    wanted = alert_rows.filter(F.col("tipo_alerta").isin(list(NEED_STOCK))).select(*KEYS).distinct()
    open_keys = state.filter(F.size("en_camino") > 0).select(*KEYS)
    rows = state.join(wanted, KEYS, "left_semi").join(open_keys, KEYS, "left_anti")
    if predictions is not None:
        rows = rows.join(predictions.select(*KEYS, "demanda_pred_7d"), KEYS, "left")
    else:
        rows = rows.withColumn("demanda_pred_7d", F.lit(None).cast("double"))
    from_history = F.when(F.size("historial") >= 4, mean_of(last_items(F.col("historial"), 4))).otherwise(F.lit(1.0))
    rows = rows.withColumn("_dem", F.coalesce("demanda_pred_7d", from_history))
    rows = rows.withColumn("cantidad_sugerida", order_quantity(F.col("stock"), F.col("_dem"), in_transit(), p))
    now = F.lit(window) if isinstance(window, int) else window
    cover = F.coalesce(F.try_divide(F.col("stock").cast("double"), F.when(F.col("_dem") > 0, F.col("_dem"))) * 7, F.lit(0.0))
    return rows.filter("cantidad_sugerida > 0").select(
        F.lit("TRANSITO_SUGERIDO").alias("tipo_orden"), *KEYS, "modelo", "marca", "tier",
        F.col("stock").alias("stock_actual"), rounded_even(F.col("_dem"), 1).alias("demanda_semanal"),
        "cantidad_sugerida", rounded_even(cover, 1).alias("cobertura_actual_dias"),
        F.lit(p.cover_weeks * 7).alias("cobertura_objetivo_dias"),
        (now + p.lead_windows).cast("bigint").alias("ventana_llegada"),
        F.lit(f"Cobertura por debajo del objetivo de {p.cover_weeks} semanas").alias("motivo"),
    )


def _best_two(candidates: DataFrame, group: list[str]) -> DataFrame:
    """First and second candidate of each group: the second serves the first itself."""
    best = Window.partitionBy(*group).orderBy(F.desc("modelo"), F.desc("dem"), F.asc("codigo_sku"))
    top = candidates.withColumn("_n", F.row_number().over(best)).filter("_n <= 2")
    pick = F.struct("codigo_sku", "modelo", "familia", "dem")
    return top.groupBy(*group).agg(
        F.max(F.when(F.col("_n") == 1, pick)).alias("_one"), F.max(F.when(F.col("_n") == 2, pick)).alias("_two"))


def substitutes(targets: DataFrame, state: DataFrame) -> DataFrame:
    """Best substitute of each target: same country, brand, tier and family, else without family.

    Newest model name first, then demand. A target needs its group's best member other
    than itself, which is one of the group's first two, so members are never paired.
    """
    hist = F.col("historial")
    demand = F.when(F.size(hist) >= 1, mean_of(last_items(hist, 4))).otherwise(F.lit(0.0))
    candidates = state.withColumn("_d", demand).filter("_d > 0").select(
        *KEYS, "modelo", "familia", "marca", "tier", rounded_even(F.col("_d"), 1).alias("dem"))
    wide = ["pais", "marca", "tier"]
    near = _best_two(candidates, [*wide, "familia"]).withColumnsRenamed({"_one": "_n1", "_two": "_n2"})
    far = _best_two(candidates, wide)
    rows = targets.join(near, [*wide, "familia"], "left").join(far, wide, "left")

    def other(a: str, b: str) -> Column:
        return F.when(F.col(f"{a}.codigo_sku") != F.col("codigo_sku"), F.col(a)).otherwise(F.col(b))

    close, loose = other("_n1", "_n2"), other("_one", "_two")
    no_family = F.coalesce(F.col("familia"), F.lit("")) == ""
    pick = F.when(no_family, loose).otherwise(F.coalesce(close, loose))
    level = F.when(F.when(no_family, loose).otherwise(close).isNotNull(), 1).when(loose.isNotNull(), 2).otherwise(0)
    return rows.withColumns({"_pick": pick, "nivel_busqueda": level}).select(
        *targets.columns,
        F.coalesce("_pick.codigo_sku", F.lit("SIN_SUSTITUTO")).alias("sku_sustituto"),
        F.coalesce("_pick.modelo", F.lit("")).alias("modelo_sustituto"),
        F.coalesce("_pick.familia", F.lit("")).alias("familia_sustituto"),
        "nivel_busqueda", F.coalesce("_pick.dem", F.lit(0.0)).alias("dem_sustituto"),
    )


def substitute_orders(state: DataFrame, p: StreamParams = P) -> DataFrame:
    """A suggested substitute for keys that reach the idle threshold in this window."""
    idle = state.filter((F.col("sin_venta") == p.idle_windows) & (F.col("codigo_sku") != ""))
    rows = substitutes(idle.filter(not_muted(F.col("estado"), p.muted_states)), state)
    zero, none = F.lit(0.0), F.lit(0).cast("bigint")
    return rows.select(
        F.lit("SUSTITUTO_SUGERIDO").alias("tipo_orden"), *KEYS, "modelo", "marca", "tier",
        F.col("stock").alias("stock_actual"), zero.alias("demanda_semanal"), none.alias("cantidad_sugerida"),
        zero.alias("cobertura_actual_dias"), F.lit(0).alias("cobertura_objetivo_dias"), none.alias("ventana_llegada"),
        F.concat(F.col("sin_venta").cast("string"), F.lit(" ventanas sin movimiento")).alias("motivo"),
        "sku_sustituto", "modelo_sustituto", "familia_sustituto", "nivel_busqueda", "dem_sustituto",
    )


def arrivals(state: DataFrame, window: int) -> DataFrame:
    """Add the transits that are due to the stock and take them off the list."""
    due = F.aggregate(
        F.filter("en_camino", lambda x: x["llegada"] <= window), F.lit(0).cast("bigint"),
        lambda acc, x: acc + x["cantidad"])
    return state.withColumns({
        "stock": F.col("stock") + due,
        "en_camino": F.filter("en_camino", lambda x: x["llegada"] > window),
    })


def with_new_transits(state: DataFrame, orders: DataFrame) -> DataFrame:
    """Put the suggested transits on their keys' lists (at most one per key)."""
    new = orders.filter("tipo_orden = 'TRANSITO_SUGERIDO'").select(
        *KEYS, F.struct(F.col("ventana_llegada").alias("llegada"), F.col("cantidad_sugerida").alias("cantidad")).alias("_new"))
    out = state.join(new, KEYS, "left")
    more = F.when(F.col("_new").isNotNull(), F.array_append("en_camino", F.col("_new"))).otherwise(F.col("en_camino"))
    return out.withColumn("en_camino", more).select(*state.columns)
