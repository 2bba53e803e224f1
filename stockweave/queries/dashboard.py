"""Slices over window KPIs, forecasts and orders rebuilt from the event history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import dashboard as dash
from ..session import frozen
from ..streaming import events as ev
from ..streaming import replay, rules
from .base import query
from .stream import QTY, REPLAY, _predictions, _state
from .stream import _kpis as _last_kpis

# The twin builds every key in every window: the newest state that is not after the window.
WINDOWS = REPLAY + """,
touched AS (
  SELECT *, coalesce(h[greatest(n_ventas - 12, 1):n_ventas], []) AS historial FROM (
    SELECT r.*, x.h FROM rep r LEFT JOIN hist x ON r.pais = x.pais AND r.codigo_sku = x.codigo_sku
    QUALIFY row_number() OVER (PARTITION BY ventana, r.pais, r.codigo_sku ORDER BY ts DESC, evento_id DESC) = 1)
),
grid AS (
  SELECT w.ventana, k.pais, k.codigo_sku, k.ventana AS desde FROM (SELECT DISTINCT ventana FROM evp) w JOIN touched k ON k.ventana <= w.ventana
  QUALIFY row_number() OVER (PARTITION BY w.ventana, k.pais, k.codigo_sku ORDER BY k.ventana DESC) = 1
),
kw0 AS (
  SELECT g.ventana, t.* EXCLUDE (ventana), CASE WHEN len(historial) >= 2 THEN list_avg(historial[-4:]) ELSE 0 END AS wk
  FROM grid g JOIN touched t ON g.pais = t.pais AND g.codigo_sku = t.codigo_sku AND g.desde = t.ventana
),
kw AS (
  SELECT ventana, pais, codigo_sku, familia, modelo, marca, tier, estado AS estado_sku, stock AS stock_actual, ventas_acum, historial,
    round_even(wk * 10, 0) / 10 AS dem_semanal_ref,
    CASE WHEN greatest(wk / 7, ventas_acum / 30) > 0 THEN round_even(stock / greatest(wk / 7, ventas_acum / 30) * 10, 0) / 10
      ELSE 999 END AS doh,
    round_even(ventas_acum * coalesce(precio, 0) * 100, 0) / 100 AS ingreso_acum,
    round_even(coalesce(precio, 0) * 100, 0) / 100 AS precio_prom FROM kw0
),
lastk AS (SELECT * FROM kw WHERE ventana = (SELECT max(ventana) FROM kw)),
pw AS (SELECT *, dem_semanal_ref * 1.5 AS demanda_pred_7d, stock_actual >= dem_semanal_ref * 1.5 AS cobertura_ok FROM kw WHERE estado_sku <> 'EOL'),
lastp AS (SELECT * FROM pw WHERE ventana = (SELECT max(ventana) FROM kw)),
aw AS (
  SELECT ventana, pais, codigo_sku, marca, unnest(list_filter([
    CASE WHEN stock_actual = 0 AND ventas_acum > 0 THEN 'STOCKOUT' WHEN doh > 0 AND doh < 7 THEN 'DOH_BAJO' END,
    CASE WHEN doh > 90 AND stock_actual > 0 AND dem_semanal_ref >= 1 THEN 'SOBRESTOCK' END,
    CASE WHEN list_avg(historial) > 0 AND list_stddev_pop(historial) > 0
      AND ventas_acum > list_avg(historial) + 2 * list_stddev_pop(historial) THEN 'PICO_DEMANDA' END,
    CASE WHEN stock_actual > 0 AND stock_actual < dem_semanal_ref * 1.5 THEN 'COBERTURA_INSUFICIENTE' END], lambda x: x IS NOT NULL)) AS tipo_alerta
  FROM kw WHERE estado_sku <> 'EOL'
),
ow AS (
  SELECT p.*, """ + QTY.format("demanda_pred_7d", "stock_actual") + """ AS cantidad_sugerida, ventana + 5 AS ventana_llegada FROM lastp p
  WHERE (pais, codigo_sku) IN (
    SELECT (pais, codigo_sku) FROM aw WHERE ventana = (SELECT max(ventana) FROM kw) AND tipo_alerta IN ('STOCKOUT', 'COBERTURA_INSUFICIENTE', 'DOH_BAJO'))
)"""
KPI = ("ventana l, pais s, codigo_sku s, stock_actual l, ventas_acum l, dem_semanal_ref d1, doh d1, ingreso_acum d2, "
       "precio_prom d2")


def _states(t):
    """Every key's state and KPIs after each window of 20 events that touches it."""
    rows = replay.replayed(ev.with_count_window(t.events))
    return frozen(rules.kpis(replay.window_states(rows)).withColumn("estado_sku", F.col("estado")))


def _last_window(states):
    return states.agg(F.max("ventana")).scalar()


def _kpis(t):
    """KPIs of all keys in every window."""
    states = _states(t)
    return replay.in_every_window(states, _last_window(states))


def _last(t):
    """KPIs of all keys in the last window: the state after all events."""
    last = ev.with_count_window(t.events).agg(F.max("ventana")).scalar()
    return _last_kpis(t).withColumn("ventana", last).withColumn("estado_sku", F.col("estado"))


def _preds(kpis):
    keep = kpis.select("pais", "codigo_sku", "ventana", "precio_prom")
    return _predictions(kpis).join(keep, ["pais", "codigo_sku"])


def _lasting(states):
    """The states with ``fin``, the last window for which each holds."""
    return states.withColumn("fin", F.coalesce("hasta", _last_window(states)))


def _state_preds(states):
    demand = F.col("dem_semanal_ref") * 1.5
    return states.filter("estado <> 'EOL'").withColumns({"demanda_pred_7d": demand, "cobertura_ok": F.col("stock_actual") >= demand})


def _alerts(kpis, preds, *keep):
    return rules.alerts(kpis, preds, keep=("ventana", *keep))


def _orders(kpis, preds):
    found = rules.transit_orders(kpis, _alerts(kpis, preds), preds, 0)
    arrival = kpis.select("pais", "codigo_sku", "ventana")
    return found.join(arrival, ["pais", "codigo_sku"])


@query("str_07b_kpis_por_ventana", KPI, "SELECT * FROM kw", WINDOWS)
def _(t):
    return _kpis(t)


@query("agg_38_resumen_ventana",
       "ventana l, skus l, con_ventas l, en_stockout l, ventas l, ingreso d2, doh_prom d4", """
SELECT ventana, count(*) AS skus, count(*) FILTER (ventas_acum > 0) AS con_ventas,
  count(*) FILTER (stock_actual = 0) AS en_stockout, sum(ventas_acum) AS ventas, sum(ingreso_acum) AS ingreso,
  avg(doh) FILTER (doh < 999) AS doh_prom FROM kw GROUP BY 1""", WINDOWS)
def _(t):
    return dash.window_totals(_states(t))


EVOL = """SELECT ventana, sum(ventas_acum) AS ventas_tot, avg(doh) FILTER (doh < 999) AS doh_prom,
  count(*) FILTER (stock_actual = 0) AS stockouts FROM kw GROUP BY 1"""


@query("agg_39_evolucion", "ventana l, ventas_tot l, doh_prom d4, stockouts l", EVOL, WINDOWS)
def _(t):
    return dash.evolution_of(dash.window_totals(_states(t)))


@query("win_10_vista_batch", "ventana l, stockouts l, stockouts_batch l", f"""
SELECT *, last_value(CASE WHEN ventana % 12 = 0 THEN stockouts END IGNORE NULLS)
  OVER (ORDER BY ventana ROWS UNBOUNDED PRECEDING) AS stockouts_batch FROM ({EVOL})""", WINDOWS)
def _(t):
    return dash.batch_view(dash.evolution_of(dash.window_totals(_states(t))), 12)


@query("flt_07_08_filtros", KPI, """
SELECT * FROM kw WHERE pais IN ('R1', 'R2') AND marca IN ('M0', 'M1', 'M2') AND tier IN ('T0', 'T1') AND estado_sku = 'ACTIVE'
  AND ventas_acum > 0 AND (contains(lower(codigo_sku), '1') OR contains(lower(modelo), '1'))""", WINDOWS)
def _(t):
    return dash.filtered(
        dash.with_metadata(_kpis(t)), ["R1", "R2"], ["M0", "M1", "M2"], ["T0", "T1"], "ACTIVE", True, " 1 ")


@query("ord_11_ultima_ventana", KPI, "SELECT * FROM lastk", WINDOWS)
def _(t):
    return _last(t)


@query("flt_09_caja_doh_marca", "marca s, N l, Q1 d6, MEDIANA d6, Q3 d6, BIGOTE_INF d6, BIGOTE_SUP d6, ATIPICOS l", """
WITH d AS (SELECT * FROM kw WHERE doh < 200),
q AS (SELECT marca, count(doh) AS N, quantile_cont(doh, 0.25) AS Q1, quantile_cont(doh, 0.5) AS MEDIANA, quantile_cont(doh, 0.75) AS Q3
  FROM d GROUP BY 1),
s AS (SELECT d.marca, doh, q.* EXCLUDE (marca), doh BETWEEN Q1 - 1.5 * (Q3 - Q1) AND Q3 + 1.5 * (Q3 - Q1) AS i FROM d JOIN q ON d.marca = q.marca)
SELECT marca, N, Q1, MEDIANA, Q3, min(doh) FILTER (i) AS BIGOTE_INF, max(doh) FILTER (i) AS BIGOTE_SUP,
  count(*) FILTER (NOT i) AS ATIPICOS FROM s GROUP BY ALL""", WINDOWS)
def _(t):
    from ..plans.profile import box_plot

    # A state is its key's in each window from ``ventana`` to ``fin``.
    states = _lasting(_states(t)).withColumn("veces", F.col("fin") - F.col("ventana") + 1)
    return box_plot(states.filter("doh < 200"), "doh", ["marca"], repeat="veces")


@query("agg_41_cobertura", "ok l, sin_cobertura l",
       "SELECT count(*) FILTER (cobertura_ok) AS ok, count(*) FILTER (NOT cobertura_ok) AS sin_cobertura FROM lastp", WINDOWS)
def _(t):
    return dash.cover_counts(_preds(frozen(_last(t))))


@query("jon_16_stockouts_evitados", "codigo_sku s, pais s, ventana l", """
SELECT * FROM lastp WHERE NOT cobertura_ok AND codigo_sku IN (SELECT codigo_sku FROM ow WHERE cantidad_sugerida > 0)""", WINDOWS)
def _(t):
    kpis = frozen(_last(t))
    preds = _preds(kpis)
    return dash.avoided_stockouts(preds, _orders(kpis, preds))


@query("agg_42_jon_17_sobrestock", "skus l, ahorro_usd d2", """
WITH o AS (SELECT * FROM lastp WHERE demanda_pred_7d > 0 AND stock_actual > demanda_pred_7d * 4),
f AS (SELECT sum(stock_actual) AS s, avg(precio_prom) AS p FROM lastk WHERE codigo_sku IN (SELECT codigo_sku FROM o))
SELECT count(*) AS skus, coalesce(greatest(0, ((SELECT s FROM f) - sum(demanda_pred_7d) * 4) * (SELECT p FROM f)), 0) AS ahorro_usd FROM o
""", WINDOWS)
def _(t):
    kpis = frozen(_last(t))
    return dash.over_stock(_preds(kpis), kpis)


@query("agg_43_batch_vs_stream",
       "alertas l, stockouts l, doh_bajo l, factor_velocidad l, skus_por_s d1, unidades_perdidas l, ahorro d2", """
SELECT count(*) AS alertas, count(*) FILTER (tipo_alerta = 'STOCKOUT') AS stockouts,
  count(*) FILTER (tipo_alerta = 'DOH_BAJO') AS doh_bajo, 28800 AS factor_velocidad,
  round_even((SELECT count(DISTINCT codigo_sku) FROM kw) / 3 * 10, 0) / 10 AS skus_por_s,
  count(*) FILTER (tipo_alerta = 'STOCKOUT') * 48 AS unidades_perdidas,
  count(*) FILTER (tipo_alerta = 'STOCKOUT') * 48 * 250 AS ahorro FROM aw""", WINDOWS)
def _(t):
    kpis = _lasting(_states(t))
    alerts = _alerts(kpis, _state_preds(kpis), "fin")
    return dash.batch_versus_stream(kpis, alerts, weight=F.col("fin") - F.col("ventana") + 1)  # an alert is raised again in each window


@query("agg_44_sin_sustituto", "marca s, skus l", """
SELECT marca, count(*) AS skus FROM st t WHERE NOT EXISTS (
  SELECT 1 FROM st c WHERE c.pais = t.pais AND c.marca = t.marca AND c.tier = t.tier AND c.familia = t.familia
    AND c.codigo_sku <> t.codigo_sku AND c.ventas > 0 AND c.stock > 0)
  AND NOT EXISTS (
  SELECT 1 FROM st c WHERE c.pais = t.pais AND c.marca = t.marca AND c.tier = t.tier AND c.codigo_sku <> t.codigo_sku
    AND c.ventas > 0 AND c.stock > 0)
GROUP BY 1 ORDER BY skus DESC, marca LIMIT 3""", REPLAY)
def _(t):
    state = frozen(_state(t))
    # Only SKUs with stock may substitute here, so that some SKUs are left without one.
    return dash.without_substitute(rules.substitutes(state, state.filter("stock > 0")))


@query("ord_08_top_ventas", "pais s, codigo_sku s, ventas_acum l",
       "SELECT * FROM lastk ORDER BY ventas_acum DESC, pais, codigo_sku LIMIT 15", WINDOWS)
def _(t):
    return dash.top_sold(frozen(_last(t)))


@query("ord_08b_sca_13_top_prediccion", "pais s, codigo_sku s, demanda_pred_7d d1, cobertura_dias l, semaforo s", """
SELECT *, CAST(coalesce(round_even(stock_actual / nullif(demanda_pred_7d / 7, 0), 0), 999) AS BIGINT) AS cobertura_dias,
  CASE WHEN cobertura_ok THEN 'verde' ELSE 'rojo' END AS semaforo
FROM lastp ORDER BY demanda_pred_7d DESC, pais, codigo_sku LIMIT 15""", WINDOWS)
def _(t):
    return dash.top_predicted(_preds(frozen(_last(t))))


@query("ord_08c_top_ordenes", "ventana l, pais s, codigo_sku s, cantidad_sugerida l", """
SELECT * FROM ow WHERE cantidad_sugerida > 0 ORDER BY cantidad_sugerida DESC, ventana DESC, pais, codigo_sku LIMIT 8""", WINDOWS)
def _(t):
    kpis = frozen(_last(t))
    orders = _orders(kpis, _preds(kpis))
    return dash.top_rows(orders, [F.desc("cantidad_sugerida"), F.desc("ventana"), F.asc("pais"), F.asc("codigo_sku")], 8)


@query("ord_10_ultimas_alertas", "ventana l, pais s, codigo_sku s, tipo_alerta s",
       "SELECT * FROM aw ORDER BY ventana DESC, pais, codigo_sku, tipo_alerta LIMIT 20", WINDOWS)
def _(t):
    kpis = _lasting(_states(t))
    alerts = _alerts(kpis, _state_preds(kpis), "fin")
    # One of the newest 20 has fewer than 20 later ones, so it is among the last 20 windows of its state.
    rows = alerts.withColumn("ventana", F.explode(F.sequence(F.greatest("ventana", F.col("fin") - 19), "fin")))
    return dash.latest_rows(rows, 20, ("pais", "codigo_sku", "tipo_alerta"))


@query("ddp_03b_opciones_filtro", "marca s", "SELECT DISTINCT marca FROM kw WHERE marca IS NOT NULL", WINDOWS)
def _(t):
    return dash.choices(_last(t), "marca")
