"""Event windows, keyed state, rules, orders and the micro-batch job."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import last_items, mean_of, population_std
from ..functions.arrays import from_end
from ..plans import forecast as fc
from ..session import frozen, shared_folder
from ..streaming import events as ev
from ..streaming import fold, replay, rules
from ..streaming.run import StreamJob
from ..streaming.scoring import predicted
from ..streaming.state import stock_accounts
from .base import query

REPLAY = """
evp AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY ts, evento_id) - 1) / 20) + 1 AS BIGINT) AS ventana FROM ev),
seg AS (
  SELECT *, sum(CASE WHEN tipo_evento = 'INVENTORY' THEN 1 ELSE 0 END) OVER k AS segmento,
    sum(CASE WHEN tipo_evento = 'SALES' THEN value ELSE 0 END) OVER k AS ventas_acum,
    sum(CASE WHEN tipo_evento = 'SALES' THEN 1 ELSE 0 END) OVER k AS n_ventas,
    last_value(CASE WHEN tipo_evento = 'SALES' THEN precio_unitario END IGNORE NULLS) OVER k AS precio
  FROM evp WINDOW k AS (PARTITION BY pais, codigo_sku ORDER BY ts, evento_id ROWS UNBOUNDED PRECEDING)
),
rep AS (
  SELECT *, greatest(0, sum(CASE WHEN tipo_evento = 'INVENTORY' THEN value ELSE 0 END) OVER s
    - sum(CASE WHEN tipo_evento = 'SALES' THEN value ELSE 0 END) OVER s) AS stock
  FROM seg WINDOW s AS (PARTITION BY pais, codigo_sku, segmento ORDER BY ts, evento_id ROWS UNBOUNDED PRECEDING)
),
hist AS (SELECT pais, codigo_sku, list(value ORDER BY ts, evento_id) AS h FROM ev WHERE tipo_evento = 'SALES' GROUP BY ALL),
st AS (
  SELECT r.pais, r.codigo_sku, familia, modelo, marca, tier, estado, stock, ventas_acum AS ventas, coalesce(precio, 0) AS precio,
    coalesce(h[-13:], []) AS historial
  FROM rep r LEFT JOIN hist x ON r.pais = x.pais AND r.codigo_sku = x.codigo_sku
  QUALIFY row_number() OVER (PARTITION BY r.pais, r.codigo_sku ORDER BY ts DESC, evento_id DESC) = 1
),
sk AS (SELECT *, CASE WHEN len(historial) >= 2 THEN list_avg(historial[-4:]) ELSE 0 END AS w FROM st),
kpi AS (
  SELECT *, stock AS stock_actual, ventas AS ventas_acum, round_even(w * 10, 0) / 10 AS dem_semanal_ref,
    CASE WHEN greatest(w / 7, ventas / 30) > 0 THEN round_even(stock / greatest(w / 7, ventas / 30) * 10, 0) / 10 ELSE 999 END AS doh,
    CASE WHEN ventas + stock > 0 THEN round_even(ventas / (ventas + stock) * 1000, 0) / 1000 ELSE 0 END AS sell_through,
    round_even(ventas * precio * 100, 0) / 100 AS ingreso_acum, round_even(precio * 100, 0) / 100 AS precio_prom FROM sk
),
pred AS (
  SELECT *, dem_semanal_ref * 1.5 AS demanda_pred_7d, stock_actual >= dem_semanal_ref * 1.5 AS cobertura_ok FROM kpi WHERE estado <> 'EOL'
),
base_alerts AS (
  SELECT pais, codigo_sku, marca, modelo, CASE WHEN stock_actual = 0 AND ventas_acum > 0 THEN 'STOCKOUT'
    WHEN doh > 0 AND doh < 7 THEN 'DOH_BAJO' END AS tipo_alerta, stock_actual, ventas_acum, doh FROM kpi WHERE estado <> 'EOL'
  UNION ALL
  SELECT pais, codigo_sku, marca, modelo, CASE WHEN doh > 90 AND stock_actual > 0 AND dem_semanal_ref >= 1 THEN 'SOBRESTOCK' END,
    stock_actual, ventas_acum, doh FROM kpi WHERE estado <> 'EOL'
  UNION ALL
  SELECT pais, codigo_sku, marca, modelo, CASE WHEN list_avg(historial) > 0 AND list_stddev_pop(historial) > 0
      AND ventas_acum > list_avg(historial) + 2 * list_stddev_pop(historial) THEN 'PICO_DEMANDA' END,
    stock_actual, ventas_acum, doh FROM kpi WHERE estado <> 'EOL'
),
al AS (
  SELECT * FROM base_alerts WHERE tipo_alerta IS NOT NULL
  UNION ALL SELECT pais, codigo_sku, marca, modelo, 'COBERTURA_INSUFICIENTE', stock_actual, ventas_acum, doh FROM pred
  WHERE NOT cobertura_ok AND stock_actual > 0
)"""
KEY = "pais s, codigo_sku s"
LEAD = "greatest(1, {0} * (5 / (7 * 24 * 3600 / 3)))"
QTY = ("CASE WHEN {0} > 0 THEN least(greatest(0, trunc({0} * 4 - greatest(0, {1} - " + LEAD + "))), trunc({0} * 8)) ELSE 0 END")


def _state(t):
    """The state after all events, as one fold."""
    return fold.folded(fold.empty_state(t.spark), t.events)


def _kpis(t):
    return rules.kpis(_state(t))


def _predictions(kpi):
    demand = F.col("dem_semanal_ref") * 1.5
    return kpi.filter("estado <> 'EOL'").select(
        "pais", "codigo_sku", "modelo", "marca", "tier", "stock_actual", demand.alias("demanda_pred_7d"),
        (F.col("stock_actual") >= demand).alias("cobertura_ok"))


def _alerts(t):
    kpi = _kpis(t)
    return rules.alerts(kpi, _predictions(kpi))


@query("str_02_ventana_de_20", "ventana l, eventos l, unidades l",
       "SELECT ventana, count(*) AS eventos, sum(value) AS unidades FROM evp GROUP BY 1", REPLAY)
def _(t):
    return ev.with_count_window(t.events).groupBy("ventana").agg(
        F.count("*").alias("eventos"), F.sum("value").alias("unidades"))


FIVE = """
SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS inicio, pais, count(*) AS eventos,
  sum(CASE WHEN tipo_evento = 'SALES' THEN value ELSE 0 END) AS unidades,
  sum(CASE WHEN tipo_evento = 'SALES' THEN value * precio_unitario ELSE 0 END) AS ingreso FROM ev {} GROUP BY ALL"""


def _shown(df):
    return df.withColumn("inicio", F.date_format("inicio", "yyyy-MM-dd HH:mm"))


@query("str_03_ventana_5_minutos", "inicio s, pais s, eventos l, unidades l, ingreso d2", FIVE.format(""))
def _(t):
    return _shown(ev.per_five_minutes(t.events))


def _run_dir(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _event_stream(t, batches=4):
    """The events as JSON lines in event order, read as a stream of so many micro-batches."""
    folder = _run_dir(t, "topic")
    files = ev.export_lines(t.events, folder, batches)
    return ev.once(ev.valid_events(ev.line_stream(t.spark, folder, files)), "60 days")


@query("str_03b_ventana_5_minutos_stream", "inicio s, pais s, eventos l, unidades l, ingreso d2", FIVE.format(
    "WHERE time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE"))
def _(t):
    topic, out, state = _run_dir(t, "topic"), _run_dir(t, "five"), _run_dir(t, "five-state")
    files = ev.export_lines(t.events, topic, 4)
    stream = ev.per_five_minutes(ev.valid_events(ev.line_stream(t.spark, topic, files)))
    job = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    job.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _shown(t.spark.read.parquet(out))


STATE_COLS = f"{KEY}, marca s, tier s, estado s, stock l, ventas l, precio d2, hist s"
STATE_SQL = "SELECT *, array_to_string(historial, ',') AS hist FROM st"


def _with_hist(df):
    return df.withColumn("hist", F.array_join(F.transform("historial", lambda v: v.cast("string")), ","))


@query("str_04_estado_stream", STATE_COLS, STATE_SQL, REPLAY)
def _(t):
    out, check = _run_dir(t, "accounts"), _run_dir(t, "accounts-state")
    accounts = stock_accounts(_event_stream(t))

    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/lote={batch_id}")

    accounts.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", check).trigger(
        availableNow=True).start().awaitTermination()
    written = t.spark.read.parquet(out)
    last = written.groupBy("pais", "codigo_sku").agg(
        F.max_by(F.struct("marca", "tier", "estado", "stock", "ventas", "precio", "historial"), "lote").alias("s"))
    return _with_hist(last.select("pais", "codigo_sku", "s.*"))


@query("str_04b_estado_por_lote", STATE_COLS, STATE_SQL, REPLAY)
def _(t):
    return _with_hist(_state(t))


@query("str_05_replay", f"evento_id s, {KEY}, segmento l, stock l, ventas_acum l", "SELECT * FROM rep", REPLAY)
def _(t):
    return replay.replayed(t.events)


@query("str_06_estado_inicial", f"{KEY}, marca s, tier s, estado s, stock l, precio d4", """
SELECT PAIS AS pais, CODIGO_SKU AS codigo_sku, max(MARCA) AS marca, max(TIER) AS tier, max(ESTADO) AS estado,
  sum(CAST(v AS BIGINT)) AS stock, arg_max(p, {'d': FECHA, 'p': p}) AS precio FROM (
  SELECT PAIS, CODIGO_SKU, CODIGO_BODEGA, max(FECHA) AS FECHA, last(VALUE ORDER BY FECHA, VALUE) AS v,
    last(PRECIO_UNITARIO ORDER BY FECHA, PRECIO_UNITARIO) AS p, max(MARCA) AS MARCA, max(TIER) AS TIER, max(ESTADO) AS ESTADO
  FROM inv GROUP BY ALL) GROUP BY ALL""")
def _(t):
    stock = t.movements.filter("TIPO_TRANSACCION = 'INVENTORY'").select(
        "PAIS", "CODIGO_SKU", "CODIGO_BODEGA", "FECHA", "VALUE", "FAMILIA", "MODELO", "MARCA", "TIER", "ESTADO",
        "PRECIO_UNITARIO")
    latest = fc.latest_positions(stock)
    return fold.initial_state(fc.initial_stock(latest), latest)


@query("str_07_kpis", f"{KEY}, stock_actual l, ventas_acum l, dem_semanal_ref d1, doh d1, sell_through d3, ingreso_acum d2, "
       "precio_prom d2", "SELECT * FROM kpi", REPLAY)
def _(t):
    return _kpis(t)


@query("str_08_a_14_alertas", f"{KEY}, marca s, modelo s, tipo_alerta s", "SELECT * FROM al", REPLAY)
def _(t):
    return _alerts(t)


@query("sca_14_detalle_alerta", f"{KEY}, tipo_alerta s, detalle s", """
SELECT *, CASE tipo_alerta WHEN 'STOCKOUT' THEN 'Stock = 0 con ' || ventas_acum || ' uds vendidas'
  ELSE 'DOH = ' || printf('%.1f', doh) || ' dias (umbral: 7)' END AS detalle
FROM al WHERE tipo_alerta IN ('STOCKOUT', 'DOH_BAJO')""", REPLAY)
def _(t):
    return _alerts(t).filter("tipo_alerta IN ('STOCKOUT', 'DOH_BAJO')")


@query("str_11_sobrestock_anticipado", f"{KEY}, tipo_alerta s", """
SELECT pais, codigo_sku, 'SOBRESTOCK' AS tipo_alerta FROM kpi WHERE estado <> 'EOL' AND dem_semanal_ref >= 1
  AND ((doh > 90 AND stock_actual > 0) OR (stock_actual + ventas_acum) / (dem_semanal_ref / 7) > 120)""", REPLAY)
def _(t):
    coming = F.array(F.struct(F.lit(9).cast("bigint").alias("llegada"), F.col("ventas").alias("cantidad")))
    kpi = rules.kpis(_state(t).withColumn("en_camino", F.when(F.col("ventas") > 0, coming).otherwise(F.col("en_camino"))))
    return rules.alerts(kpi).filter("tipo_alerta = 'SOBRESTOCK'")


@query("agg_40_alertas_por_tipo", "tipo_alerta s, alertas l", "SELECT tipo_alerta, count(*) AS alertas FROM al GROUP BY 1", REPLAY)
def _(t):
    from ..plans.dashboard import alert_counts

    return alert_counts(_alerts(t))


@query("out_03_pico_demanda", f"{KEY}, media d4, desv d4, pico b", """
SELECT *, list_avg(historial) AS media, list_stddev_pop(historial) AS desv,
  ventas > list_avg(historial) + 2 * list_stddev_pop(historial) AS pico FROM st WHERE len(historial) > 0""", REPLAY)
def _(t):
    h = F.col("historial")
    rows = _state(t).filter(F.size(h) > 0).withColumns({"media": mean_of(h), "desv": population_std(h)})
    return rows.withColumn("pico", F.col("ventas") > F.col("media") + 2 * F.col("desv"))


@query("sca_12_arreglos", f"{KEY}, n l, ult l, ult4 l, media4 d4, media8 d4, desv4 d4", """
SELECT *, len(historial) AS n, historial[-1] AS ult, coalesce(historial[-4], historial[1]) AS ult4,
  list_avg(historial[-4:]) AS media4, list_avg(historial[-8:]) AS media8, list_stddev_pop(historial[-4:]) AS desv4
FROM st WHERE len(historial) > 0""", REPLAY)
def _(t):
    h = F.col("historial")
    return _state(t).filter(F.size(h) > 0).select(
        "pais", "codigo_sku", F.size(h).alias("n"), from_end(h, 1).alias("ult"), from_end(h, 4).alias("ult4"),
        mean_of(last_items(h, 4)).alias("media4"), mean_of(last_items(h, 8)).alias("media8"),
        population_std(last_items(h, 4)).alias("desv4"))


@query("str_15_cantidad_reponer", f"{KEY}, cantidad l", f"SELECT *, {QTY.format('w', 'stock')} AS cantidad FROM sk", REPLAY)
def _(t):
    h = F.col("historial")
    w = F.when(F.size(h) >= 2, mean_of(last_items(h, 4))).otherwise(F.lit(0.0))
    return _state(t).withColumn("cantidad", rules.order_quantity(F.col("stock"), w, F.lit(0)))


ORDERS = REPLAY + f""",
need AS (
  SELECT DISTINCT a.pais, a.codigo_sku FROM al a JOIN st s ON a.pais = s.pais AND a.codigo_sku = s.codigo_sku
  WHERE tipo_alerta IN ('STOCKOUT', 'COBERTURA_INSUFICIENTE', 'DOH_BAJO') AND s.tier <> 'T0'
),
ords AS (
  SELECT *, {QTY.format('d', 'stock')} AS cantidad_sugerida FROM (
    SELECT s.*, coalesce(p.demanda_pred_7d, CASE WHEN len(s.historial) >= 4 THEN list_avg(s.historial[-4:]) ELSE 1.0 END) AS d
    FROM st s JOIN need n ON s.pais = n.pais AND s.codigo_sku = n.codigo_sku
    LEFT JOIN (SELECT * FROM pred WHERE familia = 'F1') p ON s.pais = p.pais AND s.codigo_sku = p.codigo_sku)
)"""


@query("str_16_jon_18_19_transitos_sugeridos",
       f"{KEY}, stock_actual l, demanda_semanal d1, cantidad_sugerida l, cobertura_actual_dias d1, ventana_llegada l", """
SELECT *, stock AS stock_actual, round_even(d * 10, 0) / 10 AS demanda_semanal,
  coalesce(round_even(stock / nullif(d, 0) * 7 * 10, 0) / 10, 0) AS cobertura_actual_dias, 12 AS ventana_llegada
FROM ords WHERE cantidad_sugerida > 0""", ORDERS)
def _(t):
    state = frozen(_state(t))
    kpi = rules.kpis(state)
    preds = _predictions(kpi)
    # Keys of tier T0 already have a transit; only family F1 has a forecast.
    open_transit = F.array(F.struct(F.lit(9).cast("bigint").alias("llegada"), F.lit(1).cast("bigint").alias("cantidad")))
    marked = state.withColumn("en_camino", F.when(F.col("tier") == "T0", open_transit).otherwise(F.col("en_camino")))
    some = preds.join(state.filter("familia = 'F1'").select("pais", "codigo_sku"), ["pais", "codigo_sku"], "left_semi")
    return rules.transit_orders(marked, rules.alerts(kpi, preds), some, 7)


@query("str_17_llegadas", f"{KEY}, stock l, pendientes l", """
SELECT *, stock + ventas AS stock, CASE WHEN ventas > 0 THEN 1 ELSE 0 END AS pendientes FROM (SELECT pais, codigo_sku, stock, ventas FROM st)
""".replace("SELECT *, stock + ventas AS stock", "SELECT pais, codigo_sku, stock + ventas AS stock"), REPLAY)
def _(t):
    def arrival(window):
        return F.struct(F.lit(window).cast("bigint").alias("llegada"), F.col("ventas").alias("cantidad"))

    state = _state(t)
    listed = F.when(F.col("ventas") > 0, F.array(arrival(5), arrival(6))).otherwise(F.col("en_camino"))
    out = rules.arrivals(state.withColumn("en_camino", listed), 5)
    return out.withColumn("pendientes", F.size("en_camino"))


IDLE = REPLAY + """,
idle AS (
  SELECT pais, codigo_sku, (SELECT max(ventana) FROM evp) - coalesce(max(CASE WHEN tipo_evento = 'SALES' THEN ventana END),
    min(ventana) - 1) AS sin_venta FROM evp GROUP BY pais, codigo_sku
)"""


@query("str_18_win_11_inactividad", f"{KEY}, sin_venta l", "SELECT * FROM idle", IDLE)
def _(t):
    rows = ev.with_count_window(t.events)
    windows = rows.agg(F.max("ventana")).first()[0]
    return replay.idle_windows(rows, windows)


SUBS = REPLAY + """,
cand AS (
  SELECT pais, codigo_sku, modelo, familia, marca, tier, round_even(list_avg(historial[-4:]) * 10, 0) / 10 AS dem
  FROM st WHERE len(historial) >= 1 AND list_avg(historial[-4:]) > 0
),
subs AS (
  SELECT t.pais, t.codigo_sku, c.codigo_sku AS s, c.modelo AS m, c.familia AS f, c.dem AS d,
    CASE WHEN c.codigo_sku IS NULL THEN 0 WHEN c.familia = t.familia THEN 1 ELSE 2 END AS nivel
  FROM st t LEFT JOIN cand c ON t.pais = c.pais AND t.marca = c.marca AND t.tier = c.tier AND t.codigo_sku <> c.codigo_sku
  QUALIFY row_number() OVER (PARTITION BY t.pais, t.codigo_sku ORDER BY nivel, m DESC, d DESC, s) = 1
)"""
SUB_COLS = f"{KEY}, sku_sustituto s, modelo_sustituto s, familia_sustituto s, nivel_busqueda l, dem_sustituto d1"
SUB_SQL = """SELECT pais, codigo_sku, coalesce(s, 'SIN_SUSTITUTO') AS sku_sustituto, coalesce(m, '') AS modelo_sustituto,
  coalesce(f, '') AS familia_sustituto, nivel AS nivel_busqueda, coalesce(d, 0) AS dem_sustituto FROM subs"""


@query("jon_15_ord_09_sustitutos", SUB_COLS, SUB_SQL, SUBS)
def _(t):
    state = frozen(_state(t))
    return rules.substitutes(state.select("pais", "codigo_sku", "familia", "marca", "tier"), state)


@query("str_18b_sustitutos_sugeridos", SUB_COLS,
       SUB_SQL + " WHERE (pais, codigo_sku) IN (SELECT (pais, codigo_sku) FROM st WHERE stock = 0 AND estado <> 'EOL')", SUBS)
def _(t):
    state = frozen(_state(t)).withColumn("sin_venta", F.when(F.col("stock") == 0, F.lit(4)).otherwise(F.lit(0)))
    return rules.substitute_orders(state)


JOB_WINDOWS, JOB_LEAD = 4, 2
#: The job step by step: what each window's events say of a key, then stock and the open transit from window to window.
JOB = f"""
evn AS (
  SELECT *, CAST(floor((row_number() OVER (ORDER BY ts, evento_id) - 1) / ceil((SELECT count(*) FROM ev) / {JOB_WINDOWS})) + 1
    AS BIGINT) AS v FROM ev
),
evs AS (
  SELECT *, count(*) FILTER (tipo_evento = 'INVENTORY') OVER (PARTITION BY pais, codigo_sku, v) AS tomas,
    count(*) FILTER (tipo_evento = 'INVENTORY') OVER (PARTITION BY pais, codigo_sku, v ORDER BY ts, evento_id
      ROWS UNBOUNDED PRECEDING) AS toma FROM evn
),
steps AS (
  SELECT pais, codigo_sku, estado, v FROM (SELECT pais, codigo_sku, min(estado) AS estado, min(v) AS v0 FROM evn GROUP BY ALL)
  JOIN (SELECT DISTINCT v FROM evn) ON v >= v0
),
acc AS (
  SELECT p.pais, p.codigo_sku, p.estado, p.v, coalesce(sum(value) FILTER (tipo_evento = 'SALES'), 0) AS ventas,
    coalesce(sum(value) FILTER (tipo_evento = 'SALES' AND e.v = p.v), 0) AS vendidas,
    max(value) FILTER (tipo_evento = 'INVENTORY' AND e.v = p.v AND toma = tomas) AS foto,
    coalesce(sum(value) FILTER (tipo_evento = 'SALES' AND e.v = p.v AND toma = tomas), 0) AS tras_foto,
    coalesce(arg_max(precio_unitario, {{'t': ts, 'e': evento_id}}) FILTER (tipo_evento = 'SALES'), 0) AS precio,
    coalesce((list(value ORDER BY ts, evento_id) FILTER (tipo_evento = 'SALES'))[-13:], []) AS historial
  FROM steps p JOIN evs e ON e.pais = p.pais AND e.codigo_sku = p.codigo_sku AND e.v <= p.v GROUP BY ALL
),
dem AS (
  SELECT *, greatest(CASE WHEN len(historial) >= 2 THEN list_avg(historial[-4:]) ELSE 0 END / 7, ventas / 30) AS diaria,
    CASE WHEN len(historial) >= 4 THEN list_avg(historial[-4:]) ELSE 1.0 END AS semanal FROM acc
),
sim AS (
  WITH RECURSIVE s AS (
    SELECT pais, codigo_sku, min(v) - 1 AS v, CAST(0 AS BIGINT) AS stock, CAST(0 AS BIGINT) AS sin_venta,
      CAST(NULL AS BIGINT) AS llegada, CAST(NULL AS BIGINT) AS cantidad FROM dem GROUP BY ALL
    UNION ALL
    SELECT pais, codigo_sku, v, CAST(tras AS BIGINT), CAST(sin_venta AS BIGINT),
      CAST(CASE WHEN pedir > 0 THEN v + {JOB_LEAD} WHEN abierto THEN llegada END AS BIGINT),
      CAST(CASE WHEN pedir > 0 THEN pedir WHEN abierto THEN cantidad END AS BIGINT)
    FROM (
      SELECT *, CASE WHEN estado <> 'EOL' AND NOT abierto AND ((antes = 0 AND ventas > 0) OR (doh > 0 AND doh < 7)) THEN
        least(greatest(0, trunc(semanal * 4 - greatest(0, tras - greatest(1, semanal * ({JOB_LEAD} / (7 * 24 * 3600 / 3)))))),
          trunc(semanal * 8)) ELSE 0 END AS pedir
      FROM (
        SELECT *, antes + CASE WHEN llegada <= v THEN cantidad ELSE 0 END AS tras, coalesce(llegada > v, FALSE) AS abierto,
          CASE WHEN diaria > 0 THEN round_even(antes / diaria * 10, 0) / 10 ELSE 999 END AS doh
        FROM (
          SELECT d.*, s.llegada, s.cantidad, CASE WHEN vendidas > 0 THEN 0 ELSE s.sin_venta + 1 END AS sin_venta,
            CASE WHEN foto IS NOT NULL THEN greatest(0, foto - tras_foto) ELSE greatest(0, s.stock - vendidas) END AS antes
          FROM s JOIN dem d ON d.pais = s.pais AND d.codigo_sku = s.codigo_sku AND d.v = s.v + 1)))
  )
  SELECT * FROM s
)"""


@query("str_01_09_19_20_job", f"ventana l, {KEY}, stock l, ventas l, precio d2, hist s, sin_venta l, llegada l, cantidad l", """
SELECT d.*, d.v AS ventana, stock, sin_venta, llegada, cantidad, array_to_string(historial, ',') AS hist
FROM sim s JOIN dem d ON d.pais = s.pais AND d.codigo_sku = s.codigo_sku AND d.v = s.v""", JOB)
def _(t):
    topic = _run_dir(t, "topic")
    size = -(-t.events.count() // JOB_WINDOWS)
    files = ev.export_batches(ev.with_count_window(t.events, size, "lote"), topic, "lote", range(1, JOB_WINDOWS + 1))
    job = StreamJob(t.spark, _run_dir(t, "job"), rules.StreamParams(lead_windows=JOB_LEAD))
    # Without a delay there is no watermark, whose advance would run a window without events.
    lines = ev.line_stream(t.spark, topic, files)
    job.start(ev.once(ev.valid_events(lines)), _run_dir(t, "job-state")).awaitTermination()
    coming = F.get("en_camino", F.lit(0))  # a key has one open transit at most
    return _with_hist(job.table("estado")).withColumns({"llegada": coming["llegada"], "cantidad": coming["cantidad"]})


@query("snk_05_tablas_del_job", "tabla s, ventanas l, filas l")
def _(t):
    job = StreamJob(t.spark, _run_dir(t, "job"))
    job.start(_event_stream(t, 3), _run_dir(t, "job-state")).awaitTermination()
    parts = [
        job.table(name).agg(F.lit(name).alias("tabla"), F.countDistinct("ventana").alias("ventanas"),
                            F.count("*").alias("filas"))
        for name in ("kpis", "alertas", "ordenes", "estado")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("ml_14_prediccion_en_linea", f"{KEY}, fuente_pred s, demanda_pred_7d d1, stock_actual l, cobertura_ok b")
def _(t):
    from .forecast import FULL, _training

    model = fc.fit_sku_models(_training(t), FULL, ["Random Forest"])["Random Forest"]
    state = frozen(_state(t))
    return predicted(rules.kpis(state), state, model, F.to_date(F.lit("2024-01-31")))


@query("sca_11_json", "tipo_evento s, pais s, n l, unidades l",
       "SELECT tipo_evento, pais, count(*) AS n, sum(value) AS unidades FROM ev GROUP BY ALL")
def _(t):
    back = ev.valid_events(ev.as_lines(t.events))
    return back.groupBy("tipo_evento", "pais").agg(F.count("*").alias("n"), F.sum("value").alias("unidades"))


@query("src_10_lineas_malas", "valida b, n l", """
SELECT TRUE AS valida, count(*) AS n FROM ev UNION ALL SELECT FALSE, count(*) FROM ev WHERE tipo_evento = 'INVENTORY'""")
def _(t):
    lines = ev.as_lines(t.events)
    cut = ev.as_lines(t.events.filter("tipo_evento = 'INVENTORY'")).select(F.expr("left(value, length(value) - 9)").alias("value"))
    rows = ev.parsed(lines.unionByName(cut))
    return rows.groupBy(F.col("VALIDO").alias("valida")).agg(F.count("*").alias("n"))


@query("ddp_04_evento_unico", "n l, ids l", "SELECT count(*) AS n, count(*) AS ids FROM ev")
def _(t):
    return ev.once(t.events.unionByName(t.events)).agg(F.count("*").alias("n"), F.countDistinct("evento_id").alias("ids"))


@query("ord_13_muestra", "tipo s, n l", """
SELECT 'SALES' AS tipo, least(count(*), 4000) AS n FROM sales UNION ALL SELECT 'INVENTORY', least(count(*), 6000) FROM inv""")
def _(t):
    cols = ["TIPO_TRANSACCION", "PAIS", "CODIGO_SKU", "CODIGO_BODEGA", "FECHA", "VALUE", "COSTO"]
    rows = t.movements.select(*cols)
    sample = ev.event_sample(rows.filter("TIPO_TRANSACCION = 'SALES'"), rows.filter("TIPO_TRANSACCION = 'INVENTORY'"), 10_000)
    return sample.groupBy(F.col("TIPO_TRANSACCION").alias("tipo")).agg(F.count("*").alias("n"))


@query("snk_08_eventos_desde_tabla", "tipo_evento s, pais s, n l, unidades l, importe d2", """
SELECT TIPO_TRANSACCION AS tipo_evento, PAIS AS pais, count(*) AS n, sum(CAST(VALUE AS BIGINT)) AS unidades,
  sum(CAST(COSTO AS DECIMAL(20,4))) AS importe
FROM mv WHERE TIPO_TRANSACCION = 'INVENTORY' OR (TIPO_TRANSACCION = 'SALES' AND ESTADO <> 'EOL') GROUP BY ALL""")
def _(t):
    folder = _run_dir(t, "replay")
    events = ev.table_events(t.movements, "SALES").unionByName(ev.table_events(t.movements, "INVENTORY"))
    ev.export_lines(events, folder, compression="gzip")
    back = ev.valid_events(t.spark.read.text(folder))
    return back.groupBy("tipo_evento", "pais").agg(
        F.count("*").alias("n"), F.sum("value").alias("unidades"),
        F.sum(F.col("costo").cast("decimal(20,4)")).alias("importe"))

