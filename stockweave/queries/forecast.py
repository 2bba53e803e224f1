"""Weekly series, features, split, metrics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import features as ft
from ..plans import forecast as fc
from ..schemas import ForecastParams
from ..session import shared_folder
from .base import query

# Boosting runs its 500 rounds one after another, a short job per level of each tree.
FULL = ForecastParams()


def _ser_sales(t):
    from ..plans.sales import prepared_sales

    rows = t.typed.filter("TIPO_TRANSACCION = 'SALES'")
    return prepared_sales(rows).join(rows.select("CODIGO_SKU", "FAMILIA").distinct(), "CODIGO_SKU")


WEEK = """
wk AS (
  SELECT CAST(date_trunc('week', FECHA) AS DATE) AS YEAR_WEEK, CODIGO_SKU, FAMILIA, MODELO, MARCA, PAIS,
    sum(VALUE) AS DEMANDA, count(VALUE) AS NUM_TRANSAC, exact_avg(PRECIO_UNITARIO) AS PRECIO_PROM, exact_avg(COSTO) AS COSTO_PROM
  FROM ser WHERE TIPO_TRANSACCION = 'SALES' GROUP BY ALL
),
feat AS (
  SELECT *, lag(DEMANDA, 1) OVER w AS LAG_1W, lag(DEMANDA, 2) OVER w AS LAG_2W, lag(DEMANDA, 4) OVER w AS LAG_4W,
    lag(DEMANDA, 8) OVER w AS LAG_8W, lag(DEMANDA, 13) OVER w AS LAG_13W,
    avg(DEMANDA) OVER (PARTITION BY PAIS, CODIGO_SKU ORDER BY YEAR_WEEK ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS ROLLING_4W_MEAN,
    coalesce(stddev_samp(DEMANDA) OVER (PARTITION BY PAIS, CODIGO_SKU ORDER BY YEAR_WEEK ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0)
      AS ROLLING_4W_STD,
    avg(DEMANDA) OVER (PARTITION BY PAIS, CODIGO_SKU ORDER BY YEAR_WEEK ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS ROLLING_8W_MEAN,
    weekofyear(YEAR_WEEK) AS SEMANA_ANO, month(YEAR_WEEK) AS MES, quarter(YEAR_WEEK) AS TRIMESTRE, year(YEAR_WEEK) AS ANO,
    sin(2 * pi() * weekofyear(YEAR_WEEK) / 52) AS SEMANA_SIN, cos(2 * pi() * weekofyear(YEAR_WEEK) / 52) AS SEMANA_COS,
    sin(2 * pi() * month(YEAR_WEEK) / 12) AS MES_SIN, cos(2 * pi() * month(YEAR_WEEK) / 12) AS MES_COS,
    dense_rank() OVER (ORDER BY PAIS) - 1 AS PAIS_ENC, dense_rank() OVER (ORDER BY FAMILIA) - 1 AS FAMILIA_ENC,
    dense_rank() OVER (ORDER BY MARCA) - 1 AS MARCA_ENC
  FROM wk WINDOW w AS (PARTITION BY PAIS, CODIGO_SKU ORDER BY YEAR_WEEK)
),
ready AS (SELECT * FROM feat WHERE LAG_13W IS NOT NULL),
cut AS (
  SELECT min(YEAR_WEEK) AS CORTE FROM (
    SELECT YEAR_WEEK, sum(count(*)) OVER (ORDER BY YEAR_WEEK) AS c, sum(count(*)) OVER () AS t FROM ready GROUP BY YEAR_WEEK)
  WHERE c > round_even((t - 1) * 0.8, 0)
)"""
RANGE = """
wg AS (
  SELECT CAST(date_trunc('week', FECHA) AS DATE) AS YEAR_WEEK, MARCA, TIER, PAIS, sum(VALUE) AS DEMANDA_GAMA,
    count(VALUE) AS NUM_SKUS, exact_avg(PRECIO_UNITARIO) AS PRECIO_PROM, exact_avg(COSTO) AS COSTO_PROM
  FROM sales GROUP BY ALL
),
gfeat AS (
  SELECT *, lag(DEMANDA_GAMA, 1) OVER w AS LAG_1W, lag(DEMANDA_GAMA, 2) OVER w AS LAG_2W, lag(DEMANDA_GAMA, 4) OVER w AS LAG_4W,
    lag(DEMANDA_GAMA, 8) OVER w AS LAG_8W, lag(DEMANDA_GAMA, 13) OVER w AS LAG_13W,
    avg(DEMANDA_GAMA) OVER w4 AS ROLLING_4W_MEAN, coalesce(stddev_samp(DEMANDA_GAMA) OVER w4, 0) AS ROLLING_4W_STD,
    avg(DEMANDA_GAMA) OVER w8 AS ROLLING_8W_MEAN,
    weekofyear(YEAR_WEEK) AS SEMANA_ANO, month(YEAR_WEEK) AS MES, quarter(YEAR_WEEK) AS TRIMESTRE, year(YEAR_WEEK) AS ANO,
    sin(2 * pi() * weekofyear(YEAR_WEEK) / 52) AS SEMANA_SIN, cos(2 * pi() * weekofyear(YEAR_WEEK) / 52) AS SEMANA_COS,
    sin(2 * pi() * month(YEAR_WEEK) / 12) AS MES_SIN, cos(2 * pi() * month(YEAR_WEEK) / 12) AS MES_COS,
    dense_rank() OVER (ORDER BY PAIS) - 1 AS PAIS_ENC, dense_rank() OVER (ORDER BY MARCA) - 1 AS MARCA_ENC,
    dense_rank() OVER (ORDER BY TIER) - 1 AS TIER_ENC
  FROM wg WINDOW w AS (PARTITION BY PAIS, MARCA, TIER ORDER BY YEAR_WEEK),
    w4 AS (PARTITION BY PAIS, MARCA, TIER ORDER BY YEAR_WEEK ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
    w8 AS (PARTITION BY PAIS, MARCA, TIER ORDER BY YEAR_WEEK ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)
),
ref AS (
  SELECT PAIS, MARCA, TIER, round_even(avg(DEMANDA_GAMA) * 10, 0) / 10 AS DEMANDA_SEMANAL_PROM,
    max(DEMANDA_GAMA) AS DEMANDA_SEMANAL_MAX, round_even(stddev_samp(DEMANDA_GAMA) * 10, 0) / 10 AS DEMANDA_SEMANAL_STD,
    count(*) AS SEMANAS_CON_DATOS, round_even(exact_avg(PRECIO_PROM) * 10, 0) / 10 AS PRECIO_PROM FROM wg GROUP BY ALL
)"""
SERIES = "YEAR_WEEK t, CODIGO_SKU s, PAIS s"


@query("agg_24_demanda_semanal", f"{SERIES}, FAMILIA s, MODELO s, MARCA s, DEMANDA d2, NUM_TRANSAC l, PRECIO_PROM d4, "
       "COSTO_PROM d4", "SELECT * FROM wk", WEEK)
def _(t):
    return ft.weekly_demand(_ser_sales(t))


@query("win_05_06_07_ml_01_features",
       f"{SERIES}, DEMANDA d2, LAG_1W d2, LAG_2W d2, LAG_4W d2, LAG_8W d2, LAG_13W d2, ROLLING_4W_MEAN d4, "
       "ROLLING_4W_STD d4, ROLLING_8W_MEAN d4, SEMANA_ANO l, MES l, TRIMESTRE l, ANO l, SEMANA_SIN d6, SEMANA_COS d6, "
       "MES_SIN d6, MES_COS d6, PRECIO_PROM d4, COSTO_PROM d4, NUM_TRANSAC l, PAIS_ENC l, FAMILIA_ENC l, MARCA_ENC l",
       "SELECT * FROM feat", WEEK)
def _(t):
    return ft.sku_features(ft.weekly_demand(_ser_sales(t)))


@query("ml_03_codigos", f"{SERIES}, PAIS_ENC l, FAMILIA_ENC l, MARCA_ENC l", "SELECT * FROM feat", WEEK)
def _(t):
    return ft.with_codes(ft.weekly_demand(_ser_sales(t)), ft.SKU_CATEGORIES)


def _ready(t):
    return ft.model_rows(ft.sku_features(ft.weekly_demand(_ser_sales(t))), ft.SKU_FEATURES, ft.SKU_TARGET,
                         ["PAIS", "CODIGO_SKU"])


@query("ml_04_corte_temporal", "CORTE t", "SELECT CORTE FROM cut", WEEK)
def _(t):
    return ft.split_week(_ready(t))


@query("ml_04b_lados", "LADO s, INICIO t, FIN t, MUESTRAS l", """
SELECT CASE WHEN YEAR_WEEK <= CORTE THEN 'TRAIN' ELSE 'TEST' END AS LADO, min(YEAR_WEEK) AS INICIO,
  max(YEAR_WEEK) AS FIN, count(*) AS MUESTRAS FROM ready, cut GROUP BY 1""", WEEK)
def _(t):
    return ft.split_summary(ft.with_side(_ready(t)))


@query("ml_12_demanda_por_lado", "YEAR_WEEK t, LADO s, DEMANDA d2", """
SELECT YEAR_WEEK, CASE WHEN YEAR_WEEK <= CORTE THEN 'TRAIN' ELSE 'TEST' END AS LADO, sum(DEMANDA) AS DEMANDA
FROM ready, cut GROUP BY ALL""", WEEK)
def _(t):
    return ft.with_side(_ready(t)).groupBy("YEAR_WEEK", "LADO").agg(F.sum("DEMANDA").alias("DEMANDA"))


NAIVE = WEEK + """,
naive AS (
  SELECT 'Ultima semana' AS MODELO_PRED, YEAR_WEEK, PAIS, CODIGO_SKU, DEMANDA AS Y, LAG_1W AS PRED FROM feat WHERE LAG_1W IS NOT NULL
  UNION ALL SELECT 'Media 4 semanas', YEAR_WEEK, PAIS, CODIGO_SKU, DEMANDA, ROLLING_4W_MEAN FROM feat WHERE LAG_1W IS NOT NULL
)"""
SCORES = """avg(abs(Y - PRED)) AS MAE, sqrt(avg((Y - PRED) * (Y - PRED))) AS RMSE,
  1 - sum((Y - PRED) * (Y - PRED)) / (var_pop(Y) * count(Y)) AS R2,
  avg(CASE WHEN Y > 0 THEN abs((Y - PRED) / Y) END) * 100 AS MAPE, count(*) AS N_MUESTRAS"""
SCORE_COLS = "MAE d4, RMSE d4, R2 d4, MAPE d4, N_MUESTRAS l"


def _naive(t):
    return fc.naive_predictions(ft.with_memory(ft.weekly_demand(_ser_sales(t)), ft.SKU_KEYS, ft.SKU_TARGET))


@query("ml_09_metricas", f"MODELO_PRED s, {SCORE_COLS}", f"SELECT MODELO_PRED, {SCORES} FROM naive GROUP BY 1", NAIVE)
def _(t):
    return fc.metrics(_naive(t))


@query("ml_10_metricas_pais", f"MODELO_PRED s, PAIS s, {SCORE_COLS}",
       f"SELECT MODELO_PRED, PAIS, {SCORES} FROM naive GROUP BY 1, 2", NAIVE)
def _(t):
    return fc.metrics(_naive(t), ["PAIS"])


@query("ord_12_mejor_modelo", f"MODELO_PRED s, {SCORE_COLS}",
       f"SELECT MODELO_PRED, {SCORES} FROM naive GROUP BY 1 ORDER BY MAE LIMIT 1", NAIVE)
def _(t):
    return fc.best_model(fc.metrics(_naive(t)))


@query("ml_12_real_y_pred_semana", "MODELO_PRED s, YEAR_WEEK t, REAL d2, PRED d4",
       "SELECT MODELO_PRED, YEAR_WEEK, sum(Y) AS REAL, sum(PRED) AS PRED FROM naive GROUP BY 1, 2", NAIVE)
def _(t):
    return fc.weekly_totals(_naive(t))


@query("agg_25_demanda_gama", "YEAR_WEEK t, MARCA s, TIER s, PAIS s, DEMANDA_GAMA d2, NUM_SKUS l, PRECIO_PROM d4, "
       "COSTO_PROM d4", "SELECT * FROM wg", RANGE)
def _(t):
    return ft.weekly_range_demand(t.sales)


@query("ml_02_features_gama", "YEAR_WEEK t, MARCA s, TIER s, PAIS s, DEMANDA_GAMA d2, LAG_1W d2, LAG_2W d2, LAG_4W d2, "
       "LAG_8W d2, LAG_13W d2, ROLLING_4W_MEAN d4, ROLLING_4W_STD d4, ROLLING_8W_MEAN d4, SEMANA_ANO l, MES l, TRIMESTRE l, "
       "ANO l, SEMANA_SIN d6, SEMANA_COS d6, MES_SIN d6, MES_COS d6, PRECIO_PROM d4, COSTO_PROM d4, NUM_SKUS l, PAIS_ENC l, "
       "MARCA_ENC l, TIER_ENC l", "SELECT * FROM gfeat", RANGE)
def _(t):
    return ft.range_features(ft.weekly_range_demand(t.sales))


REF_COLS = ("PAIS s, MARCA s, TIER s, DEMANDA_SEMANAL_PROM d1, DEMANDA_SEMANAL_MAX d1, DEMANDA_SEMANAL_STD d1, "
            "SEMANAS_CON_DATOS l, PRECIO_PROM d1")


@query("agg_26_referencia_gama", REF_COLS, "SELECT * FROM ref", RANGE)
def _(t):
    return ft.range_reference(ft.weekly_range_demand(t.sales))


@query("agg_27_sku_nuevo", "PAIS s, CODIGO_SKU s, MARCA s, TIER s, DEMANDA_ESPERADA d1, RANGO_MIN d1, RANGO_MAX d1, "
       "STOCK_SUGERIDO d1", """
SELECT n.*, DEMANDA_SEMANAL_PROM AS DEMANDA_ESPERADA, 
  CASE WHEN DEMANDA_SEMANAL_PROM IS NOT NULL THEN greatest(DEMANDA_SEMANAL_PROM - coalesce(DEMANDA_SEMANAL_STD, 0), 0) END AS RANGO_MIN,
  DEMANDA_SEMANAL_PROM + coalesce(DEMANDA_SEMANAL_STD, 0) AS RANGO_MAX, DEMANDA_SEMANAL_PROM * 4 AS STOCK_SUGERIDO
FROM (SELECT DISTINCT PAIS, CODIGO_SKU, MARCA, TIER FROM mv WHERE ESTADO = 'NEW') n
LEFT JOIN ref USING (PAIS, MARCA, TIER)""", RANGE)
def _(t):
    new = t.movements.filter("ESTADO = 'NEW'").select("PAIS", "CODIGO_SKU", "MARCA", "TIER").distinct()
    return ft.new_sku_forecast(new, ft.range_reference(ft.weekly_range_demand(t.sales)))


@query("agg_28_catalogo_eventos", "CODIGO_SKU s, PAIS s, MODELO s, MARCA s, TIER s, ESTADO s, PRECIO_MED d6, "
       "PRECIO_STD d4, VALUE_MED d6, VALUE_STD d4", """
SELECT CODIGO_SKU, PAIS, min(MODELO) AS MODELO, min(MARCA) AS MARCA, min(TIER) AS TIER, min(ESTADO) AS ESTADO,
  quantile_cont(PRECIO_UNITARIO, 0.5) AS PRECIO_MED, coalesce(stddev_samp(PRECIO_UNITARIO), 0) AS PRECIO_STD,
  quantile_cont(VALUE, 0.5) AS VALUE_MED, coalesce(stddev_samp(VALUE), 0) AS VALUE_STD FROM sales GROUP BY ALL""")
def _(t):
    return fc.sku_event_catalogue(t.sales)


LATEST = """
latest AS (
  SELECT PAIS, CODIGO_SKU, CODIGO_BODEGA, max(FECHA) AS FECHA, last(VALUE ORDER BY FECHA, VALUE) AS VALUE,
    last(MARCA ORDER BY FECHA) AS MARCA FROM inv GROUP BY ALL
)"""


@query("agg_29_ultima_posicion", "PAIS s, CODIGO_SKU s, CODIGO_BODEGA s, FECHA t, VALUE d2, MARCA s",
       "SELECT * FROM latest", LATEST)
def _(t):
    return fc.latest_positions(t.stock.select("PAIS", "CODIGO_SKU", "CODIGO_BODEGA", "FECHA", "VALUE", "MARCA"))


@query("agg_30_stock_inicial", "PAIS s, CODIGO_SKU s, STOCK l",
       "SELECT PAIS, CODIGO_SKU, sum(CAST(VALUE AS BIGINT)) AS STOCK FROM latest GROUP BY ALL", LATEST)
def _(t):
    return fc.initial_stock(fc.latest_positions(t.stock.select("PAIS", "CODIGO_SKU", "CODIGO_BODEGA", "FECHA", "VALUE")))


@query("agg_48_historial_13_semanas", "PAIS s, CODIGO_SKU s, HIST s", """
SELECT PAIS, CODIGO_SKU, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY SEMANA) AS HIST FROM (
  SELECT * FROM (SELECT PAIS, CODIGO_SKU, CAST(date_trunc('week', FECHA) AS DATE) AS SEMANA, sum(VALUE) AS v FROM ser
  WHERE TIPO_TRANSACCION = 'SALES' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY PAIS, CODIGO_SKU ORDER BY SEMANA DESC) <= 13) GROUP BY ALL""")
def _(t):
    h = fc.recent_weeks(t.typed.filter("TIPO_TRANSACCION = 'SALES'"))
    text = F.array_join(F.transform("HISTORIAL", lambda v: v.cast("bigint").cast("string")), ",")
    return h.select("PAIS", "CODIGO_SKU", text.alias("HIST"))


def _checkpoints(t):
    if t.spark.sparkContext.getCheckpointDir() is None:
        t.spark.sparkContext.setCheckpointDir(shared_folder(t.spark))


def _training(t):
    _checkpoints(t)
    return fc.training_rows(_ser_sales(t), FULL).cache()


def _scored(t, name):
    rows = _training(t)
    return fc.metrics(fc.predictions(fc.fit_sku_models(rows, FULL, [name]), rows))


@query("ml_05_regresion_lineal", f"MODELO_PRED s, {SCORE_COLS}")
def _(t):
    return _scored(t, "Regresion Lineal")


@query("ml_06_bosque", f"MODELO_PRED s, {SCORE_COLS}")
def _(t):
    return _scored(t, "Random Forest")


@query("ml_07_boosting", f"MODELO_PRED s, {SCORE_COLS}")
def _(t):
    return _scored(t, "Boosting")


@query("ml_08_boosting_gama", f"MODELO_PRED s, {SCORE_COLS}")
def _(t):
    _checkpoints(t)
    rows = fc.range_training_rows(t.sales, FULL).cache()
    model = fc.fit_range_model(rows, FULL)
    return fc.metrics(fc.predictions({"Boosting Gama": model}, rows, ft.RANGE_TARGET))


@query("ml_11_importancia", "FEATURE s, IMPORTANCIA d4")
def _(t):
    model = fc.fit_sku_models(_training(t), FULL, ["Random Forest"])["Random Forest"]
    return fc.feature_importance(model, ft.SKU_FEATURES, t.spark)


@query("ml_13_resumen", "metrica s, valor s")
def _(t):
    rows = _training(t)
    models = fc.fit_sku_models(rows, FULL, fc.MODEL_NAMES)
    return fc.run_summary(fc.metrics(fc.predictions(models, rows)), rows)


@query("ord_07_candidatos", "CODIGO_SKU s, PAIS s, UNIDADES d2", """
SELECT CODIGO_SKU, PAIS, UNIDADES FROM (
  SELECT CODIGO_SKU, PAIS, max(ESTADO) AS ESTADO, sum(VALUE) AS UNIDADES FROM sales GROUP BY CODIGO_SKU, PAIS
  ORDER BY UNIDADES DESC, PAIS, CODIGO_SKU LIMIT 20) WHERE ESTADO <> 'EOL'""")
def _(t):
    from ..streaming.scoring import candidates

    kpi = t.sales.groupBy(F.col("CODIGO_SKU").alias("codigo_sku"), F.col("PAIS").alias("pais")).agg(
        F.sum("VALUE").alias("ventas_acum"), F.max("ESTADO").alias("estado"))
    return candidates(kpi).select(
        F.col("codigo_sku").alias("CODIGO_SKU"), F.col("pais").alias("PAIS"), F.col("ventas_acum").alias("UNIDADES"))
