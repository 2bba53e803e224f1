"""Exploratory series, correlations and concentration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking
from ..operators.enrich import device_catalogue
from ..operators.quantiles import exact_quantiles
from ..plans import eda
from .base import query


@query("agg_32_resumen_pais",
       "PAIS s, TRANSACCIONES l, UNIDADES d2, COSTO_TOTAL d2, SKU_UNICOS l, BODEGAS_UNICAS l, FECHA_INICIO t, "
       "FECHA_FIN t, PERIODO_DIAS l, UNIDADES_DIA d4", """
SELECT *, FECHA_FIN - FECHA_INICIO AS PERIODO_DIAS, UNIDADES / (FECHA_FIN - FECHA_INICIO) AS UNIDADES_DIA FROM (
  SELECT PAIS, count(VALUE) AS TRANSACCIONES, sum(VALUE) AS UNIDADES, sum(CAST(COSTO AS DECIMAL(20,4))) AS COSTO_TOTAL,
    count(DISTINCT CODIGO_SKU) AS SKU_UNICOS, count(DISTINCT CODIGO_BODEGA) AS BODEGAS_UNICAS,
    min(FECHA) AS FECHA_INICIO, max(FECHA) AS FECHA_FIN FROM sales GROUP BY PAIS)""")
def _(t):
    return eda.country_summary(t.sales)


@query("agg_33_inventario_diario", "FECHA t, PAIS s, CODIGO_SKU s, CODIGO_BODEGA s, VALUE d2", """
SELECT FECHA, PAIS, CODIGO_SKU, CODIGO_BODEGA, sum(VALUE) AS VALUE FROM inv GROUP BY ALL""")
def _(t):
    return eda.daily_stock(t.stock)


COVER = """cov AS (SELECT CODIGO_SKU, min(FECHA) AS PRIMERA, max(FECHA) AS ULTIMA, count(DISTINCT FECHA) AS DIAS_DISTINTOS
  FROM inv GROUP BY 1)"""


@query("agg_35_cobertura_sku", "CODIGO_SKU s, PRIMERA t, ULTIMA t, DIAS_DISTINTOS l", "SELECT * FROM cov", COVER)
def _(t):
    return eda.sku_coverage(t.stock)


@query("agg_35b_cobertura_conteos", "UN_DIA l, MENOS_DE_5 l", """
SELECT count(*) FILTER (DIAS_DISTINTOS = 1) AS UN_DIA, count(*) FILTER (DIAS_DISTINTOS < 5) AS MENOS_DE_5 FROM cov""",
       COVER)
def _(t):
    return eda.coverage_counts(eda.sku_coverage(t.stock))


@query("ord_06_menor_cobertura", "CODIGO_SKU s, DIAS_DISTINTOS l",
       "SELECT * FROM cov ORDER BY DIAS_DISTINTOS, CODIGO_SKU LIMIT 10", COVER)
def _(t):
    return ranking.top_rows(eda.sku_coverage(t.stock), [F.asc("DIAS_DISTINTOS"), F.asc("CODIGO_SKU")], 10)


WEEKLY = """
ws AS (
  SELECT SEMANA, CODIGO_SKU, PAIS, STOCK, VENTAS FROM
  (SELECT CAST(date_trunc('week', FECHA) AS DATE) AS SEMANA, CODIGO_SKU, PAIS, sum(VALUE) AS STOCK FROM ser
   WHERE TIPO_TRANSACCION = 'INVENTORY' GROUP BY ALL)
  JOIN (SELECT CAST(date_trunc('week', FECHA) AS DATE) AS SEMANA, CODIGO_SKU, PAIS, sum(VALUE) AS VENTAS FROM ser
   WHERE TIPO_TRANSACCION = 'SALES' GROUP BY ALL) USING (SEMANA, CODIGO_SKU, PAIS)
)"""


def _weekly(t):
    return eda.weekly_stock_and_sales(
        t.typed.filter("TIPO_TRANSACCION = 'INVENTORY'"), t.typed.filter("TIPO_TRANSACCION = 'SALES'"))


@query("jon_11_stock_y_ventas_semana", "SEMANA t, CODIGO_SKU s, PAIS s, STOCK d2, VENTAS d2", "SELECT * FROM ws", WEEKLY)
def _(t):
    return _weekly(t)


@query("agg_36_correlacion", "PAIS s, ES_GLOBAL l, R d6, N l, T d4", """
SELECT *, R * sqrt((N - 2) / (1 - R * R)) AS T FROM (
  SELECT PAIS, grouping(PAIS) AS ES_GLOBAL, corr(STOCK, VENTAS) AS R, count(*) AS N FROM ws
  GROUP BY GROUPING SETS ((PAIS), ())) WHERE ES_GLOBAL = 1 OR N > 10""", WEEKLY)
def _(t):
    return eda.correlations(_weekly(t))


@query("agg_37_tendencia_log", "PENDIENTE d6, CORTE d6", """
SELECT regr_slope(ln(VENTAS), ln(STOCK)) AS PENDIENTE, regr_intercept(ln(VENTAS), ln(STOCK)) AS CORTE
FROM ws WHERE STOCK > 0 AND VENTAS > 0""", WEEKLY)
def _(t):
    return eda.log_trend(_weekly(t))


EMPTY = """SELECT * FROM (SELECT SEMANA, CODIGO_SKU, PAIS, VENTAS, greatest(STOCK - 10, 0) AS STOCK,
  lag(greatest(STOCK - 10, 0)) OVER (PARTITION BY PAIS, CODIGO_SKU ORDER BY SEMANA) AS STOCK_LAG1 FROM ws)
WHERE STOCK_LAG1 = 0 AND VENTAS > 0"""


def _empty(t):
    return eda.sales_after_empty_week(
        _weekly(t).withColumn("STOCK", F.greatest(F.col("STOCK") - 10, F.lit(0.0))))


@query("win_08_venta_tras_stock_cero", "SEMANA t, CODIGO_SKU s, PAIS s, STOCK d2, VENTAS d2, STOCK_LAG1 d2", EMPTY, WEEKLY)
def _(t):
    return _empty(t)


@query("agg_40b_quiebres_por_pais", "PAIS s, EVENTOS l", f"SELECT PAIS, count(*) AS EVENTOS FROM ({EMPTY}) GROUP BY PAIS",
       WEEKLY)
def _(t):
    return _empty(t).groupBy("PAIS").agg(F.count("*").alias("EVENTOS"))


PARETO = """
tot AS (SELECT CODIGO_SKU, sum(VALUE) AS UNIDADES FROM sales GROUP BY 1),
par AS (
  SELECT *, UNIDADES / sum(UNIDADES) OVER () * 100 AS PCT,
    sum(UNIDADES) OVER (ORDER BY UNIDADES DESC, CODIGO_SKU ROWS UNBOUNDED PRECEDING) / sum(UNIDADES) OVER () * 100 AS PCT_ACUM,
    row_number() OVER (ORDER BY UNIDADES DESC, CODIGO_SKU) AS RANK FROM tot
)"""
PARETO_COLS = "CODIGO_SKU s, UNIDADES d2, PCT d6, PCT_ACUM d6, RANK l"


@query("win_09_pareto", PARETO_COLS, "SELECT * FROM par", PARETO)
def _(t):
    return eda.pareto(t.sales)


@query("win_09b_pareto_80", "SKUS l, SKUS_80 l, PCT_SKUS_80 d4", """
SELECT count(*) AS SKUS, count(*) FILTER (PCT_ACUM <= 80) AS SKUS_80,
  count(*) FILTER (PCT_ACUM <= 80) / count(*) * 100 AS PCT_SKUS_80 FROM par""", PARETO)
def _(t):
    return eda.pareto_head(eda.pareto(t.sales))


@query("ord_05b_top_sku_global", "CODIGO_SKU s, UNIDADES d2",
       "SELECT * FROM tot ORDER BY UNIDADES DESC, CODIGO_SKU LIMIT 15", PARETO)
def _(t):
    totals = t.sales.groupBy("CODIGO_SKU").agg(F.sum("VALUE").alias("UNIDADES"))
    return ranking.top_rows(totals, [F.desc("UNIDADES"), F.asc("CODIGO_SKU")], 15)


@query("jon_13_pareto_atributos", "CODIGO_SKU s, PAIS s, UNIDADES d2, TRANSAC l, MODELO s, MARCA s, TIER s", """
SELECT v.*, d.MODELO, d.MARCA, d.TIER FROM
  (SELECT CODIGO_SKU, PAIS, sum(VALUE) AS UNIDADES, count(VALUE) AS TRANSAC FROM sales GROUP BY ALL) v
  LEFT JOIN dev d ON v.CODIGO_SKU = d.CODIGO_SKU AND v.PAIS = d.PAIS""")
def _(t):
    return eda.with_devices(
        eda.sales_by_sku(t.sales), device_catalogue(t.devices), ["PAIS", "CODIGO_SKU"])


@query("jon_12_devices_solo_sku", "CODIGO_SKU s, PAIS s, FILAS l, UNIDADES d2", """
SELECT v.CODIGO_SKU, v.PAIS, count(*) AS FILAS, sum(UNIDADES) AS UNIDADES FROM
  (SELECT CODIGO_SKU, PAIS, sum(VALUE) AS UNIDADES FROM sales GROUP BY ALL) v
  LEFT JOIN dev d ON v.CODIGO_SKU = d.CODIGO_SKU GROUP BY v.CODIGO_SKU, v.PAIS""")
def _(t):
    fan = eda.with_devices(eda.sales_by_sku(t.sales), device_catalogue(t.devices), ["CODIGO_SKU"])
    return fan.groupBy("CODIGO_SKU", "PAIS").agg(F.count("*").alias("FILAS"), F.sum("UNIDADES").alias("UNIDADES"))


@query("agg_45_serie_mensual", "MES t, UNIDADES d2", """
SELECT m AS MES, coalesce(u, 0) AS UNIDADES FROM
  (SELECT CAST(unnest(generate_series(date_trunc('month', min(FECHA)), date_trunc('month', max(FECHA)), INTERVAL 1 MONTH))
    AS DATE) AS m FROM sales)
  LEFT JOIN (SELECT CAST(date_trunc('month', FECHA) AS DATE) AS mm, sum(VALUE) AS u FROM sales GROUP BY 1) ON m = mm""")
def _(t):
    return eda.monthly_series(t.sales)


@query("agg_45b_serie_anual", "ANIO l, UNIDADES d2",
       "SELECT ANIO, sum(VALUE) AS UNIDADES FROM sales GROUP BY 1")
def _(t):
    return eda.yearly_series(t.sales)


@query("agg_46_mensual_pais", "MES t, PAIS s, UNIDADES d2",
       "SELECT CAST(date_trunc('month', FECHA) AS DATE) AS MES, PAIS, sum(VALUE) AS UNIDADES FROM sales GROUP BY ALL")
def _(t):
    return eda.monthly_by_country(t.sales)


MONDAY = """
wm AS (
  SELECT SEMANA, PAIS, UNIDADES, weekofyear(SEMANA) AS SEMANA_NUM, year(SEMANA) AS ANO FROM (
    SELECT CAST(FECHA + CAST((8 - isodow(FECHA)) % 7 AS INTEGER) AS DATE) AS SEMANA, PAIS, sum(VALUE) AS UNIDADES
    FROM sales GROUP BY ALL)
)"""


@query("agg_47_semanal_lunes", "SEMANA t, PAIS s, UNIDADES d2, SEMANA_NUM l, ANO l", "SELECT * FROM wm", MONDAY)
def _(t):
    return eda.weekly_by_country(t.sales)


@query("agg_47b_patron_estacional", "PAIS s, SEMANA_NUM l, UNIDADES d4",
       "SELECT PAIS, SEMANA_NUM, avg(UNIDADES) AS UNIDADES FROM wm GROUP BY ALL", MONDAY)
def _(t):
    return eda.season_pattern(eda.weekly_by_country(t.sales))


@query("agg_23_pivot_semana", "PAIS s, ANO l, " + ", ".join(f"{w} d2" for w in range(1, 54)),
       "SELECT PAIS, ANO, " + ", ".join(f'sum(UNIDADES) FILTER (SEMANA_NUM = {w}) AS "{w}"' for w in range(1, 54))
       + " FROM wm GROUP BY PAIS, ANO", MONDAY)
def _(t):
    return eda.year_week_pivot(eda.weekly_by_country(t.sales))


@query("agg_31_precio_mediano", "PAIS s, CODIGO_SKU s, N l, PRECIO_MEDIANA d6", """
SELECT PAIS, CODIGO_SKU, count(*) AS N, quantile_cont(PRECIO_UNITARIO, 0.5) AS PRECIO_MEDIANA FROM sales GROUP BY ALL""")
def _(t):
    return exact_quantiles(t.sales, ["PAIS", "CODIGO_SKU"], "PRECIO_UNITARIO", {"PRECIO_MEDIANA": 0.5})


@query("ord_06b_top_precio_mediano", "CODIGO_SKU s, PRECIO_MEDIANA d6", """
SELECT CODIGO_SKU, quantile_cont(PRECIO_UNITARIO, 0.5) AS PRECIO_MEDIANA FROM sales GROUP BY 1
ORDER BY PRECIO_MEDIANA DESC, CODIGO_SKU LIMIT 10""")
def _(t):
    m = exact_quantiles(t.sales, ["CODIGO_SKU"], "PRECIO_UNITARIO", {"PRECIO_MEDIANA": 0.5})
    return ranking.top_rows(m, [F.desc("PRECIO_MEDIANA"), F.asc("CODIGO_SKU")], 10)


@query("ord_06c_top_marcas_catalogo", "MARCA s, SKUS l", """
SELECT MARCA, count(DISTINCT CODIGO_SKU) AS SKUS FROM dev GROUP BY 1 ORDER BY SKUS DESC, MARCA LIMIT 10""")
def _(t):
    counts = device_catalogue(t.devices).groupBy("MARCA").agg(F.countDistinct("CODIGO_SKU").alias("SKUS"))
    return ranking.top_rows(counts, [F.desc("SKUS"), F.asc("MARCA")], 10)


@query("ord_01_orden_kpi", "PAIS s, YEAR_MONTH s, UNIDADES d2",
       "SELECT PAIS, YEAR_MONTH, sum(VALUE) AS UNIDADES FROM sales GROUP BY ALL ORDER BY PAIS, YEAR_MONTH")
def _(t):
    return t.sales.groupBy("PAIS", "YEAR_MONTH").agg(F.sum("VALUE").alias("UNIDADES")).orderBy("PAIS", "YEAR_MONTH")
