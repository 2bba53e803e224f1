"""Sales, inventory and product KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gapfill, ranking
from ..plans import inventory, product, sales
from .base import COUNTRIES, query

MONTHLY = """
monthly AS (
  SELECT PAIS, ANIO, MES, YEAR_MONTH, sum(VALUE) AS UNIDADES, CAST(sum(R) AS DOUBLE) AS INGRESOS,
    exact_avg(PRECIO_UNITARIO) AS ASP, count(DISTINCT CODIGO_SKU) AS SKUS_ACTIVOS
  FROM sales GROUP BY ALL
),
annual AS (
  SELECT PAIS, ANIO, sum(VALUE) AS UNIDADES, CAST(sum(R) AS DOUBLE) AS INGRESOS FROM sales GROUP BY ALL
)"""

HEADLINE = """
head AS (
  SELECT s.PAIS, u, r, inv FROM
    (SELECT PAIS, sum(VALUE) AS u, CAST(sum(R) AS DOUBLE) AS r FROM sales GROUP BY PAIS) s
    LEFT JOIN (SELECT PAIS, avg(VALUE) AS inv FROM inv GROUP BY PAIS) i ON s.PAIS = i.PAIS
)"""


@query("agg_01_ventas_generales", "PAIS s, KPI s, VALOR d4, UNIDAD s", """
SELECT PAIS, 'Unidades vendidas' AS KPI, u AS VALOR, 'ud' AS UNIDAD FROM head
UNION ALL SELECT PAIS, 'Ingresos totales', r, 'USD' FROM head
UNION ALL SELECT PAIS, 'ASP', r / u, 'USD/ud' FROM head
UNION ALL SELECT PAIS, 'Sell-through Rate', u / (u + inv), '%' FROM head""", HEADLINE)
def _(t):
    return sales.headline(t.sales, t.stock)


@query("agg_21_pivot_kpi_pais",
       'PAIS s, Unidades vendidas d2, Ingresos totales d2, ASP d4, Sell-through Rate d6, '
       'PARTICIPACION_INGRESOS d6, PARTICIPACION_UNIDADES d6', """
SELECT PAIS, u AS "Unidades vendidas", r AS "Ingresos totales", r / u AS "ASP",
  u / (u + inv) AS "Sell-through Rate", r / sum(r) OVER () AS "PARTICIPACION_INGRESOS",
  u / sum(u) OVER () AS "PARTICIPACION_UNIDADES" FROM head""", HEADLINE)
def _(t):
    return sales.headline_by_country(sales.headline(t.sales, t.stock))


@query("agg_02_ventas_mensuales",
       "PAIS s, ANIO l, MES l, YEAR_MONTH s, UNIDADES d2, INGRESOS d2, ASP d4, SKUS_ACTIVOS l",
       "SELECT * FROM monthly", MONTHLY)
def _(t):
    return sales.monthly(t.sales)


@query("win_01_02_crecimiento_mensual",
       "PAIS s, YEAR_MONTH s, CRECIMIENTO_UNID_MOM d6, CRECIMIENTO_INGRESOS_MOM d6, "
       "CRECIMIENTO_INGRESOS_YOY d6, CRECIMIENTO_UNID_YOY d6", """
SELECT PAIS, YEAR_MONTH,
  UNIDADES / lag(UNIDADES) OVER m - 1 AS CRECIMIENTO_UNID_MOM,
  INGRESOS / lag(INGRESOS) OVER m - 1 AS CRECIMIENTO_INGRESOS_MOM,
  INGRESOS / lag(INGRESOS) OVER y - 1 AS CRECIMIENTO_INGRESOS_YOY,
  UNIDADES / lag(UNIDADES) OVER y - 1 AS CRECIMIENTO_UNID_YOY
FROM monthly WINDOW m AS (PARTITION BY PAIS ORDER BY YEAR_MONTH), y AS (PARTITION BY PAIS, MES ORDER BY ANIO)
""", MONTHLY)
def _(t):
    return sales.monthly(t.sales)


@query("agg_03_win_03_ventas_anuales",
       "PAIS s, ANIO l, UNIDADES d2, INGRESOS d2, CRECIMIENTO_INGRESOS_YOY d6, CRECIMIENTO_UNID_YOY d6", """
SELECT *, INGRESOS / lag(INGRESOS) OVER y - 1 AS CRECIMIENTO_INGRESOS_YOY,
  UNIDADES / lag(UNIDADES) OVER y - 1 AS CRECIMIENTO_UNID_YOY
FROM annual WINDOW y AS (PARTITION BY PAIS ORDER BY ANIO)""", MONTHLY)
def _(t):
    return sales.annual(t.sales)


@query("agg_19_serie_global", "YEAR_MONTH s, UNIDADES d2, INGRESOS d2, CRECIMIENTO_INGRESOS_MOM d6", """
SELECT YEAR_MONTH, UNIDADES, INGRESOS, INGRESOS / lag(INGRESOS) OVER (ORDER BY YEAR_MONTH) - 1
  AS CRECIMIENTO_INGRESOS_MOM
FROM (SELECT YEAR_MONTH, sum(VALUE) AS UNIDADES, CAST(sum(R) AS DOUBLE) AS INGRESOS FROM sales GROUP BY 1)""")
def _(t):
    return sales.global_series(sales.monthly(t.sales))


@query("agg_19b_pais_y_global", "PAIS s, YEAR_MONTH s, ES_GLOBAL l, UNIDADES d2, INGRESOS d2", """
SELECT PAIS, YEAR_MONTH, grouping(PAIS) AS ES_GLOBAL, sum(VALUE) AS UNIDADES, sum(R) AS INGRESOS
FROM sales GROUP BY GROUPING SETS ((PAIS, YEAR_MONTH), (YEAR_MONTH))""")
def _(t):
    return sales.country_and_global(t.sales)


@query("agg_22_pivot_anual", "ANIO l, " + ", ".join(f"{c} d2" for c in COUNTRIES),
       "SELECT ANIO, " + ", ".join(f"sum(INGRESOS) FILTER (PAIS = '{c}') AS \"{c}\"" for c in COUNTRIES)
       + " FROM annual GROUP BY ANIO", MONTHLY)
def _(t):
    return sales.annual_pivot(sales.annual(t.sales), COUNTRIES)


@query("agg_18_tabla_ejecutiva",
       "PAIS s, ANIO l, YEAR_MONTH s, UNIDADES d2, INGRESOS d2, ASP d4, SKUS_ACTIVOS l, BODEGAS_ACTIVAS l, "
       "CRECIMIENTO_INGRESOS_MOM d6, INV_SUMA_MES d2, INV_CIERRE d2, INV_CIERRE_REAL d2", """
SELECT e.*, e.INGRESOS / lag(e.INGRESOS) OVER (PARTITION BY e.PAIS ORDER BY e.YEAR_MONTH) - 1
    AS CRECIMIENTO_INGRESOS_MOM, v.s AS INV_SUMA_MES, v.s AS INV_CIERRE, v.c AS INV_CIERRE_REAL
FROM (SELECT PAIS, ANIO, YEAR_MONTH, sum(VALUE) AS UNIDADES, CAST(sum(R) AS DOUBLE) AS INGRESOS,
        exact_avg(PRECIO_UNITARIO) AS ASP, count(DISTINCT CODIGO_SKU) AS SKUS_ACTIVOS,
        count(DISTINCT CODIGO_BODEGA) AS BODEGAS_ACTIVAS FROM sales GROUP BY ALL) e
LEFT JOIN (SELECT PAIS, YEAR_MONTH, sum(d) AS s, arg_max(d, FECHA) AS c FROM
    (SELECT PAIS, YEAR_MONTH, FECHA, sum(VALUE) AS d FROM inv GROUP BY ALL) GROUP BY ALL) v
  ON e.PAIS = v.PAIS AND e.YEAR_MONTH = v.YEAR_MONTH""")
def _(t):
    return sales.executive(t.sales, t.stock)


SNAPSHOT = """
snap AS (
  SELECT PAIS, YEAR_MONTH, sum(i) AS INV_INICIAL, sum(c) AS INV_CIERRE, sum(p) AS INV_PROMEDIO,
    day(last_day(CAST(YEAR_MONTH || '-01' AS DATE))) AS DIAS_MES
  FROM (SELECT PAIS, CODIGO_BODEGA, CODIGO_SKU, YEAR_MONTH, first(VALUE ORDER BY FECHA, VALUE) AS i,
          last(VALUE ORDER BY FECHA, VALUE) AS c, avg(VALUE) AS p FROM inv GROUP BY ALL) GROUP BY ALL
),
snapday AS (
  SELECT PAIS, YEAR_MONTH, arg_min(d, FECHA) AS INV_INICIAL, arg_max(d, FECHA) AS INV_CIERRE,
    avg(d) AS INV_PROMEDIO, day(last_day(CAST(YEAR_MONTH || '-01' AS DATE))) AS DIAS_MES
  FROM (SELECT PAIS, FECHA, YEAR_MONTH, sum(VALUE) AS d FROM inv GROUP BY ALL) GROUP BY ALL
),
sold AS (SELECT PAIS, YEAR_MONTH, sum(VALUE) AS v FROM sales GROUP BY ALL),
ratios AS (
  SELECT s.PAIS, s.YEAR_MONTH, v AS VENTAS_UNIDADES, INV_INICIAL, INV_CIERRE, INV_PROMEDIO, DIAS_MES,
    INV_PROMEDIO / nullif(v, 0) * DIAS_MES AS DOH, v / nullif(INV_PROMEDIO, 0) AS STOCK_TURNOVER,
    v / (v + nullif(INV_CIERRE, 0)) AS SELL_THROUGH
  FROM sold s LEFT JOIN snap i ON s.PAIS = i.PAIS AND s.YEAR_MONTH = i.YEAR_MONTH
)"""
SNAP_COLS = "PAIS s, YEAR_MONTH s, INV_INICIAL d2, INV_CIERRE d2, INV_PROMEDIO d4, DIAS_MES l"
RATIO_COLS = ("PAIS s, YEAR_MONTH s, VENTAS_UNIDADES d2, INV_INICIAL d2, INV_CIERRE d2, INV_PROMEDIO d4, "
              "DOH d4, STOCK_TURNOVER d4, SELL_THROUGH d6")


@query("agg_04_snapshot_mes", SNAP_COLS, "SELECT * FROM snap", SNAPSHOT)
def _(t):
    return inventory.snapshot_by_position(t.stock)


@query("agg_05_snapshot_mes_diario", SNAP_COLS, "SELECT * FROM snapday", SNAPSHOT)
def _(t):
    return inventory.snapshot_by_day(t.stock)


@query("agg_06_jon_06_kpi_inventario", RATIO_COLS, "SELECT * FROM ratios", SNAPSHOT)
def _(t):
    return inventory.monthly_ratios(t.sales, inventory.snapshot_by_position(t.stock))


@query("agg_06b_kpi_inventario_30", RATIO_COLS, """
SELECT s.PAIS, s.YEAR_MONTH, v AS VENTAS_UNIDADES, INV_INICIAL, INV_CIERRE, INV_PROMEDIO,
  INV_PROMEDIO / nullif(v, 0) * 30 AS DOH, v / nullif(INV_PROMEDIO, 0) AS STOCK_TURNOVER,
  v / (v + nullif(INV_CIERRE, 0)) AS SELL_THROUGH
FROM sold s LEFT JOIN snapday i ON s.PAIS = i.PAIS AND s.YEAR_MONTH = i.YEAR_MONTH""", SNAPSHOT)
def _(t):
    return inventory.monthly_ratios(t.sales, inventory.snapshot_by_day(t.stock), days=30)


@query("agg_15_resumen_inventario_pais",
       "PAIS s, DOH_PROM d4, VENTAS_TOT d2, INV_PROM_TOT d2, INV_CIERRE_TOT d2, TURNOVER_GLOBAL d6, "
       "SELL_THROUGH_GLOBAL d6", """
SELECT PAIS, avg(DOH) AS DOH_PROM, sum(VENTAS_UNIDADES) AS VENTAS_TOT, sum(INV_PROMEDIO) AS INV_PROM_TOT,
  sum(INV_CIERRE) AS INV_CIERRE_TOT, sum(VENTAS_UNIDADES) / sum(INV_PROMEDIO) AS TURNOVER_GLOBAL,
  sum(VENTAS_UNIDADES) / (sum(VENTAS_UNIDADES) + sum(INV_CIERRE)) AS SELL_THROUGH_GLOBAL
FROM ratios GROUP BY PAIS""", SNAPSHOT)
def _(t):
    return inventory.country_inventory(
        inventory.monthly_ratios(t.sales, inventory.snapshot_by_position(t.stock)))


# Stockout rates run on the gap-filled series, where empty days exist.
FILLED = """
siv AS (SELECT * FROM ser WHERE TIPO_TRANSACCION = 'INVENTORY'),
daily AS (SELECT PAIS, CODIGO_SKU, CODIGO_BODEGA, FECHA, sum(VALUE) AS VALUE FROM siv GROUP BY ALL),
grid AS (
  SELECT k.*, CAST(d AS DATE) AS FECHA
  FROM (SELECT DISTINCT PAIS, CODIGO_SKU, CODIGO_BODEGA FROM daily) k,
    (SELECT unnest(generate_series(min(FECHA), max(FECHA), INTERVAL 1 DAY)) AS d FROM daily)
),
filled AS (
  SELECT g.PAIS, g.CODIGO_SKU, g.CODIGO_BODEGA, g.FECHA,
    trunc(coalesce(last_value(v.VALUE IGNORE NULLS) OVER (PARTITION BY g.PAIS, g.CODIGO_SKU, g.CODIGO_BODEGA
      ORDER BY g.FECHA ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)) AS VALUE
  FROM grid g LEFT JOIN daily v ON g.PAIS = v.PAIS AND g.CODIGO_SKU = v.CODIGO_SKU
    AND g.CODIGO_BODEGA = v.CODIGO_BODEGA AND g.FECHA = v.FECHA
),
so AS (
  SELECT PAIS, CODIGO_SKU, CODIGO_BODEGA, count(DISTINCT FECHA) AS DIAS_TOTALES,
    count(*) FILTER (VALUE = 0) AS DIAS_STOCKOUT,
    count(*) FILTER (VALUE = 0) / count(DISTINCT FECHA) AS STOCKOUT_RATE FROM filled GROUP BY ALL
)"""
SO_COLS = "PAIS s, CODIGO_SKU s, CODIGO_BODEGA s, DIAS_TOTALES l, DIAS_STOCKOUT l, STOCKOUT_RATE d6"


def _filled(t):
    return gapfill.filled_days(t.typed.filter(F.col("TIPO_TRANSACCION") == "INVENTORY"))


@query("agg_07_stockout_rate", SO_COLS, "SELECT * FROM so", FILLED)
def _(t):
    return inventory.stockout_rate(_filled(t))


@query("agg_07b_stockout_desde_tramos", SO_COLS, "SELECT * FROM so", FILLED)
def _(t):
    return gapfill.stockout_from_runs(t.typed.filter(F.col("TIPO_TRANSACCION") == "INVENTORY"))


@query("agg_16_jon_10_stockout_pais",
       "PAIS s, STOCKOUT_RATE_PROM d6, SKUS_CON_STOCKOUT l, FILAS_CON_STOCKOUT l", """
SELECT PAIS, avg(STOCKOUT_RATE) AS STOCKOUT_RATE_PROM,
  count(DISTINCT CODIGO_SKU) FILTER (STOCKOUT_RATE > 0) AS SKUS_CON_STOCKOUT,
  count(*) FILTER (STOCKOUT_RATE > 0) AS FILAS_CON_STOCKOUT FROM so GROUP BY PAIS""", FILLED)
def _(t):
    runs = gapfill.stockout_from_runs(t.typed.filter(F.col("TIPO_TRANSACCION") == "INVENTORY"))
    return inventory.country_stockout(runs)


FILL = """
fr AS (
  SELECT h.PAIS, h.CODIGO_SKU, h.d AS DIAS_INVENTARIO, coalesce(s.d, 0) AS DIAS_CON_VENTAS,
    coalesce(s.d, 0) / h.d AS FILL_RATE
  FROM (SELECT PAIS, CODIGO_SKU, count(DISTINCT FECHA) AS d FROM inv GROUP BY ALL) h
  LEFT JOIN (SELECT PAIS, CODIGO_SKU, count(DISTINCT FECHA) AS d FROM sales GROUP BY ALL) s
    ON h.PAIS = s.PAIS AND h.CODIGO_SKU = s.CODIGO_SKU
)"""


@query("agg_08_jon_07_fill_rate_sku",
       "PAIS s, CODIGO_SKU s, DIAS_INVENTARIO l, DIAS_CON_VENTAS l, FILL_RATE d6", "SELECT * FROM fr", FILL)
def _(t):
    return inventory.fill_rate_by_sku(t.sales, t.stock)


@query("agg_17_fill_rate_pais", "PAIS s, FILL_RATE_PROM d6",
       "SELECT PAIS, avg(FILL_RATE) AS FILL_RATE_PROM FROM fr GROUP BY PAIS", FILL)
def _(t):
    return inventory.country_fill_rate(inventory.fill_rate_by_sku(t.sales, t.stock))


@query("agg_09_fill_rate_mes", "PAIS s, YEAR_MONTH s, SKUS_CON_INVENTARIO l, SKUS_CON_VENTA l, FILL_RATE d6", """
SELECT h.PAIS, h.YEAR_MONTH, count(DISTINCT h.CODIGO_SKU) AS SKUS_CON_INVENTARIO, count(s.v) AS SKUS_CON_VENTA,
  count(s.v) / count(DISTINCT h.CODIGO_SKU) AS FILL_RATE
FROM (SELECT PAIS, YEAR_MONTH, CODIGO_SKU FROM inv GROUP BY ALL HAVING sum(VALUE) > 0) h
LEFT JOIN (SELECT PAIS, YEAR_MONTH, CODIGO_SKU, sum(VALUE) AS v FROM sales GROUP BY ALL HAVING sum(VALUE) > 0) s
  ON h.PAIS = s.PAIS AND h.YEAR_MONTH = s.YEAR_MONTH AND h.CODIGO_SKU = s.CODIGO_SKU
GROUP BY h.PAIS, h.YEAR_MONTH""")
def _(t):
    return inventory.fill_rate_by_month(t.sales, t.stock)


DIAG = """
lastm AS (SELECT PAIS, max(YEAR_MONTH) AS YEAR_MONTH FROM inv GROUP BY PAIS),
diag AS (
  SELECT h.*, s.VENTAS_MES, coalesce(s.VENTAS_MES > 0, FALSE) AS VENDIO,
    CASE WHEN coalesce(s.VENTAS_MES > 0, FALSE) THEN 'Con venta' ELSE 'Sin venta en el mes' END AS TIPO_SKU
  FROM (SELECT i.PAIS, i.YEAR_MONTH, CODIGO_SKU, sum(VALUE) AS INV_TOTAL, min(MODELO) AS MODELO,
          min(MARCA) AS MARCA, min(TIER) AS TIER, min(ESTADO) AS ESTADO
        FROM inv i JOIN lastm l ON i.PAIS = l.PAIS AND i.YEAR_MONTH = l.YEAR_MONTH GROUP BY ALL) h
  LEFT JOIN (SELECT PAIS, YEAR_MONTH, CODIGO_SKU, sum(VALUE) AS VENTAS_MES FROM sales GROUP BY ALL) s
    ON h.PAIS = s.PAIS AND h.YEAR_MONTH = s.YEAR_MONTH AND h.CODIGO_SKU = s.CODIGO_SKU
)"""


def _diag(t):
    return inventory.last_month_diagnosis(t.sales, t.stock)


@query("agg_13_jon_08_diagnostico_ultimo_mes",
       "PAIS s, YEAR_MONTH s, CODIGO_SKU s, INV_TOTAL d2, MODELO s, MARCA s, TIER s, ESTADO s, VENTAS_MES d2, "
       "VENDIO b, TIPO_SKU s", "SELECT * FROM diag", DIAG)
def _(t):
    return _diag(t)


@query("agg_14_resumen_diagnostico",
       "PAIS s, YEAR_MONTH s, SKUS l, CON_VENTA l, SIN_VENTA l, INV d2, INV_SIN_VENTA d2, PCT_CON_VENTA d6, "
       "PCT_INV_SIN_VENTA d6", """
SELECT PAIS, YEAR_MONTH, count(*) AS SKUS, count(*) FILTER (VENDIO) AS CON_VENTA,
  count(*) FILTER (NOT VENDIO) AS SIN_VENTA, sum(INV_TOTAL) AS INV,
  coalesce(sum(INV_TOTAL) FILTER (NOT VENDIO), 0) AS INV_SIN_VENTA, count(*) FILTER (VENDIO) / count(*) AS PCT_CON_VENTA,
  coalesce(sum(INV_TOTAL) FILTER (NOT VENDIO), 0) / sum(INV_TOTAL) AS PCT_INV_SIN_VENTA FROM diag GROUP BY ALL""", DIAG)
def _(t):
    return inventory.diagnosis_totals(_diag(t))


@query("agg_14b_diagnostico_estado", "PAIS s, ESTADO s, VENDIO b, SKUS l, INV d2",
       "SELECT PAIS, ESTADO, VENDIO, count(DISTINCT CODIGO_SKU) AS SKUS, sum(INV_TOTAL) AS INV FROM diag GROUP BY ALL",
       DIAG)
def _(t):
    return inventory.diagnosis_by(_diag(t), "ESTADO", "VENDIO")


@query("agg_14c_diagnostico_tier", "PAIS s, TIER s, TIPO_SKU s, SKUS l, INV d2",
       "SELECT PAIS, TIER, TIPO_SKU, count(DISTINCT CODIGO_SKU) AS SKUS, sum(INV_TOTAL) AS INV FROM diag GROUP BY ALL",
       DIAG)
def _(t):
    return inventory.diagnosis_by(_diag(t), "TIER", "TIPO_SKU")


@query("ord_04_dead_stock", "PAIS s, CODIGO_SKU s, MODELO s, MARCA s, TIER s, ESTADO s, INV_TOTAL d2", """
SELECT * FROM diag WHERE NOT VENDIO
QUALIFY row_number() OVER (PARTITION BY PAIS ORDER BY INV_TOTAL DESC, CODIGO_SKU) <= 15""", DIAG)
def _(t):
    return inventory.dead_stock(_diag(t))


PRODUCT = """
marca AS (
  SELECT *, UNIDADES / sum(UNIDADES) OVER (PARTITION BY PAIS) AS PARTICIPACION_UNIDADES,
    INGRESOS / sum(INGRESOS) OVER (PARTITION BY PAIS) AS PARTICIPACION_INGRESOS
  FROM (SELECT PAIS, MARCA, sum(VALUE) AS UNIDADES, CAST(sum(R) AS DOUBLE) AS INGRESOS,
    exact_avg(PRECIO_UNITARIO) AS ASP, count(DISTINCT MODELO) AS MODELOS FROM sales GROUP BY ALL)
),
tier AS (
  SELECT *, UNIDADES / sum(UNIDADES) OVER (PARTITION BY PAIS) AS PARTICIPACION_UNIDADES,
    INGRESOS / sum(INGRESOS) OVER (PARTITION BY PAIS) AS PARTICIPACION_INGRESOS
  FROM (SELECT PAIS, TIER, sum(VALUE) AS UNIDADES, CAST(sum(R) AS DOUBLE) AS INGRESOS,
    exact_avg(PRECIO_UNITARIO) AS ASP, count(DISTINCT MODELO) AS MODELOS FROM sales GROUP BY ALL)
),
modelo AS (
  SELECT PAIS, MODELO, MARCA, TIER, sum(VALUE) AS UNIDADES, CAST(sum(R) AS DOUBLE) AS INGRESOS,
    exact_avg(PRECIO_UNITARIO) AS ASP FROM sales GROUP BY ALL
),
topmod AS (
  SELECT * FROM modelo
  QUALIFY row_number() OVER (PARTITION BY PAIS ORDER BY UNIDADES DESC, MODELO, MARCA, TIER) <= 15
)"""
SHARES = "UNIDADES d2, INGRESOS d2, ASP d4, MODELOS l, PARTICIPACION_UNIDADES d6, PARTICIPACION_INGRESOS d6"
RANKED = "UNIDADES d2, INGRESOS d2, ASP d4, PAISES l, PARTICIPACION_UNIDADES d6, PARTICIPACION_INGRESOS d6"


def _ranking_sql(source: str, column: str) -> str:
    return f"""
SELECT *, UNIDADES / sum(UNIDADES) OVER () AS PARTICIPACION_UNIDADES,
  INGRESOS / sum(INGRESOS) OVER () AS PARTICIPACION_INGRESOS
FROM (SELECT {column}, sum(UNIDADES) AS UNIDADES, sum(INGRESOS) AS INGRESOS, avg(ASP) AS ASP,
  count(DISTINCT PAIS) AS PAISES FROM {source} GROUP BY {column})"""


@query("agg_10_win_04_marcas", f"PAIS s, MARCA s, {SHARES}", "SELECT * FROM marca", PRODUCT)
def _(t):
    return product.brands(t.sales)


@query("agg_11_tiers", f"PAIS s, TIER s, {SHARES}", "SELECT * FROM tier", PRODUCT)
def _(t):
    return product.tiers(t.sales)


@query("agg_11b_tiers_sin_nulos", f"PAIS s, TIER s, {SHARES}", "SELECT * FROM tier WHERE TIER IS NOT NULL", PRODUCT)
def _(t):
    return product.tiers(t.sales, drop_null=True)


@query("agg_12_modelos", "PAIS s, MODELO s, MARCA s, TIER s, UNIDADES d2, INGRESOS d2, ASP d4",
       "SELECT * FROM modelo", PRODUCT)
def _(t):
    return product.models(t.sales)


@query("ord_02_top_modelos", "PAIS s, MODELO s, MARCA s, TIER s, UNIDADES d2, INGRESOS d2, ASP d4",
       "SELECT * FROM topmod", PRODUCT)
def _(t):
    return product.top_models(t.sales)


@query("ord_03_top_marcas", "PAIS s, MARCA s, UNIDADES d2", """
SELECT * FROM marca WHERE MARCA IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY PAIS ORDER BY UNIDADES DESC, MARCA) <= 8""", PRODUCT)
def _(t):
    return product.top_brands(product.brands(t.sales))


@query("ord_03b_top_modelos_global", "MODELO s, MARCA s, TIER s, UNIDADES d2, INGRESOS d2, ASP d4, PAISES l", """
SELECT MODELO, MARCA, TIER, sum(UNIDADES) AS UNIDADES, sum(INGRESOS) AS INGRESOS, avg(ASP) AS ASP,
  count(DISTINCT PAIS) AS PAISES FROM topmod GROUP BY MODELO, MARCA, TIER
ORDER BY UNIDADES DESC, MODELO, MARCA, TIER LIMIT 20""", PRODUCT)
def _(t):
    return product.top_global_models(t.sales)


@query("agg_20_ranking_marcas", f"MARCA s, {RANKED}", _ranking_sql("marca", "MARCA"), PRODUCT)
def _(t):
    return product.ranking(product.brands(t.sales), ["MARCA"])


@query("agg_20b_ranking_tiers", f"TIER s, {RANKED}", _ranking_sql("tier", "TIER"), PRODUCT)
def _(t):
    return product.ranking(product.tiers(t.sales, drop_null=True), ["TIER"])


@query("ord_05_top_sku_pais", "PAIS s, CODIGO_SKU s, UNIDADES d2, TRANSAC l, RANK l", """
SELECT *, row_number() OVER (PARTITION BY PAIS ORDER BY UNIDADES DESC, CODIGO_SKU) AS RANK
FROM (SELECT PAIS, CODIGO_SKU, sum(VALUE) AS UNIDADES, count(VALUE) AS TRANSAC FROM sales GROUP BY ALL)
QUALIFY RANK <= 10""")
def _(t):
    by_sku = t.sales.groupBy("PAIS", "CODIGO_SKU").agg(
        F.sum("VALUE").alias("UNIDADES"), F.count("VALUE").alias("TRANSAC"))
    return ranking.top_per_group(by_sku, ["PAIS"], [F.desc("UNIDADES"), F.asc("CODIGO_SKU")], 10, "RANK")
