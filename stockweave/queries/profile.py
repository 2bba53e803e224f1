"""Quality and distribution profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import safe_ratio
from ..operators import cleaning
from ..operators.enrich import device_catalogue, enriched, warehouse_catalogue
from ..plans import profile
from ..plans.clean_fact import cleaned
from .base import PARAMS, query
from .cleaning import ENRICHED

TYPED_COLS = ["PAIS", "FECHA_VENTA_INVENTARIO", "VALUE", "COSTO", "SOURCE_FILE"]


@query("prf_01_nulos", "columna s, nulos l, pct_nulos d6", " UNION ALL ".join(
    f"SELECT '{c}' AS columna, count(*) - count({c}) AS nulos, (count(*) - count({c})) / count(*) AS pct_nulos FROM typed"
    for c in TYPED_COLS))
def _(t):
    return profile.null_counts(cleaning.typed(t.raw), TYPED_COLS)


PCT = "printf('%.1f%%', floor({} * 1000 + 0.5) / 10)"


@query("prf_02_resumen_limpieza", "metrica s, valor s", f"""
WITH e AS (SELECT c.*, d.MODELO, b.NOMBRE_BODEGA {ENRICHED}), o AS (SELECT count(*) AS n FROM rawmv)
SELECT 'filas_originales' AS metrica, CAST(n AS VARCHAR) AS valor FROM o
UNION ALL SELECT 'filas_limpias', CAST(count(*) AS VARCHAR) FROM e
UNION ALL SELECT 'filas_eliminadas', CAST((SELECT n FROM o) - count(*) AS VARCHAR) FROM e
UNION ALL SELECT 'pct_retenido', {PCT.format('count(*) / (SELECT n FROM o)')} FROM e
UNION ALL SELECT 'tipos_transaccion', string_agg(DISTINCT TIPO_TRANSACCION, ', ' ORDER BY TIPO_TRANSACCION) FROM e
UNION ALL SELECT 'paises_unicos', CAST(count(DISTINCT PAIS) AS VARCHAR) FROM e
UNION ALL SELECT 'skus_unicos', CAST(count(DISTINCT CODIGO_SKU) AS VARCHAR) FROM e
UNION ALL SELECT 'bodegas_unicas', CAST(count(DISTINCT CODIGO_BODEGA) AS VARCHAR) FROM e
UNION ALL SELECT 'fecha_min', CAST(min(FECHA) AS VARCHAR) FROM e
UNION ALL SELECT 'fecha_max', CAST(max(FECHA) AS VARCHAR) FROM e
UNION ALL SELECT 'catalogo_devices_filas', CAST(count(*) AS VARCHAR) FROM dev
UNION ALL SELECT 'catalogo_bodegas_filas', CAST(count(*) AS VARCHAR) FROM bod
UNION ALL SELECT 'pct_match_devices', {PCT.format('count(MODELO) / count(*)')} FROM e
UNION ALL SELECT 'pct_match_bodegas', {PCT.format('count(NOMBRE_BODEGA) / count(*)')} FROM e""")
def _(t):
    dev, bod = device_catalogue(t.devices), warehouse_catalogue(t.warehouses)
    return profile.cleaning_summary(t.raw, enriched(cleaned(t.raw, PARAMS), dev, bod), dev, bod)


@query("prf_03_conteo_tipo", "TIPO_TRANSACCION s, REGISTROS l, PCT d4", """
SELECT coalesce(TIPO_TRANSACCION, 'SIN_TIPO') AS TIPO_TRANSACCION, count(*) AS REGISTROS,
  count(*) / sum(count(*)) OVER () * 100 AS PCT FROM typed GROUP BY 1""")
def _(t):
    return profile.value_counts(cleaning.typed(t.raw), "TIPO_TRANSACCION", "SIN_TIPO")


@query("prf_03b_conteo_pais", "PAIS s, REGISTROS l, PCT d4", """
SELECT coalesce(PAIS, 'SIN_PAIS') AS PAIS, count(*) AS REGISTROS, count(*) / sum(count(*)) OVER () * 100 AS PCT
FROM (SELECT CASE WHEN P IN ('<NA>', 'NAN', 'NONE', '') THEN NULL ELSE P END AS PAIS FROM typed0) GROUP BY 1""")
def _(t):
    return profile.value_counts(cleaning.typed(t.raw.drop("SOURCE_COUNTRY")), "PAIS", "SIN_PAIS")


@query("prf_04_valores_menores", "VALUE d2, REGISTROS l, PCT d4", """
SELECT *, REGISTROS / sum(REGISTROS) OVER () * 100 AS PCT FROM (
  SELECT VALUE, count(*) AS REGISTROS FROM mv GROUP BY 1 ORDER BY VALUE LIMIT 20)""")
def _(t):
    return profile.lowest_values(t.movements, "VALUE", 20)


@query("prf_04b_valores_menores_tipo", "TIPO_TRANSACCION s, VALUE d2, REGISTROS l, PCT d4", """
SELECT *, REGISTROS / sum(REGISTROS) OVER (PARTITION BY TIPO_TRANSACCION) * 100 AS PCT FROM (
  SELECT TIPO_TRANSACCION, VALUE, count(*) AS REGISTROS FROM mv GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY TIPO_TRANSACCION ORDER BY VALUE) <= 10)""")
def _(t):
    return profile.lowest_values(t.movements, "VALUE", 10, ["TIPO_TRANSACCION"])


@query("prf_05_describe_tipo",
       "TIPO_TRANSACCION s, N l, MEDIA d4, DESV d4, MINIMO d6, P50 d6, P90 d6, P95 d6, P99 d6, MAXIMO d6", """
SELECT TIPO_TRANSACCION, count(VALUE) AS N, avg(VALUE) AS MEDIA, stddev_samp(VALUE) AS DESV, min(VALUE) AS MINIMO,
  quantile_cont(VALUE, 0.5) AS P50, quantile_cont(VALUE, 0.9) AS P90, quantile_cont(VALUE, 0.95) AS P95,
  quantile_cont(VALUE, 0.99) AS P99, max(VALUE) AS MAXIMO FROM mv GROUP BY 1""")
def _(t):
    return profile.describe(t.movements, "VALUE", ["TIPO_TRANSACCION"])


@query("prf_06_describe_tabla",
       "N l, MEDIA d2, DESV d2, MINIMO d6, P25 d6, P50 d6, P75 d6, MAXIMO d6", """
SELECT count(COSTO) AS N, avg(COSTO) AS MEDIA, stddev_samp(COSTO) AS DESV, min(COSTO) AS MINIMO,
  quantile_cont(COSTO, 0.25) AS P25, quantile_cont(COSTO, 0.5) AS P50, quantile_cont(COSTO, 0.75) AS P75,
  max(COSTO) AS MAXIMO FROM mv""")
def _(t):
    return profile.describe(t.movements, "COSTO", [], {"P25": 0.25, "P50": 0.5, "P75": 0.75})


NUMBERS = ["VALUE", "COSTO", "PRECIO_UNITARIO", "ANIO", "MES"]
TEXTS = ["PAIS", "TIPO_TRANSACCION", "CODIGO_SKU", "CODIGO_BODEGA", "MARCA", "TIER", "ESTADO", "YEAR_MONTH", "FECHA"]


@query("prf_06b_describe_numeros",
       "COLUMNA s, N l, MEDIA d2, DESV d2, MINIMO d6, P25 d6, P50 d6, P75 d6, MAXIMO d6", " UNION ALL ".join(
           f"SELECT '{c}' AS COLUMNA, count({c}) AS N, avg({c}) AS MEDIA, stddev_samp({c}) AS DESV, min({c}) AS MINIMO, "
           f"quantile_cont({c}, 0.25) AS P25, quantile_cont({c}, 0.5) AS P50, quantile_cont({c}, 0.75) AS P75, max({c}) AS MAXIMO FROM mv"
           for c in NUMBERS))
def _(t):
    return profile.describe_numbers(t.movements, NUMBERS)


@query("prf_06c_describe_textos", "COLUMNA s, N l, UNICOS l, TOPE s, FRECUENCIA l", " UNION ALL ".join(
    f"(SELECT '{c}' AS COLUMNA, sum(k) OVER () AS N, count(*) OVER () AS UNICOS, v AS TOPE, k AS FRECUENCIA "
    f"FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS k FROM mv GROUP BY 1) ORDER BY k DESC, v LIMIT 1)" for c in TEXTS))
def _(t):
    return profile.describe_texts(t.movements, TEXTS)


@query("prf_07_costo_cero_tipo", "TIPO_TRANSACCION s, N l", """
SELECT TIPO_TRANSACCION, count(*) FILTER (COSTO / nullif(VALUE, 0) = 0) AS N FROM typed GROUP BY 1""")
def _(t):
    """Rows of price zero per type, types without such a row included."""
    price = safe_ratio(F.col("COSTO"), F.col("VALUE"))
    return cleaning.typed(t.raw).groupBy("TIPO_TRANSACCION").agg(F.count_if(price == 0).alias("N"))


@query("prf_08_histograma_costo", "BIN l, DESDE d6, HASTA d6, REGISTROS l", """
WITH r AS (SELECT min(COSTO) AS lo, max(COSTO) AS hi FROM mv)
SELECT BIN, lo + BIN * ((hi - lo) / 30) AS DESDE, lo + (BIN + 1) * ((hi - lo) / 30) AS HASTA, count(*) AS REGISTROS
FROM (SELECT least(floor((COSTO - lo) / ((hi - lo) / 30)), 29) AS BIN, lo, hi FROM mv, r) GROUP BY BIN, lo, hi""")
def _(t):
    return profile.histogram(t.movements, "COSTO", 30)


BOX = "N l, Q1 d6, MEDIANA d6, Q3 d6, BIGOTE_INF d6, BIGOTE_SUP d6, ATIPICOS l"


def _box_sql(source: str, group: str, value: str) -> str:
    return f"""
WITH q AS (SELECT {group}, count({value}) AS N, quantile_cont({value}, 0.25) AS Q1, quantile_cont({value}, 0.5) AS MEDIANA,
  quantile_cont({value}, 0.75) AS Q3 FROM {source} GROUP BY {group}),
s AS (SELECT m.{group}, {value} AS v, q.* EXCLUDE ({group}), {value} BETWEEN Q1 - 1.5 * (Q3 - Q1) AND Q3 + 1.5 * (Q3 - Q1) AS i
  FROM {source} m JOIN q ON m.{group} = q.{group})
SELECT {group}, N, Q1, MEDIANA, Q3, min(v) FILTER (i) AS BIGOTE_INF, max(v) FILTER (i) AS BIGOTE_SUP,
  count(*) FILTER (NOT i) AS ATIPICOS FROM s GROUP BY {group}, N, Q1, MEDIANA, Q3"""


@query("prf_09_caja_precio_tipo", f"TIPO_TRANSACCION s, {BOX}", _box_sql("mv", "TIPO_TRANSACCION", "PRECIO_UNITARIO"))
def _(t):
    return profile.box_plot(t.movements, "PRECIO_UNITARIO", ["TIPO_TRANSACCION"])


@query("prf_09b_caja_precio_tier", f"TIER s, {BOX}", _box_sql("mv", "TIER", "PRECIO_UNITARIO"))
def _(t):
    return profile.box_plot(t.movements, "PRECIO_UNITARIO", ["TIER"])


@query("prf_09c_caja_unidades_mes", f"MES_NOMBRE s, {BOX}", _box_sql("sm", "MES_NOMBRE", "VALUE"),
       "sm AS (SELECT strftime(FECHA, '%B') AS MES_NOMBRE, VALUE FROM sales)")
def _(t):
    return profile.box_plot(t.sales.withColumn("MES_NOMBRE", F.date_format("FECHA", "MMMM")), "VALUE", ["MES_NOMBRE"])


@query("prf_10_set_03_dias_sin_inventario", "PAIS s, MARCA s, FECHA t", """
SELECT PAIS, MARCA, CAST(d AS DATE) AS FECHA FROM (
  SELECT PAIS, MARCA, unnest(generate_series(min(FECHA), max(FECHA), INTERVAL 1 DAY)) AS d FROM inv GROUP BY PAIS, MARCA)
EXCEPT SELECT PAIS, MARCA, FECHA FROM inv""")
def _(t):
    return profile.missing_days(t.stock, ["PAIS", "MARCA"])


@query("prf_10b_cobertura_mes", "MES t, CON l, SIN l, PCT d6", """
SELECT m AS MES, coalesce(n, 0) AS CON, day(last_day(m)) - coalesce(n, 0) AS SIN,
  coalesce(n, 0) / day(last_day(m)) * 100 AS PCT
FROM (SELECT CAST(unnest(generate_series(date_trunc('month', min(FECHA)), date_trunc('month', max(FECHA)), INTERVAL 1 MONTH))
  AS DATE) AS m FROM inv)
LEFT JOIN (SELECT CAST(date_trunc('month', FECHA) AS DATE) AS mm, count(DISTINCT FECHA) AS n FROM inv GROUP BY 1) ON m = mm
""")
def _(t):
    return profile.month_coverage(t.stock)


COVER = """
WITH a AS (SELECT DISTINCT {0} AS k FROM {1}), b AS (SELECT DISTINCT {2} AS k FROM {3})
SELECT count(*) AS CLAVES, count(b.k) AS CON_MATCH, count(*) - count(b.k) AS SIN_MATCH, count(b.k) / count(*) * 100 AS PCT_MATCH
FROM a LEFT JOIN b ON a.k = b.k"""


@query("prf_11_cobertura_sku", "CLAVES l, CON_MATCH l, SIN_MATCH l, PCT_MATCH d6",
       COVER.format("CODIGO_SKU", "inv", "CODIGO_SKU", "sales"))
def _(t):
    return profile.key_coverage(t.stock, t.sales, "CODIGO_SKU", "CODIGO_SKU")


@query("prf_11b_cobertura_bodega", "CLAVES l, CON_MATCH l, SIN_MATCH l, PCT_MATCH d6",
       COVER.format("CODIGO_BODEGA", "mv", "CODIGO_BODEGA", "bod"))
def _(t):
    return profile.key_coverage(t.movements, warehouse_catalogue(t.warehouses), "CODIGO_BODEGA", "CODIGO_BODEGA")


def _keyed(df):
    return df.withColumn("CLAVE", F.concat_ws("|", "PAIS", "CODIGO_SKU"))


@query("set_02_interseccion_claves", "CLAVE s",
       "SELECT PAIS || '|' || CODIGO_SKU AS CLAVE FROM sales INTERSECT SELECT PAIS || '|' || CODIGO_SKU FROM inv")
def _(t):
    return profile.shared_keys(_keyed(t.sales), _keyed(t.stock), "CLAVE")


@query("set_03_diferencia_claves", "CLAVE s",
       "SELECT PAIS || '|' || CODIGO_SKU AS CLAVE FROM sales EXCEPT SELECT PAIS || '|' || CODIGO_SKU FROM inv")
def _(t):
    return profile.keys_only_in(_keyed(t.sales), _keyed(t.stock), "CLAVE")


@query("agg_34_grupos_repetidos", "FECHA t, CODIGO_SKU s, TIPO_TRANSACCION s, REGISTROS l, VALUE d2, COSTO d6", """
SELECT FECHA, CODIGO_SKU, TIPO_TRANSACCION, count(*) AS REGISTROS, sum(VALUE) AS VALUE, avg(COSTO) AS COSTO
FROM mv GROUP BY ALL HAVING count(*) > 1""")
def _(t):
    return profile.repeated_groups(t.movements, ["FECHA", "CODIGO_SKU", "TIPO_TRANSACCION"])
