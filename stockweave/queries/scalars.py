"""Scalar functions over the movement table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean_text, clip, country_from_file, date_from_key, rounded_even, safe_ratio, tier_rank, type_label
from ..functions.dates import date_key, month_days, week_ending_monday, week_start
from ..functions.text import contains_term
from ..plans.features import cyclic
from .base import query


@query("sca_01_texto", "TIPO s, RECORTE s, MINUSC s, HAY b, N l", """
SELECT upper(trim(regexp_replace(TIPO_TRANSACCION, '\\s+', ' ', 'g'))) AS TIPO, substring(SOURCE_FILE, 1, 5) AS RECORTE,
  lower(SOURCE_COUNTRY) AS MINUSC, contains(lower(SOURCE_FILE), 'datos') AS HAY, count(*) AS N FROM rawmv GROUP BY ALL""")
def _(t):
    return t.raw.select(
        clean_text(F.col("TIPO_TRANSACCION")).alias("TIPO"), F.substring("SOURCE_FILE", 1, 5).alias("RECORTE"),
        F.lower("SOURCE_COUNTRY").alias("MINUSC"), contains_term([F.col("SOURCE_FILE")], " DATOS").alias("HAY"),
    ).groupBy("TIPO", "RECORTE", "MINUSC", "HAY").agg(F.count("*").alias("N"))


@query("sca_02_fecha_clave", "CLAVE s, FECHA t, N l", """
SELECT FECHA_VENTA_INVENTARIO AS CLAVE,
  CAST(try_strptime(CAST(TRY_CAST(FECHA_VENTA_INVENTARIO AS BIGINT) AS VARCHAR), '%Y%m%d') AS DATE) AS FECHA, count(*) AS N
FROM rawmv GROUP BY ALL""")
def _(t):
    c = F.col("FECHA_VENTA_INVENTARIO")
    return t.raw.select(c.alias("CLAVE"), date_from_key(c).alias("FECHA")).groupBy("CLAVE", "FECHA").agg(
        F.count("*").alias("N"))


@query("sca_03_04_calendario",
       "FECHA t, ANIO l, MES l, TRIM l, SEMANA l, MES_NOMBRE s, DIAS l, YM s, ANOMES l, CLAVE l, LUNES t, FIN_LUNES t", """
SELECT DISTINCT FECHA, year(FECHA) AS ANIO, month(FECHA) AS MES, quarter(FECHA) AS TRIM, weekofyear(FECHA) AS SEMANA,
  strftime(FECHA, '%B') AS MES_NOMBRE, day(last_day(FECHA)) AS DIAS, strftime(FECHA, '%Y-%m') AS YM,
  year(FECHA) * 100 + month(FECHA) AS ANOMES, CAST(strftime(FECHA, '%Y%m%d') AS BIGINT) AS CLAVE,
  CAST(date_trunc('week', FECHA) AS DATE) AS LUNES, CAST(FECHA + CAST((8 - isodow(FECHA)) % 7 AS INTEGER) AS DATE) AS FIN_LUNES
FROM mv""")
def _(t):
    d = F.col("FECHA")
    return t.movements.select(
        d, F.year(d).alias("ANIO"), F.month(d).alias("MES"), F.quarter(d).alias("TRIM"), F.weekofyear(d).alias("SEMANA"),
        F.date_format(d, "MMMM").alias("MES_NOMBRE"), month_days(F.col("YEAR_MONTH")).alias("DIAS"),
        F.col("YEAR_MONTH").alias("YM"), (F.year(d) * 100 + F.month(d)).alias("ANOMES"), date_key(d).alias("CLAVE"),
        week_start(d).alias("LUNES"), week_ending_monday(d).alias("FIN_LUNES"),
    ).distinct()


@query("sca_05_pais_archivo", "ARCHIVO s, PAIS s, N l", """
SELECT ARCHIVO, CASE c WHEN 0 THEN 'PARAGUAY' WHEN 1 THEN 'NICARAGUA' WHEN 2 THEN 'COSTA RICA' WHEN 3 THEN 'HONDURAS' END AS PAIS,
  count(*) AS N FROM (SELECT n_nationkey % 5 AS c, CASE n_nationkey % 5 WHEN 0 THEN 'Datos_PY-' WHEN 1 THEN 'ni ventas '
    WHEN 2 THEN 'CostaRica_' WHEN 3 THEN 'x_HN_PA_' ELSE 'otros_' END || n_name || '.csv' AS ARCHIVO
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY ALL""")
def _(t):
    place = t.read("lineitem").join(t.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.col("n_nationkey") % 5
    head = (F.when(kind == 0, "Datos_PY-").when(kind == 1, "ni ventas ").when(kind == 2, "CostaRica_")
            .when(kind == 3, "x_HN_PA_").otherwise("otros_"))
    files = place.select(F.concat(head, F.col("n_name"), F.lit(".csv")).alias("ARCHIVO"))
    return files.withColumn("PAIS", country_from_file(F.col("ARCHIVO"))).groupBy("ARCHIVO", "PAIS").agg(
        F.count("*").alias("N"))


@query("sca_06_ciclico", "FECHA t, SEMANA_SIN d6, SEMANA_COS d6, MES_SIN d6, MES_COS d6", """
SELECT DISTINCT FECHA, sin(2 * pi() * weekofyear(FECHA) / 52) AS SEMANA_SIN, cos(2 * pi() * weekofyear(FECHA) / 52) AS SEMANA_COS,
  sin(2 * pi() * month(FECHA) / 12) AS MES_SIN, cos(2 * pi() * month(FECHA) / 12) AS MES_COS FROM mv""")
def _(t):
    d = F.col("FECHA")
    ws, wc = cyclic(F.weekofyear(d), 52)
    ms, mc = cyclic(F.month(d), 12)
    return t.movements.select(d, ws.alias("SEMANA_SIN"), wc.alias("SEMANA_COS"), ms.alias("MES_SIN"),
                              mc.alias("MES_COS")).distinct()


@query("sca_07_08_razones", "CODIGO_SKU s, RAZON d6, ACOTADO d2, PAR d1", """
SELECT CODIGO_SKU, sum(VALUE) / nullif(sum(VALUE) - 500, 0) AS RAZON, least(greatest(sum(VALUE) - 300, 0), 400) AS ACOTADO,
  round_even(sum(VALUE) / 4 * 10, 0) / 10 AS PAR FROM sales GROUP BY 1""")
def _(t):
    s = t.sales.groupBy("CODIGO_SKU").agg(F.sum("VALUE").alias("v"))
    v = F.col("v")
    return s.select("CODIGO_SKU", safe_ratio(v, v - 500).alias("RAZON"),
                    clip(v - 300, F.lit(0.0), F.lit(400.0)).alias("ACOTADO"), rounded_even(v / 4, 1).alias("PAR"))


@query("sca_09_10_etiquetas", "TIPO_TRANSACCION s, ETIQUETA s, TIER s, TIER_ORDEN l, N l", """
SELECT TIPO_TRANSACCION, CASE TIPO_TRANSACCION WHEN 'SALES' THEN 'VENTA' WHEN 'INVENTORY' THEN 'INVENTARIO_BODEGA'
    WHEN 'TRANSITS' THEN 'TRANSITO' END AS ETIQUETA, TIER,
  CASE TIER WHEN 'ENTRY' THEN 1 WHEN 'LOW' THEN 2 WHEN 'MID' THEN 4 WHEN 'HIGH' THEN 6 WHEN 'FLAGSHIP' THEN 7 ELSE 0 END
    AS TIER_ORDEN, count(*) AS N FROM mv GROUP BY ALL""")
def _(t):
    return t.movements.select(
        "TIPO_TRANSACCION", type_label(F.col("TIPO_TRANSACCION")).alias("ETIQUETA"), "TIER",
        tier_rank(F.col("TIER")).alias("TIER_ORDEN"),
    ).groupBy("TIPO_TRANSACCION", "ETIQUETA", "TIER", "TIER_ORDEN").agg(F.count("*").alias("N"))
