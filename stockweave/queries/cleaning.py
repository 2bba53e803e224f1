"""Cleaning, gap fill, outliers and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, enrich, gapfill, outliers
from ..operators.columns import canonical_columns, stack_frames
from ..plans.clean_fact import clean_fact, cleaned
from ..session import stored
from .base import PARAMS, query
from .kpis import FILLED

KEY = "PAIS s, TIPO_TRANSACCION s, CODIGO_SKU s, CODIGO_BODEGA s"
NUM = "VALUE d2, COSTO d2"


@query("prj_02_03_04_tipado", f"{KEY}, {NUM}, FECHA_VENTA_INVENTARIO l, SOURCE_FILE s", "SELECT * FROM typed")
def _(t):
    return cleaning.typed(t.raw)


@query("flt_01_tipos", "TIPO_TRANSACCION s, N l", """
SELECT TIPO_TRANSACCION, count(*) AS N FROM typed
WHERE TIPO_TRANSACCION IN ('SALES', 'INVENTORY', 'TRANSITS') GROUP BY 1""")
def _(t):
    rows = cleaning.of_types(cleaning.typed(t.raw))
    return rows.groupBy("TIPO_TRANSACCION").agg(F.count("*").alias("N"))


@query("flt_02_requeridos", f"{KEY}, {NUM}, FECHA_VENTA_INVENTARIO l",
       "SELECT * FROM priced")
def _(t):
    return cleaning.with_required(cleaning.of_types(cleaning.typed(t.raw)))


@query("prj_05_precio_unitario", f"{KEY}, {NUM}, PRECIO_UNITARIO d4",
       "SELECT * FROM priced WHERE PRECIO_UNITARIO > 1.0")
def _(t):
    return cleaning.with_unit_price(cleaning.with_required(cleaning.of_types(cleaning.typed(t.raw))))


@query("flt_03_04_sca_02_fechas", f"{KEY}, FECHA t, ANIO l, MES l, MES_NOMBRE s, YEAR_MONTH s", """
SELECT *, year(FECHA) AS ANIO, month(FECHA) AS MES, strftime(FECHA, '%B') AS MES_NOMBRE,
  strftime(FECHA, '%Y-%m') AS YEAR_MONTH FROM dated""")
def _(t):
    rows = cleaning.with_required(cleaning.of_types(cleaning.typed(t.raw)))
    return cleaning.with_dates(cleaning.with_unit_price(rows), PARAMS)


@query("ddp_01_sin_duplicados", f"{KEY}, FECHA t, {NUM}, SOURCE_FILE s, SOURCE_COUNTRY s", "SELECT * FROM clean")
def _(t):
    return cleaned(t.raw, PARAMS)


@query("prf_12_filas_por_paso", "PASO s, FILAS l", """
WITH f AS (
  SELECT *, coalesce(TIPO_TRANSACCION IN ('SALES', 'INVENTORY', 'TRANSITS'), FALSE) AS a,
    PAIS IS NOT NULL AND CODIGO_SKU IS NOT NULL AND CODIGO_BODEGA IS NOT NULL
      AND FECHA_VENTA_INVENTARIO IS NOT NULL AND coalesce(VALUE > 0 AND COSTO > 0, FALSE) AS b,
    CAST(try_strptime(CAST(CAST(FECHA_VENTA_INVENTARIO AS BIGINT) AS VARCHAR), '%Y%m%d') AS DATE) AS d FROM typed
), g AS (
  SELECT *, a AND b AS ab, a AND b AND COSTO / nullif(VALUE, 0) > 1 AS abc FROM f
), k AS (
  SELECT * FROM g WHERE abc AND d >= DATE '1996-01-01' AND d < DATE '2001-07-01'
), u AS (
  SELECT DISTINCT PAIS, FECHA_VENTA_INVENTARIO, TIPO_TRANSACCION, CODIGO_SKU, CODIGO_BODEGA, VALUE, COSTO FROM k
)
SELECT 'tipos' AS PASO, count(*) FILTER (NOT a) AS FILAS FROM g
UNION ALL SELECT 'nulos_ceros', count(*) FILTER (a AND NOT b) FROM g
UNION ALL SELECT 'precio', count(*) FILTER (ab AND NOT abc) FROM g
UNION ALL SELECT 'fecha_invalida', count(*) FILTER (abc AND d IS NULL) FROM g
UNION ALL SELECT 'fecha_minima', count(*) FILTER (abc AND d < DATE '1996-01-01') FROM g
UNION ALL SELECT 'fecha_corte', count(*) FILTER (abc AND d >= DATE '2001-07-01') FROM g
UNION ALL SELECT 'copias', count(*) - (SELECT count(*) FROM u) FROM k
UNION ALL SELECT 'restantes', count(*) FROM u""")
def _(t):
    return cleaning.step_counts(cleaning.typed(t.raw), PARAMS)


@query("prj_06_ingreso", "PAIS s, CODIGO_SKU s, FECHA t, VALUE d2, INGRESO_TOTAL d2", "SELECT * FROM sales")
def _(t):
    return t.sales


@query("prj_07_margen", "PAIS s, CODIGO_SKU s, INGRESO_TOTAL d2, MARGEN_BRUTO d4, MARGEN_PCT d6", """
SELECT * EXCLUDE (INGRESO_TOTAL), VALUE * P AS INGRESO_TOTAL, VALUE * P - COSTO AS MARGEN_BRUTO,
  (VALUE * P - COSTO) / (VALUE * P) AS MARGEN_PCT FROM (
  SELECT s.*, least(PRECIO_UNITARIO, 1500.0) AS P FROM sales s)""")
def _(t):
    capped = t.sales.withColumn("PRECIO_UNITARIO", F.least("PRECIO_UNITARIO", F.lit(1500.0)))
    return cleaning.with_margin(capped)


@query("flt_05_sin_eol", "PAIS s, CODIGO_SKU s, ESTADO s, N l", """
SELECT PAIS, CODIGO_SKU, ESTADO, count(*) AS N FROM sales WHERE ESTADO <> 'EOL' GROUP BY ALL""")
def _(t):
    rows = t.sales.filter(cleaning.not_muted(F.col("ESTADO")))
    return rows.groupBy("PAIS", "CODIGO_SKU", "ESTADO").agg(F.count("*").alias("N"))


@query("flt_06_por_tipo", "TIPO s, N l, UNIDADES d2", """
SELECT TIPO_TRANSACCION AS TIPO, count(*) AS N, sum(VALUE) AS UNIDADES FROM mv GROUP BY 1""")
def _(t):
    parts = [
        t.movements.filter(F.col("TIPO_TRANSACCION") == kind).agg(
            F.lit(kind).alias("TIPO"), F.count("*").alias("N"), F.sum("VALUE").alias("UNIDADES"))
        for kind in PARAMS.types
    ]
    return stack_frames(parts)


@query("set_01_union_por_nombre", "PAIS s, ORIGEN s, N l, CON_ESTADO l", """
SELECT PAIS, 'mov' AS ORIGEN, count(*) AS N, 0 AS CON_ESTADO FROM typed GROUP BY PAIS
UNION ALL SELECT PAIS, 'cat', count(*), count(ESTADO) FROM dev GROUP BY PAIS""")
def _(t):
    moves = cleaning.typed(t.raw).select("PAIS", "CODIGO_SKU", "VALUE").withColumn("ORIGEN", F.lit("mov"))
    cat = enrich.device_catalogue(t.devices).select("PAIS", "CODIGO_SKU", "ESTADO").withColumn("ORIGEN", F.lit("cat"))
    return stack_frames([moves, cat]).groupBy("PAIS", "ORIGEN").agg(
        F.count("*").alias("N"), F.count("ESTADO").alias("CON_ESTADO"))


@query("ddp_02_catalogo_devices", "PAIS s, CODIGO_SKU s, FAMILIA s, MODELO s, MARCA s, TIER s, ESTADO s",
       "SELECT * FROM dev")
def _(t):
    return enrich.device_catalogue(t.devices.unionByName(t.devices))


@query("ddp_02b_catalogo_bodegas", "PAIS s, CODIGO_BODEGA s, NOMBRE_BODEGA s, UBICACION s, TIPO_BODEGA s",
       "SELECT * FROM bod")
def _(t):
    return enrich.warehouse_catalogue(t.warehouses.unionByName(t.warehouses))


@query("ddp_03_listas_distintas", "PAIS s", "SELECT DISTINCT PAIS FROM mv WHERE PAIS IS NOT NULL")
def _(t):
    return t.movements.select("PAIS").dropna().distinct()


ENRICHED = "FROM clean c LEFT JOIN dev d USING (PAIS, CODIGO_SKU) LEFT JOIN bod b USING (PAIS, CODIGO_BODEGA)"


def _enriched(t):
    return enrich.enriched(
        cleaned(t.raw, PARAMS), enrich.device_catalogue(t.devices), enrich.warehouse_catalogue(t.warehouses))


@query("jon_01_02_enriquecido",
       f"{KEY}, FECHA t, FAMILIA s, MODELO s, MARCA s, TIER s, ESTADO s, NOMBRE_BODEGA s, UBICACION s, "
       f"TIPO_BODEGA s, {NUM}", f"SELECT * {ENRICHED}")
def _(t):
    return _enriched(t)


@query("jon_03_tasa_match", "metrica s, valor d6", f"""
SELECT 'pct_match_devices' AS metrica, count(MODELO) / count(*) AS valor {ENRICHED}
UNION ALL SELECT 'pct_match_bodegas', count(NOMBRE_BODEGA) / count(*) {ENRICHED}""")
def _(t):
    return enrich.match_rates(_enriched(t))


# --- gap fill -------------------------------------------------------------
SERIES_KEY = "PAIS s, CODIGO_SKU s, CODIGO_BODEGA s"


def _series_stock(t):
    return t.typed.filter(F.col("TIPO_TRANSACCION") == "INVENTORY")


@query("gap_01_jon_04_05_relleno_diario", f"{SERIES_KEY}, FECHA t, VALUE d2", "SELECT * FROM filled", FILLED)
def _(t):
    return gapfill.filled_days(_series_stock(t))


@query("gap_02_relleno_sin_pais", "CODIGO_SKU s, FECHA t, VALUE d2", """
SELECT g.CODIGO_SKU, g.FECHA, coalesce(last_value(v.VALUE IGNORE NULLS) OVER (
  PARTITION BY g.CODIGO_SKU ORDER BY g.FECHA ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS VALUE
FROM g LEFT JOIN v ON g.CODIGO_SKU = v.CODIGO_SKU AND g.FECHA = v.FECHA""", """
v AS (SELECT CODIGO_SKU, FECHA, sum(VALUE / 4) AS VALUE FROM ser WHERE TIPO_TRANSACCION = 'INVENTORY' GROUP BY ALL),
g AS (SELECT CODIGO_SKU, CAST(d AS DATE) AS FECHA FROM (SELECT DISTINCT CODIGO_SKU FROM v),
  (SELECT unnest(generate_series(min(FECHA), max(FECHA), INTERVAL 1 DAY)) AS d FROM v))""")
def _(t):
    quarter = _series_stock(t).withColumn("VALUE", F.col("VALUE") / 4)
    return gapfill.filled_days(quarter, ["CODIGO_SKU"], as_int=False)


@query("gap_03_tabla_con_relleno",
       "PAIS s, TIPO_TRANSACCION s, YEAR_MONTH s, N l, VALUE d2, COSTO d2, FECHA_CLAVE l", """
SELECT PAIS, TIPO_TRANSACCION, YEAR_MONTH, count(*) AS N, sum(VALUE) AS VALUE, sum(CAST(COSTO AS DECIMAL(20,4))) AS COSTO,
  max(K) AS FECHA_CLAVE FROM (
  SELECT PAIS, TIPO_TRANSACCION, YEAR_MONTH, VALUE, COSTO, NULL AS K FROM ser WHERE TIPO_TRANSACCION <> 'INVENTORY'
  UNION ALL
  SELECT f.PAIS, 'INVENTORY', strftime(f.FECHA, '%Y-%m'), f.VALUE, r.COSTO, CAST(strftime(f.FECHA, '%Y%m%d') AS BIGINT)
  FROM filled f JOIN (
    SELECT PAIS, CODIGO_SKU, CODIGO_BODEGA, first(COSTO ORDER BY FECHA, COSTO) AS COSTO FROM siv GROUP BY ALL) r
    ON f.PAIS = r.PAIS AND f.CODIGO_SKU = r.CODIGO_SKU AND f.CODIGO_BODEGA = r.CODIGO_BODEGA
) GROUP BY PAIS, TIPO_TRANSACCION, YEAR_MONTH""", FILLED)
def _(t):
    base = t.typed.withColumn("FECHA_VENTA_INVENTARIO", F.lit(None).cast("double"))
    full = gapfill.with_filled_inventory(base)
    return full.groupBy("PAIS", "TIPO_TRANSACCION", "YEAR_MONTH").agg(
        F.count("*").alias("N"), F.sum("VALUE").alias("VALUE"),
        F.sum(F.col("COSTO").cast("decimal(20,4)")).alias("COSTO"),
        F.max("FECHA_VENTA_INVENTARIO").alias("FECHA_CLAVE"))


# --- outliers -------------------------------------------------------------
IQR = """
iqr AS (
  SELECT TIPO_TRANSACCION, q1, q3, greatest(q1 - 1.5 * (q3 - q1), 0) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
    SELECT TIPO_TRANSACCION, quantile_cont(PRECIO_UNITARIO, 0.25) AS q1, quantile_cont(PRECIO_UNITARIO, 0.75) AS q3
    FROM clean GROUP BY 1 HAVING count(PRECIO_UNITARIO) >= 5) WHERE q3 > q1
)"""


@query("out_01_limites_iqr", "TIPO_TRANSACCION s, Q1 d6, Q3 d6, LIM_INF d6, LIM_SUP d6",
       "SELECT *, lo AS LIM_INF, hi AS LIM_SUP FROM iqr", IQR)
def _(t):
    return outliers.price_bounds(cleaned(t.raw, PARAMS), PARAMS)


@query("out_01b_precios_capados", f"{KEY}, FECHA t, VALUE d2, PRECIO_UNITARIO d6, ES_OUTLIER b", """
SELECT c.* REPLACE (CASE WHEN hi IS NULL THEN PRECIO_UNITARIO ELSE least(greatest(PRECIO_UNITARIO, lo), hi) END
    AS PRECIO_UNITARIO),
  coalesce(PRECIO_UNITARIO < lo OR PRECIO_UNITARIO > hi, FALSE) AS ES_OUTLIER
FROM clean c LEFT JOIN iqr i ON c.TIPO_TRANSACCION = i.TIPO_TRANSACCION""", IQR)
def _(t):
    return outliers.capped_prices(stored(cleaned(t.raw, PARAMS), "movements"), PARAMS)


@query("out_02_listado_global", "PAIS s, CODIGO_SKU s, TIPO_TRANSACCION s, FECHA t, PRECIO_UNITARIO d4", """
SELECT * FROM clean, (SELECT quantile_cont(PRECIO_UNITARIO, 0.25) AS q1, quantile_cont(PRECIO_UNITARIO, 0.75) AS q3 FROM clean)
WHERE PRECIO_UNITARIO < q1 - 1.5 * (q3 - q1) OR PRECIO_UNITARIO > q3 + 1.5 * (q3 - q1)""")
def _(t):
    return outliers.outlier_rows(stored(cleaned(t.raw, PARAMS), "movements"))


@query("hecho_limpio_completo", "PAIS s, TIPO_TRANSACCION s, MARCA s, N l, UNIDADES d2, PRECIO d4, OUTLIERS l", """
SELECT PAIS, c.TIPO_TRANSACCION, MARCA, count(*) AS N, sum(VALUE) AS UNIDADES,
  exact_avg(P) AS PRECIO, count(*) FILTER (O) AS OUTLIERS
FROM (SELECT c.*, CASE WHEN hi IS NULL THEN PRECIO_UNITARIO ELSE least(greatest(PRECIO_UNITARIO, lo), hi) END AS P,
        coalesce(PRECIO_UNITARIO < lo OR PRECIO_UNITARIO > hi, FALSE) AS O
      FROM clean c LEFT JOIN iqr i ON c.TIPO_TRANSACCION = i.TIPO_TRANSACCION) c
LEFT JOIN dev USING (PAIS, CODIGO_SKU) GROUP BY PAIS, c.TIPO_TRANSACCION, MARCA""", IQR)
def _(t):
    from ..functions import exact_mean

    fact = clean_fact(t.raw, t.devices, t.warehouses, PARAMS, fill_gaps=False)
    return fact.groupBy("PAIS", "TIPO_TRANSACCION", "MARCA").agg(
        F.count("*").alias("N"), F.sum("VALUE").alias("UNIDADES"),
        exact_mean(F.col("PRECIO_UNITARIO")).alias("PRECIO"), F.count_if("ES_OUTLIER").alias("OUTLIERS"))


SERIES_FACT = """
sdated AS (
  SELECT d.* REPLACE (upper(p_brand || '/' || p_type) AS CODIGO_SKU, SOURCE_COUNTRY AS CODIGO_BODEGA)
  FROM dated d JOIN part ON d.CODIGO_SKU = CAST(p_partkey AS VARCHAR)
),
sclean AS (
  SELECT PAIS, FECHA_VENTA_INVENTARIO, TIPO_TRANSACCION, CODIGO_SKU, CODIGO_BODEGA, VALUE, COSTO,
    min(PRECIO_UNITARIO) AS PRECIO_UNITARIO, min(FECHA) AS FECHA FROM sdated
  GROUP BY PAIS, FECHA_VENTA_INVENTARIO, TIPO_TRANSACCION, CODIGO_SKU, CODIGO_BODEGA, VALUE, COSTO
),
sinv AS (SELECT * FROM sclean WHERE TIPO_TRANSACCION = 'INVENTORY'),
sday AS (SELECT PAIS, CODIGO_SKU, CODIGO_BODEGA, FECHA, sum(VALUE) AS VALUE FROM sinv GROUP BY ALL),
sref AS (
  SELECT PAIS, CODIGO_SKU, CODIGO_BODEGA, first(PRECIO_UNITARIO ORDER BY FECHA, COSTO, PRECIO_UNITARIO) AS PRECIO
  FROM sinv GROUP BY ALL
),
sgrid AS (
  SELECT r.*, CAST(d AS DATE) AS FECHA
  FROM sref r, (SELECT unnest(generate_series(min(FECHA), max(FECHA), INTERVAL 1 DAY)) AS d FROM sday)
),
sfull AS (
  SELECT PAIS, TIPO_TRANSACCION, CODIGO_SKU, VALUE, PRECIO_UNITARIO FROM sclean WHERE TIPO_TRANSACCION <> 'INVENTORY'
  UNION ALL
  SELECT g.PAIS, 'INVENTORY', g.CODIGO_SKU, trunc(coalesce(last_value(v.VALUE IGNORE NULLS) OVER (
    PARTITION BY g.PAIS, g.CODIGO_SKU, g.CODIGO_BODEGA ORDER BY g.FECHA ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)), g.PRECIO
  FROM sgrid g LEFT JOIN sday v ON g.PAIS = v.PAIS AND g.CODIGO_SKU = v.CODIGO_SKU AND g.CODIGO_BODEGA = v.CODIGO_BODEGA
    AND g.FECHA = v.FECHA
),
siqr AS (
  SELECT TIPO_TRANSACCION, greatest(q1 - 1.5 * (q3 - q1), 0) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
    SELECT TIPO_TRANSACCION, quantile_cont(PRECIO_UNITARIO, 0.25) AS q1, quantile_cont(PRECIO_UNITARIO, 0.75) AS q3
    FROM sfull GROUP BY 1 HAVING count(PRECIO_UNITARIO) >= 5) WHERE q3 > q1
),
sdev AS (SELECT DISTINCT r_name AS PAIS, upper(p_brand || '/' || p_type) AS CODIGO_SKU, upper(p_brand) AS MARCA FROM part CROSS JOIN region)"""


def _series_raw(t):
    """Raw movements keyed by brand/type, one warehouse per country."""
    kinds = t.read("part").select(
        F.col("p_partkey").cast("string").alias("CODIGO_SKU"), F.concat_ws("/", "p_brand", "p_type").alias("_kind"))
    rows = t.raw.join(kinds, "CODIGO_SKU").withColumns({"CODIGO_SKU": F.col("_kind"), "CODIGO_BODEGA": F.col("SOURCE_COUNTRY")})
    return rows.drop("_kind")


@query("hecho_limpio_con_relleno", "PAIS s, TIPO_TRANSACCION s, MARCA s, N l, UNIDADES d2, PRECIO d4, OUTLIERS l", """
SELECT PAIS, TIPO_TRANSACCION, MARCA, count(*) AS N, sum(VALUE) AS UNIDADES, exact_avg(P) AS PRECIO, count(*) FILTER (O) AS OUTLIERS
FROM (SELECT f.*, CASE WHEN hi IS NULL THEN PRECIO_UNITARIO ELSE least(greatest(PRECIO_UNITARIO, lo), hi) END AS P,
        coalesce(PRECIO_UNITARIO < lo OR PRECIO_UNITARIO > hi, FALSE) AS O
      FROM sfull f LEFT JOIN siqr i USING (TIPO_TRANSACCION)) c
LEFT JOIN sdev USING (PAIS, CODIGO_SKU) GROUP BY PAIS, TIPO_TRANSACCION, MARCA""", SERIES_FACT)
def _(t):
    """The clean job's whole plan, gap fill and bounds over the filled prices included."""
    from ..functions import exact_mean

    kinds = t.devices.select("Country", F.concat_ws("/", "Brand", "Family").alias("COD SKU"), "Brand").distinct()
    fact = clean_fact(_series_raw(t), kinds, None, PARAMS)
    return fact.groupBy("PAIS", "TIPO_TRANSACCION", "MARCA").agg(
        F.count("*").alias("N"), F.sum("VALUE").alias("UNIDADES"),
        exact_mean(F.col("PRECIO_UNITARIO")).alias("PRECIO"), F.count_if("ES_OUTLIER").alias("OUTLIERS"))


@query("prj_01_08_09_columnas", "PAIS s, N l, SIN_CANAL l", """
SELECT PAIS, count(*) AS N, count(*) AS SIN_CANAL FROM dev GROUP BY PAIS""")
def _(t):
    from ..operators.columns import preferred_order, with_missing
    from ..schemas import CLEAN_FACT_ORDER

    out = preferred_order(with_missing(canonical_columns(t.devices), CLEAN_FACT_ORDER), CLEAN_FACT_ORDER)
    return out.groupBy("PAIS").agg(F.count("*").alias("N"), F.count_if(F.col("CANAL").isNull()).alias("SIN_CANAL"))
