"""Sources and sinks: tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sinks, sources
from ..functions import clean_text, to_number
from ..operators import cleaning
from ..plans import forecast as fc
from ..plans import report
from ..plans.clean_fact import cleaned
from ..session import shared_folder, stored
from .base import PARAMS, query


def _dir(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


COUNTS = "SELECT PAIS, TIPO_TRANSACCION, count(*) AS N, sum(VALUE) AS UNIDADES FROM {} GROUP BY ALL"
COUNT_COLS = "PAIS s, TIPO_TRANSACCION s, N l, UNIDADES d2"


def _counts(df):
    return df.groupBy("PAIS", "TIPO_TRANSACCION").agg(F.count("*").alias("N"), F.sum("VALUE").alias("UNIDADES"))


@query("src_04_parquet", COUNT_COLS, COUNTS.format("mv"))
def _(t):
    return _counts(t.movements)


@query("src_05_columnas_y_filtro", "PAIS s, UNIDADES d2, COSTO d2", """
SELECT PAIS, sum(VALUE) AS UNIDADES, sum(CAST(COSTO AS DECIMAL(20,4))) AS COSTO FROM sales GROUP BY PAIS""")
def _(t):
    folder = _dir(t, "fact")
    sinks.write_fact(t.movements, folder)
    rows = sources.load_fact(t.spark, folder, "SALES", ["PAIS", "VALUE", "COSTO"])
    return rows.groupBy("PAIS").agg(
        F.sum("VALUE").alias("UNIDADES"), F.sum(F.col("COSTO").cast("decimal(20,4)")).alias("COSTO"))


@query("snk_01_hecho_particionado", COUNT_COLS, COUNTS.format("clean"))
def _(t):
    folder = _dir(t, "fact")
    sinks.write_fact(cleaned(t.raw, PARAMS), folder)
    return _counts(sources.load_fact(t.spark, folder))


RAW_OUT = """
SELECT SOURCE_FILE_KIND AS ORIGEN, TIPO_TRANSACCION, PAIS, count(*) AS N, sum(VALUE) AS UNIDADES FROM (
  SELECT CASE TIPO_TRANSACCION WHEN 'SALES' THEN 'PARAGUAY' WHEN 'INVENTORY' THEN 'NICARAGUA' WHEN 'TRANSITS' THEN 'PANAMA'
    END AS SOURCE_FILE_KIND, * FROM typed WHERE TIPO_TRANSACCION <> 'SERVICE LEVEL') GROUP BY ALL"""


@query("src_01_02_03_06_07_archivos", "ORIGEN s, TIPO_TRANSACCION s, PAIS s, N l, UNIDADES d2", RAW_OUT)
def _(t):
    """Raw movements as files of three layouts, found, sniffed, read and typed again."""
    folder = _dir(t, "raw")
    cols = ["PAIS", "FECHA_VENTA_INVENTARIO", "TIPO_TRANSACCION", "CODIGO_SKU", "CODIGO_BODEGA", "VALUE", "COSTO"]
    # The country comes from the data here, so that only ORIGEN depends on the file name.
    named = stored(t.raw.withColumn("PAIS", F.coalesce(clean_text(F.col("PAIS")), F.col("SOURCE_COUNTRY"))).select(*cols), "named")
    headers = {
        "Sales": ("py", ";", ["Country", "FECHA", "Tipo de Transaccion", "SKU", "Bodega", "Unidades", "Cost"]),
        " inventory ": ("NI", "|", ["PAIS", "Date", "TRANSACCION", "cod sku", "Warehouse", "UNITS", "COSTO"]),
        "TRANSITS": ("panama", ",", ["country name", "Fecha Venta", "tipo_transaccion", "SKU code", "WAREHOUSE ID", "Cantidad", "Costo"]),
    }
    for kind, (country, sep, header) in headers.items():
        part = named.filter(F.col("TIPO_TRANSACCION") == kind).toDF(*header)
        part.write.option("header", True).option("sep", sep).option("quoteAll", True).csv(f"{folder}/{country}")
    paths = sources.find_files(t.spark, folder)
    # The writer names its files; the folder carries the country that a file name would.
    loaded = sources.read_files(t.spark, paths)
    rows = cleaning.typed(loaded.drop("SOURCE_COUNTRY"))
    origin = (F.when(F.col("TIPO_TRANSACCION") == "SALES", "PARAGUAY").when(F.col("TIPO_TRANSACCION") == "INVENTORY", "NICARAGUA")
              .otherwise("PANAMA"))
    return rows.groupBy(origin.alias("ORIGEN"), "TIPO_TRANSACCION", "PAIS").agg(
        F.count("*").alias("N"), F.sum("VALUE").alias("UNIDADES"))


@query("src_07_parquet_de_varias_cabeceras", COUNT_COLS, COUNTS.format("mv"))
def _(t):
    """Parquet files of two header spellings, units as number and as text."""
    folder = _dir(t, "mixed")
    rows = t.movements.select("PAIS", "TIPO_TRANSACCION", "VALUE")
    rows.filter("TIPO_TRANSACCION = 'SALES'").write.parquet(f"{folder}/a")
    rows.filter("TIPO_TRANSACCION <> 'SALES'").select(
        F.col("PAIS").alias("Country"), F.col("TIPO_TRANSACCION").alias("Tipo de Transaccion"),
        F.col("VALUE").cast("string").alias("Unidades")).write.parquet(f"{folder}/b")
    return _counts(sources.load_movements(t.spark, folder).withColumn("VALUE", to_number(F.col("VALUE"))))


@query("src_08_catalogos", "catalogo s, filas l", """
SELECT 'devices' AS catalogo, count(*) AS filas FROM dev UNION ALL SELECT 'bodegas', count(*) FROM bod
UNION ALL SELECT 'vacio', 0""")
def _(t):
    folder = _dir(t, "catalogs")
    t.devices.write.parquet(f"{folder}/d/devices.parquet")
    t.warehouses.write.parquet(f"{folder}/b/bodegas.parquet")
    dev = sources.read_files(t.spark, sources.find_files(t.spark, f"{folder}/d"))
    bod = sources.read_files(t.spark, sources.find_files(t.spark, f"{folder}/b"))
    none = sources.load_devices(t.spark, folder)  # the writer's file names carry no hint
    parts = [df.agg(F.lit(n).alias("catalogo"), F.count("*").alias("filas"))
             for n, df in (("devices", dev), ("bodegas", bod), ("vacio", none))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("snk_02_03_04_tablas_kpi", "tabla s, filas l")
def _(t):
    folder = _dir(t, "kpis")
    s, iv = t.sales.cache(), t.stock.cache()
    tables, summaries = report.stored_tables(s, iv)
    sinks.write_tables(tables, f"{folder}/paises", by_country=True)
    sinks.write_tables(summaries, f"{folder}/global")
    sinks.write_report(report.report_sheets(tables, summaries), f"{folder}/reporte")
    places = [("paises", n) for n in tables] + [("global", n) for n in summaries]
    parts = [
        t.spark.read.option("header", True).csv(f"{folder}/{place}/{n}").agg(F.lit(n).alias("tabla"), F.count("*").alias("filas"))
        for place, n in places
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("src_11_lectura_tolerante", "tabla s, filas l", """
SELECT 'ventas' AS tabla, count(*) AS filas FROM sales UNION ALL SELECT 'ausente', 0""")
def _(t):
    folder = _dir(t, "result")
    t.sales.select("PAIS", "CODIGO_SKU", "VALUE").write.parquet(folder)
    schema = "PAIS string, CODIGO_SKU string, VALUE double"
    there = sinks.read_result(t.spark, folder, schema)
    absent = sinks.read_result(t.spark, f"{folder}-none", schema)
    return there.agg(F.lit("ventas").alias("tabla"), F.count("*").alias("filas")).unionByName(
        absent.agg(F.lit("ausente").alias("tabla"), F.count("*").alias("filas")))


@query("snk_06_07_modelo_guardado", "MODELO_PRED s, PAIS s, N_MUESTRAS l, MAE d4")
def _(t):
    from .forecast import FULL, _training

    rows, folder = _training(t), _dir(t, "model")
    fc.save_model(fc.fit_sku_models(rows, FULL, ["Random Forest"])["Random Forest"], f"{folder}/m")
    preds = fc.predictions({"Random Forest": fc.load_model(f"{folder}/m")}, rows)
    preds.write.parquet(f"{folder}/predicciones")
    return fc.metrics(t.spark.read.parquet(f"{folder}/predicciones"), ["PAIS"])
