"""What several steps read is worked out once and read back."""

from datetime import date
from types import SimpleNamespace

from pyspark.sql import functions as F

from stockweave.plans import forecast, report
from stockweave.queries import REGISTRY
from stockweave.session import shared_folder

SALE = ("PAIS string, ANIO int, MES int, YEAR_MONTH string, FECHA date, VALUE double, PRECIO_UNITARIO double, INGRESO_TOTAL double, "
        "CODIGO_SKU string, CODIGO_BODEGA string, MARCA string, MODELO string, TIER string, ESTADO string, COSTO double, FAMILIA string")


def counted(spark, rows, schema):
    """The rows as a table, and a counter of how often a row was made."""
    made = spark.sparkContext.accumulator(0)

    def one(row):
        made.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 1).map(one), schema), made


def sales(*prices):
    return [("PY", 2024, 1, "2024-01", date(2024, 1, 1), 2.0, p, 2 * p, "1", "B", "M", "X", "LOW", "ACTIVE", 1.0, "F") for p in prices]


def test_event_catalogue_reads_its_sales_once(spark):
    rows, made = counted(spark, sales(1.0, 2.0, 6.0), SALE)
    (got,) = forecast.sku_event_catalogue(rows).collect()
    assert (got.PRECIO_MED, got.VALUE_MED, got.MARCA, got.ESTADO) == (2.0, 2.0, "M", "ACTIVE") and made.value == 3


def test_tables_of_the_report_are_read_back(spark):
    s, iv = (spark.createDataFrame(sales(1.0, 2.0), SALE) for _ in range(2))
    tables, summaries = report.stored_tables(s, iv)
    assert set(tables) == set(report.kpi_tables(s, iv)) and set(summaries) == set(report.global_tables(tables, s, iv))
    for df in (*tables.values(), *summaries.values(), *report.report_sheets(tables, summaries).values()):
        assert all(shared_folder(spark) in path for path in df.inputFiles()) and "LocalTableScan" not in df._jdf.queryExecution().toString()
    assert tables["kpi_ventas_generales"].count() == report.kpi_tables(s, iv)["kpi_ventas_generales"].count()


def test_files_of_three_layouts_read_the_movements_once(spark):
    rows = [(p, "2024-01-02", kind, "1", "B", str(n), "1.5", "PARAGUAY")
            for n, (p, kind) in enumerate([("ASIA", "Sales"), (None, " inventory "), ("ASIA", "TRANSITS")], 1)]
    names = "PAIS string, FECHA_VENTA_INVENTARIO string, TIPO_TRANSACCION string, CODIGO_SKU string, CODIGO_BODEGA string, "
    raw, made = counted(spark, rows, names + "VALUE string, COSTO string, SOURCE_COUNTRY string")
    got = REGISTRY["src_01_02_03_06_07_archivos"].run(SimpleNamespace(spark=spark, raw=raw))
    assert sorted(r.ORIGEN for r in got.collect()) == ["NICARAGUA", "PANAMA", "PARAGUAY"] and made.value == 3
    assert got.agg(F.sum("N")).first()[0] == 3
