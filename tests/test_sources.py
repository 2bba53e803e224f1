import pytest
from pyspark.sql import functions as F

from stockweave import jobs, sources
from stockweave.functions import clean_text, country_from_file
from stockweave.operators.cleaning import typed
from stockweave.operators.columns import canonical_columns, canonical_name, require_columns


@pytest.mark.parametrize("sep", [";", ",", "|", "\t"])
def test_delimiter_is_found(spark, tmp_path, sep):
    lines = [sep.join(["PAIS", "Fecha", "Tipo de Transaccion", "SKU", "Bodega", "Unidades", "Cost"]),
             sep.join(["PY", "20240105", "SALES", "A1", "B1", "3", "30.5"])]
    (tmp_path / "Datos_PY.csv").write_text("\n".join(lines))
    df = sources.load_movements(spark, str(tmp_path))
    row = df.collect()[0]
    assert (row.CODIGO_SKU, row.VALUE, row.COSTO, row.SOURCE_FILE, row.SOURCE_COUNTRY) == (
        "A1", "3", "30.5", "Datos_PY.csv", "PARAGUAY")
    assert row.ANOMES is None


def test_mixed_encodings_layouts_and_parquet(spark, tmp_path):
    (tmp_path / "a_NI.csv").write_bytes("pais;sku;marca\nNI;1;Ñandú\n".encode("latin-1"))
    (tmp_path / "b_NI.csv").write_bytes("pais,sku,marca\nNI,2,Ñandú\n".encode())
    spark.createDataFrame([("NI", 3, "Ñandú")], "PAIS string, SKU int, MARCA string").toPandas().to_parquet(
        tmp_path / "c_NI.parquet")
    df = sources.load_movements(spark, str(tmp_path))
    assert {(r.CODIGO_SKU, r.MARCA) for r in df.collect()} == {("1", "Ñandú"), ("2", "Ñandú"), ("3", "Ñandú")}


def test_parquet_of_different_headers_types_and_damage(spark, tmp_path):
    def put(name, row, schema):
        spark.createDataFrame([row], schema).toPandas().to_parquet(tmp_path / name)

    put("a_PY.parquet", ("PY", "1", 2.0), "PAIS string, SKU string, VALUE double")
    put("b_PY.parquet", ("PY", "2", 3), "Country string, CODIGO_SKU string, Unidades long")
    put("c_PY.parquet", ("PY", 3, "4"), "PAIS string, SKU long, VALUE string")
    (tmp_path / "d_PY.parquet").write_bytes(b"no such format")
    got = sources.load_movements(spark, str(tmp_path)).select("PAIS", "CODIGO_SKU", "VALUE", "SOURCE_FILE").collect()
    assert sorted(tuple(r) for r in got) == [
        ("PY", "1", "2.0", "a_PY.parquet"), ("PY", "2", "3", "b_PY.parquet"), ("PY", "3", "4", "c_PY.parquet")]


def test_headers_of_one_folder_may_differ(spark, tmp_path):
    (tmp_path / "a b+c.csv").write_text("PAIS;SKU\nPY;1\n")
    (tmp_path / "b.csv").write_text("SKU;PAIS\n2;PY\n")
    (tmp_path / "empty.csv").write_text("")
    got = sources.load_movements(spark, str(tmp_path)).select("PAIS", "CODIGO_SKU", "SOURCE_FILE").collect()
    assert sorted(tuple(r) for r in got) == [("PY", "1", "a b+c.csv"), ("PY", "2", "b.csv")]


def test_lines_that_do_not_fit_are_set_aside(spark, tmp_path):
    (tmp_path / "x.csv").write_text('PAIS,SKU,VALUE\nPY,"a,b",1\nPY,2\nPY,3,4,5\n')
    rows = sources.load_movements(spark, str(tmp_path))
    assert rows.count() == 2
    assert sorted((r.CODIGO_SKU, r.VALUE) for r in rows.collect()) == [("2", None), ("a,b", "1")]
    bad = sources.rejected_lines(spark, str(tmp_path))
    assert bad.count() == 1
    assert [(r.CODIGO_SKU, r.VALUE, r._sobra, r.SOURCE_FILE) for r in bad.collect()] == [("3", "4", "5", "x.csv")]


def test_catalogues_by_hint_and_empty(spark, tmp_path):
    (tmp_path / "Devices_PY.csv").write_text("COD_SKU,FAMILY,BRAND\n1,PHONE,ACME\n")
    (tmp_path / "Bodega_PY.csv").write_text("COD_BODEGA,NOMBRE_BODEGA\n9,Centro\n")
    assert sources.load_devices(spark, str(tmp_path)).select("CODIGO_SKU", "MARCA").collect() == [("1", "ACME")]
    assert sources.load_warehouses(spark, str(tmp_path)).count() == 1
    other = tmp_path / "none"
    other.mkdir()
    (other / "z.csv").write_text("a,b\n1,2\n")
    empty = sources.load_devices(spark, str(other))
    assert empty.count() == 0 and "TIER" in empty.columns
    nothing = tmp_path / "nothing"
    nothing.mkdir()
    with pytest.raises(FileNotFoundError):
        sources.load_movements(spark, str(nothing))


def test_header_names():
    assert canonical_name("  Tipo de   Transaccion ") == "TIPO_TRANSACCION"
    assert canonical_name("PAÍS") == "PAS"
    assert canonical_name("_unit price_") == "PRECIO_UNITARIO"
    assert canonical_name("Otro-Dato") == "OTRODATO"


def test_two_headers_with_one_target(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["SKU", "cod sku", "Codigo SKU"])
    assert canonical_columns(df).columns == ["CODIGO_SKU", "CODIGO_SKU_2", "CODIGO_SKU_3"]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="COSTO"):
        require_columns(spark.range(1), ["id", "COSTO"], "t")


def test_text_and_null_spellings(spark):
    df = spark.createDataFrame([(v,) for v in ["  a   b ", "<NA>", "nan", "None", "", "\t x\n"]], "v string")
    assert [r[0] for r in df.select(clean_text(F.col("v"))).collect()] == ["A B", None, None, None, None, "X"]


def test_country_from_file_name(spark):
    names = ["Datos_PY.csv", "ventas-CostaRica 2024.csv", "El_Salvador.csv", "x_HN_PA.csv", "SPY.csv"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    got = [r[0] for r in df.select(country_from_file(F.col("v"))).collect()]
    assert got == ["PARAGUAY", "COSTA RICA", None, "HONDURAS", None]


def test_country_codes_and_names_meet(spark):
    df = spark.createDataFrame([(None, "PARAGUAY"), ("py", None)], "PAIS string, SOURCE_COUNTRY string")
    got = typed(df, {"PY": "PARAGUAY"}).select("PAIS").collect()
    assert [r[0] for r in got] == ["PARAGUAY", "PARAGUAY"]


def test_clean_job_writes_rejects_and_steps(spark, tmp_path):
    raw, cat, out = tmp_path / "raw", tmp_path / "cat", str(tmp_path / "out")
    raw.mkdir()
    cat.mkdir()
    head = "PAIS,FECHA,TIPO_TRANSACCION,SKU,Bodega,Unidades,Cost\n"
    (raw / "x_PY.csv").write_text(head + "PY,20240105,SALES,A1,B1,3,30.5\n,20240106,SALES,A1,B1,0,30.5\nPY,20240106,SALES,A1,B1,1,9,9\n,20240107,SALES,A1,B1,2,20\n")
    (cat / "Devices_PY.csv").write_text("PAIS,COD_SKU,FAMILY,BRAND\nPY,A1,PHONE,ACME\n")
    jobs.clean(spark, str(raw), str(cat), out)
    fact = sources.load_fact(spark, f"{out}/datos_limpios").collect()
    assert sorted((r.PAIS, r.VALUE, r.MARCA) for r in fact) == [("PARAGUAY", 2.0, "ACME"), ("PARAGUAY", 3.0, "ACME")]
    assert spark.read.parquet(f"{out}/lineas_rechazadas").count() == 1
    steps = {r.PASO: r.FILAS for r in spark.read.option("header", True).csv(f"{out}/reporte_calidad/filas_por_paso").collect()}
    assert steps["nulos_ceros"] == "1" and steps["restantes"] == "2"
