"""The cleaning of movements stays small enough to be compiled, and plain texts skip the replacement."""

import re

from pyspark.sql import functions as F

from stockweave.functions.text import normal_text
from stockweave.plans.clean_fact import cleaned

RAW = ("PAIS string, FECHA_VENTA_INVENTARIO string, TIPO_TRANSACCION string, CODIGO_SKU string, CODIGO_BODEGA string, "
       "VALUE string, COSTO string, SOURCE_FILE string, SOURCE_COUNTRY string")
ROW = ("PY", "20240105", " sales ", "1", "B", "2", "10", "a.csv", "PARAGUAY")


def methods(df, capsys):
    """Bytes of the largest generated method of each compiled part of the plan."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        capsys.readouterr()
        df.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]


def test_cleaning_is_compiled(spark, tmp_path, capsys):
    """The JVM leaves methods of more than 8,000 bytes uncompiled."""
    path = str(tmp_path / "raw")
    spark.createDataFrame([ROW, ROW], RAW).write.parquet(path)
    df = cleaned(spark.read.parquet(path))
    sizes = methods(df, capsys)
    assert sizes and max(sizes) < 7000
    assert [(r.PAIS, r.TIPO_TRANSACCION, r.SOURCE_FILE) for r in df.collect()] == [("PY", "SALES", "A.CSV")]


def test_rows_are_dropped_before_their_other_texts_are_cleaned(spark):
    lines = cleaned(spark.createDataFrame([ROW], RAW))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    texts, first = (i for i, line in enumerate(lines) if "Generate inline" in line)
    assert "regexp_replace(PAIS" in lines[texts] and "regexp_replace(PAIS" not in lines[first]
    assert any("Filter" in line and "SALES" in line for line in lines[texts:first])


def test_plain_texts_are_as_with_the_replacement(spark):
    texts = ["abc", "a b", " a ", "abc\n", "\tab", "a\u00a0b", "\u2003x\u3000", "a  \n b", "", " ", "~!", "\u00f1u", "a\u0000b", "\u200bz", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.upper(F.trim(F.regexp_replace("t", r"[\s\p{Z}]+", " ")))
    for row in df.select(normal_text(F.col("t")).alias("new"), old.alias("old")).collect():
        assert row.new == row.old
