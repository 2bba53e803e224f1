from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockweave.operators import cleaning, gapfill, outliers, ranking
from stockweave.operators.enrich import device_catalogue, enriched, filled_from
from stockweave.operators.quantiles import exact_quantiles
from stockweave.operators.slices import Running, dealt, sliced, with_row_number, with_running
from stockweave.plans.clean_fact import clean_fact
from stockweave.schemas import CleaningParams

D = date(2024, 1, 1)


def raw(spark, rows):
    return spark.createDataFrame(rows, (
        "PAIS string, FECHA_VENTA_INVENTARIO string, TIPO_TRANSACCION string, CODIGO_SKU string, CODIGO_BODEGA string, "
        "VALUE string, COSTO string, SOURCE_FILE string, SOURCE_COUNTRY string, CANAL string"))


def movement(**kw):
    base = dict(PAIS="PY", FECHA="20240105", TIPO="SALES", SKU="1", BOD="B", VALUE="2", COSTO="10", FILE="a", CTRY="PARAGUAY", CANAL="X")
    base.update(kw)
    return tuple(base.values())


def test_bad_dates_go(spark):
    days = ["20211399", "texto", "20201231", None, "20210101", "20251214", "20251215", "20210101.0"]
    df = raw(spark, [movement(FECHA=d, SKU=str(i)) for i, d in enumerate(days)])
    out = clean_fact(df, fill_gaps=False)
    assert sorted(r.CODIGO_SKU for r in out.collect()) == ["4", "5", "7"]


def test_values_prices_and_types(spark):
    df = raw(spark, [
        movement(SKU="ok"), movement(SKU="v0", VALUE="0"), movement(SKU="c0", COSTO="0"), movement(SKU="cheap", VALUE="10"),
        movement(SKU="text", VALUE="n/a"), movement(SKU="type", TIPO="SERVICE LEVEL"), movement(SKU="lower", TIPO=" sales "),
        movement(SKU="nan", COSTO="nan")])
    assert sorted(r.CODIGO_SKU for r in clean_fact(df, fill_gaps=False).collect()) == ["LOWER", "OK"]
    counts = {r.PASO: r.FILAS for r in cleaning.step_counts(cleaning.typed(df)).collect()}
    assert counts == {"tipos": 1, "nulos_ceros": 4, "precio": 1, "fecha_invalida": 0, "fecha_minima": 0, "fecha_corte": 0,
                      "copias": 0, "restantes": 2}


def test_zero_stock_is_kept_on_request(spark):
    df = raw(spark, [movement(TIPO="INVENTORY", VALUE="0"), movement(TIPO="SALES", VALUE="0")])
    assert clean_fact(df, fill_gaps=False).count() == 0
    out = clean_fact(df, params=CleaningParams(keep_zero_inventory=True), fill_gaps=False)
    assert [r.TIPO_TRANSACCION for r in out.collect()] == ["INVENTORY"]


def test_first_file_wins_among_copies(spark):
    df = raw(spark, [movement(FILE="b", CANAL="two"), movement(FILE="a", CANAL="one"), movement(FILE="a", CANAL="zzz")])
    out = clean_fact(df, fill_gaps=False).collect()
    assert [(r.SOURCE_FILE, r.CANAL) for r in out] == [("A", "ONE")]
    counts = {r.PASO: r.FILAS for r in cleaning.step_counts(cleaning.typed(df)).collect()}
    assert (counts["copias"], counts["restantes"]) == (2, 1)
    none = {r.PASO: r.FILAS for r in cleaning.step_counts(cleaning.typed(df.limit(0))).collect()}
    assert set(none.values()) == {0}


def stock(spark, rows):
    return spark.createDataFrame(rows, "PAIS string, CODIGO_SKU string, CODIGO_BODEGA string, FECHA date, VALUE double, COSTO double")


def test_gap_fill_rules(spark):
    iv = stock(spark, [
        ("PY", "1", "B", D, 3.0, 9.0), ("PY", "1", "B", D, 2.0, 8.0), ("PY", "1", "B", D + timedelta(3), 7.9, 1.0),
        ("NI", "1", "B", D + timedelta(2), 4.0, 5.0)])
    got = {(r.PAIS, r.FECHA): (r.VALUE, r.COSTO) for r in gapfill.filled_days(iv).collect()}
    assert len(got) == 2 * 4
    assert [got["PY", D + timedelta(i)] for i in range(4)] == [(5.0, 8.0), (5.0, 8.0), (5.0, 8.0), (7.0, 8.0)]
    assert [got["NI", D + timedelta(i)][0] for i in range(4)] == [0.0, 0.0, 4.0, 4.0]
    kept = gapfill.filled_days(iv, ["CODIGO_SKU"], as_int=False)
    assert max(r.VALUE for r in kept.collect()) == pytest.approx(7.9)


def test_gap_fill_replaces_stock_rows_only(spark):
    df = clean_fact(raw(spark, [
        movement(TIPO="INVENTORY", FECHA="20240101"), movement(TIPO="INVENTORY", FECHA="20240104", VALUE="4", COSTO="40"),
        movement(TIPO="SALES", FECHA="20240102")]))
    rows = df.orderBy("TIPO_TRANSACCION", "FECHA").collect()
    assert [r.TIPO_TRANSACCION for r in rows] == ["INVENTORY"] * 4 + ["SALES"]
    assert [r.VALUE for r in rows[:4]] == [2.0, 2.0, 2.0, 4.0]
    assert rows[1].FECHA_VENTA_INVENTARIO == 20240102 and rows[1].ANOMES == 202401 and rows[1].COSTO == 10.0
    assert rows[0].CANAL is None and rows[4].CANAL == "X"


def test_runs_give_the_filled_stockout(spark):
    rng = np.random.default_rng(1)
    iv = stock(spark, [(str(k % 2), str(k), "B", D + timedelta(int(d)), float(rng.integers(0, 3)) / 2, 1.0)
                       for k in range(6) for d in rng.choice(30, 8, replace=False)])
    from stockweave.plans.inventory import stockout_rate

    a = stockout_rate(gapfill.filled_days(iv)).select("CODIGO_SKU", "DIAS_TOTALES", "DIAS_STOCKOUT")
    b = gapfill.stockout_from_runs(iv).select("CODIGO_SKU", "DIAS_TOTALES", "DIAS_STOCKOUT")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(7)
    parts = {"hot": rng.normal(100, 30, 6000).round(1), "one": [5.0], "two": [1.0, 2.0], "same": [3.0] * 500,
             "few": rng.random(49), "edge": rng.random(51), None: rng.random(400)}
    data = [(k, float(v)) for k, vs in parts.items() for v in vs]
    df = spark.createDataFrame(data, "k string, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, accuracy).collect()}
    assert set(got) == set(parts)
    for k, vs in parts.items():
        assert got[k].N == len(vs)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12), (k, name)
    whole = exact_quantiles(df, [], "v", probs, accuracy).collect()[0]
    assert whole.c == pytest.approx(np.quantile([v for _, v in data], 0.5), rel=1e-12)


def test_a_coarse_sketch_changes_no_quantile(spark):
    n = 1_000_000
    value = F.when(F.col("id") % 3 == 0, F.lit(7.25)).otherwise(F.exp(F.hash("id") / F.lit(1.5e8)))
    df = spark.range(n).select(F.when(F.col("id") % 4 > 0, F.lit("hot")).alias("k"), value.alias("v"))
    pdf = df.toPandas()
    probs = {"a": 0.001, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.9999}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, accuracy=10).collect()}
    for k, vs in (("hot", pdf[pdf.k == "hot"].v), (None, pdf[pdf.k.isna()].v)):
        assert got[k].N == len(vs)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12), (k, name)


def test_repeated_rows_weigh_in_quantiles(spark):
    df = spark.createDataFrame([("a", float(v), 3) for v in range(5)] + [("b", 1.0, 1)], "k string, v double, t int")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"m": 0.5, "h": 0.95}, repeat="t").collect()}
    assert got["a"].N == 15 and got["a"].m == 2.0 and got["a"].h == pytest.approx(np.quantile(np.repeat(range(5), 3), 0.95))
    assert (got["b"].N, got["b"].m) == (1, 1.0)
    assert exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
    assert exact_quantiles(df.limit(0), [], "v", {"m": 0.5}).count() == 0


def test_iqr_edges(spark):
    prices = {"SALES": [10, 11, 12, 13, 14, 500.0], "INVENTORY": [5.0] * 9 + [99], "TRANSITS": [1, 2, 3, 4.0]}
    df = spark.createDataFrame([(t, float(v)) for t, vs in prices.items() for v in vs] + [("SALES", None)],
                               "TIPO_TRANSACCION string, PRECIO_UNITARIO double")
    out = outliers.capped_prices(df).collect()
    assert len(out) == 21
    assert [r.PRECIO_UNITARIO for r in out if r.ES_OUTLIER] == [pytest.approx(13.75 + 1.5 * 2.5)]
    assert max(r.PRECIO_UNITARIO for r in out if r.TIPO_TRANSACCION == "INVENTORY") == 99
    low = spark.createDataFrame([("SALES", float(v)) for v in [1, 1, 2, 50, 60, 70]], df.schema)
    assert outliers.price_bounds(low).collect()[0].LIM_INF == 0.0


def test_running_values_over_slices(spark):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({
        "k": rng.choice(["hot", "a", "b", "c"], n, p=[0.7, 0.1, 0.1, 0.1]), "t": rng.permutation(n),
        "v": rng.integers(-5, 6, n)})
    df = spark.createDataFrame(pdf)
    cut = sliced(df, ["k"], ["t"], 16)
    assert cut.filter("k = 'hot'").select("_slice").distinct().count() > 5
    got = with_running(cut, ["k"], ["t"], {
        "s": Running("sum", F.col("v")), "m": Running("min", F.col("v")),
        "l": Running("last", F.when(F.col("v") > 3, F.col("v")))}).toPandas().sort_values(["k", "t"])
    want = pdf.sort_values(["k", "t"])
    by = want.groupby("k")["v"]
    assert (got["s"].to_numpy() == by.cumsum().to_numpy()).all()
    assert (got["m"].to_numpy() == by.cummin().to_numpy()).all()
    last = want["v"].where(want["v"] > 3).groupby(want["k"]).ffill()
    assert np.allclose(got["l"].to_numpy(dtype=float), last.to_numpy(), equal_nan=True)
    numbered = with_row_number(sliced(df, [], [F.desc("v"), F.asc("t")], 8), [F.desc("v"), F.asc("t")]).toPandas()
    ranked = pdf.sort_values(["v", "t"], ascending=[False, True]).reset_index(drop=True)
    assert (numbered.sort_values("RANK")["t"].to_numpy() == ranked["t"].to_numpy()).all()


def test_top_rows_limit_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id AS v")
    out = ranking.top_per_group(df, ["g"], [F.desc("v")], 2)
    assert sorted(r.v for r in out.collect()) == [994, 995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_catalogue_fills_only_nulls(spark):
    fact = spark.createDataFrame([("PY", "1", None), ("PY", "2", "OWN"), ("NI", "1", None)], "PAIS string, CODIGO_SKU string, MARCA string")
    dim = spark.createDataFrame([("PY", "1", "CAT", "T"), ("PY", "2", "CAT", "T")], "PAIS string, CODIGO_SKU string, MARCA string, TIER string")
    got = sorted((r.PAIS, r.CODIGO_SKU, r.MARCA, r.TIER) for r in filled_from(fact, dim, ["PAIS", "CODIGO_SKU"]).collect())
    assert got == [("NI", "1", None, None), ("PY", "1", "CAT", "T"), ("PY", "2", "OWN", "T")]


def test_bounds_of_the_filled_table_without_its_rows(spark):
    rng = np.random.default_rng(5)
    rows = [("INVENTORY", "PY", str(k), "B", D + timedelta(int(d)), 1.0, float(rng.integers(1, 99)), float(rng.integers(1, 99)))
            for k in range(25) for d in rng.choice(20, 3, replace=False)]
    rows += [("SALES", "PY", "1", "B", D, 1.0, 1.0, float(v)) for v in rng.integers(1, 50, 30)]
    df = spark.createDataFrame(rows, "TIPO_TRANSACCION string, PAIS string, CODIGO_SKU string, CODIGO_BODEGA string, FECHA date, "
                               "VALUE double, COSTO double, PRECIO_UNITARIO double")
    direct = outliers.price_bounds(gapfill.with_filled_inventory(df)).orderBy("TIPO_TRANSACCION").collect()
    short = outliers.price_bounds(gapfill.filled_prices(df), repeat="VECES").orderBy("TIPO_TRANSACCION").collect()
    assert direct == short and len(direct) == 2


def test_to_number_takes_no_type_suffix(spark):
    from stockweave.functions.numbers import to_number

    texts = ["5d", "7F", " 5 ", "-1.5e3", ".5", "3.", "x", "", None, "0x1", "nan"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", to_number(F.col("t")).alias("v"))
    assert [r["v"] for r in got.orderBy("i").collect()] == [None, None, 5.0, -1500.0, 0.5, 3.0, None, None, None, None, None]


def test_catalogue_rows_of_one_scan_task_are_sorted_by_many(spark):
    rows = [("PY", str(i % 50), "a") for i in range(400)] + [("PY", "hot", "b")] * 400 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "Country string, SKU string, Brand string").coalesce(1)
    spread = dealt(df, ["Country", "SKU"])
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and sum(sizes) == len(rows)
    wide = dealt(spark.createDataFrame(rows[400:800], df.schema).repartition(8), ["SKU"])  # one key from eight tasks
    assert wide.groupBy(F.spark_partition_id()).count().count() > 1
    plan = device_catalogue(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert device_catalogue(df).count() == 51


def test_catalogues_are_joined_by_the_size_of_their_stored_rows(spark):
    fact = spark.createDataFrame([("PY", "1", "B"), ("PY", "9", "B")], "PAIS string, CODIGO_SKU string, CODIGO_BODEGA string")
    devices = device_catalogue(spark.createDataFrame([("py", "1", "x")], "Country string, SKU string, Brand string"))
    out = enriched(fact, devices, None)
    assert any("/devices-" in f for f in out.inputFiles())
    assert sorted((r.CODIGO_SKU, r.MARCA) for r in out.collect()) == [("1", "X"), ("9", None)]
