from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stockweave.plans import dashboard, eda, features, forecast, inventory, product, profile, sales

D = date(2024, 1, 1)
S = "PAIS string, ANIO int, MES int, YEAR_MONTH string, FECHA date, VALUE double, PRECIO_UNITARIO double, INGRESO_TOTAL double, CODIGO_SKU string, CODIGO_BODEGA string, MARCA string, MODELO string, TIER string, ESTADO string, COSTO double, FAMILIA string"


def sale(ym="2024-01", value=1.0, price=10.0, sku="1", pais="PY", day=1, **kw):
    y, m = int(ym[:4]), int(ym[5:])
    row = dict(PAIS=pais, ANIO=y, MES=m, YEAR_MONTH=ym, FECHA=date(y, m, day), VALUE=float(value),
               PRECIO_UNITARIO=float(price), INGRESO_TOTAL=float(value * price), CODIGO_SKU=sku, CODIGO_BODEGA="B", MARCA="M", MODELO="X", TIER="LOW",
               ESTADO="ACTIVE", COSTO=float(value * price), FAMILIA="F")
    row.update(kw)
    return tuple(row.values())


def table(spark, rows):
    return spark.createDataFrame(rows, S)


def test_growth_against_previous_present_period(spark):
    df = sales.monthly(table(spark, [
        sale("2022-03", 10), sale("2023-02", 0), sale("2023-05", 30), sale("2024-03", 15), sale("2024-05", 60)]))
    got = {r.YEAR_MONTH: r for r in df.collect()}
    assert got["2022-03"].CRECIMIENTO_UNID_MOM is None
    assert got["2023-02"].CRECIMIENTO_UNID_MOM == -1
    assert got["2023-05"].CRECIMIENTO_UNID_MOM is None  # previous value is zero
    assert got["2024-03"].CRECIMIENTO_UNID_MOM == -0.5  # previous present month, not the previous calendar month
    assert got["2024-03"].CRECIMIENTO_UNID_YOY == 0.5  # the year between is missing
    assert got["2024-05"].CRECIMIENTO_UNID_YOY == 1.0


def test_headline_without_stock_has_no_sell_through(spark):
    s = table(spark, [sale(value=4, price=5)])
    got = {r.KPI: r.VALOR for r in sales.headline(s, s.filter("VALUE < 0")).collect()}
    assert got == {"Unidades vendidas": 4, "Ingresos totales": 20, "ASP": 5, "Sell-through Rate": None}


def test_null_brand_counts_in_shares_and_null_tier_can_go(spark):
    s = table(spark, [sale(value=1, MARCA=None, TIER=None), sale(value=3)])
    brands = {r.MARCA: r.PARTICIPACION_UNIDADES for r in product.brands(s).collect()}
    assert brands == {None: 0.25, "M": 0.75}
    assert product.tiers(s).count() == 2
    assert [r.PARTICIPACION_UNIDADES for r in product.tiers(s, drop_null=True).collect()] == [1.0]
    assert [r.MARCA for r in product.top_brands(product.brands(s)).collect()] == ["M"]


def test_top_models_ties_break_on_name(spark):
    s = table(spark, [sale(MODELO=m) for m in "dbca"])
    assert [r.MODELO for r in product.top_models(s, 2).orderBy("MODELO").collect()] == ["a", "b"]


def test_month_stock_variants(spark):
    iv = table(spark, [sale(value=v, day=d, sku=k) for k, d, v in [("1", 1, 10), ("1", 20, 4), ("2", 5, 6), ("2", 5, 2)]])
    a = inventory.snapshot_by_position(iv).collect()[0]
    assert (a.INV_INICIAL, a.INV_CIERRE, a.INV_PROMEDIO, a.DIAS_MES) == (12, 10, 11, 31)
    b = inventory.snapshot_by_day(iv).collect()[0]
    assert (b.INV_INICIAL, b.INV_CIERRE, b.INV_PROMEDIO) == (10, 4, pytest.approx(22 / 3))
    s = table(spark, [sale(value=11)])
    r = inventory.monthly_ratios(s, inventory.snapshot_by_position(iv)).collect()[0]
    assert (r.DOH, r.STOCK_TURNOVER, r.SELL_THROUGH) == (31, 1, pytest.approx(11 / 21))
    assert inventory.monthly_ratios(s, inventory.snapshot_by_position(iv), 30).collect()[0].DOH == 30


def test_fill_rates(spark):
    iv = table(spark, [sale(sku="1", day=1), sale(sku="1", day=2), sale(sku="2", day=1), sale(sku="3", value=0)])
    s = table(spark, [sale(sku="1", day=9), sale(sku="9", day=9)])
    by_sku = {r.CODIGO_SKU: r.FILL_RATE for r in inventory.fill_rate_by_sku(s, iv).collect()}
    assert by_sku == {"1": 0.5, "2": 0, "3": 0}
    m = inventory.fill_rate_by_month(s, iv).collect()[0]
    assert (m.SKUS_CON_INVENTARIO, m.SKUS_CON_VENTA, m.FILL_RATE) == (2, 1, 0.5)


def test_diagnosis_takes_first_known_attribute(spark):
    iv = table(spark, [sale("2024-02", 5, sku="1", day=1, MODELO=None), sale("2024-02", 5, sku="1", day=2, MODELO="new"),
                       sale("2024-02", 1, sku="2"), sale("2024-01", 9, sku="3")])
    s = table(spark, [sale("2024-02", 1, sku="2"), sale("2024-01", 1, sku="1")])
    d = inventory.last_month_diagnosis(s, iv)
    got = {r.CODIGO_SKU: (r.INV_TOTAL, r.MODELO, r.VENDIO, r.TIPO_SKU) for r in d.collect()}
    assert got == {"1": (10, "new", False, "Sin venta en el mes"), "2": (1, "X", True, "Con venta")}
    assert [r.CODIGO_SKU for r in inventory.dead_stock(d).collect()] == ["1"]


def test_stockout_counts_skus_and_rows(spark):
    rates = spark.createDataFrame([("PY", "1", "a", 0.5), ("PY", "1", "b", 0.1), ("PY", "2", "a", 0.0)],
                                  "PAIS string, CODIGO_SKU string, CODIGO_BODEGA string, STOCKOUT_RATE double")
    r = inventory.country_stockout(rates).collect()[0]
    assert (r.SKUS_CON_STOCKOUT, r.FILAS_CON_STOCKOUT, r.STOCKOUT_RATE_PROM) == (1, 2, pytest.approx(0.2))


def test_executive_stock_sum_and_closing(spark):
    iv = table(spark, [sale(value=5, day=1), sale(value=7, day=9)])
    r = sales.executive(table(spark, [sale(value=2)]), iv).collect()[0]
    assert (r.INV_SUMA_MES, r.INV_CIERRE, r.INV_CIERRE_REAL, r.BODEGAS_ACTIVAS) == (12, 12, 7, 1)


def weekly(spark, values, sku="1", **kw):
    return [sale(value=v, sku=sku, **{"FECHA": D + timedelta(7 * i), **kw}) for i, v in enumerate(values)]


def test_features_of_short_and_long_series(spark):
    f = features.sku_features(features.weekly_demand(table(spark, weekly(spark, range(1, 16)) + weekly(spark, [9], "2"))))
    one = f.filter("CODIGO_SKU = '2'").collect()[0]
    assert one.LAG_1W is None and one.ROLLING_4W_MEAN is None and one.ROLLING_4W_STD == 0
    last = f.filter("CODIGO_SKU = '1'").orderBy(F.desc("YEAR_WEEK")).first()
    assert (last.LAG_1W, last.LAG_13W, last.ROLLING_4W_MEAN, last.ROLLING_8W_MEAN) == (14, 2, 12.5, 10.5)
    assert last.ROLLING_4W_STD == pytest.approx(1.2909944)
    second = f.filter("CODIGO_SKU = '1'").orderBy("YEAR_WEEK").collect()[1]
    assert second.ROLLING_4W_STD == 0  # a single earlier row


def test_null_keys_leave_the_weekly_series(spark):
    rows = table(spark, [sale(FAMILIA=None), sale(), sale(MODELO="Y")])
    assert features.weekly_demand(rows).count() == 2
    assert features.weekly_range_demand(rows).collect()[0].NUM_SKUS == 3


def test_missing_weeks_can_be_added(spark):
    rows = table(spark, [sale(value=5, FECHA=D), sale(value=6, FECHA=D + timedelta(21))])
    w = features.dense_weeks(features.weekly_demand(rows), features.SKU_KEYS, "DEMANDA").orderBy("YEAR_WEEK").collect()
    assert [(r.YEAR_WEEK, r.DEMANDA) for r in w] == [(D + timedelta(7 * i), v) for i, v in enumerate([5, 0, 0, 6])]


@pytest.mark.parametrize("weeks", [[1] * 10, [1, 1, 5, 1], [3], [1, 9], [2, 1, 1, 1, 1]])
def test_split_is_the_nearest_row_quantile(spark, weeks):
    days = [D + timedelta(7 * i) for i, n in enumerate(weeks) for _ in range(n)]
    df = spark.createDataFrame([(d,) for d in days], "YEAR_WEEK date")
    want = sorted(days)[round(0.8 * (len(days) - 1))]  # half-even
    assert features.split_week(df).collect()[0].CORTE == want
    sides = features.with_side(df).groupBy("LADO").agg(F.min("YEAR_WEEK").alias("a"), F.max("YEAR_WEEK").alias("z")).collect()
    ends = {r.LADO: r for r in sides}
    assert "TEST" not in ends or ends["TRAIN"].z < ends["TEST"].a


def test_codes_are_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("b",)], "x string")
    assert sorted(map(tuple, features.with_codes(df, ["x"]).collect())) == [("a", 0), ("b", 1), ("b", 1), ("c", 2)]


def test_metrics(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, 3.0), ("m", 0.0, 1.0)], "MODELO_PRED string, Y double, PRED double")
    r = forecast.metrics(df).collect()[0]
    assert (r.MAE, r.MAPE, r.N_MUESTRAS) == (pytest.approx(2 / 3), pytest.approx(50), 3)
    assert r.RMSE == pytest.approx((2 / 3) ** 0.5)
    assert r.R2 == pytest.approx(1 - 2 / (14 / 3))


def test_models_train_score_save(spark, tmp_path):
    from stockweave.schemas import ForecastParams

    small = ForecastParams(forest_trees=3, forest_depth=3, boost_rounds=3, boost_depth=3)
    data = [r for k in range(6) for r in weekly(spark, [10 + (i * (k + 3)) % 7 for i in range(40)], str(k), MARCA=f"M{k % 2}")]
    s = table(spark, data)
    rows = forecast.training_rows(s, small).cache()
    models = forecast.fit_sku_models(rows, small)
    preds = forecast.predictions(models, rows)
    assert preds.filter("PRED < 0").count() == 0
    assert forecast.metrics(preds).count() == 3
    summary = {r.metrica: r.valor for r in forecast.run_summary(forecast.metrics(preds), rows).collect()}
    assert summary["modelo_ganador"] in models and int(summary["test_muestras"]) == rows.filter("LADO = 'TEST'").count()
    forecast.save_model(models["Boosting"], str(tmp_path / "m"))
    again = forecast.predictions({"Boosting": forecast.load_model(str(tmp_path / "m"))}, rows)
    a = preds.filter("MODELO_PRED = 'Boosting'").agg(F.sum("PRED")).first()[0]
    assert again.agg(F.sum("PRED")).first()[0] == pytest.approx(a)
    importance = forecast.importances(models, features.SKU_FEATURES, spark).groupBy("MODELO_PRED").agg(
        F.count("*").alias("n"), F.sum("IMPORTANCIA").alias("s")).collect()
    assert {r.MODELO_PRED: (r.n, round(r.s, 9)) for r in importance} == {"Random Forest": (22, 1), "Boosting": (22, 1)}


def test_train_job_writes_models_scores_and_importances(spark, tmp_path):
    from stockweave import jobs
    from stockweave.schemas import ForecastParams

    small = ForecastParams(forest_trees=2, forest_depth=2, boost_rounds=2, boost_depth=2)
    data = [r for k in range(4) for r in weekly(spark, [10 + (i * (k + 3)) % 7 for i in range(40)], str(k), MARCA=f"M{k % 2}")]
    table(spark, data).withColumn("TIPO_TRANSACCION", F.lit("SALES")).write.parquet(str(tmp_path / "fact"))
    jobs.train(spark, str(tmp_path / "fact"), str(tmp_path / "out"), small)

    def sheet(name):
        return spark.read.option("header", True).csv(str(tmp_path / "out" / "reporte_modelos" / name))

    assert sheet("importancias").count() == 44
    assert sheet("predicciones_test").count() == spark.read.parquet(str(tmp_path / "out" / "predicciones_test")).count() > 0
    assert {r.MODELO_PRED for r in sheet("metricas_globales").collect()} == set(forecast.MODEL_NAMES)
    assert forecast.load_model(str(tmp_path / "out" / "model_boosting_gama")).stages[-1].featureImportances.size == len(features.RANGE_FEATURES)


def test_series_without_gaps_and_weeks_ending_monday(spark):
    s = table(spark, [sale("2024-01", 2), sale("2024-04", 3)])
    assert [r.UNIDADES for r in eda.monthly_series(s).orderBy("MES").collect()] == [2, 0, 0, 3]
    days = table(spark, [sale(FECHA=date(2024, 1, d)) for d in (1, 2, 8, 9)])
    assert sorted(r.SEMANA.day for r in eda.weekly_by_country(days).collect()) == [1, 8, 15]


def test_pareto_shares(spark):
    s = table(spark, [sale(value=v, sku=k) for k, v in [("a", 50), ("b", 30), ("c", 10), ("d", 10)]])
    rows = eda.pareto(s).orderBy("RANK").collect()
    assert [(r.CODIGO_SKU, r.PCT_ACUM, r.RANK) for r in rows] == [("a", 50, 1), ("b", 80, 2), ("c", 90, 3), ("d", 100, 4)]
    assert eda.pareto_head(eda.pareto(s)).collect()[0].SKUS_80 == 2


def test_missing_days(spark):
    df = spark.createDataFrame([("a", D), ("a", D + timedelta(3)), ("b", D), ("b", D + timedelta(1))], "g string, FECHA date")
    assert profile.missing_days(df).count() == 1
    assert sorted(r.FECHA for r in profile.missing_days(df, ["g"]).collect()) == [D + timedelta(1), D + timedelta(2)]


def test_reading_absent_results(spark, tmp_path):
    from stockweave.sinks import read_result

    assert read_result(spark, str(tmp_path / "no"), "a int").count() == 0


def test_batch_view_holds_the_last_seen_value(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(1, 8)], "ventana int, stockouts int")
    got = [r.stockouts_batch for r in dashboard.batch_view(df, 3).orderBy("ventana").collect()]
    assert got == [None, None, 30, 30, 30, 60, 60]


def test_devices_are_merged_whatever_size_the_optimizer_takes_them_for(spark):
    devices = spark.createDataFrame([("PY", "1", "X"), ("PY", "2", "Y")], "PAIS string, CODIGO_SKU string, MODELO string")
    totals = eda.sales_by_sku(table(spark, [sale(sku="1"), sale(sku="3")]))
    out = eda.with_devices(totals, devices, ["PAIS", "CODIGO_SKU"])
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.CODIGO_SKU, r.MODELO) for r in out.collect()) == [("1", "X"), ("3", None)]


def test_box_of_rows_that_stand_for_many(spark):
    rows = [("A", 1.0, 3), ("A", 2.0, 1), ("A", 4.0, 2), ("A", 90.0, 2), ("B", 5.0, 1), (None, 7.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, n bigint")
    single = df.select("g", "v", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")
    weighted, plain = profile.box_plot(df, "v", ["g"], repeat="n"), profile.box_plot(single, "v", ["g"])
    assert sorted(map(tuple, weighted.collect())) == sorted(map(tuple, plain.collect()))
    assert {r.g: r.ATIPICOS for r in weighted.collect()} == {"A": 2, "B": 0}


def test_boxes_are_broadcast(spark):
    out = profile.box_plot(table(spark, [sale(price=p) for p in (1, 2, 3, 50)]), "PRECIO_UNITARIO", ["TIER"])
    assert "strategy=broadcast" in out._jdf.queryExecution().analyzed().toString()
