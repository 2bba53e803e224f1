"""The four jobs: clean, kpis, train, stream. ``python -m stockweave.jobs <job> --help``."""

from __future__ import annotations

import argparse
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks, sources
from .functions.text import normal_text
from .operators import cleaning
from .plans import features, forecast, profile, report
from .plans.clean_fact import clean_fact
from .plans.sales import prepared_sales, prepared_stock
from .schemas import FILE_COUNTRIES, CleaningParams, ForecastParams, StreamParams
from .session import build_session
from .streaming import events as ev
from .streaming import fold
from .streaming.run import StreamJob


def _one_country_form(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Country codes of a catalogue in the form that the fact has them."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn("PAIS", F.coalesce(F.try_element_at(known, normal_text(F.col("PAIS"))), F.col("PAIS")))


def clean(
    spark: SparkSession, raw: str, catalogues: str, out: str, params: CleaningParams = CleaningParams(),
    country_names: Mapping[str, str] = FILE_COUNTRIES,
) -> None:
    """Raw files to the clean fact, the lines that do not fit their header, and the quality report.

    ``country_names`` maps country codes to the names that file names give; {} keeps codes as they are.
    """
    movements = sources.load_movements(spark, raw)
    devices, warehouses = sources.load_devices(spark, catalogues), sources.load_warehouses(spark, catalogues)
    if country_names:
        devices, warehouses = _one_country_form(devices, country_names), _one_country_form(warehouses, country_names)
    sinks.write_fact(clean_fact(movements, devices, warehouses, params, country_names=country_names), f"{out}/datos_limpios")
    sinks.write_tables({"lineas_rechazadas": sources.rejected_lines(spark, raw)}, out, "parquet")
    rejected = spark.read.parquet(f"{out}/lineas_rechazadas")
    fact = sources.load_fact(spark, f"{out}/datos_limpios")
    from .operators.enrich import device_catalogue, match_rates, warehouse_catalogue

    sinks.write_report({
        "resumen": profile.cleaning_summary(movements, fact, device_catalogue(devices), warehouse_catalogue(warehouses)),
        "faltantes": profile.null_counts(fact),
        "por_pais": profile.value_counts(fact, "PAIS", "SIN_PAIS"),
        "por_tipo": profile.value_counts(fact, "TIPO_TRANSACCION", "SIN_TIPO"),
        "match_catalogos": match_rates(fact),
        "filas_por_paso": cleaning.step_counts(cleaning.typed(movements, country_names), params),
        "lineas_rechazadas": rejected.groupBy("SOURCE_FILE").agg(F.count("*").alias("LINEAS")),
    }, f"{out}/reporte_calidad")


def kpis(spark: SparkSession, fact_folder: str, out: str, notebook: bool = False) -> None:
    """The clean fact to KPI tables per country, summaries and the KPI report."""
    fact = sources.load_fact(spark, fact_folder)
    s = prepared_sales(fact).persist(StorageLevel.MEMORY_AND_DISK)
    iv = prepared_stock(fact).persist(StorageLevel.MEMORY_AND_DISK)
    tables, summaries = report.stored_tables(s, iv, notebook)
    sinks.write_tables(tables, f"{out}/paises", by_country=True)
    sinks.write_tables(summaries, f"{out}/global")
    sinks.write_report(report.report_sheets(tables, summaries), f"{out}/reporte_kpis")
    s.unpersist()
    iv.unpersist()


def train(spark: SparkSession, fact_folder: str, out: str, params: ForecastParams = ForecastParams()) -> None:
    """The clean fact to fitted models, their scores, predictions and the range reference."""
    sales = sources.load_fact(spark, fact_folder, "SALES")
    rows = forecast.training_rows(sales, params).persist(StorageLevel.MEMORY_AND_DISK)
    models = forecast.fit_sku_models(rows, params)
    names = {"Regresion Lineal": "model_linear", "Random Forest": "model_forest", "Boosting": "model_boosting"}
    for name, model in models.items():
        forecast.save_model(model, f"{out}/{names[name]}")
    preds = forecast.predictions(models, rows).persist(StorageLevel.MEMORY_AND_DISK)
    scores = forecast.metrics(preds)
    ranges = forecast.range_training_rows(sales, params).persist(StorageLevel.MEMORY_AND_DISK)
    range_model = forecast.fit_range_model(ranges, params)
    forecast.save_model(range_model, f"{out}/model_boosting_gama")
    reference = features.range_reference(features.weekly_range_demand(sales))
    sinks.write_tables({"predicciones_test": preds, "tabla_referencia_gama": reference}, out, "parquet")
    sinks.write_report({
        "metricas_globales": scores,
        "metricas_por_pais": forecast.metrics(preds, ["PAIS"]),
        "predicciones_test": preds,
        "importancias": forecast.importances(models, features.SKU_FEATURES, spark),
        "resumen_ejecutivo": forecast.run_summary(scores, rows),
        "metricas_gama": forecast.metrics(
            forecast.predictions({"Boosting Gama": range_model}, ranges, features.RANGE_TARGET)),
        "referencia_gama": reference,
    }, f"{out}/reporte_modelos")
    for df in (rows, preds, ranges):
        df.unpersist()


def stream(
    spark: SparkSession, topic: str, fact_folder: str | None, models: str | None, out: str, checkpoint: str,
    every: str | None = None, files_per_batch: int = 1, params: StreamParams = StreamParams(), delay: str | None = None,
) -> None:
    """JSON-line events to window KPIs, alerts, forecasts and orders; lines that are no event to a table of their own.

    Without ``delay`` no late event is lost; see ``streaming.events.once``.
    """
    initial = None
    if fact_folder:
        latest = forecast.latest_positions(sources.load_fact(spark, fact_folder, "INVENTORY", [
            "PAIS", "CODIGO_SKU", "CODIGO_BODEGA", "FECHA", "VALUE", "FAMILIA", "MODELO", "MARCA", "TIER", "ESTADO",
            "PRECIO_UNITARIO"]))
        history = forecast.recent_weeks(sources.load_fact(spark, fact_folder, "SALES"), params.history_size)
        initial = fold.initial_state(forecast.initial_stock(latest), latest, history)
    model = forecast.load_model(f"{models}/model_boosting") if models else None
    job = StreamJob(spark, out, params, initial, model)
    lines = ev.line_stream(spark, topic, files_per_batch)
    main = job.start(ev.once(ev.valid_events(lines), delay), checkpoint, every)
    bad = ev.quarantined(lines).writeStream.format("parquet").option("path", f"{out}/lineas_rechazadas").option(
        "checkpointLocation", f"{checkpoint}-rechazadas")
    trigger = {"processingTime": every} if every else {"availableNow": True}
    rejected = bad.trigger(**trigger).start()
    main.awaitTermination()
    rejected.awaitTermination()


def main() -> None:
    parser = argparse.ArgumentParser(prog="stockweave")
    jobs = parser.add_subparsers(dest="job", required=True)
    c = jobs.add_parser("clean")
    c.add_argument("raw")
    c.add_argument("catalogues")
    c.add_argument("out")
    k = jobs.add_parser("kpis")
    k.add_argument("fact")
    k.add_argument("out")
    k.add_argument("--notebook", action="store_true")
    t = jobs.add_parser("train")
    t.add_argument("fact")
    t.add_argument("out")
    s = jobs.add_parser("stream")
    s.add_argument("topic")
    s.add_argument("out")
    s.add_argument("checkpoint")
    s.add_argument("--fact")
    s.add_argument("--models")
    s.add_argument("--every")
    s.add_argument("--delay", help="forget event ids after this time and drop later events, as in '60 days'")
    a = parser.parse_args()
    spark = build_session(f"stockweave-{a.job}")
    if a.job == "clean":
        clean(spark, a.raw, a.catalogues, a.out)
    elif a.job == "kpis":
        kpis(spark, a.fact, a.out, a.notebook)
    elif a.job == "train":
        train(spark, a.fact, a.out)
    else:
        stream(spark, a.topic, a.fact, a.models, a.out, a.checkpoint, a.every, delay=a.delay)


if __name__ == "__main__":
    main()
