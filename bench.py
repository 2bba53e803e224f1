"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local threads, BENCH_QUERIES optional
comma-separated query names.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stockweave.queries import REGISTRY  # noqa: E402
from stockweave.queries.base import run  # noqa: E402
from stockweave.session import build_session  # noqa: E402

HEADLINE = [
    "agg_01_ventas_generales", "agg_02_ventas_mensuales", "win_01_02_crecimiento_mensual", "agg_18_tabla_ejecutiva",
    "agg_06_jon_06_kpi_inventario", "agg_07_stockout_rate", "agg_07b_stockout_desde_tramos", "agg_08_jon_07_fill_rate_sku",
    "agg_10_win_04_marcas", "agg_13_jon_08_diagnostico_ultimo_mes", "ord_02_top_modelos", "agg_20_ranking_marcas",
    "ddp_01_sin_duplicados", "gap_01_jon_04_05_relleno_diario", "out_01b_precios_capados", "jon_01_02_enriquecido",
    "hecho_limpio_completo", "prf_01_nulos", "prf_05_describe_tipo", "win_09_pareto", "agg_36_correlacion",
    "agg_31_precio_mediano", "agg_24_demanda_semanal", "win_05_06_07_ml_01_features", "ml_04_corte_temporal",
    "ml_09_metricas", "str_02_ventana_de_20", "str_05_replay", "str_07_kpis", "str_08_a_14_alertas",
    "jon_15_ord_09_sustitutos", "agg_38_resumen_ventana",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": max(int(cpus), 1), "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    run("agg_45b_serie_anual", spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for name in names:
        assert name in REGISTRY, name
        start = time.perf_counter()
        run(name, spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
