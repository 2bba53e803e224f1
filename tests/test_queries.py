"""A cross-section of the registered queries against their SQL twins on the smallest data.

``tools/check.py`` compares all of them.
"""

import ast
import importlib
import importlib.util
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tools.check import TABLES, rows  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "agg_01_ventas_generales", "win_01_02_crecimiento_mensual", "agg_18_tabla_ejecutiva", "agg_04_snapshot_mes",
    "agg_07b_stockout_desde_tramos", "agg_09_fill_rate_mes", "ord_04_dead_stock", "agg_20_ranking_marcas",
    "ddp_01_sin_duplicados", "jon_03_tasa_match", "gap_03_tabla_con_relleno", "out_01b_precios_capados",
    "prf_02_resumen_limpieza", "prf_09_caja_precio_tipo", "agg_36_correlacion", "win_09_pareto", "agg_23_pivot_semana",
    "win_05_06_07_ml_01_features", "ml_04b_lados", "ml_10_metricas_pais", "agg_27_sku_nuevo", "str_05_replay",
    "str_08_a_14_alertas", "str_16_jon_18_19_transitos_sugeridos", "jon_15_ord_09_sustitutos", "win_10_vista_batch",
    "agg_42_jon_17_sobrestock", "agg_43_batch_vs_stream", "ord_10_ultimas_alertas", "ord_11_ultima_ventana", "str_07b_kpis_por_ventana", "src_01_02_03_06_07_archivos", "snk_01_hecho_particionado",
]


@pytest.fixture(scope="module")
def db():
    if not Path(FOLDER).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    got = rows(entry.queries()[name](spark, FOLDER).toPandas())
    want = rows(db.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_imports_inside_queries_resolve():
    """A query's own imports run only when it is called; each names something that is there."""
    package = Path(entry.__file__).parent / "stockweave" / "queries"
    for file in package.glob("*.py"):
        for node in ast.walk(ast.parse(file.read_text())):
            if isinstance(node, ast.ImportFrom) and node.level and node.module:
                base = ".".join(["stockweave", "queries"][: 3 - node.level])
                module = importlib.import_module(f"{base}.{node.module}")
                assert all(hasattr(module, a.name) or importlib.util.find_spec(f"{module.__name__}.{a.name}") for a in node.names), (file, node.module)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_callable():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180
