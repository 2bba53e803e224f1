"""A forest's few long jobs use the cores, boosting's many short ones few tasks."""

from stockweave.plans import features as ft
from stockweave.plans import forecast as fc
from stockweave.schemas import ForecastParams


def test_tasks_follow_the_rows():
    assert [fc._tasks(n, True) for n in (0, 50_000, 104_750, 6_300_000)] == [1, 1, 12, 32]
    assert [fc._tasks(n, False) for n in (0, 8_000, 104_750, 6_300_000)] == [1, 1, 1, 32]


def test_forest_rows_remember_their_nodes(spark):
    forest = fc.pipelines(ft.SKU_FEATURES, ft.SKU_TARGET, ft.SKU_CATEGORIES, ForecastParams())["Random Forest"].getStages()[-1]
    assert forest.getCacheNodeIds()
