"""Trees grown by tasks that hold all rows: splits by brute force, MLlib's forest, saving, and what must not change them."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from stockweave.plans import forest
from stockweave.plans.forest import Forest, ForestModel, Tree, grow, split_values


def one_split(x, y, weight, categorical, min_rows=2, width=8):
    """The tree of one split on all features."""
    rng = np.random.default_rng(1)
    return grow(x.astype(np.uint8), y - y.mean(), weight, np.asarray(categorical), width, len(x), 1, min_rows, rng)


def error(y, w):
    return (w * (y - np.average(y, weights=w)) ** 2).sum() if w.sum() else 0.0


def test_split_is_the_best_of_all_bounds():
    rng = np.random.default_rng(5)
    x, weight = rng.integers(0, 8, (3, 70)), rng.poisson(1.0, 70)
    y = x[1] * 2.0 + (x[2] > 4) * 3 + rng.normal(size=70)
    tree, gains = one_split(x, y, weight, [False] * 3)
    found = max((error(y, weight) - error(y[x[j] <= b], weight[x[j] <= b]) - error(y[x[j] > b], weight[x[j] > b]), j, b)
                for j in range(3) for b in range(7) if min(weight[x[j] <= b].sum(), weight[x[j] > b].sum()) >= 2)
    assert (tree.feature[0], tree.number[0]) == found[1:] and gains[found[1]] == pytest.approx(found[0])
    left = x[found[1]] <= found[2]
    assert tree.number[1:] == pytest.approx([np.average(v[m], weights=weight[m]) for v, m in ((y - y.mean(), left), (y - y.mean(), ~left))])


def test_split_of_a_category_is_the_best_of_all_sets():
    rng = np.random.default_rng(6)
    x, weight = rng.integers(0, 5, (1, 60)), np.ones(60, int)
    y = np.asarray([4.0, 9, 1, 8, 2])[x[0]] + rng.normal(size=60)
    tree, gains = one_split(x, y, weight, [True])
    sets = [np.asarray([s >> c & 1 for c in range(5)], bool) for s in range(1, 31)]
    found = max(error(y, weight) - error(y[m[x[0]]], weight[m[x[0]]]) - error(y[~m[x[0]]], weight[~m[x[0]]]) for m in sets)
    assert gains[0] == pytest.approx(found)
    assert tree.lefts[0].tolist() == [True, False, True, False, True, False, False, False]  # the codes of low means
    got = tree.scores(x.astype(float), np.asarray([True]))
    assert set(np.round(got, 9)) == set(np.round(tree.number[1:], 9))
    again = Tree.opened(tree.packed(0), 8)
    assert (again.scores(x.astype(float), np.asarray([True])) == got).all()
    assert again.scores(np.asarray([[7.0]]), np.asarray([True])) == tree.number[2]  # a code without rows goes right


def test_no_split_where_labels_are_equal_or_rows_few():
    x, weight = np.arange(8)[None, :], np.ones(8, int)
    assert one_split(x, np.full(8, 3.0), weight, [False])[0].feature.tolist() == [-1]
    assert one_split(x, np.arange(8.0), weight, [False], min_rows=5)[0].feature.tolist() == [-1]
    assert one_split(x, np.arange(8.0), np.zeros(8, int), [False])[0].feature.tolist() == [-1]


def test_bounds_lie_between_values_of_about_equally_many_rows():
    assert split_values(np.asarray([1.0, 2, 4]), np.asarray([5, 1, 1]), 32).tolist() == [1.5, 3]
    assert split_values(np.asarray([1.0]), np.asarray([9]), 32).size == 0
    assert split_values(np.arange(100.0), np.full(100, 3), 4).tolist() == [24.5, 49.5, 74.5]
    assert split_values(np.arange(10.0), np.asarray([90, *[1] * 9]), 4).tolist() == [0.5, 1.5, 2.5]


@pytest.fixture(scope="module")
def sold(spark):
    rng = np.random.default_rng(8)
    n = 900
    brand, a, b = rng.integers(0, 6, n), rng.normal(size=n).round(2), rng.integers(0, 5, n)
    y = np.asarray([3.0, 9, 1, 7, 2, 5])[brand] + np.where(a > 0.3, 4, 0) * (b + 1) + rng.normal(size=n) * 0.3
    rows = [(f"M{i}", float(p), float(q), float(v)) for i, p, q, v in zip(brand, a, b, y, strict=True)]
    return spark.createDataFrame(rows, "brand string, a double, b double, y double").cache()


def pipeline():
    return Pipeline(stages=[
        StringIndexer(inputCol="brand", outputCol="code", handleInvalid="keep"),
        VectorAssembler(inputCols=["a", "b", "code"], outputCol="features"),
        Forest(labelCol="y", numTrees=20, maxDepth=6, minInstancesPerNode=3, featureSubsetStrategy="sqrt", seed=3, cacheNodeIds=True)])


def mean_error(model, rows):
    return model.transform(rows).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]


def test_forest_of_tasks_scores_as_mllibs_and_is_saved(spark, sold, tmp_path, monkeypatch):
    with monkeypatch.context() as few:
        few.setattr(forest, "TASK_ROWS", 899)
        whole = pipeline().fit(sold)
    assert isinstance(whole.stages[-1], RandomForestRegressionModel)  # more rows than a task holds
    spark.sparkContext.setJobGroup("forest", "")
    model = pipeline().fit(sold)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert isinstance(model.stages[-1], ForestModel) and len(model.stages[-1].trees) == 20
    assert jobs < 15  # not some for each level
    assert mean_error(model, sold) == pytest.approx(mean_error(whole, sold), rel=0.15)
    theirs, ours = (m.stages[-1].featureImportances.toArray() for m in (whole, model))
    assert ours.sum() == pytest.approx(1) and ours == pytest.approx(theirs, abs=0.1)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    want = [r.prediction for r in model.transform(sold).select("prediction").collect()]
    assert [r.prediction for r in again.transform(sold).select("prediction").collect()] == want
    assert (again.stages[-1].featureImportances.toArray() == ours).all()
    unseen = spark.createDataFrame([("other", 0.1, 2.0)], "brand string, a double, b double")
    assert 0 < again.transform(unseen).first().prediction < 30


def test_number_of_tasks_changes_no_tree(spark, sold, monkeypatch):
    rows = sold.coalesce(1).cache()
    first = pipeline().fit(rows).stages[-1].trees
    monkeypatch.setattr(forest, "TASKS", 20)
    assert pipeline().fit(rows).stages[-1].trees == first
