"""Boosted trees against a brute-force search of splits, and what must not change them."""

import os

import numpy as np
import pytest

from stockweave.plans import boosting
from stockweave.plans.boosting import BoostedTrees, BoostSettings, fit_trees
from stockweave.session import shared_folder

WHOLE = BoostSettings(rounds=1, step=1.0, depth=1, rows=1.0, features=1.0, min_rows=3, l1=0.5, l2=2.0)


def data(n=60, columns=4):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 9, (n, columns)).astype(float)
    return x, np.where(x[:, 2] > 4, 20.0, 3.0) + x[:, 0] + rng.integers(0, 3, n)


def table(spark, x, y, parts=3):
    rows = [([float(v) for v in r], None if t is None else float(t)) for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "x array<double>, y double").repartition(parts)


def brute(x, y, s):
    """Gain, column, bound and leaf values of the best split of all rows."""
    g = y.mean() - y

    def worth(v):
        return max(abs(v.sum()) - s.l1, 0) ** 2 / (len(v) + s.l2) / 2

    def leaf(v):
        return -np.sign(v.sum()) * max(abs(v.sum()) - s.l1, 0) / (len(v) + s.l2)

    found = []
    for j in range(x.shape[1]):
        for bound in np.unique(x[:, j]):
            low = x[:, j] <= bound
            if low.sum() >= s.min_rows and (~low).sum() >= s.min_rows:
                found.append((worth(g[low]) + worth(g[~low]) - worth(g), j, bound, leaf(g[low]), leaf(g[~low])))
    return max(found)


def test_split_is_the_best_of_all(spark):
    x, y = data()
    base, (tree,) = fit_trees(table(spark, x, y), WHOLE)
    gain, column, bound, low, high = brute(x, y, WHOLE)
    assert base == pytest.approx(y.mean())
    assert (tree.feature[0], tree.cut[0]) == (column, bound)
    assert tree.gain[0] == pytest.approx(gain)
    assert tree.value[1:3] == pytest.approx([low, high])


def test_second_round_fits_what_the_first_left(spark):
    x, y = data()
    base, (first, second) = fit_trees(table(spark, x, y), BoostSettings(**{**WHOLE.__dict__, "rounds": 2}))
    left = y - base - first.scores(x.T)
    error = [np.mean((y - base) ** 2), np.mean(left**2), np.mean((left - second.scores(x.T)) ** 2)]
    assert error[0] > error[1] > error[2]


def test_partitions_and_refreshes_change_nothing(spark, monkeypatch):
    x, y = data(200)
    before = set(os.listdir(shared_folder(spark)))
    s = BoostSettings(rounds=5, step=0.5, depth=3, rows=1.0, features=0.5, min_rows=2)
    fits = [fit_trees(table(spark, x, y, 1), s), fit_trees(table(spark, x, y, 7), s)]
    monkeypatch.setattr(boosting, "REFRESH", 2)
    fits.append(fit_trees(table(spark, x, y, 3), s))
    want = fits[0][0] + sum(t.scores(x.T) for t in fits[0][1])
    for base, trees in fits[1:]:
        assert base + sum(t.scores(x.T) for t in trees) == pytest.approx(want)
    assert set(os.listdir(shared_folder(spark))) == before


def test_strong_l1_leaves_the_mean_and_rows_bound_the_leaves(spark):
    x, y = data()
    _, trees = fit_trees(table(spark, x, y), BoostSettings(rounds=2, l1=1e9))
    assert all((t.feature < 0).all() and not t.value.any() for t in trees)
    _, (tree,) = fit_trees(table(spark, x, y), BoostSettings(**{**WHOLE.__dict__, "depth": 4, "min_rows": 10}))
    assert np.bincount(tree.places(x.T, 4))[np.unique(tree.places(x.T, 4))].min() >= 10


def test_stage_scores_as_its_trees_and_needs_rows(spark):
    from pyspark.ml.functions import array_to_vector

    x, y = data()
    rows = table(spark, x, [*y[:-1], None]).select(array_to_vector("x").alias("features"), "x", "y")
    model = BoostedTrees("y", BoostSettings(rounds=3, depth=2, min_rows=2)).fit(rows)
    base, size, trees = model._read()
    got = model.transform(rows).select("x", "prediction").collect()
    want = base + sum(t.scores(np.asarray([r.x for r in got]).T) for t in trees)
    assert size == 4 and base == pytest.approx(y[:-1].mean())
    assert [r.prediction for r in got] == pytest.approx(want)
    assert model.featureImportances.toArray().sum() == pytest.approx(1) and model.featureImportances.toArray().argmax() == 2
    with pytest.raises(ValueError, match="no training rows"):
        BoostedTrees("y").fit(rows.filter("y < 0"))


def test_cuts_of_all_features_are_those_of_the_whole_search(spark):
    """Merged by feature, in the order of the tasks, sums give the split that a search over all of them gives."""
    rng = np.random.default_rng(3)
    parts = [(task, rng.normal(size=(5, 2, 2, 6))) for task in (2, 0, 1)]
    for _, part in parts:
        part[:, 1] = rng.integers(1, 9, (5, 2, 6))
    pairs = [(j, (task, part[j])) for task, part in parts for j in range(5)]
    found = dict(boosting._merged(iter(pairs), WHOLE))
    whole = sum(part for _, part in sorted(parts, key=lambda p: p[0]))
    tree = boosting.Tree.empty(2)
    assert boosting.grow(tree, 1, [found[j] for j in range(5)], [10, 11, 12, 13, 14], WHOLE)

    def worth(v):
        g, h = v.sum(axis=1)
        return max(abs(g) - WHOLE.l1, 0) ** 2 / (h + WHOLE.l2) / 2

    for k in range(2):
        gain, j, b = max((worth(whole[j, :, k, :b + 1]) + worth(whole[j, :, k, b + 1:]) - worth(whole[j, :, k]), -j, -b)
                         for j in range(5) for b in range(5))
        assert (tree.feature[1 + k], tree.cut[1 + k]) == (10 - j, -b) and tree.gain[1 + k] == pytest.approx(gain)


def test_one_constant_column_has_no_cut(spark):
    base, (tree,) = fit_trees(table(spark, np.ones((9, 1)), np.arange(9.0)), WHOLE)
    assert base == 4 and (tree.feature == -1).all() and tree.value[0] == 0


def test_a_worker_takes_one_step_a_level_and_a_new_one_gets_the_same(monkeypatch):
    """Of a block seen before, a level is one step and a tree is added once; what a worker forgot is worked out again."""
    x, y = data(50)
    bins = np.ascontiguousarray(x.T.astype(np.uint8))
    trees = []
    for j in range(3):
        tree = boosting.Tree.empty(2)
        tree.feature[:3], tree.cut[:3], tree.value[:] = [j, 2, 3], [4, 3, 5], np.arange(7) + j
        trees.append(tree)
    block, steps, below = (0, 0, y.tobytes(), np.full(50, 1.5).tobytes(), bins.tobytes()), [], boosting.Tree.below
    monkeypatch.setattr(boosting, "_SEEN", {})
    monkeypatch.setattr(boosting.Tree, "below", lambda *a: steps.append(1) or below(*a))
    for turn, tree in enumerate(trees):
        for level in (0, 1, 1):  # the last one again
            del steps[:]
            p, labels, _ = boosting._progress(block, "a", 0, trees[:turn], tree, level)
            assert len(steps) <= 1  # to the leaves of the last tree, or one level down this one
            assert p.margin == pytest.approx(1.5 + sum(t.scores(bins) for t in trees[:turn])) and (labels == y).all()
            assert (p.node == tree.places(bins, level)).all()
            fresh, _, _ = boosting._progress((0, 1, *block[2:]), "a", 0, trees[:turn], tree, level)
            boosting._SEEN.pop(("a", 0, 1))
            assert (fresh.margin == p.margin).all() and (fresh.node == p.node).all()
    for number in range(boosting.KEPT + 5):
        boosting._progress((0, number, *block[2:]), "b", 0, [], trees[0], 0)
    assert len(boosting._SEEN) == boosting.KEPT and all(k[0] == "b" for k in boosting._SEEN)


def test_batches_of_a_partition_are_one_block(spark):
    x, y = data(90)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        blocks = boosting.binned(table(spark, x, y, 1), [np.arange(9.0)] * 4, 0.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    (block,) = blocks
    assert sorted(np.frombuffer(block.y)) == sorted(y)
    assert (np.frombuffer(block.bins, np.uint8).reshape(4, 90).sum(axis=1) == x.sum(axis=0)).all()


def test_rows_are_drawn_by_stretches_of_ten_thousand():
    draws = boosting._draws((42, 0, 3), 1, 25_000)
    want = [np.random.default_rng((42, 0, 3, 10 + k)).random(n) for k, n in enumerate((10_000, 10_000, 5_000))]
    assert (draws == np.concatenate(want)).all() and boosting._draws((42, 0, 3), 0, 0).size == 0


def test_rounds_of_a_small_table_are_one_job_and_give_the_trees_of_the_level_jobs(spark, monkeypatch):
    x, y = data(300)
    s = BoostSettings(rounds=7, step=0.5, depth=4, rows=0.8, features=0.5, min_rows=2)
    monkeypatch.setattr(boosting, "REFRESH", 3)
    fits, jobs = [], []
    for alone in (boosting.ALONE_ROWS, 0):
        monkeypatch.setattr(boosting, "ALONE_ROWS", alone)
        spark.sparkContext.setJobGroup(f"alone-{alone}", "")
        fits.append(fit_trees(table(spark, x, y, 5), s))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"alone-{alone}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    (base, trees), (other, others) = fits
    assert base == other and len(trees) == len(others) == 7
    for a, b in zip(trees, others, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and a.value == pytest.approx(b.value)
    assert jobs[0] + 7 * 3 <= jobs[1]  # three jobs of rounds for seven times four of levels, or a few less where nothing gains
