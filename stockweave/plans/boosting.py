"""Gradient boosting of squared error with L1 and L2 terms, as a pipeline stage.

The rows are cut into bins once and written to the shared folder as blocks of a matrix. A level
of a tree is one job: each task adds up gradients and rows per node, feature and bin, the sums are dealt
out by feature, the task that has all of a feature's finds its best cut of each node, and the driver,
which holds no rows and no sums, takes the best feature. A feature's sum has 2**level * bins cells whatever the rows are. Every ``REFRESH`` rounds the
predictions so far are written with the blocks, so neither lineage nor a task's work grows with the
rounds, and a lost executor costs the tasks it had. A Python worker keeps predictions and places of the
blocks it saw last, so that a level costs a step and not the trees since the last write; another
worker works them out from the block. The blocks are RDD rows because the sums are arrays that no
aggregate function merges. Blocks that are all in one task need no job for a level: a job is then the rounds
between two writes.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, new_path

#: Bins of a feature, so that a bin is one byte.
BINS = 256
#: Rows of a block at most, a partition's last batches aside.
BLOCK_ROWS = 100_000
#: Rows that one generator draws from; a block is ten of its stretches.
DRAW_ROWS = 10_000
#: Rows up to which one task holds all blocks. A job costs a tenth of a second and more, and a level of so many rows no longer.
ALONE_ROWS = 500_000
#: Blocks whose progress a Python worker keeps.
KEPT = 24
#: Rounds between two writes of the predictions so far.
REFRESH = 20
#: A split must gain more than this.
LEAST_GAIN = 1e-6

BLOCK = "part int, number int, y binary, margin binary, bins binary"


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 500
    step: float = 0.05
    depth: int = 6
    rows: float = 0.8
    features: float = 0.8
    min_rows: int = 5
    l1: float = 0.1
    l2: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """A binary tree as a heap: the split feature (-1: leaf), what goes left at most, the leaf's value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int64), np.zeros(n), np.zeros(n), np.zeros(n))

    def places(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node of each column of ``x`` (features by rows) after ``depth`` levels."""
        node, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        for _ in range(depth):
            node = self.below(x, node, rows)
        return node

    def below(self, x: np.ndarray, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The nodes one level below ``node``; a leaf keeps its rows."""
        split = self.feature[node]
        return np.where(split < 0, node, 2 * node + 1 + (x[split, rows] > self.cut[node]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.places(x, len(self.value).bit_length() - 1)]


def bin_edges(train: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """Per column at most BINS - 1 values; a value's bin is the number of edges below it."""
    quantiles = train.approxQuantile(columns, [k / BINS for k in range(1, BINS)], 1 / (4 * BINS))
    return [np.unique(q) for q in quantiles]


def binned(train: DataFrame, edges: list[np.ndarray], base: float) -> DataFrame:
    """Blocks of the matrix, of whole Arrow batches of ``train`` (array x, double y) up to ``BLOCK_ROWS`` rows."""

    def one(batch):
        y = batch.column("y").to_numpy(zero_copy_only=False)
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(edges))
        return y, np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]).astype(np.uint8)

    def grouped(batches):
        parts, rows = [], 0
        for part in map(one, batches):
            if parts and rows + len(part[0]) > BLOCK_ROWS:
                yield parts
                parts, rows = [], 0
            parts.append(part)
            rows += len(part[0])
        if parts:
            yield parts

    def cut(batches):
        for number, parts in enumerate(grouped(batches)):
            y, bins = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
            row = [[TaskContext.get().partitionId()], [number], [y.tobytes()], [np.full(len(y), base).tobytes()], [bins.tobytes()]]
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "number", "y", "margin", "bins"])

    return train.mapInArrow(cut, BLOCK)


def _opened(block, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, predictions after ``trees`` and bins (features by rows) of a block."""
    y, margin = np.frombuffer(block[2]), np.frombuffer(block[3]).copy()
    bins = np.frombuffer(block[4], np.uint8).reshape(-1, len(y))
    for tree in trees:
        margin += tree.scores(bins)
    return y, margin, bins


@dataclass
class Progress:
    """A block after ``trees`` trees of its fit, and its rows' places after ``level`` levels of the next; ``sample``
    holds this round's rows with their bins and slopes, once drawn."""

    trees: int
    margin: np.ndarray
    level: int = 0
    node: np.ndarray | None = None
    sample: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


#: The progress of the blocks that this Python worker saw last, by fit, part and number.
_SEEN: dict[tuple[str, int, int], Progress] = {}


def _progress(block, fit, done, trees, tree, level) -> tuple[Progress, np.ndarray, np.ndarray]:
    """A block's progress, labels and bins after ``level`` levels of ``tree``; the block was written after ``done`` trees,
    ``trees`` are those since then."""
    key = (fit, block[0], block[1])
    p = _SEEN.pop(key, None)
    y, bins = np.frombuffer(block[2]), np.frombuffer(block[4], np.uint8)
    bins, turn, rows = bins.reshape(-1, len(y)), done + len(trees), np.arange(len(y))
    if p is None or not done <= p.trees <= turn or (p.trees == turn and p.level > level):
        p = Progress(done, np.frombuffer(block[3]).copy())  # not seen, or a task that is run again
    for grown, depth in [*((t, len(t.value).bit_length() - 1) for t in trees[p.trees - done:]), (tree, level)]:
        node = np.zeros(len(y), np.int64) if p.node is None else p.node
        for _ in range(p.level, depth):
            node = grown.below(bins, node, rows)
        if p.trees < turn:
            p = Progress(p.trees + 1, p.margin + grown.value[node])
        else:
            p.level, p.node = level, node
    for other in [k for k in _SEEN if k[0] != fit] + list(_SEEN)[: max(0, len(_SEEN) + 1 - KEPT)]:
        _SEEN.pop(other, None)
    _SEEN[key] = p
    return p, y, bins


def _draws(seed: tuple, number: int, rows: int) -> np.ndarray:
    """A number from 0 to 1 for each row of a block, the same for any length of the blocks."""
    first = number * (BLOCK_ROWS // DRAW_ROWS)
    return np.concatenate([np.random.default_rng((*seed, first + k)).random(min(DRAW_ROWS, rows - k * DRAW_ROWS))
                           for k in range(-(-rows // DRAW_ROWS))] or [np.empty(0)])


def _level_sums(blocks, fit, done, trees, tree, level, features, width, share, seed):
    """Of one task, for each feature's place among ``features``: the task, and gradients and rows by node of the level and bin."""
    nodes, total = 2**level, None
    for block in blocks:
        p, y, bins = _progress(block, fit, done, trees, tree, level)
        if p.sample is None:
            taken = np.flatnonzero(_draws((*seed, block[0]), block[1], len(y)) < share)
            p.sample = taken, np.ascontiguousarray(bins[features][:, taken]), (p.margin - y)[taken]
        taken, x, slope = p.sample
        node = p.node[taken] - (nodes - 1)
        if node.min(initial=0) < 0:  # rows of leaves further up
            left = np.flatnonzero(node >= 0)
            node, x, slope = node[left], x[:, left], slope[left]
        first, part = node * width, np.empty((2, len(features), nodes * width))
        for j in range(len(features)):
            cell = first + x[j]
            part[0, j] = np.bincount(cell, slope, nodes * width)
            part[1, j] = np.bincount(cell, minlength=nodes * width)
        total = part if total is None else total + part
    if total is None:
        return []
    task = TaskContext.get().partitionId()
    return [(j, (task, total[:, j].reshape(2, nodes, width))) for j in range(len(features))]


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_cuts(sums: np.ndarray, s: BoostSettings) -> np.ndarray:
    """Of one feature, for each node: gain and bin of the best cut, gradients and rows left and right of it, and of the node."""

    def worth(g, h):
        return _shrunk(g, s.l1) ** 2 / (h + s.l2)

    left, whole = sums.cumsum(axis=2)[..., :-1], sums.sum(axis=2, keepdims=True)
    nodes = np.arange(sums.shape[1])
    if not left.shape[2]:
        none = np.zeros(len(nodes))
        return np.column_stack([none - np.inf, *[none] * 5, *whole[..., 0]])
    right = whole - left
    gain = (worth(*left) + worth(*right) - worth(*whole)) / 2
    gain[(left[1] < s.min_rows) | (right[1] < s.min_rows)] = -np.inf
    at = gain.argmax(axis=1)
    return np.column_stack([gain[nodes, at], at, *left[:, nodes, at], *right[:, nodes, at], *whole[..., 0]])


def _merged(pairs, s: BoostSettings):
    """``best_cuts`` of the features of a task; the sums of the tasks before it are added in their order."""
    parts = {}
    for j, part in pairs:
        parts.setdefault(j, []).append(part)
    for j, found in parts.items():
        found.sort(key=lambda p: p[0])
        total = found[0][1].copy()
        for _, more in found[1:]:
            total += more
        yield j, best_cuts(total, s)


def grow(tree: Tree, level: int, cuts: list[np.ndarray], features: list[int], s: BoostSettings) -> bool:
    """Split the nodes of ``level`` where that gains, by the ``best_cuts`` of each feature; whether any was split."""
    first, found = 2**level - 1, False
    table = np.stack(cuts)  # feature, node, field
    if level == 0:
        g, h = table[0, 0, 6:]
        tree.value[0] = -s.step * _shrunk(g, s.l1) / (h + s.l2)
    for k, j in enumerate(table[:, :, 0].argmax(axis=0)):
        gain, b, *sides = table[j, k, :6]
        if not gain > LEAST_GAIN:
            continue
        found, at = True, first + k
        tree.feature[at], tree.cut[at], tree.gain[at] = features[j], b, gain
        for child, (g, h) in ((2 * at + 1, sides[:2]), (2 * at + 2, sides[2:])):
            tree.value[child] = -s.step * _shrunk(g, s.l1) / (h + s.l2)
    return found


def _chosen(turn: int, size: int, s: BoostSettings) -> list[int]:
    """The features of a round."""
    some = np.random.default_rng((s.seed, turn)).permutation(size)[: max(1, int(s.features * size))]
    return sorted(some.tolist())


def _rounds(blocks, fit, turns, size, width, s: BoostSettings):
    """The trees of the rounds ``turns``, of blocks that were written before them and are all there are."""
    blocks, trees = sorted(blocks, key=lambda b: b[:2]), []
    for turn in turns:
        features, tree = _chosen(turn, size, s), Tree.empty(s.depth)
        for level in range(s.depth):
            cuts = dict(_merged(_level_sums(blocks, fit, turns[0], trees, tree, level, features, width, s.rows, (s.seed, turn)), s))
            if not grow(tree, level, [cuts[j] for j in range(len(features))], features, s):
                break
        trees.append(tree)
    return trees


def fit_trees(train: DataFrame, s: BoostSettings) -> tuple[float, list[Tree]]:
    """The mean label and the trees, cuts as values, of ``train`` (array x, double y)."""
    spark = train.sparkSession
    base, size, rows = train.agg(F.avg("y"), F.max(F.size("x")), F.count("y")).first()
    if base is None:
        raise ValueError("no training rows")
    columns = [f"x{j}" for j in range(size)]
    edges = bin_edges(train.select(*[F.col("x")[j].alias(c) for j, c in enumerate(columns)]), columns)
    width, alone = 1 + max(len(e) for e in edges), rows <= ALONE_ROWS

    def written(df: DataFrame):
        path = new_path(spark, "boosting")
        df.write.parquet(path)
        blocks = spark.read.schema(BLOCK).parquet(path)
        return path, (blocks.coalesce(1) if alone else blocks).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    path, blocks = written(binned(train, edges, float(base)))
    trees, recent, fit = [], [], uuid.uuid4().hex
    try:
        while len(trees) < s.rounds:
            turn = len(trees)
            if len(recent) == REFRESH:
                done = list(recent)
                moved = blocks.map(lambda b, done=done: (b[0], b[1], b[2], _opened(b, done)[1].tobytes(), b[4]))
                old_path, old = path, blocks
                path, blocks = written(spark.createDataFrame(moved, BLOCK))
                old.unpersist()
                discard(spark, old_path)
                recent = []
            if alone:
                turns = range(turn, min(turn + REFRESH, s.rounds))
                recent = blocks.mapPartitions(lambda b, turns=turns: _rounds(b, fit, turns, size, width, s)).collect()
                trees += recent
                continue
            features, tree = _chosen(turn, size, s), Tree.empty(s.depth)
            for level in range(s.depth):
                task = (fit, turn - len(recent), list(recent), tree, level, features, width, s.rows, (s.seed, turn))
                sums = blocks.mapPartitions(lambda b, task=task: _level_sums(b, *task))
                if blocks.getNumPartitions() > 1:
                    sums = sums.partitionBy(min(len(features), math.ceil(blocks.getNumPartitions() ** 0.5)), int)
                cuts = dict(sums.mapPartitions(lambda p: _merged(p, s)).collect())
                if not grow(tree, level, [cuts[j] for j in range(len(features))], features, s):
                    break
            trees.append(tree)
            recent.append(tree)
    finally:
        blocks.unpersist()
        discard(spark, path)
    for tree in trees:
        for at in np.flatnonzero(tree.feature >= 0):
            tree.cut[at] = edges[tree.feature[at]][int(tree.cut[at])]
    return float(base), trees


class BoostedTrees(Estimator, HasFeaturesCol, HasPredictionCol):
    """Fits ``fit_trees`` on a vector column; same rows in the same blocks give the same trees."""

    def __init__(self, label: str, settings: BoostSettings = BoostSettings()) -> None:
        super().__init__()
        self.label, self.settings = label, settings

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        train = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.label).cast("double").alias("y"))
        base, trees = fit_trees(train.filter("y IS NOT NULL"), self.settings)
        rows = [[t.feature.tolist(), t.cut.tolist(), t.value.tolist(), t.gain.tolist()] for t in trees]
        size = dataset.select(F.size(vector_to_array(self.getFeaturesCol()))).first()[0]
        model = BoostedTreesModel()
        model._set(trees=json.dumps({"base": base, "features": size, "trees": rows}))
        return model


class BoostedTreesModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted trees as one text parameter, which saving and loading keep to the last digit."""

    trees = Param(Params._dummy(), "trees", "base value and trees as JSON", typeConverter=TypeConverters.toString)

    def _read(self) -> tuple[float, int, list[Tree]]:
        data = json.loads(self.getOrDefault(self.trees))
        return data["base"], data["features"], [Tree(*map(np.asarray, t)) for t in data["trees"]]

    @property
    def featureImportances(self):
        """Mean gain of each feature's splits, as shares."""
        _, size, trees = self._read()
        gain, splits = np.zeros(size), np.zeros(size)
        for t in trees:
            inner = t.feature >= 0
            gain += np.bincount(t.feature[inner], t.gain[inner], size)
            splits += np.bincount(t.feature[inner], minlength=size)
        mean = gain / np.maximum(splits, 1)
        return Vectors.dense(mean / (mean.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        base, size, trees = self._read()

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).T
            out = np.full(values.shape[1], base)
            for tree in trees:
                out += tree.scores(values)
            return pa.array(out)

        return dataset.withColumn(self.getPredictionCol(), score(vector_to_array(F.col(self.getFeaturesCol()))))
