"""A random forest of regression trees, grown by tasks that hold all training rows.

MLlib sums up nodes, features and bins of all trees level by level: the sums of a small node go through a shuffle as those of a
large one do, and the driver holds every node as JVM objects, with those of a second model when one is loaded. Here the rows are cut
into bins once and written to the shared folder; a task reads all of them, a byte per feature, and grows its share of the trees by
itself, so there is no shuffle of sums, and the driver gets each tree as a few arrays. Draws hang on seed, tree and block, not on
the tasks. What a tree is follows MLlib: Poisson weights of mean 1 for the rows, the square root of the features for each node, split
values in the middle between values of about equally many rows, categories in the order of their mean label, the largest fall of the variance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, new_path
from .boosting import BINS, BLOCK, binned

#: Rows that a task holds at most; a forest of more is MLlib's.
TASK_ROWS = 2_000_000
#: Tasks at least, if there are as many trees.
TASKS = 12
#: A split must lower the squared error by more than this share of the error of all rows.
LEAST_SHARE = 1e-12

TREE = "tree int, feature binary, child binary, number binary, lefts binary"


@dataclass
class Tree:
    """Nodes by number, children side by side: split feature (-1: leaf), left child, and bound, row of ``lefts`` or the leaf's value.

    ``lefts``: for each split of a category, which codes go left."""

    feature: np.ndarray
    child: np.ndarray
    number: np.ndarray
    lefts: np.ndarray

    def scores(self, x: np.ndarray, categorical: np.ndarray) -> np.ndarray:
        """The leaf value of each column of ``x`` (features by rows)."""
        node, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        while True:
            split = self.feature[node]
            inner = split >= 0
            if not inner.any():
                return self.number[node]
            value = x[split, rows]
            left = value <= self.number[node]
            if len(self.lefts):
                coded = np.flatnonzero(inner & categorical[split])
                left[coded] = self.lefts[self.number[node[coded]].astype(np.int64), value[coded].astype(np.int64)]
            node = np.where(inner, self.child[node] + ~left, node)

    def packed(self, tree: int) -> tuple:
        return (tree, self.feature.astype(np.int16).tobytes(), self.child.astype(np.int32).tobytes(), self.number.tobytes(),
                np.packbits(self.lefts, axis=1).tobytes())

    @classmethod
    def opened(cls, row, width: int) -> Tree:
        lefts = np.frombuffer(row[4], np.uint8).reshape(-1, -(-width // 8))
        return cls(np.frombuffer(row[1], np.int16), np.frombuffer(row[2], np.int32), np.frombuffer(row[3]),
                   np.unpackbits(lefts, axis=1, count=width).astype(bool))


def split_values(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """The bounds of at most ``bins`` bins for sorted distinct values: middles between neighbours, of about equally many rows."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) < bins:
        return middles
    stride, upto, out = counts.sum() / bins, counts.cumsum(), []
    target = stride
    for k in range(1, len(values)):
        if abs(upto[k - 1] - target) < abs(upto[k] - target):
            out.append(middles[k - 1])
            target += stride
    return np.asarray(out[: bins - 1])


def _edges(train: DataFrame, size: int, codes: dict[int, int], bins: int) -> list[np.ndarray]:
    """Per feature the bounds of its bins; a category's code is its bin."""
    counts = train.select(F.posexplode("x").alias("j", "v")).filter(~F.col("j").isin(list(codes))).groupBy("j", "v").count()

    def bounds(found: pa.Table) -> pa.Table:
        found = found.sort_by("v")
        values = split_values(found.column("v").to_numpy(), found.column("count").to_numpy(), bins)
        return pa.table({"j": [found.column("j")[0].as_py()], "edges": [values.tolist()]},
                        schema=pa.schema([("j", pa.int32()), ("edges", pa.list_(pa.float64()))]))

    found = dict(counts.groupBy("j").applyInArrow(bounds, "j int, edges array<double>").collect())
    return [np.arange(codes[j] - 1.0) if j in codes else np.asarray(found[j], float) for j in range(size)]


def _codes(dataset: DataFrame, column: str) -> dict[int, int]:
    """Of the features that are categories, the number of codes."""
    attributes = dataset.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    named = {a["idx"]: len(a["vals"]) if "vals" in a else a["num_vals"] for a in attributes.get("nominal", []) if "vals" in a or "num_vals" in a}
    return named | {a["idx"]: 2 for a in attributes.get("binary", [])}


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, categorical: np.ndarray, width: int, per_node: int, depth: int,
         min_rows: int, rng: np.random.Generator) -> tuple[Tree, np.ndarray]:
    """One tree on bins ``x`` (features by rows), its bounds as bins, and by feature the fall of the squared error."""
    rows, size = np.flatnonzero(weight), len(x)
    flat, step = x.reshape(-1), x.shape[1]
    w, wy = weight[rows].astype(float), weight[rows] * y[rows]
    most = min(2 ** (depth + 1) - 1, 2 * len(rows) + 1)
    feature, child, number = np.full(most, -1, np.int64), np.zeros(most, np.int64), np.zeros(most)
    gains, lefts, node, at, used = np.zeros(size), [], np.zeros(len(rows), np.int64), np.zeros(1, np.int64), 1
    number[0] = wy.sum() / max(w.sum(), 1.0)
    least = LEAST_SHARE * (wy * y[rows]).sum()
    for _ in range(depth):
        k = len(at)
        n, s = np.bincount(node, w, k)[:, None], np.bincount(node, wy, k)[:, None]
        chosen = np.sort(rng.random((k, size)).argsort(axis=1)[:, :per_node], axis=1)
        best, split, cut, left = np.full(k, least), np.full(k, -1), np.zeros(k, np.int64), np.zeros((k, width), bool)
        sides = np.zeros((k, 4))
        for f in chosen.T:
            cell = node * width + flat[f[node] * step + rows]
            bn, bs = np.bincount(cell, w, k * width).reshape(k, width), np.bincount(cell, wy, k * width).reshape(k, width)
            place = np.broadcast_to(np.arange(width), (k, width))
            coded = np.flatnonzero(categorical[f])
            if len(coded):  # in the order of their means, codes without rows last
                mean = np.full((len(coded), width), np.inf)
                np.divide(bs[coded], bn[coded], out=mean, where=bn[coded] > 0)
                order, place = mean.argsort(axis=1, kind="stable"), place.copy()
                bn[coded], bs[coded] = np.take_along_axis(bn[coded], order, 1), np.take_along_axis(bs[coded], order, 1)
                place[coded] = order.argsort(axis=1, kind="stable")
            ln, ls = bn.cumsum(axis=1)[:, :-1], bs.cumsum(axis=1)[:, :-1]
            rn, rs = n - ln, s - ls
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = ls**2 / ln + rs**2 / rn - s**2 / n
            gain[(ln < max(min_rows, 1)) | (rn < max(min_rows, 1))] = -np.inf
            b = gain.argmax(axis=1)
            g = gain[np.arange(k), b]
            better = np.flatnonzero(g > best)
            best[better], split[better], cut[better] = g[better], f[better], b[better]
            left[better] = place[better] <= b[better, None]
            sides[better] = np.column_stack([v[better, b[better]] for v in (ln, ls, rn, rs)])
        found = np.flatnonzero(split >= 0)
        if not len(found):
            break
        ids, below = at[found], used + 2 * np.arange(len(found))
        feature[ids], child[ids] = split[found], below
        gains += np.bincount(split[found], best[found], size)
        coded = categorical[split[found]]
        number[ids] = np.where(coded, len(lefts) + coded.cumsum() - 1, cut[found])
        lefts.extend(left[found[coded]])
        number[below], number[below + 1] = sides[found, 1] / sides[found, 0], sides[found, 3] / sides[found, 2]
        used += 2 * len(found)
        at = np.column_stack([below, below + 1]).reshape(-1)
        new = np.full(k, -1)
        new[found] = np.arange(len(found))
        kept = np.flatnonzero(split[node] >= 0)
        rows, w, wy, node = rows[kept], w[kept], wy[kept], node[kept]
        node = 2 * new[node] + ~left[node, flat[split[node] * step + rows]]
    masks = np.asarray(lefts, bool).reshape(-1, width)
    return Tree(feature[:used], child[:used], number[:used], masks), gains


def _share(pairs, trees, tasks, edges, categorical, width, per_node, depth, min_rows, seed):
    """Of one task, the trees whose number leaves its own by ``tasks``, with cuts as values, and their gains."""
    pairs = list(pairs)
    blocks = sorted((b for _, b in pairs), key=lambda b: b[:2])
    y = np.concatenate([np.frombuffer(b[2]) for b in blocks])
    x = np.concatenate([np.frombuffer(b[4], np.uint8).reshape(len(edges), -1) for b in blocks], axis=1)
    base, sizes = y.mean(), [len(b[2]) // 8 for b in blocks]
    y = y - base
    for number in range(pairs[0][0], trees, tasks):
        weight = np.concatenate([np.random.default_rng((seed, number, 2, *b[:2])).poisson(1.0, n) for b, n in zip(blocks, sizes, strict=True)])
        tree, gains = grow(x, y, weight, categorical, width, per_node, depth, min_rows, np.random.default_rng((seed, number, 1)))
        leaf, coded = tree.feature < 0, categorical[tree.feature]
        tree.number[leaf] += base
        for at in np.flatnonzero(~leaf & ~coded):
            tree.number[at] = edges[tree.feature[at]][int(tree.number[at])]
        yield tree.packed(number), gains


class Forest(RandomForestRegressor):
    """MLlib's regressor; up to ``TASK_ROWS`` rows its trees are grown in tasks that hold all of them."""

    def _fit(self, dataset: DataFrame):
        train = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        rows, size = train.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        if not 0 < rows <= TASK_ROWS or self.getMaxBins() > BINS or self.getFeatureSubsetStrategy() != "sqrt":
            return super()._fit(dataset)
        spark, trees = dataset.sparkSession, self.getNumTrees()
        codes = _codes(dataset, self.getFeaturesCol())
        edges = _edges(train, size, codes, self.getMaxBins())
        categorical, width = np.isin(np.arange(size), list(codes)), max([1 + max(len(e) for e in edges), *codes.values()])
        path = new_path(spark, "forest")
        try:
            binned(train, edges, 0.0).write.parquet(path)
            blocks = spark.read.schema(BLOCK).parquet(path).coalesce(1).rdd.map(tuple)
            context = spark.sparkContext
            tasks = min(trees, max(TASKS, 2 * context.defaultParallelism))
            settings = (trees, tasks, edges, categorical, width, int(np.ceil(size**0.5)), self.getMaxDepth(),
                        self.getMinInstancesPerNode(), self.getSeed())
            pairs = context.parallelize(range(tasks), tasks).cartesian(blocks)
            found = sorted(pairs.mapPartitions(lambda p: _share(p, *settings)).collect(), key=lambda t: t[0][0])
        finally:
            discard(spark, path)
        shares = sum(g / (g.sum() or 1.0) for _, g in found)
        model = ForestModel([t for t, _ in found])
        model._set(width=width, categorical=np.flatnonzero(categorical).tolist(), importances=(shares / (shares.sum() or 1.0)).tolist())
        return model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, MLReadable, MLWritable):
    """Trees as packed rows of ``TREE``; saved as a Parquet table beside the parameters."""

    width = Param(Params._dummy(), "width", "codes of a category at most", typeConverter=TypeConverters.toInt)
    categorical = Param(Params._dummy(), "categorical", "features that are categories", typeConverter=TypeConverters.toListInt)
    importances = Param(Params._dummy(), "importances", "share of each feature", typeConverter=TypeConverters.toListFloat)

    def __init__(self, trees: list[tuple] | None = None) -> None:
        super().__init__()
        self.trees = trees or []

    @property
    def featureImportances(self):
        """Each feature's share of the fall of the squared error, as the mean over the trees."""
        return Vectors.dense(self.getOrDefault(self.importances))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, width, size = self.trees, self.getOrDefault(self.width), len(self.getOrDefault(self.importances))
        categorical = np.isin(np.arange(size), self.getOrDefault(self.categorical))

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).T
            out = np.zeros(values.shape[1])
            for row in trees:
                out += Tree.opened(row, width).scores(values, categorical)
            return pa.array(out / len(trees))

        return dataset.withColumn(self.getPredictionCol(), score(vector_to_array(F.col(self.getFeaturesCol()))))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.sparkSession.createDataFrame(self.model.trees, TREE).write.parquet(f"{path}/trees")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.schema(TREE).parquet(f"{path}/trees").collect()
        model = ForestModel(sorted((r.tree, *map(bytes, r[1:])) for r in rows))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
