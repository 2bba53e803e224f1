"""Exact top-k search by inner product, with a table of distances to pivots.

Integer vectors get one more component that gives all of them the same length, which turns the
largest inner product into the least distance. Every vector's distances to the pivots are
computed once. For a query, the largest difference between its own distances and a vector's is a
lower bound on theirs; vectors are scored in the order of this bound until it exceeds the k-th
best distance so far. That best starts from a bounded sample, which holds for all blocks.
A task meets one block of vectors with one block of queries, so neither side grows with the data.

Defined results: a null vector, or one with a null, NaN or infinite component, takes no part;
shorter vectors count as ended by zeros; an empty vector scores 0; copies are kept apart by
vec_id; rows that repeat a vec_id are candidates each, but a query never meets its own vec_id;
queries that repeat are answered once; a null vec_id is a candidate that loses ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import record

PIVOTS, SAMPLE, CELLS = 32, 2048, 8
#: Vectors of a block, queries of a block.
BLOCK, ASKED = 16_384, 4096


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * component) as array<long> of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.filter(F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n points, each the farthest from those before."""
    chosen, gap = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(n, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def padded(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; through floats, which are faster, where these are exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if top < 2**52 else a @ b.T


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best. ``is_query``: a column over vec_id."""
    data = quantised(vectors, scale)
    top = data.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") ** 2)).alias("m"), F.max(F.size("v")).alias("d")).first()
    if top["m"] is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, length = max(1, int(top["d"])), float(top["m"]) * (1 + 1e-9)
    drawn = data.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).collect()  # a bounded sample to choose pivots from
    sample = padded([r["v"] for r in drawn], width)
    sample_ids = np.array([-1 if r["vec_id"] is None else r["vec_id"] for r in drawn])

    def lifted(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.column_stack((v, np.sqrt(np.maximum(length - (v**2).sum(1), 0))))

    pivots = farthest_first(lifted(sample), PIVOTS)
    cells = pivots[:CELLS]
    slack = 1e-6 * np.sqrt(length) + 1e-6

    def as_query(v: np.ndarray) -> np.ndarray:
        return np.column_stack((v.astype(np.float64), np.zeros(len(v))))

    # the table: each vector with its cell and its distances to the pivots
    row = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("cell", pa.int32()), ("to_pivots", pa.list_(pa.float64()))])

    def table(batches):
        for batch in batches:
            v = padded(batch.column("v").to_pylist(), width)
            d = distances(lifted(v), pivots)
            yield record(row, [batch.column("vec_id"), v.tolist(), d[:, : len(cells)].argmin(1), d.tolist()])

    placed = data.mapInArrow(table, "vec_id long, v array<long>, cell int, to_pivots array<double>")
    chosen = data.filter(F.col("vec_id").isNotNull() & is_query)
    groups = max(1, -(-chosen.agg(F.count_distinct("vec_id")).first()[0] // ASKED))
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
    parts = {c: -(-n // BLOCK) for c, n in counts.items()}
    salts = F.coalesce(*[F.when(F.col("cell") == c, F.lit(n)) for c, n in parts.items()])
    placed = placed.withColumn("part", F.floor(F.rand(11) * salts).cast("int"))
    placed = placed.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # a query starts with the k-th best score within the sample, and goes to every block
    ask = pa.schema([("query_id", pa.int64()), ("q", pa.list_(pa.int64())), ("floor", pa.int64())])

    def seeded(batches):
        for batch in batches:
            ids, q = batch.column("vec_id").to_numpy(), padded(batch.column("v").to_pylist(), width)
            if len(ids):
                s = scores(q, sample)
                s = np.where(ids[:, None] == sample_ids[None], np.iinfo(np.int64).min, s)
                least = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(ids), np.iinfo(np.int64).min)
                yield record(ask, [ids, q.tolist(), least])

    queries = chosen.dropDuplicates(["vec_id"]).mapInArrow(seeded, "query_id long, q array<long>, floor long")
    asked = queries.withColumn("block", F.explode(F.array(*[F.struct(F.lit(int(c)).alias("cell"), F.sequence(F.lit(0), F.lit(n - 1)).alias("parts")) for c, n in parts.items()])))
    own_group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("asked")
    asked = asked.select("query_id", "q", "floor", own_group, F.col("block.cell").alias("cell"), F.explode("block.parts").alias("part"))
    hit = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids = np.array([np.iinfo(np.int64).max if x is None else x for x in right["vec_id"].to_pylist()])
            order = np.argsort(ids, kind="stable")  # ties go to the lesser vec_id
            ids, v = ids[order], padded(right["v"].to_pylist(), width)[order]
            to_pivots = np.array(right["to_pivots"].to_pylist())[order]
            asked_ids, qs, floors = left["query_id"].to_numpy(), padded(left["q"].to_pylist(), width), left["floor"].to_numpy()
            own = distances(as_query(qs), pivots)
            for at, q, d, floor in zip(asked_ids.tolist(), qs, own, floors.tolist(), strict=True):
                bound = np.abs(to_pivots - d).max(1)
                by_bound = np.argsort(bound, kind="stable")
                square = float((q.astype(np.float64) ** 2).sum()) + length
                best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for begin in range(0, len(ids), 256):
                    some = by_bound[begin : begin + 256]
                    if bound[some[0]] > np.sqrt(max(0.0, square - 2.0 * floor)) + slack:
                        break  # no later vector can score above, or at, the k-th best
                    some = some[ids[some] != at]
                    best_s = np.concatenate((best_s, scores(v[some], q[None])[:, 0]))
                    best_i = np.concatenate((best_i, some))
                    keep = np.lexsort((best_i, -best_s))[:k]
                    best_s, best_i = best_s[keep], best_i[keep]
                    if len(best_s) == k:
                        floor = max(floor, int(best_s[-1]))
                out[0] += [at] * len(best_s)
                out[1] += [None if x == np.iinfo(np.int64).max else x for x in ids[best_i].tolist()]
                out[2] += best_s.tolist()
        return pa.Table.from_batches([record(hit, out)])

    found = asked.groupBy("cell", "part", "asked").cogroup(placed.groupBy("cell", "part", "asked")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
