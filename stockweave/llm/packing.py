"""Best-fit packing of token pieces into sequences by the sum-of-squares rule.

Documents longer than a sequence are cut into full pieces, the first may be shorter. A full piece
is a sequence of its own. The other pieces are dealt at random to shares of about SHARE pieces,
and each share is packed on its own: a share's few open sequences at the end are the only loss.

Null and empty texts are documents of the end id alone. Rows that repeat a document are packed
each. An empty table gives no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, kept, record
from .wordpieces import wordpieces

SHARE = 32_768


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, lean: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32. ``lean``: a task leaves no cached words to its worker's next one."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        coder, end = wordpieces(path), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in columns_of(batch, "doc_id", "text"):
                ids = coder.encode(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                out += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield record(schema, list(zip(*out, strict=True)) or [[]] * 5)
        if lean:
            coder.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, longest first.

    ``open_[g]`` counts the open bins with a gap of g. Putting a size s into a bin of gap g moves
    one bin from g to g - s; the sum of squares changes by 2 * (open_[g - s] - open_[g] + 1), and
    by 1 - 2 * open_[s] when the bin closes. A new bin is opened only when no open one has room,
    which measures better here than letting the rule open bins.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_ = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made, widest, never = 0, 0, 1 << 40
    for i in order.tolist():
        s = int(sizes[i])
        gap = capacity
        if s <= widest:
            here = open_[s : widest + 1]
            cost = 2 * (open_[: widest + 1 - s] - here + 1)
            cost[0] = 1 - 2 * here[0]
            cost[here == 0] = never
            k = int(np.argmin(cost))
            if cost[k] < never:  # a new sequence only when none has room
                gap = s + k
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = stacks[gap].pop()
            open_[gap] -= 1
        left = gap - s
        if left:
            open_[left] += 1
            stacks[left].append(b)
            widest = max(widest, left)
        bins[i], offsets[i] = b, capacity - gap
    return bins, offsets


def packed(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, lean: bool = False) -> DataFrame:
    """Each piece with its sequence_id and its offset there. Sequences of one full piece have negative numbers."""
    pieces = kept(token_pieces(docs, path, end_id, capacity, lean), "pieces")
    full, rest = pieces.filter(F.col("length") == capacity), pieces.filter(F.col("length") < capacity)
    shares = max(1, -(-rest.count() // SHARE))

    def fill(rows: pa.Table) -> pa.Table:
        bins, offsets = pack(rows["length"].to_numpy(), capacity)
        number = (rows["share"].to_numpy() << 40) + bins
        return rows.drop_columns(["share"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets))

    shared = rest.withColumn("share", F.floor(F.rand(7) * shares)).groupBy("share").applyInArrow(
        fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return shared.unionByName(alone)
