"""Token-ID output: ids of all documents in ascending doc_id order, range-coded in independent blocks.

``write_token_files`` stores every document's ids, counts every token of the corpus, makes one
frequency table of the counts, orders the ids by range partitions of doc_id, cuts each partition into
blocks of whole documents and codes the blocks with the table. ``read_token_files`` decodes the blocks in parallel. A file set is two Parquet
folders: ``table`` (id, frequency) and ``blocks`` (part, block, doc_ids, lengths, payload); the
payload is the format of ``rans.py`` with its checkpoints and checksums.

Null and empty texts give the end id alone. A null doc_id comes first. Rows that repeat a doc_id
follow one another, each with ids of its own. An empty table writes no block and reads as no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, forget, kept, keyed, record, written_by
from .rans import SCALE, Coder, frequencies
from .wordpieces import wordpieces

#: A block is closed at so many ids; a longer document makes a longer block.
BLOCK_IDS = 1 << 20


TOKENS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("ids", pa.binary())])
BLOCKS = "part int, block int, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def token_rows(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """doc_id, th, ids (numpy integers of ``kind``, the end id last) of every row."""
    end = np.asarray([end_id], "<u4").tobytes()

    def tokenize(batches):
        coder = wordpieces(path)
        for batch in batches:
            ids = [np.frombuffer(coder.encode(t or "") + end, "<u4").astype(kind).tobytes() for t in batch.column("text").to_pylist()]
            yield record(TOKENS, [batch.column("doc_id"), batch.column("th"), ids])

    return keyed(docs).mapInArrow(tokenize, "doc_id long, th long, ids binary")


def token_counts(tokens: DataFrame, size: int, kind: str) -> DataFrame:
    """How often each id occurs in the whole corpus: id, n."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            column = batch.column("ids")
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            total += np.bincount(np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind), minlength=size)
        ids = np.flatnonzero(total)
        yield record(schema, [ids.astype(np.int32), total[ids]])

    return tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def coded_blocks(tokens: DataFrame, freq: np.ndarray, kind: str) -> DataFrame:
    """Blocks of whole documents in ascending doc_id order: the ids, not the texts, go to their range's task."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def encode(batches):
        part, block, size, coder, doc_ids, held = TaskContext.get().partitionId(), 0, 0, Coder(freq), [], []

        def closed():
            data = np.frombuffer(b"".join(held), kind)
            return record(schema, [[part], [block], [len(data)], [doc_ids], [[len(x) // data.itemsize for x in held]], [coder.encode(data)]])

        for batch in batches:
            for doc_id, ids in columns_of(batch, "doc_id", "ids"):
                held.append(ids)
                doc_ids.append(doc_id)
                size += len(ids) // np.dtype(kind).itemsize
                if size >= BLOCK_IDS:
                    yield closed()
                    doc_ids, held, size, block = [], [], 0, block + 1
        if doc_ids:
            yield closed()

    ordered = tokens.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th")
    return ordered.select("doc_id", "ids").mapInArrow(encode, BLOCKS)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    spark, size = docs.sparkSession, max(wordpieces(path).size, end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    tokens, stored = written_by(lambda: kept(token_rows(docs, path, end_id, kind), "tokens"))
    counts = np.zeros(size, np.int64)
    for row in token_counts(tokens, size, kind).toLocalIterator():  # a row per vocabulary entry at most
        counts[row["id"]] = row["n"]
    freq = frequencies(counts)
    spark.createDataFrame(list(enumerate(freq.tolist())), "id int, frequency int").coalesce(1).write.parquet(f"{folder}/table")
    coded_blocks(tokens, freq, kind).write.parquet(f"{folder}/blocks")
    forget(stored)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32, ids binary."""
    rows = spark.read.parquet(f"{folder}/table").orderBy("id").collect()  # as long as the vocabulary
    freq = np.asarray([r["frequency"] for r in rows], np.int64)
    assert freq.sum() == 1 << SCALE
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", "n_ids").withColumn("within", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per partition of the writer
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = blocks.drop("n_ids").join(starts.join(parts, "part").select("part", "block", (F.col("base") + F.col("within")).alias("start")), ["part", "block"])
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def decode(batches):
        coder = Coder(freq)
        for batch in batches:
            for doc_ids, lengths, payload, start in columns_of(batch, "doc_ids", "lengths", "payload", "start"):
                data = coder.decode(payload).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                own = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths, strict=True)]
                yield record(schema, [doc_ids, (start + ends - lengths).tolist(), lengths, [zlib.crc32(x) for x in own], own])

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
