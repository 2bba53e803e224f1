"""Helpers shared by the operators of this subpackage.

Operators read only the columns that they name, so extra columns of a table never clash with
theirs. A row is known by (doc_id, hash of its text): rows that repeat a doc_id with another
text stay apart, and rows that repeat both get the same result each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

_WRITTEN: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; ``release`` deletes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, where lost executors don't reach, and read back."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(make: Callable[[], DataFrame]) -> tuple[DataFrame, list[tuple[SparkSession, str]]]:
    """What ``make`` returns and the folders that it wrote; they are no longer ``release``'s."""
    mark = len(_WRITTEN)
    result = make()
    paths = _WRITTEN[mark:]
    del _WRITTEN[mark:]
    return result, paths


def forget(paths: list[tuple[SparkSession, str]], still_read: Callable[[str], bool] = lambda path: False) -> list[tuple[SparkSession, str]]:
    """Delete the folders but those still read, which are returned."""
    left = []
    for spark, path in paths:
        if still_read(path):
            left.append((spark, path))
            continue
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
    return left


def release() -> None:
    """Delete what operators have written to the shared folder, once their results are used."""
    forget(_WRITTEN)
    _WRITTEN.clear()


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.col(text))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hash ``th`` that tells apart rows of one doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), F.col("text"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on doc_id (null equals null) and ``th``."""
    return (left["th"] == right["th"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def columns_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
