"""From raw documents to packed training sequences: five stages, each one of the operators of stockweave.llm.

Every stage but the last returns the columns of its input. A stage takes all rows that the one
before kept; its result is written to the shared folder and read back. What a stage wrote on the
way is deleted when the next one begins, by which time its result has been written.

Defined results: rows that repeat are judged alike and, except by near_duplicates, kept or dropped
together; an empty table stays empty through all stages; columns beyond those of documents are
carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm import decontaminate, packing, pii, simhash, toxicity
from stockweave.llm.common import forget, kept, text_hash, written_by
from stockweave.llm.wordpieces import vocabulary


#: Folders of stages whose results have not been taken up yet.
_DONE: list[tuple[SparkSession, str]] = []


def _judged(docs: DataFrame, verdict: DataFrame, how: str, *columns: str) -> DataFrame:
    """docs with a verdict's columns by row: doc_id and the text's hash, as ``_id`` and ``_th``."""
    verdict = verdict.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), *columns).dropDuplicates(["_id", "_th"])
    return docs.join(verdict, docs["doc_id"].eqNullSafe(verdict["_id"]) & (text_hash() == verdict["_th"]), how)


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Deletes what the stages before wrote on the way, unless ``docs`` still reads it, and notes what this one writes."""

    @wraps(fn)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _DONE:
            read = docs.inputFiles()
            _DONE[:] = forget(_DONE, lambda path: any(path in file for file in read))
        result, paths = written_by(lambda: fn(spark, docs, sf_dir))
        _DONE.extend(paths)
        return result

    return staged


@stage
def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts are scored as empty; a score of one half or more rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, toxicity.fold() != 0)
    return toxicity.without_toxic(docs, model)


@stage
def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints of three-word shingles within three bits stays: the one of the least
    doc_id (a null comes last), of these the least hash of the text, of equal rows one. Null, empty and blank texts share fingerprint zero."""
    return simhash.one_of_each(docs)


@stage
def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark go; null and empty texts hold nothing and stay, also where doc_id is null."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _judged(docs, found.filter("contaminated"), "left_anti")


@stage
def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows where there is such a column. Null texts stay null."""
    return pii.without_personal_data(docs)


@stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset; a null or empty text is a piece of the end id alone."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048, lean=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out), ("near_duplicates", near_duplicates_out), ("decontamination", contaminated_out),
    ("personal_data", personal_data_out), ("packing", sequences),
]
#: No stage but decontamination can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, fn in STAGES:
        docs, paths = written_by(lambda fn=fn, name=name, docs=docs: kept(fn(spark, docs, sf_dir), f"stage-{name}"))
        forget(before)
        before = paths[-1:]
    return docs
