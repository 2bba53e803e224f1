"""Delimited and Parquet files of unknown layout."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import country_from_file
from ..operators.columns import canonical_columns, stack_frames
from ..schemas import DELIMITERS

BEYOND = "_sobra"
SOURCE = ["SOURCE_FILE", "SOURCE_COUNTRY"]


@dataclass(frozen=True)
class Layout:
    """Delimiter and header of a delimited file."""

    delimiter: str
    header: tuple[str, ...]


def find_files(spark: SparkSession, folder: str, hints: Iterable[str] | None = None) -> list[str]:
    """CSV and Parquet files under a folder, sorted; ``hints`` must occur in the file name."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{csv,parquet}").load(folder).select("path")
    )
    paths = sorted(row.path for row in listing.collect())  # names only, never contents
    if hints is None:
        return paths
    wanted = list(hints)
    return [p for p in paths if any(h in PurePosixPath(p).stem.lower() for h in wanted)]


def layout_of(line: bytes) -> Layout:
    """The first delimiter that splits a header line into more than one column."""
    try:
        text = line.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = line.decode("latin-1")
    for delimiter in DELIMITERS:
        names = next(csv.reader([text], delimiter=delimiter))
        if len(names) > 1:
            return Layout(delimiter, tuple(names))
    return Layout(",", (text,))


def header_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and first line (bytes) of every file that has a line, by one scan of the files' first blocks."""
    lines = spark.read.text(paths).select(
        _decoded_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("_at"),
        F.col("value").cast("binary").alias("line"))
    rows = lines.filter("_at = 0").withColumn("_n", F.monotonically_increasing_id())
    return rows.groupBy("path").agg(F.min_by("line", "_n").alias("line"))


def decoded(c: Column) -> Column:
    """Text read byte for byte (ISO-8859-1): UTF-8 where the bytes are valid UTF-8."""
    raw = F.encode(c, "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(c)


def _decoded_path(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _with_source(df: DataFrame) -> DataFrame:
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.withColumn("SOURCE_FILE", _decoded_path(name)).withColumn(
        "SOURCE_COUNTRY", country_from_file(F.col("SOURCE_FILE")))


def _named(df: DataFrame, place: list[str], header: Iterable[str], extra: list[str]) -> DataFrame:
    """Canonical names for positional columns; source columns inside a file give way to its own."""
    names = canonical_columns(df.select(*place).toDF(*header)).columns
    kept = [F.col(c).alias(n) for c, n in zip(place, names) if n not in SOURCE]
    return df.select(*kept, *extra)


def read_delimited(spark: SparkSession, paths: list[str], layout: Layout) -> DataFrame:
    """All files of one layout as text columns with their source, in one pass.

    A short line leaves its last columns null. ``_sobra`` holds the first field beyond the
    header, which marks a line that does not fit.
    """
    names = [f"c{i}" for i in range(len(layout.header))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BEYOND]])
    rows = (
        spark.read.schema(schema).option("header", True).option("sep", layout.delimiter).option("quote", '"')
        .option("escape", '"').option("encoding", "ISO-8859-1").option("enforceSchema", True).csv(paths)
    )
    rows = _with_source(rows)
    text = rows.select(*[decoded(F.col(n)).alias(n) for n in names], BEYOND, *SOURCE)
    return _named(text, names, layout.header, [BEYOND, *SOURCE])


def parquet_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """Column names and types from a file's footer; None if the file is damaged."""
    try:
        return spark.read.option("ignoreCorruptFiles", True).parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None


def read_parquet(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Parquet files of one schema as text columns with their source; damaged files are skipped."""
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(*paths)
    place = [f"c{i}" for i in range(len(schema.names))]
    rows = _with_source(rows.select(*[F.col(f"`{n}`").cast("string").alias(c) for n, c in zip(schema.names, place)], "_metadata"))
    return _named(rows.select(*place, *SOURCE), place, schema.names, SOURCE)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Any mix of files as one table of text columns, or None without files.

    Files are read in groups of equal layout, one scan per layout: delimiter and header of a
    delimited file, names and types of a Parquet file. Names are made canonical group by group,
    so spellings and types may differ between files.
    """
    delimited = [p for p in paths if p.lower().endswith(".csv")]
    columnar = [p for p in paths if p.lower().endswith(".parquet")]
    frames = []
    if delimited:
        groups: dict[Layout, list[str]] = defaultdict(list)
        for row in header_lines(spark, delimited).collect():  # a row per file, as in ``paths``
            groups[layout_of(bytes(row.line))].append(row.path)
        frames += [read_delimited(spark, sorted(group), layout) for layout, group in sorted(groups.items(), key=lambda g: min(g[1]))]
    if columnar:
        with ThreadPoolExecutor(max_workers=16) as pool:
            schemas = list(pool.map(lambda p: parquet_schema(spark, p), columnar))
        alike: dict[str, tuple[T.StructType, list[str]]] = {}
        for path, schema in zip(columnar, schemas):
            if schema is not None:
                alike.setdefault(schema.simpleString(), (schema, []))[1].append(path)
        frames += [read_parquet(spark, group, schema) for schema, group in alike.values()]
    return stack_frames(frames) if frames else None
