"""Reading, parsing, de-duplicating and windowing events; the same code runs on batch input."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import not_muted
from ..operators.slices import sliced, with_row_number
from ..schemas import EVENT_SCHEMA

ORDER = ["timestamp", "evento_id"]
KEYS = ["pais", "codigo_sku"]
_PARSED = T.StructType([*EVENT_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])


def line_stream(spark: SparkSession, folder: str, max_files: int = 1) -> DataFrame:
    """JSON lines of a growing folder; at most ``max_files`` new files per micro-batch."""
    reader = spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files)
    return reader.text(folder)


def kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int) -> DataFrame:
    """JSON lines of a Kafka topic; needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    records = reader.option("subscribe", topic).option("maxOffsetsPerTrigger", max_offsets).load()
    return records.select(F.col("value").cast("string").alias("value"))


def parsed(lines: DataFrame) -> DataFrame:
    """Event columns, the source line, and VALIDO: parsed and with type, key and units."""
    json = F.from_json("value", _PARSED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.filter(F.trim("value") != "").select(F.col("value").alias("linea"), json.alias("e"))
    needed = ["tipo_evento", "pais", "codigo_sku", "value"]
    ok = F.col("e").isNotNull() & F.col("e._corrupt_record").isNull()
    for c in needed:
        ok = ok & F.col(f"e.{c}").isNotNull()
    return rows.select("linea", ok.alias("VALIDO"), *[F.col(f"e.{f.name}").alias(f.name) for f in EVENT_SCHEMA])


def valid_events(lines: DataFrame) -> DataFrame:
    return parsed(lines).filter("VALIDO").drop("linea", "VALIDO")


def quarantined(lines: DataFrame) -> DataFrame:
    """Lines that are no usable event."""
    return parsed(lines).filter(~F.col("VALIDO")).select("linea")


def once(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Drop repeats of an event id.

    A stream remembers every id, in the state store on disk, and so keeps late events. With
    ``delay`` it forgets ids after that time and drops events that come later than that.
    """
    if events.isStreaming and delay:
        return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["evento_id"])
    return events.dropDuplicates(["evento_id"])


def per_five_minutes(events: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Events, units sold and revenue per event-time window and country."""
    rows = events.withWatermark("timestamp", delay) if events.isStreaming else events
    sold = F.when(F.col("tipo_evento") == "SALES", F.col("value")).otherwise(F.lit(0))
    out = rows.groupBy(F.window("timestamp", f"{minutes} minutes").alias("w"), "pais").agg(
        F.count(F.lit(1)).alias("eventos"), F.sum(sold).alias("unidades"),
        F.sum((sold * F.col("precio_unitario")).cast("decimal(20,4)")).cast("double").alias("ingreso"),
    )
    return out.select(F.col("w.start").alias("inicio"), F.col("w.end").alias("fin"), "pais", "eventos", "unidades", "ingreso")


def with_count_window(events: DataFrame, size: int = 20, name: str = "ventana") -> DataFrame:
    """Number the windows of ``size`` consecutive events in event order."""
    rows = with_row_number(sliced(events, [], ORDER), ORDER, "_pos").drop("_slice")
    window = (F.floor((F.col("_pos") - 1) / size) + 1).cast("bigint")
    return rows.withColumn(name, window).drop("_pos")


def table_events(fact: DataFrame, kind: str) -> DataFrame:
    """Clean-fact rows as events of one kind."""
    def text(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in fact.columns else F.lit("")

    ident = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in sorted(fact.columns)]), 256)
    rows = fact.filter(F.col("TIPO_TRANSACCION") == kind)
    if kind == "SALES" and "ESTADO" in fact.columns:
        rows = rows.filter(not_muted(F.col("ESTADO")))
    return rows.select(
        F.concat(F.lit("REAL_"), ident).alias("evento_id"),
        F.col("FECHA").cast("timestamp").alias("timestamp"),
        F.col("FECHA").alias("fecha_original"),
        F.lit(kind).alias("tipo_evento"),
        text("PAIS").alias("pais"), text("CODIGO_SKU").alias("codigo_sku"), text("FAMILIA").alias("familia"),
        text("MODELO").alias("modelo"), text("MARCA").alias("marca"), text("TIER").alias("tier"),
        F.coalesce(F.col("ESTADO"), F.lit("ACTIVE")).alias("estado") if "ESTADO" in fact.columns
        else F.lit("ACTIVE").alias("estado"),
        text("CODIGO_BODEGA").alias("codigo_bodega"),
        F.col("VALUE").cast("bigint").alias("value"),
        F.round("PRECIO_UNITARIO", 2).alias("precio_unitario"),
        F.round("COSTO", 2).alias("costo"),
        F.lit("REAL").alias("fuente"),
    )


def as_lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines."""
    return events.select(F.to_json(F.struct(*[f.name for f in EVENT_SCHEMA if f.name in events.columns])).alias("value"))


def export_lines(events: DataFrame, folder: str, batches: int | None = None, compression: str = "none") -> int | None:
    """Write events as JSON lines for replay.

    ``batches`` for a stream: so many ranges of the event order, one per micro-batch; returns the files of
    each. Without it the ranges are those of a shuffle and all written at once, for a batch that doesn't ask
    for the files' age; a table is several times its size as lines, so these files can be compressed.
    """
    if batches is None:
        n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lines = as_lines(events.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER))
        lines.write.mode("append").text(folder, compression=compression)
        return None
    return export_batches(sliced(events, [], ORDER, batches), folder, "_slice", range(batches))


def export_batches(
    events: DataFrame, folder: str, batch: str, numbers: Iterable[int], rows_per_file: int = 50_000
) -> int:
    """Write JSON lines for each number of the column ``batch``, which is left out; returns the files of each.

    The numbers are written one after the other because a stream takes files by age. A long one is dealt
    over several files, the same count for each number and none empty, so that a stream of so many files
    per micro-batch takes one number at a time.
    """
    numbers = list(numbers)
    sizes = dict(events.filter(F.col(batch).isin(numbers)).groupBy(batch).count().collect())
    rows = [sizes.get(i, 0) for i in numbers]
    files = max(1, min(-(-max(rows) // rows_per_file), min(rows)))
    for i in numbers:
        part = events.filter(F.col(batch) == i).drop(batch).coalesce(1)
        if files > 1:
            turn = part.withColumn("_file", (F.monotonically_increasing_id() % files).cast("int"))
            part = turn.repartitionById(files, "_file").drop("_file")
        as_lines(part.sortWithinPartitions(*ORDER)).write.mode("append").text(folder)
    return files


def event_sample(sales: DataFrame, stock: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """Repeatable sample without replacement: 40 % sales, 60 % stock rows of ``total``."""
    return lowest_hashes(sales, int(total * 0.4), seed).unionByName(lowest_hashes(stock, int(total * 0.6), seed))


def lowest_hashes(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows of least hash, all if there are no more; equal hashes by their columns.

    The hash values lie evenly, so a bound on them follows from the row count. It is moved up until
    ``n`` rows lie below it; only these are put in order. Equal rows share a hash and may lie
    below it in any number, so the order is that of range slices.
    """
    if n <= 0:
        return df.limit(0)
    columns = sorted(df.columns)
    mixed = df.withColumn("_mix", F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]))
    rows, spread = df.count(), 6
    if rows <= n:
        return df
    while True:
        share = (n + spread * (n**0.5 + 1)) / rows
        if share >= 1:
            low = mixed
            break
        low = mixed.filter(F.col("_mix") <= F.lit(int(share * 2**64) - 2**63))
        if low.count() >= n:
            break
        spread *= 4
    order = ["_mix", *columns]
    numbered = with_row_number(sliced(low, [], order), order, "_pos")
    return numbered.filter(F.col("_pos") <= n).select(*df.columns)
