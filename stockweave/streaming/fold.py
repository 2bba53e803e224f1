"""Fold one micro-batch of events into the state table with aggregates and one merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import last_items
from ..operators.ranking import top_per_group
from ..schemas import StreamParams
from .events import KEYS, ORDER

STATE_SCHEMA = (
    "pais string, codigo_sku string, familia string, modelo string, marca string, tier string, estado string, "
    "stock bigint, ventas bigint, precio double, historial array<bigint>, ventas_ventana bigint, sin_venta bigint, "
    "en_camino array<struct<llegada: bigint, cantidad: bigint>>"
)


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def initial_state(stock: DataFrame, latest: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """State before the first event.

    ``stock`` holds units per (PAIS, SKU), ``latest`` the last position per warehouse with
    price and attributes, ``history`` optional weekly totals (HISTORIAL).
    """
    keys = ["PAIS", "CODIGO_SKU"]

    def newest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("FECHA", c))).alias(c)

    attributes = latest.groupBy(*keys).agg(
        *[newest(c) for c in ("FAMILIA", "MODELO", "MARCA", "TIER", "ESTADO", "PRECIO_UNITARIO")])
    out = stock.join(attributes, keys, "left")
    if history is not None:
        out = out.join(history, keys, "left")
        sales = F.coalesce(F.transform("HISTORIAL", lambda v: v.cast("bigint")), F.array().cast("array<bigint>"))
    else:
        sales = F.array().cast("array<bigint>")
    return out.select(
        F.col("PAIS").alias("pais"), F.col("CODIGO_SKU").alias("codigo_sku"),
        *[F.coalesce(c, F.lit("")).alias(c.lower()) for c in ("FAMILIA", "MODELO", "MARCA", "TIER")],
        F.coalesce("ESTADO", F.lit("ACTIVE")).alias("estado"),
        F.col("STOCK").alias("stock"), F.lit(0).cast("bigint").alias("ventas"),
        F.coalesce("PRECIO_UNITARIO", F.lit(0.0)).alias("precio"), sales.alias("historial"),
        F.lit(0).cast("bigint").alias("ventas_ventana"), F.lit(0).cast("bigint").alias("sin_venta"),
        F.array().cast("array<struct<llegada: bigint, cantidad: bigint>>").alias("en_camino"),
    )


def batch_changes(events: DataFrame, params: StreamParams = StreamParams()) -> DataFrame:
    """What a batch does to each of its keys.

    Within a batch the stock ends at max(0, last snapshot - sales after it), or, without a
    snapshot, at max(0, previous stock - all sales): plain aggregates that combine on the
    map side, so neither a hot key nor event order needs a sort of the key's rows.
    """
    order = F.struct(*ORDER)
    is_sale, is_stock = F.col("tipo_evento") == "SALES", F.col("tipo_evento") == "INVENTORY"

    def filled(c: str) -> Column:
        return F.when(F.col(c).isNotNull() & (F.col(c) != ""), order)

    rows = events.filter(is_sale | is_stock)
    base = rows.groupBy(*KEYS).agg(
        F.min_by("familia", filled("familia")).alias("b_familia"),
        F.min_by("modelo", filled("modelo")).alias("b_modelo"),
        F.min_by("marca", order).alias("b_marca"),
        F.min_by("tier", order).alias("b_tier"),
        F.max_by("estado", filled("estado")).alias("b_estado"),
        F.max_by(F.struct(*ORDER, "value"), F.when(is_stock, order)).alias("_snap"),
        F.sum(F.when(is_sale, F.col("value")).otherwise(F.lit(0))).alias("b_ventas"),
        F.max_by("precio_unitario", F.when(is_sale & (F.col("precio_unitario") > 0), order)).alias("b_precio"),
    )
    snaps = base.select(*KEYS, "_snap").filter(F.col("_snap").isNotNull())
    after = rows.filter(is_sale).join(snaps, KEYS).filter(order > F.struct(*[F.col(f"_snap.{c}") for c in ORDER]))
    since = after.groupBy(*KEYS).agg(F.sum("value").alias("_since"))
    recent = top_per_group(rows.filter(is_sale), KEYS, [F.desc(c) for c in ORDER], params.history_size)
    history = recent.groupBy(*KEYS).agg(  # at most history_size items
        F.transform(F.sort_array(F.collect_list(F.struct(*ORDER, "value"))), lambda x: x["value"]).alias("b_hist"))
    out = base.join(since, KEYS, "left").join(history, KEYS, "left")
    snapshot = F.when(
        F.col("_snap").isNotNull(),
        F.greatest(F.lit(0), F.col("_snap.value") - F.coalesce("_since", F.lit(0))))
    return out.withColumn("b_stock", snapshot).drop("_snap", "_since")


def folded(
    state: DataFrame, events: DataFrame, params: StreamParams = StreamParams(), idle: str = "window"
) -> DataFrame:
    """The state after the batch, for all keys, also those without events.

    ``idle`` counts windows without a sale by sales of the window (``"window"``) or by
    sales since the start (``"cumulative"``).
    """
    changes = batch_changes(events, params)
    j = state.join(changes, KEYS, "full_outer")
    nothing = F.array().cast("array<bigint>")
    old_sales, new_sales = F.coalesce("ventas", F.lit(0)), F.coalesce("b_ventas", F.lit(0))
    total = old_sales + new_sales
    running = F.greatest(F.lit(0), F.coalesce("stock", F.lit(0)) - new_sales)
    sold = (new_sales > 0) if idle == "window" else (total > 0)

    def kept(c: str) -> Column:
        """First non-empty value ever seen."""
        old = F.when(F.col(c) != "", F.col(c))
        return F.coalesce(old, F.col(f"b_{c}"), F.lit("")).alias(c)

    return j.select(
        *KEYS, kept("familia"), kept("modelo"),
        F.coalesce("marca", "b_marca", F.lit("")).alias("marca"),
        F.coalesce("tier", "b_tier", F.lit("")).alias("tier"),
        F.coalesce("b_estado", "estado", F.lit("ACTIVE")).alias("estado"),
        F.coalesce("b_stock", running).cast("bigint").alias("stock"),
        total.cast("bigint").alias("ventas"),
        F.coalesce("b_precio", "precio", F.lit(0.0)).alias("precio"),
        last_items(F.concat(F.coalesce("historial", nothing), F.coalesce("b_hist", nothing)),
                   params.history_size).alias("historial"),
        new_sales.cast("bigint").alias("ventas_ventana"),
        F.when(sold, F.lit(0)).otherwise(F.coalesce("sin_venta", F.lit(0)) + 1).cast("bigint").alias("sin_venta"),
        F.coalesce("en_camino", F.array().cast("array<struct<llegada: bigint, cantidad: bigint>>")).alias("en_camino"),
    )
