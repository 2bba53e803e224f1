"""The micro-batch job: state, KPIs, alerts, forecasts and orders of every window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.columns import stack_frames
from ..schemas import StreamParams
from . import fold, rules
from .scoring import predicted

PREDICTION_SCHEMA = (
    "pais string, codigo_sku string, modelo string, marca string, tier string, estado_sku string, "
    "fuente_pred string, demanda_pred_7d double, stock_actual bigint, cobertura_ok boolean"
)


@dataclass
class StreamJob:
    """Runs the window rules on each micro-batch and writes its tables under ``folder``.

    Every table of a window is one partition overwritten by its own window number, and the
    state is versioned by batch, so a batch that is run again after a failure replaces its
    own output and starts from the previous version.
    """

    spark: SparkSession
    folder: str
    params: StreamParams = StreamParams()
    initial: DataFrame | None = None
    model: PipelineModel | None = None
    idle: str = "window"

    def _path(self, table: str, window: int) -> str:
        return f"{self.folder}/{table}/ventana={window}"

    def _store(self, df: DataFrame, table: str, window: int, stamp) -> DataFrame:
        path = self._path(table, window)
        df.withColumn("timestamp", stamp).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _previous(self, window: int) -> DataFrame:
        if window > 1:
            return self.spark.read.parquet(self._path("estado", window - 1)).drop("timestamp")
        return self.initial if self.initial is not None else fold.empty_state(self.spark)

    def process(self, events: DataFrame, batch_id: int) -> None:
        """One window. The fold reads the batch several times, so it is kept, not taken from the source again."""
        events = events.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._window(events, batch_id + 1)
        finally:
            events.unpersist()

    def _window(self, events: DataFrame, window: int) -> None:
        p = self.params
        stamp = F.current_timestamp()
        state = self._store(
            fold.folded(self._previous(window), events, p, self.idle), "estado_previo", window, stamp).drop("timestamp")
        kpi = rules.kpis(state, p)
        self._store(kpi.select(*rules.KPI_FIELDS), "kpis", window, stamp)
        if self.model is not None:
            preds = predicted(kpi, state, self.model, F.current_date(), p)
        else:
            preds = self.spark.createDataFrame([], PREDICTION_SCHEMA)
        # Forecasts come first, so their cover shortfalls alert in the same window.
        preds = self._store(preds, "predicciones", window, stamp).drop("timestamp")
        alert_rows = self._store(rules.alerts(kpi, preds, p), "alertas", window, stamp).drop("timestamp")
        arrived = rules.arrivals(state, window)
        orders = self._store(stack_frames([
            rules.transit_orders(arrived, alert_rows, preds, window, p), rules.substitute_orders(arrived, p),
        ]), "ordenes", window, stamp).drop("timestamp")
        self._store(rules.with_new_transits(arrived, orders), "estado", window, stamp)

    def start(self, events: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Start on a stream of events; without ``every`` process what is there and stop."""
        writer = events.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return writer.trigger(**trigger).start()

    def table(self, name: str) -> DataFrame:
        """A result table over all windows."""
        return self.spark.read.parquet(f"{self.folder}/{name}")
