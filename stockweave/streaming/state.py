"""Keyed stock state as a stateful streaming operator."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, GroupedData, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ROCKSDB_PROVIDER
from .events import KEYS

META = ["familia", "modelo", "marca", "tier", "estado"]
FIELDS = [*KEYS, "timestamp", "evento_id", "tipo_evento", "value", "precio_unitario", *META]
#: The accounts of a bucket, a list per field.
ACCOUNTS = ", ".join(f"{c} array<string>" for c in (*KEYS, *META)) + (
    ", stock array<bigint>, ventas array<bigint>, precio array<double>, eventos array<bigint>, historial array<array<bigint>>")
OUTPUT = (
    "pais string, codigo_sku string, familia string, modelo string, marca string, tier string, estado string, "
    "stock bigint, ventas bigint, precio double, historial array<bigint>, eventos bigint, ultimo bigint"
)
#: So many groups hold all keys. A checkpoint keeps the number it began with.
BUCKETS = 4_096


class StockProcessor(StatefulProcessor):
    """One account per key: a snapshot replaces the stock, a sale lowers it (not below
    zero), an arrival raises it; the last sales are kept in a bounded list.

    A call of the processor and of its state are messages between Python and the JVM that cost more
    than the few events of a key, so the keys of a bucket share a call and their accounts a state value.
    """

    def __init__(self, history_size: int = 13) -> None:
        self.history_size = history_size
        self.fields = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accounts = handle.getValueState("accounts", ACCOUNTS)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        accounts = self._load()
        name = tuple(initialState[c] for c in KEYS)
        past = [int(v) for v in initialState["historial"]][-self.history_size:]
        accounts[name] = (
            tuple(initialState[c] for c in META), int(initialState["stock"]), int(initialState["ventas"]),
            float(initialState["precio"]), 0, past or accounts.get(name, _NEW)[-1],
        )
        self._store(accounts)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # A bucket's rows of one micro-batch; the source's rate limit bounds them.
        batches = {}
        for e in map(self._event, rows):
            batches.setdefault(e[:2], []).append(e[2:])
        accounts = self._load()
        for name, batch in batches.items():
            batch.sort(key=_order)
            accounts[name] = self._after(accounts.get(name, _NEW), batch)
        self._store(accounts)
        for name, batch in batches.items():
            meta, stock, sold, price, seen, recent = accounts[name]
            yield _OUTPUT_ROW(*name, *meta, stock, sold, price, recent, seen, batch[-1][0])

    def _after(self, account: tuple, batch: list[tuple]) -> tuple:
        meta, stock, sold, price, seen, recent = account
        recent = list(recent)
        for _, _, kind, units, unit_price, *texts in batch:
            meta = _merged(meta, texts)
            units = int(units)
            if kind == "INVENTORY":
                stock = units
            elif kind == "TRANSIT":
                stock += units
            elif kind == "SALES":
                sold += units
                stock = max(0, stock - units)
                recent.append(units)
                if unit_price is not None and unit_price > 0:
                    price = float(unit_price)
        return meta, stock, sold, price, seen + len(batch), recent[-self.history_size:]

    def _event(self, row: Row) -> tuple:
        if self.fields is None:  # by place: a row looks a name up in a list
            self.fields = itemgetter(*[row.__fields__.index(c) for c in FIELDS])
        return self.fields(row)

    def _load(self) -> dict[tuple, tuple]:
        stored = self.accounts.get()
        return {a[:2]: (a[2:7], *a[7:]) for a in zip(*stored)} if stored is not None else {}

    def _store(self, accounts: dict[tuple, tuple]) -> None:
        rows = [(*name, *meta, *rest) for name, (meta, *rest) in accounts.items()]
        self.accounts.update(tuple(list(column) for column in zip(*rows)))

    def close(self) -> None:
        pass


_NEW = (None, 0, 0, 0.0, 0, [])
_OUTPUT_ROW = Row(*[c.split()[0] for c in OUTPUT.split(", ")])


def _order(event: tuple) -> tuple:
    """By time, then id; nulls last."""
    time, ident = event[:2]
    return time is None, time or 0, ident is None, ident or ""


def _merged(meta: tuple | None, event: list) -> tuple:
    """Family and model: first non-empty; brand and tier: first; state: latest non-empty."""
    new_family, new_model, new_brand, new_tier, new_status = (v or "" for v in event)
    if meta is None:
        return new_family, new_model, new_brand, new_tier, new_status or "ACTIVE"
    family, model, brand, tier, status = meta
    return family or new_family, model or new_model, brand, tier, new_status or status


def _bucketed(df: DataFrame) -> GroupedData:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS))).groupBy("_bucket")


def stock_accounts(events: DataFrame, initial: DataFrame | None = None, history_size: int = 13) -> DataFrame:
    """Account rows of the keys touched by each micro-batch (update mode)."""
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB_PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    # Times go as numbers: a row's times are costly to convert.
    rows = events.select(*FIELDS).withColumn("timestamp", F.unix_micros("timestamp"))
    accounts = _bucketed(rows).transformWithState(
        statefulProcessor=StockProcessor(history_size), outputStructType=OUTPUT, outputMode="Update",
        timeMode="None", initialState=_bucketed(initial) if initial is not None else None,
    )
    return accounts.withColumn("ultimo", F.timestamp_micros("ultimo"))
