"""Running values over a total order, split so that no key or range fills one task.

``sliced`` range-partitions rows by (keys, order) and freezes the partition number. The
range partitioner splits a key that holds many rows over several slices. A running value is
then the value carried in from earlier slices combined with a window inside the slice; the
carry table has one row per (key, slice).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import frozen


@dataclass(frozen=True)
class Running:
    """A running ``sum``, ``min`` or ``last`` (last non-null) of a column."""

    how: str
    value: Column


def sliced(df: DataFrame, keys: list[str], order: list[str | Column], slices: int | None = None) -> DataFrame:
    """Rows with ``_slice``; a checkpoint keeps slice numbers stable if tasks are rerun."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id())
    return frozen(out)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows over as many tasks as a shuffle has, so that what sorts them next holds a share of its own.

    A compressed file is few scan tasks however many rows it gives. Copies of a key go by the task
    they come from, too: a key of a third of the rows is not one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_from", F.spark_partition_id()).repartition(n, "_from", *keys).drop("_from")


def with_running(
    rows: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, Running]
) -> DataFrame:
    """Add running values up to and including each row; ``rows`` comes from ``sliced``.

    ``keys`` may be finer than the keys of the slicing as long as each finer group is
    contiguous in its order.
    """
    up_to = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.withColumns({f"_x_{n}": v.value for n, v in values.items()})
    ordering = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])

    totals, carries, results = [], [], {}
    for name, v in values.items():
        x = F.col(f"_x_{name}")
        if v.how == "sum":
            totals.append(F.sum(x).alias(f"_t_{name}"))
            carries.append(F.sum(f"_t_{name}").over(before).alias(f"_c_{name}"))
            results[name] = F.coalesce(F.col(f"_c_{name}"), F.lit(0)) + F.col(f"_l_{name}")
        elif v.how == "min":
            totals.append(F.min(x).alias(f"_t_{name}"))
            carries.append(F.min(f"_t_{name}").over(before).alias(f"_c_{name}"))
            results[name] = F.least(F.col(f"_c_{name}"), F.col(f"_l_{name}"))
        elif v.how == "last":
            totals.append(F.max_by(x, F.when(x.isNotNull(), ordering)).alias(f"_t_{name}"))
            carries.append(F.last(f"_t_{name}", ignorenulls=True).over(before).alias(f"_c_{name}"))
            results[name] = F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}"))
        else:
            raise ValueError(f"unknown running value {v.how!r}")

    def local(name: str, v: Running) -> Column:
        x = F.col(f"_x_{name}")
        if v.how == "sum":
            return F.coalesce(F.sum(x).over(up_to), F.lit(0))
        if v.how == "min":
            return F.min(x).over(up_to)
        return F.last(x, ignorenulls=True).over(up_to)

    carry = base.groupBy(*keys, "_slice").agg(*totals).select(*keys, "_slice", *carries)
    inside = base.withColumns({f"_l_{n}": local(n, v) for n, v in values.items()})
    out = inside.join(carry, [*keys, "_slice"])
    return out.select(*[c for c in rows.columns if c not in values], *[e.alias(n) for n, e in results.items()])


def with_row_number(rows: DataFrame, order: list[str | Column], name: str = "RANK") -> DataFrame:
    """Global 1-based position in the order of the slicing."""
    return with_running(rows, [], order, {name: Running("sum", F.lit(1).cast("bigint"))})
