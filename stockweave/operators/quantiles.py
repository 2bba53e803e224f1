"""Exact, linearly interpolated quantiles that never hold a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slices import Running, sliced, with_running


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = 10_000,
    repeat: str | None = None,
    few: bool = False,
) -> DataFrame:
    """One row per key: ``N`` values and one column per named probability.

    A sketch guesses a bracket around each quantile and the rows below and inside it are
    counted. An end that the wanted rank lies beyond is opened, so the sketch decides how much
    is ranked and never the result. The distinct values inside the checked brackets are ranked
    over range slices: a bracket of any size is spread over tasks.

    ``repeat`` names a column by which each row stands for that many equal rows. The sketch
    doesn't know it: where it differs among the rows of a key, more values are ranked.
    ``few``: the keys are types, tiers or brands, whose rows are broadcast; shuffled by so few
    values, the counted values of a key would be one task.
    """
    keys = list(keys)
    times = F.col(repeat).cast("bigint") if repeat else F.lit(1).cast("bigint")
    rows = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"), times.alias("_t"))
    slack = 3.0 / accuracy
    names = list(probs)
    lows = [max(probs[n] - slack, 0.0) for n in names]
    highs = [min(probs[n] + slack, 1.0) for n in names]
    marks = rows.groupBy(*keys).agg(
        F.sum("_t").alias("N"),
        F.percentile_approx("_v", lows + highs, accuracy).alias("_m"),
    )
    k = len(names)

    def guess(i: int):
        pos = F.lit(probs[names[i]]) * (F.col("N") - 1)
        return F.struct(
            F.lit(i).alias("q"),
            F.get("_m", F.lit(i)).alias("lo"),
            F.get("_m", F.lit(k + i)).alias("hi"),
            F.floor(pos).alias("r0"),
            F.ceil(pos).alias("r1"),
            (pos - F.floor(pos)).alias("frac"),
        )

    guesses = marks.select(*keys, "N", F.array(*[guess(i) for i in range(k)]).alias("_b"))
    counts = rows.groupBy(*keys, "_v").agg(F.sum("_t").alias("_n"))

    def rows_where(test):
        return F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0))

    counted = _of_group(counts, guesses, keys, few).select(*keys, "N", "_v", "_n", F.explode("_b").alias("b"))
    counted = counted.groupBy(*keys, "N", "b").agg(
        rows_where(F.col("_v") < F.col("b.lo")).alias("below"),
        rows_where(F.col("_v") <= F.col("b.hi")).alias("upto"))
    low_ok, high_ok = F.col("below") <= F.col("b.r0"), F.col("upto") > F.col("b.r1")
    checked = F.struct(
        F.col("b.q").alias("q"), F.col("b.r0").alias("r0"), F.col("b.r1").alias("r1"), F.col("b.frac").alias("frac"),
        F.when(low_ok, F.col("b.lo")).alias("lo"), F.when(high_ok, F.col("b.hi")).alias("hi"),
        F.when(low_ok, F.col("below")).otherwise(F.lit(0)).alias("below"))
    brackets = counted.groupBy(*keys, "N").agg(F.collect_list(checked).alias("_b"))  # one per probability

    def holds(b):
        return (b["lo"].isNull() | (F.col("_v") >= b["lo"])) & (b["hi"].isNull() | (F.col("_v") <= b["hi"]))

    inside = _of_group(counts, brackets, keys, few).select(*keys, "N", "_v", "_n", F.explode(F.filter("_b", holds)).alias("b"))
    # A struct of the keys compares null keys as equal.
    group = F.struct(*keys, "b.q").alias("_g")
    cut = sliced(inside.select(*keys, "N", "_v", "_n", "b", group), ["_g"], ["_v"])
    ranked = with_running(cut, ["_g"], ["_v"], {"_c": Running("sum", F.col("_n"))})
    upto = F.col("_c") + F.col("b.below")
    ends = ranked.groupBy(*keys, "N", F.col("b.q").alias("q"), F.col("b.frac").alias("frac")).agg(
        F.min(F.when(upto > F.col("b.r0"), F.col("_v"))).alias("x0"),
        F.min(F.when(upto > F.col("b.r1"), F.col("_v"))).alias("x1"),
    )
    point = F.col("x0") * (1 - F.col("frac")) + F.col("x1") * F.col("frac")
    return ends.groupBy(*keys, "N").agg(
        *[F.max(F.when(F.col("q") == i, point)).alias(n) for i, n in enumerate(names)]
    )


def _of_group(counts: DataFrame, groups: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Counted values with ``N`` and ``_b`` of their group, null keys included."""
    if not keys:
        whole = groups.select(F.struct("N", "_b").alias("_w")).scalar()
        return counts.withColumn("_w", whole).select("_v", "_n", "_w.N", "_w._b")
    renamed = groups.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    return counts.join(F.broadcast(renamed) if few else renamed, on).drop(*[f"_r_{c}" for c in keys])
