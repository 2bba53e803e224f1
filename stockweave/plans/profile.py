"""Data-quality and distribution profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe_ratio
from ..operators.quantiles import exact_quantiles
from ..operators.ranking import top_per_group, top_rows


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls and their share per column, all columns in one pass."""
    names = columns or df.columns
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in names],
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("columna"), F.col(c).alias("nulos"),
                 F.coalesce(safe_ratio(F.col(c), F.col("_rows")), F.lit(0.0)).alias("pct_nulos"))
        for c in names
    ])
    return one.select(F.inline(rows))


def value_counts(df: DataFrame, column: str, null_label: str | None = None) -> DataFrame:
    """Rows per value with their share; ``null_label`` names the null group."""
    value = F.coalesce(F.col(column), F.lit(null_label)) if null_label else F.col(column)
    counts = df.groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("REGISTROS"))
    total = counts.agg(F.sum("REGISTROS")).scalar()
    return counts.withColumn("PCT", safe_ratio(F.col("REGISTROS"), total) * 100)


def cleaning_summary(original: DataFrame, clean: DataFrame, devices: DataFrame, warehouses: DataFrame) -> DataFrame:
    """The cleaning run as (metrica, valor) text rows."""
    before = original.agg(F.count(F.lit(1))).scalar()
    dev_rows = devices.agg(F.count(F.lit(1))).scalar()
    bod_rows = warehouses.agg(F.count(F.lit(1))).scalar()
    # Types are a handful of values, so the collected set is bounded.
    one = clean.agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set("TIPO_TRANSACCION")), ", ").alias("tipos"),
        F.countDistinct("PAIS").alias("paises"),
        F.countDistinct("CODIGO_SKU").alias("skus"),
        F.countDistinct("CODIGO_BODEGA").alias("bodegas"),
        F.min("FECHA").alias("lo"),
        F.max("FECHA").alias("hi"),
        F.avg(F.col("MODELO").isNotNull().cast("double")).alias("dev"),
        F.avg(F.col("NOMBRE_BODEGA").isNotNull().cast("double")).alias("bod"),
    ).withColumns({"antes": before, "dr": dev_rows, "br": bod_rows})

    def percent(c: Column) -> Column:
        tenths = F.floor(F.coalesce(c, F.lit(0.0)) * 1000 + 0.5) / 10
        return F.concat(F.format_string("%.1f", tenths.cast("double")), F.lit("%"))

    def item(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("metrica"), value.cast("string").alias("valor"))

    return one.select(F.inline(F.array(
        item("filas_originales", F.col("antes")),
        item("filas_limpias", F.col("n")),
        item("filas_eliminadas", F.col("antes") - F.col("n")),
        item("pct_retenido", percent(safe_ratio(F.col("n"), F.col("antes")))),
        item("tipos_transaccion", F.col("tipos")),
        item("paises_unicos", F.col("paises")),
        item("skus_unicos", F.col("skus")),
        item("bodegas_unicas", F.col("bodegas")),
        item("fecha_min", F.col("lo")),
        item("fecha_max", F.col("hi")),
        item("catalogo_devices_filas", F.col("dr")),
        item("catalogo_bodegas_filas", F.col("br")),
        item("pct_match_devices", percent(F.col("dev"))),
        item("pct_match_bodegas", percent(F.col("bod"))),
    )))


def lowest_values(df: DataFrame, column: str, n: int = 20, groups: list[str] | None = None) -> DataFrame:
    """Counts of the ``n`` least values and their share of those rows."""
    groups = groups or []
    counts = df.filter(F.col(column).isNotNull()).groupBy(*groups, column).agg(
        F.count(F.lit(1)).alias("REGISTROS"))
    low = top_per_group(counts, groups, [F.asc(column)], n) if groups else top_rows(counts, [F.asc(column)], n)
    listed = Window.partitionBy(*groups)  # at most n rows per group
    return low.withColumn("PCT", safe_ratio(F.col("REGISTROS"), F.sum("REGISTROS").over(listed)) * 100)


def describe(df: DataFrame, column: str, groups: list[str], probs: dict[str, float] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles per group; groups are types or columns, few of them."""
    probs = probs or {"P50": 0.5, "P90": 0.9, "P95": 0.95, "P99": 0.99}
    base = df.groupBy(*groups).agg(
        F.count(column).alias("N"), F.avg(column).alias("MEDIA"), F.stddev_samp(column).alias("DESV"),
        F.min(column).alias("MINIMO"), F.max(column).alias("MAXIMO"),
    )
    ranks = exact_quantiles(df, groups, column, probs, few=True).drop("N")
    if groups:
        return base.join(ranks, groups, "left")
    point = ranks.select(F.struct(*probs)).scalar()
    return base.withColumn("_q", point).select(*base.columns, "_q.*")


def describe_numbers(df: DataFrame, columns: list[str], probs: dict[str, float] | None = None) -> DataFrame:
    """``describe`` of several columns at once, a row for each, named in COLUMNA."""
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "COLUMNA", "VALOR")
    return describe(values, "VALOR", ["COLUMNA"], probs or {"P25": 0.25, "P50": 0.5, "P75": 0.75})


def describe_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values, different values, and the most frequent one (of equals the least) with its count, per column."""
    values = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "COLUMNA", "VALOR")
    counts = values.groupBy("COLUMNA", "VALOR").agg(F.count("VALOR").alias("n"))
    top = F.min_by(F.struct("VALOR", "n"), F.when(F.col("VALOR").isNotNull(), F.struct(-F.col("n"), "VALOR")))
    out = counts.groupBy("COLUMNA").agg(F.sum("n").alias("N"), F.count("VALOR").alias("UNICOS"), top.alias("t"))
    return out.select("COLUMNA", "N", "UNICOS", F.col("t.VALOR").alias("TOPE"), F.col("t.n").alias("FRECUENCIA"))


def box_plot(df: DataFrame, column: str, groups: list[str], factor: float = 1.5, repeat: str | None = None) -> DataFrame:
    """Quartiles and whiskers: the extreme values within ``factor`` spreads of the box.

    The boxes of a plot are few, so they are broadcast. ``repeat`` names a column by which each
    row stands for that many equal rows.
    """
    q = exact_quantiles(df, groups, column, {"Q1": 0.25, "MEDIANA": 0.5, "Q3": 0.75}, repeat=repeat, few=True)
    spread = F.col("Q3") - F.col("Q1")
    box = q.withColumns({"_lo": F.col("Q1") - factor * spread, "_hi": F.col("Q3") + factor * spread})
    inside = F.col(column).between(F.col("_lo"), F.col("_hi"))
    times = F.col(repeat).cast("bigint") if repeat else F.lit(1).cast("bigint")
    ends = df.join(F.broadcast(box.select(*groups, "_lo", "_hi")), groups).groupBy(*groups).agg(
        F.min(F.when(inside, F.col(column))).alias("BIGOTE_INF"),
        F.max(F.when(inside, F.col(column))).alias("BIGOTE_SUP"),
        F.coalesce(F.sum(F.when(~inside, times)), F.lit(0)).alias("ATIPICOS"),
    )
    return box.drop("_lo", "_hi").join(ends, groups)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Rows per equal-width bin between the column's extremes."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    rows = df.filter(F.col(column).isNotNull()).withColumns({"_lo": lo, "_hi": hi})
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col(column) - F.col("_lo"), width)), F.lit(0))
    binned = rows.select(F.least(place, F.lit(bins - 1)).cast("int").alias("BIN"), "_lo", width.alias("w"))
    return binned.groupBy("BIN", (F.col("_lo") + F.col("BIN") * F.col("w")).alias("DESDE"),
                          (F.col("_lo") + (F.col("BIN") + 1) * F.col("w")).alias("HASTA")).agg(
        F.count(F.lit(1)).alias("REGISTROS"))


def missing_days(stock: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Days between the first and last snapshot on which nothing was recorded.

    With ``groups`` each group has its own range. Gaps come from consecutive recorded days.
    """
    groups = groups or []
    days = stock.select(*groups, "FECHA").distinct()
    by_day = Window.partitionBy(*groups).orderBy("FECHA")  # one row per calendar day
    following = days.withColumn("_next", F.lead("FECHA").over(by_day))
    gaps = following.filter(F.datediff("_next", "FECHA") > 1)
    return gaps.select(
        *groups, F.explode(F.sequence(F.date_add("FECHA", 1), F.date_sub("_next", 1))).alias("FECHA"))


def month_coverage(stock: DataFrame) -> DataFrame:
    """Days with and without snapshots in each month of the covered range."""
    days = stock.select("FECHA").distinct()
    months = days.agg(F.min("FECHA").alias("lo"), F.max("FECHA").alias("hi")).select(
        F.explode(F.sequence(F.trunc("lo", "MM"), F.trunc("hi", "MM"), F.expr("interval 1 month"))).alias("MES"))
    seen = days.groupBy(F.trunc("FECHA", "MM").alias("MES")).agg(F.count(F.lit(1)).alias("_n"))
    out = months.join(seen, "MES", "left").withColumn("CON", F.coalesce("_n", F.lit(0))).drop("_n")
    length = F.dayofmonth(F.last_day("MES"))
    return out.withColumns({"SIN": length - F.col("CON"), "PCT": safe_ratio(F.col("CON"), length) * 100})


def key_coverage(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Distinct fact keys found and not found in a catalogue."""
    keys = fact.select(F.col(fact_key).alias("k")).dropna().distinct()
    known = dim.select(F.col(dim_key).alias("k"), F.lit(1).alias("hit")).dropna().distinct()
    out = keys.join(known, "k", "left").agg(
        F.count(F.lit(1)).alias("CLAVES"), F.count("hit").alias("CON_MATCH"))
    return out.withColumns({
        "SIN_MATCH": F.col("CLAVES") - F.col("CON_MATCH"),
        "PCT_MATCH": safe_ratio(F.col("CON_MATCH"), F.col("CLAVES")) * 100,
    })


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).dropna().intersect(b.select(key).dropna())


def keys_only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).dropna().subtract(b.select(key).dropna())


def repeated_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of more than one row, with units and mean cost."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("REGISTROS"), F.sum("VALUE").alias("VALUE"), F.avg("COSTO").alias("COSTO")
    ).filter("REGISTROS > 1")
