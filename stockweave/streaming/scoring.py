"""Demand forecasts for the best-selling keys of a window, by a saved pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import last_items, mean_of, population_std, rounded_even
from ..functions.arrays import from_end
from ..operators.cleaning import not_muted
from ..operators.ranking import top_rows
from ..plans.features import SKU_CATEGORIES, cyclic
from ..schemas import StreamParams
from .events import KEYS
from .rules import substitutes


def candidates(kpi: DataFrame, p: StreamParams = StreamParams()) -> DataFrame:
    """The best-selling keys, muted ones left out after the cut."""
    top = top_rows(kpi, [F.desc("ventas_acum"), *[F.asc(c) for c in KEYS]], p.candidates)
    return top.filter(not_muted(F.col("estado"), p.muted_states))


def with_history(rows: DataFrame, state: DataFrame, p: StreamParams = StreamParams()) -> DataFrame:
    """Own history, or the substitute's where the own one is short; rows with neither go."""
    short = F.size("historial") < p.min_history
    subs = substitutes(rows.filter(short), state).select(
        *KEYS, F.col("sku_sustituto"))
    theirs = state.select("pais", F.col("codigo_sku").alias("sku_sustituto"), F.col("historial").alias("_theirs"))
    found = subs.join(theirs, ["pais", "sku_sustituto"]).filter(F.size("_theirs") >= p.min_history)
    out = rows.join(found.select(*KEYS, "_theirs"), KEYS, "left")
    return out.withColumns({
        "_hist": F.when(short, F.col("_theirs")).otherwise(F.col("historial")),
        "fuente_pred": F.when(short, "sustituto").otherwise("propio"),
    }).filter(F.col("_hist").isNotNull()).drop("_theirs")


def with_features(rows: DataFrame, day: Column) -> DataFrame:
    """The training features from a history array as of ``day``."""
    hist = F.col("_hist")
    week_sin, week_cos = cyclic(F.weekofyear(day), 52)
    month_sin, month_cos = cyclic(F.month(day), 12)
    lag2 = F.coalesce(F.try_element_at(hist, F.lit(-2)), F.lit(0)).cast("double")
    return rows.withColumns({
        "SEMANA_ANO": F.weekofyear(day), "MES": F.month(day), "TRIMESTRE": F.quarter(day), "ANO": F.year(day),
        "SEMANA_SIN": week_sin, "SEMANA_COS": week_cos, "MES_SIN": month_sin, "MES_COS": month_cos,
        "LAG_1W": from_end(hist, 1).cast("double"), "LAG_2W": lag2,
        **{f"LAG_{k}W": from_end(hist, k).cast("double") for k in (4, 8, 13)},
        "ROLLING_4W_MEAN": mean_of(last_items(hist, 4)), "ROLLING_4W_STD": population_std(last_items(hist, 4)),
        "ROLLING_8W_MEAN": mean_of(last_items(hist, 8)),
        "PRECIO_PROM": F.col("precio_prom"), "COSTO_PROM": F.col("precio_prom") * 0.55,
        "NUM_TRANSAC": F.greatest(F.lit(1), F.size(hist)),
    })


def predicted(
    kpi: DataFrame, state: DataFrame, model: PipelineModel, day: Column, p: StreamParams = StreamParams()
) -> DataFrame:
    """Prediction rows with the cover flag, scored in one distributed transform."""
    ready = with_features(with_history(candidates(kpi, p), state, p), day)
    scored = model.transform(ready.withColumnsRenamed({c.lower(): c for c in SKU_CATEGORIES}))
    units = F.greatest(rounded_even(F.col("prediction"), 1), F.lit(0.0))
    return scored.select(
        F.col("PAIS").alias("pais"), "codigo_sku", "modelo", F.col("MARCA").alias("marca"), "tier",
        F.upper("estado").alias("estado_sku"), "fuente_pred", units.alias("demanda_pred_7d"), "stock_actual",
        (F.col("stock_actual") >= units).alias("cobertura_ok"),
    )
