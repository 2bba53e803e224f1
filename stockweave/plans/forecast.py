"""Demand models on MLlib, ``boosting`` and ``forest``: training, metrics, persistence and scoring."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safe_ratio
from ..schemas import ForecastParams
from ..session import stored
from . import features as ft
from .boosting import BoostedTrees, BoostSettings
from .forest import Forest

MODEL_NAMES = ("Regresion Lineal", "Random Forest", "Boosting")


def _inputs(columns: list[str], categories: list[str]) -> list:
    """Indexers for the categories (alphabetical, unseen values last) and the feature vector."""
    indexer = StringIndexer(
        inputCols=categories, outputCols=[f"{c}_ENC" for c in categories],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    )
    return [indexer, VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")]


def _floor_at_zero(df: DataFrame, raw: str = "prediction") -> DataFrame:
    return df.withColumn("PRED", F.greatest(F.col(raw), F.lit(0.0)))


def pipelines(
    columns: list[str], target: str, categories: list[str], p: ForecastParams, max_bins: int = 32
) -> dict[str, Pipeline]:
    """The three regressors over one feature vector."""
    inputs = _inputs(columns, categories)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return {
        "Regresion Lineal": Pipeline(stages=[
            *inputs, scaler, LinearRegression(featuresCol="scaled", labelCol=target, regParam=0.0)]),
        "Random Forest": Pipeline(stages=[*inputs, Forest(
            labelCol=target, numTrees=p.forest_trees, maxDepth=p.forest_depth,
            minInstancesPerNode=p.forest_min_leaf, featureSubsetStrategy="sqrt", seed=p.seed, maxBins=max_bins,
            cacheNodeIds=True)]),
        "Boosting": Pipeline(stages=[*inputs, boosting(target, p, p.boost_min_leaf)]),
    }


def boosting(target: str, p: ForecastParams, min_leaf: int) -> BoostedTrees:
    return BoostedTrees(target, BoostSettings(
        rounds=p.boost_rounds, step=p.boost_step, depth=p.boost_depth, rows=p.boost_subsample, features=p.boost_features,
        min_rows=min_leaf, l1=p.boost_l1, l2=p.boost_l2, seed=p.seed))


def training_rows(sales: DataFrame, p: ForecastParams = ForecastParams()) -> DataFrame:
    """SKU feature rows with their TRAIN / TEST side; category text stays for the indexers."""
    rows = ft.with_memory(ft.with_calendar(ft.weekly_demand(sales)), ft.SKU_KEYS, ft.SKU_TARGET)
    numeric = [c for c in ft.SKU_FEATURES if not c.endswith("_ENC")]
    return ft.with_side(ft.model_rows(rows, numeric, ft.SKU_TARGET, ["PAIS", "CODIGO_SKU", "FAMILIA", "MARCA"]),
                        p.train_fraction)


def range_training_rows(sales: DataFrame, p: ForecastParams = ForecastParams()) -> DataFrame:
    rows = ft.with_memory(ft.with_calendar(ft.weekly_range_demand(sales)), ft.RANGE_KEYS, ft.RANGE_TARGET)
    numeric = [c for c in ft.RANGE_FEATURES if not c.endswith("_ENC")]
    return ft.with_side(ft.model_rows(rows, numeric, ft.RANGE_TARGET, ft.RANGE_KEYS), p.train_fraction)


def _bins(rows: DataFrame, categories: list[str]) -> int:
    """Bins that hold the largest category, and the code of unseen values with it; 32 at least."""
    counts = rows.agg(*[F.count_distinct(c).alias(c) for c in categories]).first()
    return max(32, *(n + 2 for n in counts))


#: Training rows of a partition. Boosting runs thousands of short jobs one after another, so small tables are few tasks.
TRAIN_ROWS = 200_000
#: A forest runs a dozen long jobs: more than ``FOREST_ROWS`` rows are ``FOREST_TASKS`` at least.
FOREST_ROWS, FOREST_TASKS = 50_000, 12


def _tasks(n: int, forest: bool) -> int:
    """Partitions of ``n`` training rows. The sums of a forest's level are as large in a small task as in a large one."""
    few = max(1, -(-n // TRAIN_ROWS))
    return max(few, FOREST_TASKS) if forest and n > FOREST_ROWS else few


def _train_side(rows: DataFrame, forest: bool = False) -> DataFrame:
    train = rows.filter("LADO = 'TRAIN'")
    return train.repartition(_tasks(train.count(), forest)).persist(StorageLevel.MEMORY_AND_DISK)


def fit_sku_models(rows: DataFrame, p: ForecastParams = ForecastParams(), names=MODEL_NAMES) -> dict[str, PipelineModel]:
    """Fit the regressors on the TRAIN side; cache ``rows`` before when fitting several."""
    built = pipelines(ft.SKU_FEATURES, ft.SKU_TARGET, ft.SKU_CATEGORIES, p, _bins(rows, ft.SKU_CATEGORIES))
    models = {}
    for n in names:
        train = _train_side(rows, n == "Random Forest")
        models[n] = built[n].fit(train)
        train.unpersist()
    return models


def fit_range_model(rows: DataFrame, p: ForecastParams = ForecastParams()) -> PipelineModel:
    stages = [*_inputs(ft.RANGE_FEATURES, ft.RANGE_CATEGORIES), boosting(ft.RANGE_TARGET, p, p.range_min_leaf)]
    train = _train_side(rows)
    model = Pipeline(stages=stages).fit(train)
    train.unpersist()
    return model


def predictions(models: dict[str, PipelineModel], rows: DataFrame, target: str = ft.SKU_TARGET) -> DataFrame:
    """Test-side predictions, one row per model and observation: MODELO_PRED, Y, PRED."""
    test = rows.filter("LADO = 'TEST'")
    keep = [c for c in ("YEAR_WEEK", "PAIS", "CODIGO_SKU", "MARCA", "TIER") if c in rows.columns]
    parts = [
        _floor_at_zero(m.transform(test)).select(
            F.lit(name).alias("MODELO_PRED"), *keep, F.col(target).alias("Y"), "PRED")
        for name, m in models.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _error_measures(y: Column, pred: Column) -> list[Column]:
    error = y - pred
    share = F.when(y > 0, F.abs(safe_ratio(error, y)))
    return [
        F.avg(F.abs(error)).alias("MAE"),
        F.sqrt(F.avg(error * error)).alias("RMSE"),
        (F.lit(1.0) - safe_ratio(F.sum(error * error), F.var_pop(y) * F.count(y))).alias("R2"),
        (F.avg(share) * 100).alias("MAPE"),
        F.count(y).alias("N_MUESTRAS"),
    ]


def metrics(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R2 and MAPE (over positive demand) per model and the given columns."""
    keys = ["MODELO_PRED", *(by or [])]
    return preds.groupBy(*keys).agg(*_error_measures(F.col("Y"), F.col("PRED")))


def best_model(scores: DataFrame) -> DataFrame:
    """The model of least MAE with its scores, as one row."""
    return scores.agg(F.min_by(F.struct(*scores.columns), F.struct("MAE", "MODELO_PRED")).alias("b")).select("b.*")


def weekly_totals(preds: DataFrame) -> DataFrame:
    return preds.groupBy("MODELO_PRED", "YEAR_WEEK").agg(F.sum("Y").alias("REAL"), F.sum("PRED").alias("PRED"))


def run_summary(scores: DataFrame, sided: DataFrame) -> DataFrame:
    """Winner, its scores and the range and size of each side, as (metrica, valor) text rows."""
    best = best_model(scores)
    pairs = F.array(
        F.struct(F.lit("modelo_ganador").alias("metrica"), F.col("MODELO_PRED").alias("valor")),
        *[F.struct(F.lit(c).alias("metrica"), F.format_string("%.3f", F.col(c)).alias("valor"))
          for c in ("MAE", "RMSE", "R2", "MAPE")],
    )
    sides = ft.split_summary(sided).select(F.inline(F.array(*[
        F.struct(F.concat(F.lower("LADO"), F.lit(suffix)).alias("metrica"), F.col(c).cast("string").alias("valor"))
        for suffix, c in (("_inicio", "INICIO"), ("_fin", "FIN"), ("_muestras", "MUESTRAS"))
    ])))
    return best.select(F.inline(pairs)).unionByName(sides)


def feature_importance(model: PipelineModel, columns: list[str], spark) -> DataFrame:
    """Importance per feature of a fitted tree model, a row per feature."""
    weights = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(c, float(w)) for c, w in zip(columns, weights)], "FEATURE string, IMPORTANCIA double")


def importances(models: dict[str, PipelineModel], columns: list[str], spark) -> DataFrame:
    """Importance per feature of every tree model among ``models``, with the model's name."""
    parts = [feature_importance(m, columns, spark).select(F.lit(name).alias("MODELO_PRED"), "FEATURE", "IMPORTANCIA")
             for name, m in models.items() if hasattr(m.stages[-1], "featureImportances")]
    out = spark.createDataFrame([], "MODELO_PRED string, FEATURE string, IMPORTANCIA double")
    for part in parts:
        out = out.unionByName(part)
    return out


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def naive_predictions(features: DataFrame, target: str = ft.SKU_TARGET) -> DataFrame:
    """Last week and four-week mean as reference predictions in the shape of ``predictions``."""
    keep = [c for c in ("YEAR_WEEK", "PAIS", "CODIGO_SKU") if c in features.columns]
    rows = F.array(
        F.struct(F.lit("Ultima semana").alias("MODELO_PRED"), F.col("LAG_1W").alias("PRED")),
        F.struct(F.lit("Media 4 semanas").alias("MODELO_PRED"), F.col("ROLLING_4W_MEAN").alias("PRED")),
    )
    return features.filter(F.col("LAG_1W").isNotNull()).select(
        *keep, F.col(target).alias("Y"), F.inline(rows))


def sku_event_catalogue(sales: DataFrame) -> DataFrame:
    """Per SKU and country: first attributes, median and deviation of price and units."""
    from ..operators.quantiles import exact_quantiles

    keys = ["CODIGO_SKU", "PAIS"]
    used = (*keys, "FECHA", "FAMILIA", "MODELO", "MARCA", "TIER", "ESTADO", "PRECIO_UNITARIO", "VALUE")
    sales = stored(sales.select(*[c for c in used if c in sales.columns]), "sales")  # read several times

    def earliest(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("FECHA", c))).alias(c)

    base = sales.groupBy(*keys).agg(
        *[earliest(c) for c in ("FAMILIA", "MODELO", "MARCA", "TIER", "ESTADO") if c in sales.columns],
        F.coalesce(F.stddev_samp("PRECIO_UNITARIO"), F.lit(0.0)).alias("PRECIO_STD"),
        F.coalesce(F.stddev_samp("VALUE"), F.lit(0.0)).alias("VALUE_STD"),
    )
    base = base.withColumn("ESTADO", F.coalesce("ESTADO", F.lit("ACTIVE")))
    price = exact_quantiles(sales, keys, "PRECIO_UNITARIO", {"PRECIO_MED": 0.5}).drop("N")
    units = exact_quantiles(sales, keys, "VALUE", {"VALUE_MED": 0.5}).drop("N")
    return base.join(price, keys, "left").join(units, keys, "left")


def latest_positions(stock: DataFrame) -> DataFrame:
    """Last known value of every column per (PAIS, SKU, warehouse)."""
    keys = ["PAIS", "CODIGO_SKU", "CODIGO_BODEGA"]
    rest = [c for c in stock.columns if c not in keys and c != "FECHA"]
    return stock.groupBy(*keys).agg(
        F.max("FECHA").alias("FECHA"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("FECHA", c))).alias(c) for c in rest],
    )


def initial_stock(latest: DataFrame) -> DataFrame:
    return latest.groupBy("PAIS", "CODIGO_SKU").agg(F.sum(F.col("VALUE").cast("bigint")).alias("STOCK"))


def recent_weeks(sales: DataFrame, n: int = 13) -> DataFrame:
    """The last ``n`` weekly totals per SKU as an array, oldest first."""
    from ..functions import week_start
    from ..operators.ranking import top_per_group

    weekly = sales.groupBy("PAIS", "CODIGO_SKU", week_start(F.col("FECHA")).alias("SEMANA")).agg(
        F.sum("VALUE").alias("v"))
    last = top_per_group(weekly, ["PAIS", "CODIGO_SKU"], [F.desc("SEMANA")], n)
    pairs = F.sort_array(F.collect_list(F.struct("SEMANA", "v")))  # at most n items
    return last.groupBy("PAIS", "CODIGO_SKU").agg(F.transform(pairs, lambda x: x["v"]).alias("HISTORIAL"))


