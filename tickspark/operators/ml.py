"""Model-facing data work: splits, scaling, sequences, boosted trees, ensembles, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import stored
from ..functions.windows import BY, correlation, ordered

#: Rows that a task of a model's training holds at most.
TASK_ROWS = 1_000_000


def time_split(df: DataFrame, train: float = 0.7, valid: float = 0.15, by=BY, order=("ts",)) -> DataFrame:
    """part: train, valid or test by position in each symbol's time order."""
    size = df.groupBy(*by).agg(F.count("*").alias("_c"))
    out = df.withColumn("_i", F.row_number().over(ordered(by, order)) - 1).join(size, list(by))
    part = F.when(F.col("_i") < F.floor(F.col("_c") * train), "train").when(F.col("_i") < F.floor(F.col("_c") * (train + valid)), "valid").otherwise("test")
    return out.withColumn("part", part).drop("_i", "_c")


def standard_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation of the fitting rows; zero deviation gives null."""
    s = (df if fit_on is None else fit_on).agg(*(f(c).alias(f"_{c}_{k}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(s))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"_{c}_m")) / F.nullif(F.col(f"_{c}_s"), F.lit(0.0)) for c in cols}).drop(*s.columns)


def sequences(df: DataFrame, cols: list[str], length: int, target: str, horizon: int = 1, by=BY, order=("ts",)) -> DataFrame:
    """Sliding windows of `length` rows as arrays of feature arrays, with the next target(s); whole ones only."""
    w = ordered(by, order)
    x = F.collect_list(F.array(*(F.col(c).cast("double") for c in cols))).over(w.rowsBetween(1 - length, 0))
    y = F.array(*(F.lead(target, k).over(w) for k in range(1, horizon + 1)))
    out = df.withColumns({"x": x, "y": y})
    return out.filter((F.size("x") == length) & F.element_at("y", horizon).isNotNull()).select(*by, *order, "x", "y")


def fit_gbt(df: DataFrame, features: list[str], label: str, folds: int = 0, grid: dict[str, list] | None = None, seed: int = 7, **params):
    """(model, R2 of the fitted rows, importance by feature); folds > 1 searches the grid by cross-validation.

    Training reads its rows many times: they are stored once, and dealt into parts of at most TASK_ROWS rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = stored(df.select(*dict.fromkeys([*features, label])).dropna(), "fit")
    # the trainer keeps its points in memory by partition, and reads one in a task
    rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS)))
    gbt = GBTRegressor(featuresCol="_x", labelCol=label, seed=seed, **params)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), gbt])
    score = RegressionEvaluator(labelCol=label, metricName="r2")
    if folds > 1:
        options = ParamGridBuilder()
        for k, v in (grid or {}).items():
            options = options.addGrid(gbt.getParam(k), v)
        model = CrossValidator(estimator=pipe, estimatorParamMaps=options.build(), evaluator=score, numFolds=folds, seed=seed).fit(rows).bestModel
    else:
        model = pipe.fit(rows)
    weights = model.stages[-1].featureImportances.toArray().tolist()
    return model, score.evaluate(model.transform(rows)), dict(zip(features, weights))


def top_features(importance: DataFrame, n: int) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def ensemble_weights(preds: DataFrame, models: list[str], target: str, method: str = "mse") -> DataFrame:
    """(model, weight): inverse mean square error, inverse error variance, or Gaussian posterior (softmax of log-likelihood)."""
    error = {m: F.col(m) - F.col(target) for m in models}
    agg = {"mse": lambda e: 1 / F.nullif(F.avg(e * e), F.lit(0.0)), "variance": lambda e: 1 / F.nullif(F.var_samp(e), F.lit(0.0)), "posterior": lambda e: -0.5 * F.count(e) * F.ln(F.nullif(F.avg(e * e), F.lit(0.0)))}[method]
    row = preds.agg(*(agg(e).alias(m) for m, e in error.items()))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("v")) for m in models))).alias("x")).select("x.*")
    w = Window.partitionBy(F.lit(0))  # as many rows as models
    v = F.exp(F.col("v") - F.max("v").over(w)) if method == "posterior" else F.col("v")
    return long.withColumn("v", v).select("model", (F.col("v") / F.sum("v").over(w)).alias("weight"))


def blend(preds: DataFrame, weights: DataFrame, models: list[str], key: str) -> DataFrame:
    """(key, blended): weighted sum of the models' outputs."""
    long = preds.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in models))).alias("x")).select(key, "x.*")
    return long.join(F.broadcast(weights), "model").groupBy(key).agg(F.sum(F.col("p") * F.col("weight")).alias("blended"))  # one row a model


def information_coefficient(preds: DataFrame, pred: str, target: str, by: list[str]) -> DataFrame:
    return preds.groupBy(*by).agg(correlation(pred, target).alias("ic"), F.count("*").alias("n"))


def kmeans_regimes(df: DataFrame, features: list[str], k: int = 3, seed: int = 7) -> DataFrame:
    """regime: the k-means cluster of the standardised features (rows with nulls go); the rows, read by each step of the fit, are stored once."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = stored(df.dropna(subset=features), "clusters")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True), KMeans(featuresCol="_s", predictionCol="regime", k=k, seed=seed)])
    return pipe.fit(rows).transform(rows).drop("_v", "_s")


def latest_production_model(registry: DataFrame, stage: str = "production") -> DataFrame:
    return registry.filter(F.col("stage") == stage).groupBy("name").agg(F.max("version").alias("version"), F.max_by("uri", "version").alias("uri"))
