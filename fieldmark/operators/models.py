"""Fold preprocessing, classifiers and the fixed scorer."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Boosted-tree settings of the two model versions.
TREE_PARAMS_V1 = {
    "maxIter": 300,
    "maxDepth": 4,
    "stepSize": 0.03,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "minInstancesPerNode": 10,
}
TREE_PARAMS_V2 = {**TREE_PARAMS_V1, "minInstancesPerNode": 8}
DEFAULT_SEED = 42

# Hyperparameter names accepted in configs -> estimator parameters.
HYPERPARAMETERS = {
    "n_estimators": ("maxIter", int),
    "max_depth": ("maxDepth", int),
    "learning_rate": ("stepSize", float),
    "subsample": ("subsamplingRate", float),
    "colsample_bytree": ("featureSubsetStrategy", str),
    "min_child_weight": ("minInstancesPerNode", int),
}


def _boosted(defaults: dict):
    def make(seed: int = DEFAULT_SEED, hyperparams: dict | None = None) -> GBTClassifier:
        params = dict(defaults)
        unknown = sorted(set(hyperparams or {}) - set(HYPERPARAMETERS))
        if unknown:
            raise ValueError(f"hyperparameters that the boosted trees do not have: {unknown}; known: {sorted(HYPERPARAMETERS)}")
        for name, value in (hyperparams or {}).items():
            target, kind = HYPERPARAMETERS[name]
            params[target] = kind(value)
        return GBTClassifier(
            featuresCol="features", labelCol="label", seed=seed, cacheNodeIds=False, checkpointInterval=20, **params
        )

    return make


def _missing(name: str):
    def make(*_, **__):
        raise NotImplementedError(f"model type {name!r} has no implementation")

    return make


# Model type names of stored configs.
MODELS = {
    "xgboost": _boosted(TREE_PARAMS_V2),
    "ol_xgb_v1": _boosted(TREE_PARAMS_V1),
    "ol_xgb_v2": _boosted(TREE_PARAMS_V2),
    "logistic_regression": _missing("logistic_regression"),
    "random_forest": _missing("random_forest"),
}


def estimator(name: str, seed: int = DEFAULT_SEED, hyperparams: dict | None = None):
    if name not in MODELS:
        raise ValueError(f"unknown model type {name!r}")
    return MODELS[name](seed=seed, hyperparams=hyperparams)


def season_moments(matrix: DataFrame, cols: list[str], label: str = "home_covered", by: tuple[str, ...] = ("season",)) -> DataFrame:
    """One row per season (or per ``by``): its games, its labelled ones, and count, mean and squared deviations of each column over those."""
    labelled = F.col(label).isNotNull()
    aggs = [F.count("*").alias("games"), F.count_if(labelled).alias("labelled")]
    for c in cols:
        value = F.when(labelled, F.col(c).cast("double"))
        aggs.append(F.struct(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2")).alias(c))
    return matrix.groupBy(*by).agg(*aggs)


def fold_moments(seasons: DataFrame, roles: DataFrame | None, cols: list[str]) -> DataFrame:
    """Mean and spread of each column over a fold's training rows, merged from its seasons' moments.

    No game is read: a fold's moments come from as many rows as it has seasons. Without ``roles``
    the moments given are those of (fold, season) already.
    """
    own = seasons if roles is None else roles.where(F.col("role") == "train").join(seasons, "season")
    train = own.select(
        "fold", "labelled", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.*")) for c in cols])).alias("m")
    ).select("fold", "labelled", "m.*")
    whole = Window.partitionBy("fold", "column")
    mean = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(whole), F.sum("n").over(whole))
    apart = F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2)
    merged = train.withColumn("_mean", mean).groupBy("fold", "column").agg(
        F.max("_mean").alias("mean"), F.sqrt(F.try_divide(F.sum(apart), F.sum("labelled"))).alias("sd")
    )
    return merged.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("mean", "sd")))).alias("moments"))


def standardise(tagged: DataFrame, cols: list[str], moments: DataFrame | None = None) -> DataFrame:
    """Mean-fill and standardise with the moments of each fold's training rows (``fold_moments``).

    Without ``moments`` they are taken from the tagged training rows, each once a fold.

    The fill keeps the mean, and shrinks the variance by the share of rows that were present.
    A constant column is only centred; a column without training values becomes 0.
    """
    if moments is None:
        train = tagged.where(F.col("role") == "train")
        moments = fold_moments(season_moments(train, cols, by=("fold", "season")), None, cols)
    out = {}
    for c in cols:
        mean, sd = F.coalesce(F.col("moments")[c]["mean"], F.lit(0.0)), F.col("moments")[c]["sd"]
        value = F.coalesce(F.col(c).cast("double"), mean)
        out[c] = (value - mean) / F.when(sd > 1e-12, sd).otherwise(1.0)
    return tagged.join(moments, "fold", "left").withColumns(out).drop("moments")


def assemble(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


def positive_probability(scored: DataFrame, name: str = "predicted_home_cover_prob") -> DataFrame:
    return scored.withColumn(name, vector_to_array("probability").getItem(1)).drop(
        "rawPrediction", "probability", "prediction"
    )


def importance_rows(spark, model, cols: list[str], fold: int) -> DataFrame:
    """Gain importances of one fold; at most one row per model column."""
    values = model.featureImportances.toArray()
    return spark.createDataFrame(
        [(fold, c, float(v)) for c, v in zip(cols, values)], "fold int, feature string, importance double"
    )


def always_home(df: DataFrame) -> DataFrame:
    """Baseline that picks home in every game."""
    return df.withColumns(
        {
            "predicted_home_cover_prob": F.lit(1.0),
            "baseline_predicted_side": F.lit("home"),
            "baseline_correct": F.col("home_covered").cast("int"),
        }
    )


def fixed_scorer() -> Column:
    """Logistic of the summed composite edges: an exact scorer without a fit, for checks."""
    edge = (F.col("home_ol_composite") - F.col("away_def_composite")) - (
        F.col("away_ol_composite") - F.col("home_def_composite")
    )
    return 1 / (1 + F.exp(-F.coalesce(edge, F.lit(0.0))))
