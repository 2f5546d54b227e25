"""Feature catalogue, its checks and config resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.schemas import (
    FEATURE_REFS_JSON,
    GAME_CONTEXT,
    REST_DIFFERENTIAL,
    TEAM_FEATURES,
)

# Game-level catalogue entries, the namespace and the tombstone reason.
CONTEXT_ENTRIES = ["rest_differential", "div_game", "roof_dome", "temp", "wind"]
CURATED = "curated"
USER_PREFIX = "user_datasets."
TOMBSTONE_REASON = "Feature removed from curated catalog during v2 rebuild"

ENTRY = (
    "feature_id string, semantic_name string, description string, dataset string, data_type string, "
    "join_key_type string, license_tag string, deprecated boolean, deprecated_reason string"
)


def _readable(name: str) -> str:
    return name.replace("_", " ")


def _entries(spark: SparkSession, named: list[tuple[str, str]], reason: str | None) -> DataFrame:
    rows = [
        (f"{CURATED}.{n}", n, text, CURATED, "numeric", "game_id", "open", reason is not None, reason)
        for n, text in named
    ]
    return spark.createDataFrame(rows, ENTRY)


def active_catalog(spark: SparkSession) -> DataFrame:
    """Every built team feature for both sides, plus the game-level entries."""
    named = [(f"{side}_{c}", f"{side} team {_readable(c)}") for side in ("home", "away") for c in TEAM_FEATURES]
    return _entries(spark, named + [(c, _readable(c)) for c in CONTEXT_ENTRIES], None)


def deprecated_catalog(spark: SparkSession) -> DataFrame:
    """Names without a side, kept so that old configs stay readable."""
    return _entries(spark, [(c, f"{_readable(c)} without a side") for c in TEAM_FEATURES], TOMBSTONE_REASON)


def user_features(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns of ready datasets that are not keys, in catalogue shape."""
    ready = datasets.where(F.col("status") == "ready").select("dataset_id", "join_key_type", "license_tag")
    dataset = F.concat(F.lit(USER_PREFIX), F.col("dataset_id"))
    return (
        columns.where(~F.col("is_join_key"))
        .join(ready, "dataset_id")
        .select(
            F.concat(dataset, F.lit("."), F.col("column_name")).alias("feature_id"),
            F.coalesce("semantic_name", "column_name").alias("semantic_name"),
            F.coalesce("description", F.lit("")).alias("description"),
            dataset.alias("dataset"),
            F.coalesce("data_type", F.lit("numeric")).alias("data_type"),
            F.coalesce("join_key_type", F.lit("game_id")).alias("join_key_type"),
            F.coalesce("license_tag", F.lit("open")).alias("license_tag"),
            F.lit(False).alias("deprecated"),
        )
    )


def list_features(
    datasets: DataFrame,
    columns: DataFrame,
    dataset: str | None = None,
    data_type: str | None = None,
    join_key_type: str | None = None,
    include_deprecated: bool = False,
) -> DataFrame:
    """Catalogue plus user columns, optionally with tombstones, filtered."""
    spark = datasets.sparkSession
    out = active_catalog(spark)
    if include_deprecated:
        out = out.unionByName(deprecated_catalog(spark))
    out = out.unionByName(user_features(datasets, columns), allowMissingColumns=True)
    for name, wanted in (("dataset", dataset), ("data_type", data_type), ("join_key_type", join_key_type)):
        if wanted is not None:
            out = out.where(F.col(name) == wanted)
    return out


def feature_refs(configs: DataFrame) -> DataFrame:
    """One row per feature reference of each config, with its position."""
    refs = F.from_json("features", FEATURE_REFS_JSON, {"mode": "PERMISSIVE"})
    return configs.select("experiment_id", F.posexplode(refs).alias("pos", "_ref")).select(
        "experiment_id", "pos", "_ref.dataset", "_ref.column", "_ref.semantic_name"
    )


def base_name(c: Column) -> Column:
    return F.regexp_replace(c, "^(home|away)_", "")


def deprecated_refs(configs: DataFrame) -> DataFrame:
    """Curated references under a tombstoned name."""
    old = deprecated_catalog(configs.sparkSession).select(F.col("semantic_name").alias("column"), "deprecated_reason")
    return (
        feature_refs(configs)
        .where(F.col("dataset") == CURATED)
        .join(old, "column")
        .select("experiment_id", F.col("column").alias("name"), "deprecated_reason")
    )


def flag_deprecated(configs: DataFrame) -> DataFrame:
    has = deprecated_refs(configs).select("experiment_id").distinct().withColumn("_old", F.lit(True))
    return (
        configs.join(has, "experiment_id", "left")
        .withColumn("has_deprecated_features", F.coalesce("_old", F.lit(False)))
        .drop("_old")
    )


def reference_errors(configs: DataFrame, datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """References that resolve to nothing: unknown feature, namespace, dataset or column.

    Curated references may name a side or not.
    """
    refs = feature_refs(configs)
    known = [c for s in ("home", "away") for c in [f"{s}_{f}" for f in TEAM_FEATURES]]
    known += TEAM_FEATURES + CONTEXT_ENTRIES
    user_id = F.regexp_replace("dataset", "^user_datasets\\.", "")
    tagged = refs.withColumns(
        {
            "dataset_id": F.when(F.col("dataset").startswith(USER_PREFIX), user_id),
            "_curated": F.col("dataset") == CURATED,
        }
    )
    states = datasets.select("dataset_id", F.col("status").alias("_status"))
    existing = columns.select("dataset_id", F.col("column_name").alias("column")).distinct().withColumn("_has", F.lit(True))
    joined = tagged.join(states, "dataset_id", "left").join(existing, ["dataset_id", "column"], "left")
    problem = (
        F.when(F.col("_curated"), F.when(~F.col("column").isin(known), "unknown_feature"))
        .when(F.col("dataset_id").isNull(), "unknown_namespace")
        .when(F.col("_status").isNull(), "dataset_missing")
        .when(F.col("_status") != "ready", "dataset_not_ready")
        .when(F.col("_has").isNull(), "unknown_column")
    )
    return (
        joined.withColumn("problem", problem)
        .where(F.col("problem").isNotNull())
        .select("experiment_id", "dataset", "column", "problem")
    )


def resolve_columns(features: list[dict]) -> tuple[list[str], list[str]]:
    """(team features, model columns) of one config's curated references, order kept."""
    requested = []
    for ref in features:
        if ref["dataset"] != CURATED:
            continue
        name = ref["column"].removeprefix("home_").removeprefix("away_")
        if name not in requested:
            requested.append(name)
    unknown = [c for c in requested if c not in TEAM_FEATURES and c not in CONTEXT_ENTRIES]
    if unknown:
        raise ValueError(f"features not in the catalogue: {unknown}")
    requested = [c for c in requested if c in TEAM_FEATURES]  # context is always included
    model = [f"{s}_{c}" for s in ("home", "away") for c in requested] + GAME_CONTEXT + [REST_DIFFERENTIAL]
    return requested, model


def rejected_references(configs: DataFrame) -> DataFrame:
    """Curated references of every config that the catalogue does not have."""
    refs = feature_refs(configs).where(F.col("dataset") == CURATED)
    known = [*TEAM_FEATURES, *CONTEXT_ENTRIES]
    return refs.where(~base_name(F.col("column")).isin(known)).select("experiment_id", "column")


def resolve_all(configs: DataFrame) -> DataFrame:
    """Model columns of every config with their position.

    A config that names a feature outside the catalogue is refused whole, as ``resolve_columns``
    refuses it; ``rejected_references`` lists why.
    """
    refs = feature_refs(configs).where(F.col("dataset") == CURATED)
    refs = refs.join(rejected_references(configs).select("experiment_id").distinct(), "experiment_id", "left_anti")
    wanted = (
        refs.select("experiment_id", base_name(F.col("column")).alias("base"), "pos")
        .where(F.col("base").isin(TEAM_FEATURES))
        .groupBy("experiment_id", "base")
        .agg(F.min("pos").alias("pos"))
    )
    sides = wanted.select(
        "experiment_id",
        F.posexplode(F.array(F.lit("home"), F.lit("away"))).alias("block", "_side"),
        "pos",
        "base",
    ).select("experiment_id", "block", "pos", F.concat_ws("_", "_side", "base").alias("model_column"))
    context = F.array(*[F.lit(c) for c in [*GAME_CONTEXT, REST_DIFFERENTIAL]])
    tail = (
        wanted.select("experiment_id")
        .distinct()
        .select("experiment_id", F.lit(2).alias("block"), F.posexplode(context).alias("pos", "model_column"))
    )
    rows = sides.unionByName(tail)
    order = Window.partitionBy("experiment_id").orderBy("block", "pos")
    return rows.select("experiment_id", (F.row_number().over(order)).alias("position"), "model_column")
