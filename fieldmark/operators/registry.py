"""Dataset and experiment registries as append-only change logs with a latest view."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.operators.compare import latest
from fieldmark.operators.profile import column_profile
from fieldmark.operators.serve import latest_runs, seek, seek_pages
from fieldmark.operators.versions import heads
from fieldmark.sources.sinks import append

# Upload timeout in minutes, its message, and the run transitions allowed.
UPLOAD_TIMEOUT_MINUTES = 30
RUNNABLE_FROM = ["draft", "complete", "failed"]
CANCELLABLE_FROM = ["running"]

# Key roles each join key type must supply.
KEY_ROLES = {
    "game_id": ["game_id"],
    "player_season_week": ["player_id", "season", "week"],
    "team_season_week": ["team", "season", "week"],
}


def register(log_path: str, rows: DataFrame, status: str) -> None:
    """First version of an entry."""
    append(rows.withColumn("status", F.lit(status)), log_path)


def current(log: DataFrame, key: str, order: tuple[str, ...] = ("updated_at", "seq")) -> DataFrame:
    """Latest version per key; entries whose latest version is a tombstone are gone."""
    out = latest(log, [key], list(order))
    return out.where(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in log.columns else out


def update(log: DataFrame, key: str, changes: dict[str, Column], at: Column, where: Column | None = None) -> DataFrame:
    """New versions to append for the current rows that match."""
    rows = current(log, key)
    rows = rows if where is None else rows.where(where)
    return rows.withColumns({**changes, "updated_at": at, "seq": F.col("seq") + 1})


def completion(configs: DataFrame, runs: DataFrame) -> DataFrame:
    """Configs brought up to date with their runs: status, gate, latest run, run count."""
    newest = latest_runs(runs).select(
        "experiment_id",
        F.col("run_id").alias("_run"),
        F.col("status").alias("_status"),
        F.col("gate_passed").alias("_gate"),
    )
    counts = runs.groupBy("experiment_id").agg(F.countDistinct("run_id").alias("_count"))
    joined = configs.join(newest, "experiment_id", "left").join(counts, "experiment_id", "left")
    return joined.withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "gate_passed": F.when(F.col("_run").isNotNull(), F.coalesce("_gate", F.lit(False))).otherwise(F.col("gate_passed")),
            "latest_run_id": F.col("_run"),
            "run_count": F.coalesce("_count", F.lit(0)),
        }
    ).drop("_run", "_status", "_gate", "_count")


def expire_uploads(datasets: DataFrame, now: datetime | Column, minutes: int = UPLOAD_TIMEOUT_MINUTES) -> DataFrame:
    """Uploads still running after the timeout become errors."""
    at = now if isinstance(now, Column) else F.lit(now)
    cutoff = at - F.make_dt_interval(mins=F.lit(minutes))
    stale = (F.col("status") == "uploading") & (F.col("upload_date") <= cutoff)
    return datasets.withColumn("status", F.when(stale, "error").otherwise(F.col("status")))


def profile_upload(df: DataFrame, dataset_id: str) -> DataFrame:
    """Column rows of one upload, ready to replace that dataset's partition."""
    return column_profile(df).select(F.lit(dataset_id).alias("dataset_id"), "*")


def remap_columns(profile: DataFrame, updates: DataFrame, keys: DataFrame) -> DataFrame:
    """New column mapping with the profiled null rate carried over and key columns marked.

    ``updates``: dataset_id, column_name, semantic_name, data_type. ``keys``: dataset_id,
    column_name of the join keys.
    """
    rates = profile.select("dataset_id", "column_name", "null_rate")
    marked = keys.select("dataset_id", "column_name").distinct().withColumn("_key", F.lit(True))
    return (
        updates.join(rates, ["dataset_id", "column_name"], "left")
        .join(marked, ["dataset_id", "column_name"], "left")
        .withColumns(
            {
                "null_rate": F.coalesce("null_rate", F.lit(0.0)),
                "is_join_key": F.coalesce("_key", F.lit(False)),
            }
        )
        .drop("_key")
    )


def key_role_errors(mappings: DataFrame) -> DataFrame:
    """Mappings (dataset_id, join_key_type, roles array) whose roles differ from the required."""
    required = F.lit(None).cast("array<string>")
    for kind, roles in KEY_ROLES.items():
        required = F.when(F.col("join_key_type") == kind, F.array(*[F.lit(r) for r in roles])).otherwise(required)
    required = F.coalesce(required, F.array().cast("array<string>"))
    return (
        mappings.withColumns(
            {"missing": F.array_except(required, F.col("roles")), "extra": F.array_except(F.col("roles"), required)}
        )
        .where((F.size("missing") > 0) | (F.size("extra") > 0))
        .select("dataset_id", "join_key_type", F.sort_array("missing").alias("missing"), F.sort_array("extra").alias("extra"))
    )


def delete(log: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The log without the given keys."""
    return log.join(keys.select(key), key, "left_anti")


def referenced_datasets(datasets: DataFrame, refs: DataFrame) -> DataFrame:
    """Datasets some config refers to. ``refs`` are exploded feature references."""
    used = refs.select(F.regexp_extract("dataset", r"^user_datasets\.(.+)$", 1).alias("dataset_id"))
    return datasets.join(used, "dataset_id", "left_semi")


def list_datasets(datasets: DataFrame, status: str | None = None, license_tag: str | None = None) -> DataFrame:
    out = datasets
    if status is not None:
        out = out.where(F.col("status") == status)
    if license_tag is not None:
        out = out.where(F.col("license_tag") == license_tag)
    return out


def open_data(datasets: DataFrame) -> DataFrame:
    """Data that may be shown publicly."""
    return list_datasets(datasets, license_tag="open")


def list_experiments(
    configs: DataFrame,
    runs: DataFrame,
    status: str | None = None,
    target: str | None = None,
    gate_passed: bool | None = None,
) -> DataFrame:
    """``complete`` means the experiment has a run, whatever its status column says."""
    out = configs
    if status == "complete":
        out = with_runs(out, runs)
    elif status is not None:
        out = out.where(F.col("status") == status)
    if target is not None:
        out = out.where(F.col("target") == target)
    if gate_passed is not None:
        out = out.where(F.col("gate_passed") == gate_passed)
    return out


def with_runs(configs: DataFrame, runs: DataFrame) -> DataFrame:
    return configs.join(runs.select("experiment_id"), "experiment_id", "left_semi")


def run_status(configs: DataFrame, runs: DataFrame) -> DataFrame:
    """Each config with its newest run, if any, and the share of folds done."""
    newest = latest_runs(runs).select(
        "experiment_id", "run_id", "run_at", "completed_at", "folds_complete", "folds_total", "error_message"
    )
    return (
        configs.select("experiment_id", "status")
        .join(newest, "experiment_id", "left")
        .withColumn(
            "progress", F.try_divide(F.col("folds_complete").cast("double"), F.col("folds_total"))
        )
    )


def refresh_candidates(configs: DataFrame) -> DataFrame:
    """Gate-passed experiments that are not running."""
    return configs.where(F.col("gate_passed") & (F.col("status") != "running"))


def rejected_transitions(configs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (experiment_id, action) the current status does not allow, with the reason."""
    joined = requests.join(configs.select("experiment_id", "status"), "experiment_id", "left")
    s, action = F.col("status"), F.col("action")
    reason = (
        F.when(s.isNull(), "not_found")
        .when((action == "run") & (s == "running"), "already_running")
        .when((action == "run") & ~s.isin(RUNNABLE_FROM), "invalid_status")
        .when((action == "cancel") & ~s.isin(CANCELLABLE_FROM), "invalid_status")
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull())


# The config fields a saved copy holds.
SNAPSHOT_FIELDS = ["target", "features", "evaluation", "methodology", "model"]


def snapshot(configs: DataFrame, id_prefix: str = "fw_") -> DataFrame:
    """Saved copies: the config under a new id, as a draft without a gate result."""
    new_id = F.concat(F.lit(id_prefix), F.col("experiment_id"))
    have = [c for c in SNAPSHOT_FIELDS if c in configs.columns]
    body = F.struct(
        new_id.alias("experiment_id"),
        F.concat(F.lit("Framework config "), new_id).alias("name"),
        *have,
        F.lit("draft").alias("status"),
    )
    return configs.select(
        new_id.alias("framework_id"),
        F.col("name"),
        F.col("experiment_id").alias("base_experiment_id"),
        F.to_json(body).alias("config_snapshot"),
    )


def patch(saved: DataFrame, changes: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Partial update: a given value replaces the stored one, NULL keeps it."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    return (
        saved.join(new, key, "left")
        .withColumns({c: F.coalesce(f"_new_{c}", c) for c in cols})
        .drop(*[f"_new_{c}" for c in cols])
    )


# --- saved configs: a log of versions, a tombstone for one that is deleted

NEWEST_SAVED = {"created_at": False, "framework_id": True}


def saved_configs(log: DataFrame) -> DataFrame:
    """Saved configs that are not deleted, as their newest accepted versions have them."""
    return heads(log, "framework_id").where(~F.coalesce(F.col("deleted"), F.lit(False)))


def list_saved(log: DataFrame, limit: int, after: tuple | None = None, every: bool = False) -> DataFrame:
    """A page of saved configs, newest first, after the given (created_at, framework_id); or ``every`` page, numbered."""
    found = saved_configs(log)
    return seek_pages(found, NEWEST_SAVED, limit) if every else seek(found, NEWEST_SAVED, limit, after)


def saved_config(log: DataFrame, framework_id: str) -> DataFrame:
    """One saved config with its parts parsed; no row if there is none."""
    own = saved_configs(log.where(F.col("framework_id") == framework_id))
    parts = ",".join(f"{c}:string" for c in ["experiment_id", "name", *SNAPSHOT_FIELDS, "status"])
    return own.withColumn("config", F.from_json("config_snapshot", f"struct<{parts}>"))


def deleted_saved(log: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Versions to append that delete the given saved configs."""
    found = saved_configs(log).join(ids.select("framework_id").distinct(), "framework_id", "left_semi")
    return found.withColumns({"deleted": F.lit(True), "updated_at": at, "based_on": F.col("seq"), "seq": F.col("seq") + 1})
