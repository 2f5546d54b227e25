"""Stored experiment configs, run: config log in, running version, run row, predictions, closing version.

The config log is append-only (``operators.versions``). A run claims its config by appending a
``running`` version made from the one it read, so that of two runners one gives up before it has
computed anything. Whatever happens then, a closing version follows: ``complete`` or ``failed``, with the
gate, the run's id and one more run counted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.operators.quality import load_guards
from fieldmark.operators.registry import CANCELLABLE_FROM, RUNNABLE_FROM, refresh_candidates
from fieldmark.operators.versions import StaleVersion, commit, heads
from fieldmark.plans.experiment import Backtest, run_experiment
from fieldmark.schemas import EVALUATION_JSON, EXPERIMENT_CONFIGS, FEATURE_REFS_JSON, METHODOLOGY_JSON, MODEL_JSON
from fieldmark.session import untagged
from fieldmark.sources.coerce import project_to

KEY = "experiment_id"
CONFIG_LOG = T.StructType(
    EXPERIMENT_CONFIGS.fields
    + [T.StructField("seq", T.LongType(), False), T.StructField("based_on", T.LongType()), T.StructField("writer", T.StringType(), False)]
)
SHAPES = {"features": FEATURE_REFS_JSON, "evaluation": EVALUATION_JSON, "methodology": METHODOLOGY_JSON, "model": MODEL_JSON}


class NotRunnable(RuntimeError):
    """The config's status does not allow the request."""


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def config_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONFIG_LOG).parquet(path)


def add_configs(spark: SparkSession, path: str, configs: DataFrame, writer: str | None = None) -> None:
    """First versions of new configs, as drafts; one whose id is taken is refused."""
    first = configs.withColumns(
        {
            "status": F.lit("draft"),
            "run_count": F.lit(0).cast("bigint"),
            "created_at": F.lit(_now()),
            "updated_at": F.lit(_now()),
            "seq": F.lit(1).cast("bigint"),
            "based_on": F.lit(None).cast("bigint"),
            "writer": F.lit(""),
        }
    )
    rows = project_to(first, CONFIG_LOG).drop("writer")
    commit(spark, path, rows, KEY, writer or uuid.uuid4().hex)


def _given(value):
    """A parsed payload without the fields it does not state."""
    if isinstance(value, dict):
        return {k: _given(v) for k, v in value.items() if v is not None}
    return [_given(v) for v in value] if isinstance(value, list) else value


def load_config(spark: SparkSession, path: str, experiment_id: str) -> dict:
    """The newest accepted version of one config, its JSON columns parsed with their declared shapes."""
    own = config_log(spark, path).where(F.col(KEY) == experiment_id)
    parsed = heads(own, KEY).withColumns({c: F.from_json(c, shape, {"mode": "FAILFAST"}) for c, shape in SHAPES.items()})
    row = parsed.first()
    if row is None:
        raise LookupError(f"no experiment config {experiment_id!r}")
    return _given(row.asDict(recursive=True))


def next_version(spark: SparkSession, path: str, config: dict, **changes) -> int:
    """Append a version made from the loaded one; its seq. Raises ``StaleVersion`` if another stands."""
    log = config_log(spark, path).where((F.col(KEY) == config[KEY]) & (F.col("seq") == config["seq"]) & (F.col("writer") == config["writer"]))
    values = {**changes, "updated_at": _now(), "based_on": config["seq"], "seq": config["seq"] + 1}
    types = {f.name: f.dataType for f in CONFIG_LOG.fields}
    row = log.limit(1).withColumns({k: F.lit(v).cast(types[k]) for k, v in values.items()})
    writer = config.get("_writer") or uuid.uuid4().hex
    commit(spark, path, project_to(row, CONFIG_LOG).drop("writer"), KEY, writer)
    config.update(values, writer=writer, _writer=writer)
    return values["seq"]


def run_config(
    spark: SparkSession,
    log_path: str,
    experiment_id: str,
    plays: DataFrame,
    games: DataFrame,
    matrix: DataFrame | Callable[[], DataFrame],
    runs_path: str,
    predictions_path: str,
    run_id: str | None = None,
    guards: dict | None = None,
    user_tables: dict | None = None,
) -> Backtest:
    """One stored config from claim to closing version.

    ``guards`` are the thresholds of ``quality.load_guards``; a half-loaded table fails the run. ``matrix`` may
    be a function, so that building it counts as part of the run.
    """
    config = load_config(spark, log_path, experiment_id)
    if config.get("status") not in RUNNABLE_FROM:
        raise NotRunnable(f"{experiment_id} is {config.get('status')!r}")
    run_id = run_id or uuid.uuid4().hex
    next_version(spark, log_path, config, status="running")
    passed, done = False, False
    try:
        checks = load_guards(plays, games, **(guards or {}))
        result = run_experiment(spark, config, matrix, runs_path, predictions_path, user_tables, run_id, checks)
        passed = bool(result.totals.first()["gate_passed"])
        done = True
        return result
    finally:
        with untagged(spark):
            next_version(
                spark,
                log_path,
                config,
                status="complete" if done else "failed",
                gate_passed=passed,
                latest_run_id=run_id,
                run_count=config.get("run_count", 0) + 1,
            )


def tag_of(experiment_id: str) -> str:
    return f"fieldmark-run-{experiment_id.replace(',', '_')}"


def cancel(spark: SparkSession, log_path: str, experiment_id: str) -> None:
    """Stop the Spark jobs of a running config; its runner then records it as failed.

    A run that is between two jobs, or still reads whether its claim stands, goes on: cancel again.
    """
    status = load_config(spark, log_path, experiment_id).get("status")
    if status not in CANCELLABLE_FROM:
        raise NotRunnable(f"{experiment_id} is {status!r}")
    spark.sparkContext.cancelJobsWithTag(tag_of(experiment_id))


def refresh_production(
    spark: SparkSession,
    log_path: str,
    plays: DataFrame,
    games: DataFrame,
    matrix: DataFrame,
    runs_path: str,
    predictions_path: str,
    guards: dict | None = None,
    parallel: int = 2,
) -> DataFrame:
    """Run every config whose gate is passed and that is not running; (experiment_id, run_id, status, error).

    Each runs under a job tag and in a scheduler pool of its own, so that one can be cancelled alone, and
    with ``spark.scheduler.mode=FAIR`` they share the cluster. A failure is a row, and the others go on.
    """
    log = config_log(spark, log_path)
    chosen = refresh_candidates(heads(log, KEY)).orderBy(F.desc("created_at"), KEY)
    names = [r[KEY] for r in chosen.select(KEY).collect()]

    def run(name: str) -> tuple:
        sc, run_id = spark.sparkContext, uuid.uuid4().hex
        sc.addJobTag(tag_of(name))
        sc.setLocalProperty("spark.scheduler.pool", tag_of(name))
        try:
            run_config(spark, log_path, name, plays, games, matrix, runs_path, predictions_path, run_id, guards)
            return name, run_id, "complete", None
        except (StaleVersion, NotRunnable) as error:
            return name, None, "skipped", str(error)
        except Exception as error:  # recorded in the run table and the log by the run itself
            return name, run_id, "failed", str(error)
        finally:
            sc.removeJobTag(tag_of(name))
            sc.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(run), names))
    return spark.createDataFrame(rows, "experiment_id string, run_id string, status string, error string")
