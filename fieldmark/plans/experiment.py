"""Config-driven walk-forward experiments."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators.catalog import CURATED, USER_PREFIX, resolve_columns
from fieldmark.operators.folds import (
    DEFAULT_END,
    DEFAULT_START,
    DEFAULT_TRAIN,
    filter_universe,
    folds,
    role_seasons,
    with_roles,
)
from fieldmark.operators.matrix import build_matrix, join_user
from fieldmark.operators.mismatch import mismatch_flag
from fieldmark.operators.models import (
    DEFAULT_SEED,
    assemble,
    estimator,
    fold_moments,
    importance_rows,
    positive_probability,
    season_moments,
    standardise,
)
from fieldmark.operators.permute import permuted_copies, shuffle_labels
from fieldmark.operators.quality import require
from fieldmark.operators.scoring import fold_metrics, gate, mean_importance, record, score, totals
from fieldmark.schemas import GATE_HIT_RATE, GATE_MIN_GAMES, model_columns
from fieldmark.session import ensure_checkpoint_dir, materialise, untagged
from fieldmark.sources.sinks import append, append_predictions, error_record, run_record, spread_for_write

# Folds fitted at the same time. Each fit is a Spark job chain with idle gaps between its
# iterations; running a few side by side fills them.
PARALLEL_FOLDS = 8
# Universes run at the same time, for the same reason.
PARALLEL_RUNS = 4
# Training games that one task of a fit holds.
ROWS_PER_TASK = 20_000


@dataclass
class FoldInput:
    """What the folds of a run read: the matrix by season, the seasons of each fold, and its moments.

    The matrix is stored once, whatever the number of folds. A fold joins its seasons first, and Spark
    prunes the other seasons' partitions at run time; its moments are one row.
    """

    matrix: DataFrame
    roles: DataFrame
    seasons: DataFrame
    moments: DataFrame
    cols: list[str]

    def rows(self, role: str, fold: int | None = None) -> DataFrame:
        """Standardised games of one role, of one fold or of all."""
        roles = self.roles.where(F.col("role") == role)
        roles = roles if fold is None else roles.where(F.col("fold") == fold)
        return standardise(with_roles(self.matrix, roles), self.cols, self.moments)

    def complete(self) -> dict[int, int]:
        """Training games of the folds that have games of both roles; the run record tells how many of all folds that were."""
        counts = self.roles.join(self.seasons, "season").groupBy("fold").agg(
            F.sum(F.when(F.col("role") == "train", F.col("labelled"))).alias("train"),
            F.sum(F.when(F.col("role") == "test", F.col("games"))).alias("test"),
        )
        return {r["fold"]: r["train"] for r in counts.where("train > 0 and test > 0").orderBy("fold").collect()}


@dataclass
class Backtest:
    """Distributed results of one walk-forward run, plus the fitted model of each fold."""

    predictions: DataFrame
    metrics: DataFrame
    totals: DataFrame
    importance: DataFrame
    models: dict
    input: FoldInput


def prepare_folds(matrix: DataFrame, fold_rows: DataFrame, cols: list[str]) -> FoldInput:
    """One write of the matrix by season, one pass for the moments of its seasons."""
    ensure_checkpoint_dir(matrix.sparkSession)
    stored = materialise(spread_for_write(matrix, "season", ["game_id"]), "folds", "season")
    roles = materialise(role_seasons(fold_rows), "roles")
    seasons = materialise(season_moments(stored, cols), "seasons")
    return FoldInput(stored, roles, seasons, materialise(fold_moments(seasons, roles, cols), "moments"), cols)


def walk_forward(
    matrix: DataFrame,
    fold_rows: DataFrame,
    cols: list[str],
    model: str = "xgboost",
    seed: int = DEFAULT_SEED,
    hyperparams: dict | None = None,
    gate_hit_rate: float = GATE_HIT_RATE,
    gate_min_games: int = GATE_MIN_GAMES,
    parallel: int = PARALLEL_FOLDS,
) -> Backtest:
    """Fit on each fold's training rows, score its test season, and sum up.

    Preprocessing is shared by all folds; the driver only loops over the fits.
    """
    spark = matrix.sparkSession
    ready = prepare_folds(matrix, fold_rows, cols)
    present = ready.complete()

    def fit(fold: int):
        train = assemble(ready.rows("train", fold), cols).select("game_id", "features", F.col("home_covered").cast("int").alias("label"))
        # trees draw their samples by place, so equal data has to lie equally, however its files do
        dealt = train.repartition(-(-present[fold] // ROWS_PER_TASK), "game_id").sortWithinPartitions("game_id")
        # every job of a fit ships the lineage of its rows, so it is cut first; the rows lie as they were dealt
        return fold, estimator(model, seed, hyperparams).fit(dealt.select("features", "label").checkpoint())

    with ThreadPoolExecutor(max(1, min(parallel, len(present)))) as pool:
        models = dict(pool.map(inheritable_thread_target(spark)(fit), present))

    scored = [positive_probability(models[f].transform(assemble(ready.rows("test", f), cols))).drop("features") for f in present]
    predictions = materialise(score(reduce(DataFrame.unionByName, scored)), "predictions")
    metrics = fold_metrics(predictions)
    importance = mean_importance(
        reduce(DataFrame.unionByName, [importance_rows(spark, models[f], cols, f) for f in present])
    )
    return Backtest(
        predictions, metrics, totals(metrics, None, gate_hit_rate, gate_min_games), importance, models, ready
    )


def permutation_importance(run: Backtest, cols: list[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """Hit-rate drop when a feature is permuted within each test season.

    The fold models are already fitted, so every permuted copy is only scored, all features
    in one pass per fold.
    """
    copies = permuted_copies(run.input.rows("test"), cols, ["fold"], ["game_id"], seed, ("home_covered",))
    wide = assemble(copies, cols).select("fold", "game_id", "home_covered", "permuted_feature", "features")
    scored = reduce(
        DataFrame.unionByName,
        [
            positive_probability(m.transform(wide.where(F.col("fold") == f))).drop("features")
            for f, m in run.models.items()
        ],
    )
    right = (F.col("predicted_home_cover_prob") > 0.5) == F.col("home_covered")
    permuted = record(
        scored.withColumn("correct", right.cast("int")), ["permuted_feature"]
    ).select(F.col("permuted_feature").alias("feature"), F.col("hit_rate").alias("permuted_hr"))
    base = run.totals.select("overall_hit_rate").scalar()
    return permuted.withColumn("baseline_hr", base).withColumn(
        "hr_drop", F.col("baseline_hr") - F.col("permuted_hr")
    )


def attach_user_features(matrix: DataFrame, features: list[dict], user_tables: dict) -> tuple[DataFrame, list[str]]:
    """Join each referenced user dataset; ``user_tables``: id -> (frame, key type, key names)."""
    wanted: dict[str, list[dict]] = {}
    for ref in features:
        if ref["dataset"] != CURATED:
            wanted.setdefault(ref["dataset"].removeprefix(USER_PREFIX), []).append(ref)
    cols: list[str] = []
    for dataset_id, refs in wanted.items():
        frame, key_type, keys = user_tables[dataset_id]
        renamed = frame.withColumnsRenamed({r["column"]: r.get("semantic_name") or r["column"] for r in refs})
        names = [r.get("semantic_name") or r["column"] for r in refs]
        matrix = join_user(matrix, renamed, names, key_type, keys)
        cols += names if key_type == "game_id" else [f"{s}_{n}" for n in names for s in ("home", "away")]
    return matrix, cols


def experiment_matrix(plays: DataFrame, games: DataFrame, with_mismatch: bool = False) -> DataFrame:
    """The full matrix, stored once so that several runs and folds read it back."""
    matrix = materialise(build_matrix(plays, games), "matrix")
    return materialise(mismatch_flag(matrix), "flagged") if with_mismatch else matrix


def run_experiment(
    spark: SparkSession,
    config: dict,
    matrix: DataFrame | Callable[[], DataFrame],
    runs_path: str | None = None,
    predictions_path: str | None = None,
    user_tables: dict | None = None,
    run_id: str | None = None,
    guards: DataFrame | None = None,
) -> Backtest:
    """One configured run: guards, columns, universe, optional label shuffle, folds, fit, write.

    ``matrix`` may be a function that builds it; ``guards`` are checks that must pass first. A failure
    in any of them is recorded as a failed run before it is raised.
    """
    run_id = run_id or uuid.uuid4().hex
    started = datetime.now(timezone.utc).replace(tzinfo=None)
    method, evaluation, model = config["methodology"], config.get("evaluation", {}), config.get("model", {})
    shuffled = bool(method.get("shuffle_labels"))
    identity = {
        "run_id": run_id,
        "experiment_id": config["experiment_id"],
        "name": config.get("name", config["experiment_id"]),
        "run_at": started,
        "model_type": model.get("type", "xgboost"),
    }
    try:
        if guards is not None:
            require(guards)
        _, cols = resolve_columns(config["features"])
        matrix = matrix() if callable(matrix) else matrix
        seed = int(method.get("random_seed") or DEFAULT_SEED)
        if shuffled:
            matrix = shuffle_labels(matrix, seed)
        matrix, extra = attach_user_features(matrix, config["features"], user_tables or {})
        universe = method.get("game_universe")
        matrix = filter_universe(matrix, universe, int(method.get("min_universe", 100)))
        fold_rows = folds(
            spark, method["start_season"], method["end_season"], method["train_seasons"], method.get("test_seasons") or 1
        )
        threshold = float(evaluation.get("success_threshold", GATE_HIT_RATE))
        min_games = int(evaluation.get("min_sample", GATE_MIN_GAMES))
        result = walk_forward(
            matrix, fold_rows, cols + extra, identity["model_type"], seed, model.get("hyperparams"), threshold, min_games
        )
        if shuffled:
            result.totals = result.totals.withColumn("gate_passed", F.lit(False))
        if predictions_path:  # before the run's row, so that a run recorded as complete has its predictions
            stamped = result.predictions.withColumns(
                {"run_id": F.lit(run_id), "experiment_id": F.lit(config["experiment_id"])}
            )
            append_predictions(stamped, predictions_path)
        if runs_path:
            counts = (len(result.models), fold_rows.count())
            append(summarise_run(result, identity, config, cols + extra, universe, shuffled, *counts), runs_path)
        return result
    except Exception as error:
        if runs_path:
            with untagged(spark):
                append(error_record(spark, identity, str(error)), runs_path)
        raise


def summarise_run(
    result: Backtest, identity: dict, config: dict, cols: list[str], universe, shuffled: bool, n_done: int, n_folds: int
) -> DataFrame:
    """The run-table row of a finished run."""
    notes = config.get("description") or ""
    if shuffled:
        notes = f"{notes} [SHUFFLE_LABELS=True]".strip()
    if universe:
        notes = f"{notes} [UNIVERSE: {universe['field']} {universe.get('operator', 'eq')} {universe['value']}]".strip()
    seasons = result.predictions.agg(F.sort_array(F.collect_set("season"))).scalar()
    importance = result.importance.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "importance")))
    ).scalar()
    t = result.totals
    return run_record(
        t.select(
            *[F.lit(v).alias(k) for k, v in identity.items()],
            F.current_timestamp().alias("completed_at"),
            F.lit(json.dumps(cols)).alias("features"),
            F.lit("complete").alias("status"),
            F.col("overall_hit_rate").alias("ats_hit_rate"),
            F.col("total_wins").alias("ats_record_wins"),
            F.col("total_losses").alias("ats_record_losses"),
            F.col("total_pushes").alias("ats_record_pushes"),
            F.col("total_n_games").alias("n_games_evaluated"),
            "gate_passed",
            F.lit(config["methodology"]["train_seasons"]).alias("training_window_years"),
            seasons.alias("seasons_evaluated"),
            F.lit(n_done).alias("folds_complete"),
            F.lit(n_folds).alias("folds_total"),
            F.lit(notes).alias("notes"),
            F.lit(json.dumps(config.get("evaluation", {}))).alias("success_criteria"),
            importance.alias("feature_importances"),
        )
    )


# Universes of the two situational runs.
SITUATIONAL_UNIVERSES = {
    "divisional": {"field": "div_game", "operator": "eq", "value": "true"},
    "late_season": {"field": "week", "operator": "gte", "value": "15"},
}


def run_situational(
    spark: SparkSession, config: dict, matrix: DataFrame, universes: dict | None = None, **paths
) -> dict[str, Backtest]:
    """The same config on several universes over one stored matrix, side by side; the first failure is raised when all are done."""

    def run(item: tuple[str, dict]) -> tuple[str, Backtest]:
        name, universe = item
        method = {**config["methodology"], "game_universe": universe}
        own = {**config, "experiment_id": f"{config['experiment_id']}_{name}", "methodology": method}
        return name, run_experiment(spark, own, matrix, **paths)

    chosen = universes or SITUATIONAL_UNIVERSES
    with ThreadPoolExecutor(max(1, min(PARALLEL_RUNS, len(chosen)))) as pool:
        return dict(pool.map(inheritable_thread_target(spark)(run), chosen.items()))


def default_config(start: int = DEFAULT_START, end: int = DEFAULT_END, train: int = DEFAULT_TRAIN) -> dict:
    """First standalone run: every team feature, six folds, boosted trees."""
    team = [c.removeprefix("home_") for c in model_columns() if c.startswith("home_") and c != "home_advantage"]
    return {
        "experiment_id": "default",
        "name": "all features",
        "features": [{"dataset": CURATED, "column": c, "semantic_name": c} for c in team],
        "evaluation": {"success_threshold": GATE_HIT_RATE, "min_sample": GATE_MIN_GAMES},
        "methodology": {"train_seasons": train, "test_seasons": 1, "start_season": start, "end_season": end},
        "model": {"type": "ol_xgb_v2"},
    }


def gate_rows(runs: DataFrame) -> DataFrame:
    """Gate decision per stored run from its record; shuffled runs never pass."""
    shuffled = F.coalesce(F.col("notes").contains("SHUFFLE_LABELS=True"), F.lit(False))
    return runs.withColumn(
        "gate_passed", gate(F.col("ats_hit_rate"), F.col("n_games_evaluated"), shuffled=shuffled)
    )
