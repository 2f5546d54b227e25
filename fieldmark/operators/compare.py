"""Reading runs side by side, and rules over run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.operators.scoring import record
from fieldmark.schemas import IMPORTANCES_JSON

# Thresholds of the diagnostic rules.
FOLD_BAR = 0.54
SHUFFLED_MAX = 0.52


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest row per key by the given ordering columns, later columns breaking ties.

    A max over a struct combines map-side, so a key that owns a third of the rows costs no
    more than any other; a row number would sort it in one task.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    picked = df.groupBy(*key).agg(F.max(F.struct(*order)).alias("_o"), F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*key, "_o.*", "_r.*").select(*df.columns)


def importance_long(runs: DataFrame) -> DataFrame:
    """Importance JSON of each run as rows."""
    parsed = F.from_json("feature_importances", IMPORTANCES_JSON)
    return runs.select("run_id", F.explode(parsed).alias("feature", "importance"))


def ranked_importance(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rank by importance, then name. A run has at most one row per model column."""
    window = Window.partitionBy(*(by or [])).orderBy(F.desc("importance"), "feature")
    return rows.withColumn("rank", F.row_number().over(window))


def top_features(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("importance"), "feature").limit(k)


def comparison_rows(runs: DataFrame, preds: DataFrame, top: int = 3) -> DataFrame:
    """(metric, run_id, value) rows: name, hit rate, games, gate, seasons, top features."""
    newest = latest(runs, ["run_id"], ["run_at", "experiment_id"])
    cells = newest.select(
        "run_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(label).alias("metric"), value.cast("string").alias("value"))
                    for label, value in {
                        "name": F.col("name"),
                        "hit_rate": F.round("ats_hit_rate", 4),
                        "n_games": F.col("n_games_evaluated"),
                        "gate_passed": F.col("gate_passed"),
                    }.items()
                ]
            )
        ),
    )
    seasons = record(preds.join(newest.select("run_id"), "run_id", "left_semi"), ["run_id", "season"]).select(
        "run_id",
        F.concat(F.lit("season_"), F.col("season")).alias("metric"),
        F.round("hit_rate", 4).cast("string").alias("value"),
    )
    best = (
        ranked_importance(importance_long(newest), ["run_id"])
        .where(F.col("rank") <= top)
        .select("run_id", F.concat(F.lit("top_feature_"), F.col("rank")).alias("metric"), F.col("feature").alias("value"))
    )
    return cells.unionByName(seasons).unionByName(best)


def compare_runs(runs: DataFrame, preds: DataFrame, run_ids: list[str], top: int = 3) -> DataFrame:
    """One row per metric, one column per requested run."""
    chosen = runs.where(F.col("run_id").isin(run_ids))
    return comparison_rows(chosen, preds, top).groupBy("metric").pivot("run_id", run_ids).agg(F.max("value"))


def diagnostics(summaries: DataFrame, fold_bar: float = FOLD_BAR, shuffled_max: float = SHUFFLED_MAX) -> DataFrame:
    """Decision rules over (experiment_id, seed, fold, hit_rate, shuffled) rows."""
    real, probe = F.col("shuffled") == F.lit(False), F.col("shuffled")
    per_seed = summaries.groupBy("experiment_id", "seed").agg(
        F.avg(F.when(real, F.col("hit_rate"))).alias("seed_rate"),
        F.count_if(real & (F.col("hit_rate") > fold_bar)).alias("folds_above"),
        F.count_if(real).alias("folds"),
        F.avg(F.when(probe, F.col("hit_rate"))).alias("probe_rate"),
    )
    return per_seed.groupBy("experiment_id").agg(
        F.sum("folds_above").alias("folds_above"),
        F.sum("folds").alias("folds"),
        (F.max("seed_rate") - F.min("seed_rate")).alias("seed_spread"),
        F.max("probe_rate").alias("shuffled_rate"),
    ).withColumns(
        {
            "folds_majority": F.col("folds_above") * 2 > F.col("folds"),
            "probe_clean": F.coalesce(F.col("shuffled_rate") <= shuffled_max, F.lit(True)),
        }
    )
