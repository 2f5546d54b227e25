"""A small end-to-end run: writes, reproducibility, label shuffle, failure record."""

import random

import pytest

from fieldmark.operators import folds, models
from fieldmark.plans import experiment
from fieldmark.schemas import model_columns

FEATURES = ["ol_pass_epa_per_att", "def_sack_rate"]
SMALL = {"n_estimators": 3, "max_depth": 2, "min_child_weight": 1}


@pytest.fixture(scope="module")
def matrix(spark):
    rng = random.Random(1)
    rows = []
    for season in range(2000, 2005):
        for i in range(40):
            x = [rng.gauss(0, 1) for _ in FEATURES * 2]
            label = None if i % 13 == 0 else (x[0] - x[2] + rng.gauss(0, 0.3) > 0)
            rows.append((f"{season}_{i}", season, 1 + i % 10, "A", "B", 3.0, label, *x, 1, i % 2, 0, 60.0, 5.0, 0.0, None if i % 4 else 1.0))
    names = [f"home_{c}" for c in FEATURES] + [f"away_{c}" for c in FEATURES]
    ddl = "game_id string, season int, week int, home_team string, away_team string, home_spread_close double, home_covered boolean, "
    ddl += ", ".join(f"{c} double" for c in names)
    ddl += ", home_advantage int, div_game int, roof_dome int, temp double, wind double, rest_differential double, sparse double"
    return spark.createDataFrame(rows, ddl).repartition(4)


def config(**method):
    return {
        "experiment_id": "e1",
        "name": "small",
        "features": [{"dataset": "curated", "column": f"home_{c}", "semantic_name": c} for c in FEATURES],
        "evaluation": {"success_threshold": 0.5, "min_sample": 10},
        "methodology": {"train_seasons": 3, "start_season": 2000, "end_season": 2004, **method},
        "model": {"type": "xgboost", "hyperparams": SMALL},
    }


def test_run_writes_one_record_and_every_test_game(spark, matrix, tmp_path):
    runs, preds = str(tmp_path / "runs"), str(tmp_path / "preds")
    result = experiment.run_experiment(spark, config(), matrix, runs, preds, run_id="r1")
    row = spark.read.parquet(runs).first()
    assert (row["run_id"], row["status"], row["folds_total"]) == ("r1", "complete", 2)
    assert row["ats_record_wins"] + row["ats_record_losses"] + row["ats_record_pushes"] == 80
    assert row["gate_passed"] and row["ats_hit_rate"] > 0.5
    stored = spark.read.parquet(preds)
    assert stored.count() == 80 and stored.select("game_id").distinct().count() == 80
    assert stored.where("predicted_home_cover_prob NOT BETWEEN 0 AND 1").count() == 0
    again = experiment.run_experiment(spark, config(), matrix)
    one = {r["game_id"]: r["predicted_home_cover_prob"] for r in result.predictions.collect()}
    two = {r["game_id"]: r["predicted_home_cover_prob"] for r in again.predictions.collect()}
    assert one == pytest.approx(two)
    drops = experiment.permutation_importance(result, [f"home_{FEATURES[0]}", *[c for c in model_columns(FEATURES) if c != f"home_{FEATURES[0]}"]])
    assert drops.count() == len(model_columns(FEATURES))


def test_shuffled_labels_never_pass(spark, matrix, tmp_path):
    runs = str(tmp_path / "runs")
    experiment.run_experiment(spark, config(shuffle_labels=True), matrix, runs)
    row = spark.read.parquet(runs).first()
    assert row["gate_passed"] is False and "SHUFFLE_LABELS=True" in row["notes"]


def test_failures_are_recorded(spark, matrix, tmp_path):
    runs = str(tmp_path / "runs")
    bad = {**config(), "features": [{"dataset": "curated", "column": "nothing", "semantic_name": "n"}]}
    with pytest.raises(ValueError, match="nothing"):
        experiment.run_experiment(spark, bad, matrix, runs)
    row = spark.read.parquet(runs).first()
    assert row["status"] == "failed" and "nothing" in row["error_message"]


def test_moments_come_from_training_rows_only(spark, matrix):
    fold_rows = folds.folds(spark, 2000, 2003, 3)
    tagged = folds.assign_roles(matrix, fold_rows)
    out = models.standardise(tagged, ["home_ol_pass_epa_per_att", "home_advantage", "sparse"]).toPandas()
    train = out[out.role == "train"]
    assert train["home_ol_pass_epa_per_att"].mean() == pytest.approx(0, abs=1e-9)
    assert train["home_ol_pass_epa_per_att"].std(ddof=0) == pytest.approx(1)
    assert (out["home_advantage"] == 0).all()
    assert out["sparse"].notna().all()
    assert train["home_covered"].notna().all() and out[out.role == "test"]["home_covered"].isna().any()


def test_unknown_and_missing_models():
    with pytest.raises(NotImplementedError):
        models.estimator("random_forest")
    with pytest.raises(ValueError):
        models.estimator("nothing")


def test_a_fold_reads_its_own_seasons_only(spark, matrix):
    cols = ["home_ol_pass_epa_per_att", "sparse"]
    ready = experiment.prepare_folds(matrix, folds.folds(spark, 2000, 2004, 3), cols)
    assert ready.matrix.count() == matrix.count()  # one copy, whatever the number of folds
    train = ready.rows("train", 1)
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r["season"] for r in train.collect()} == {2000, 2001, 2002}
    assert {r["season"] for r in ready.rows("test").collect()} == {2003, 2004}
    assert list(ready.complete()) == [1, 2]
    tagged = folds.assign_roles(matrix, folds.folds(spark, 2000, 2004, 3))
    whole = {(r["fold"], r["role"], r["game_id"]): (r[cols[0]], r[cols[1]]) for r in models.standardise(tagged, cols).collect()}
    merged = {(r["fold"], r["role"], r["game_id"]): (r[cols[0]], r[cols[1]]) for role in ("train", "test") for r in ready.rows(role).collect()}
    assert whole.keys() == merged.keys() and all(whole[k] == pytest.approx(merged[k]) for k in whole)
