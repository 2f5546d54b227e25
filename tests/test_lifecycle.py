"""Stored configs from draft to closing version: claims, failures, guards, refresh, cancellation."""

import json
import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import versions
from fieldmark.plans import lifecycle
from tests.test_experiment import config, matrix  # noqa: F401 (a fixture)

GUARDS = {"min_plays": 10, "min_games": 10, "max_null_pct": 100.0}


def rows_of(*configs):
    out = []
    for c in configs:
        stored = {**c, **{k: json.dumps(c[k]) for k in ("features", "evaluation", "methodology", "model")}}
        out.append({"target": "home_covered", **stored})
    return out


@pytest.fixture
def paths(spark, matrix, tmp_path):  # noqa: F811
    names = [str(tmp_path / n) for n in ("log", "runs", "predictions")]
    broken = {**config(), "experiment_id": "broken", "features": [{"dataset": "curated", "column": "nothing", "semantic_name": "n"}]}
    other = {**config(), "experiment_id": "e2"}
    lifecycle.add_configs(spark, names[0], spark.createDataFrame(rows_of(config(), broken, other)))
    return names


def run(spark, paths, name, matrix, **more):  # noqa: F811
    log, runs, predictions = paths
    return lifecycle.run_config(spark, log, name, matrix, matrix, lambda: matrix, runs, predictions, guards={**GUARDS, **more.pop("guards", {})}, **more)


def head(spark, paths, name):
    return lifecycle.load_config(spark, paths[0], name)


def test_a_run_closes_its_config(spark, matrix, paths):  # noqa: F811
    result = run(spark, paths, "e1", matrix, run_id="r1")
    now = head(spark, paths, "e1")
    assert (now["status"], now["run_count"], now["latest_run_id"], now["seq"]) == ("complete", 1, "r1", 3)
    assert now["gate_passed"] == result.totals.first()["gate_passed"]
    log = lifecycle.config_log(spark, paths[0]).where("experiment_id = 'e1'").orderBy("seq")
    assert [r["status"] for r in log.collect()] == ["draft", "running", "complete"]
    row = spark.read.parquet(paths[1]).first()
    assert (row["run_id"], row["status"]) == ("r1", "complete")
    run(spark, paths, "e1", matrix)
    assert head(spark, paths, "e1")["run_count"] == 2
    assert head(spark, paths, "e2")["status"] == "draft"


@pytest.mark.parametrize("name, guards, message", [("broken", {}, "nothing"), ("e1", {"min_games": 10**9}, "min_games")])
def test_a_failing_run_closes_its_config_too(spark, matrix, paths, name, guards, message):  # noqa: F811
    with pytest.raises(ValueError, match=message):
        run(spark, paths, name, matrix, guards=guards, run_id="r2")
    now = head(spark, paths, name)
    assert (now["status"], now["gate_passed"], now["run_count"], now["latest_run_id"]) == ("failed", False, 1, "r2")
    row = spark.read.parquet(paths[1]).first()
    assert (row["run_id"], row["status"]) == ("r2", "failed") and message in row["error_message"]


def test_of_two_runners_one_gives_up_before_it_computes(spark, matrix, paths):  # noqa: F811
    one, two = head(spark, paths, "e1"), head(spark, paths, "e1")
    assert lifecycle.next_version(spark, paths[0], one, status="running") == 2
    with pytest.raises(versions.StaleVersion):
        lifecycle.next_version(spark, paths[0], two, status="running")
    lost = versions.rejected(lifecycle.config_log(spark, paths[0]), "experiment_id").collect()
    assert [(r["experiment_id"], r["seq"], r["reason"]) for r in lost] == [("e1", 2, "stale_version")]
    assert head(spark, paths, "e1")["writer"] == one["writer"]
    with pytest.raises(lifecycle.NotRunnable):
        run(spark, paths, "e1", matrix)
    with pytest.raises(LookupError):
        run(spark, paths, "nobody", matrix)
    with pytest.raises(versions.StaleVersion):
        lifecycle.add_configs(spark, paths[0], spark.createDataFrame(rows_of(config())))


def test_versions_of_many_writers(spark):
    at = [datetime(2024, 1, 1, 0, 0, k) for k in range(4)]
    log = spark.createDataFrame(
        [("a", 1, None, "w", at[0]), ("a", 2, 1, "y", at[1]), ("a", 2, 1, "x", at[1]), ("a", 3, 2, "x", at[2]), ("b", 1, None, "w", at[3]), ("b", 1, None, "v", at[2])],
        "k string, seq long, based_on long, writer string, updated_at timestamp",
    )
    assert sorted((r["k"], r["seq"], r["writer"]) for r in versions.heads(log, "k").collect()) == [("a", 3, "x"), ("b", 1, "v")]
    assert sorted((r["k"], r["seq"], r["writer"]) for r in versions.rejected(log, "k").collect()) == [("a", 2, "y"), ("b", 1, "w")]
    empty = log.limit(0)
    assert versions.heads(empty, "k").isEmpty() and versions.rejected(empty, "k").isEmpty()


def test_refresh_goes_on_after_a_failure(spark, matrix, paths):  # noqa: F811
    log, runs, predictions = paths
    for name in ("e1", "broken", "e2"):
        lifecycle.next_version(spark, log, head(spark, paths, name), status="complete", gate_passed=True)
    found = lifecycle.refresh_production(spark, log, matrix, matrix, matrix, runs, predictions, GUARDS)
    assert {r["experiment_id"]: r["status"] for r in found.collect()} == {"e1": "complete", "e2": "complete", "broken": "failed"}
    stored = {r["experiment_id"]: (r["status"], r["error_message"]) for r in spark.read.parquet(runs).collect()}
    assert {k: s for k, (s, _) in stored.items()} == {"e1": "complete", "e2": "complete", "broken": "failed"}
    assert "nothing" in stored["broken"][1]
    assert spark.read.parquet(predictions).groupBy("experiment_id").count().count() == 2
    assert lifecycle.refresh_production(spark, log, matrix, matrix, matrix, runs, predictions, GUARDS).where("experiment_id = 'broken'").isEmpty()


def test_one_run_is_cancelled_alone(spark, matrix, paths):  # noqa: F811
    log, runs, predictions = paths
    lifecycle.next_version(spark, log, head(spark, paths, "e1"), status="complete", gate_passed=True)
    slow = matrix.withColumn("home_covered", F.expr("if(java_method('java.lang.Thread', 'sleep', 20L) is null, home_covered, home_covered)"))
    out = []
    worker = threading.Thread(target=lambda: out.extend(lifecycle.refresh_production(spark, log, matrix, matrix, slow, runs, predictions, GUARDS).collect()))
    worker.start()
    stopped = False
    while worker.is_alive():
        try:
            lifecycle.cancel(spark, log, "e1")
            stopped = True
        except lifecycle.NotRunnable:
            pass
        time.sleep(0.3)
    assert stopped and [r["status"] for r in out] == ["failed"]
    assert "cancel" in out[0]["error"].lower()
    assert head(spark, paths, "e1")["status"] == "failed"
