"""What a fit ships with each of its jobs, and universes side by side."""

import threading

import pytest

from fieldmark.operators import models
from fieldmark.plans import experiment
from tests.test_experiment import SMALL, config, matrix  # noqa: F401 (a fixture)


def test_fits_start_from_stored_rows(spark, matrix, monkeypatch):  # noqa: F811
    plans, uncut = [], {}

    class Watched:
        def fit(self, rows):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            return models.estimator("xgboost", 42, SMALL).fit(rows)

    monkeypatch.setattr(experiment, "estimator", lambda *_: Watched())
    cut = experiment.run_experiment(spark, config(), matrix).models
    assert len(plans) == 2 and not any("Exchange" in p or "parquet" in p.lower() for p in plans)
    monkeypatch.setattr("pyspark.sql.DataFrame.checkpoint", lambda df, *_: df)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.checkpoint", lambda df, *_: df)
    uncut = experiment.run_experiment(spark, config(), matrix).models
    assert any("Exchange" in p for p in plans[2:])
    assert {f: m.toDebugString.split("\n", 1)[1] for f, m in cut.items()} == {f: m.toDebugString.split("\n", 1)[1] for f, m in uncut.items()}


def test_universes_run_side_by_side(spark, monkeypatch):
    met = threading.Barrier(2)

    def run(_, own, matrix, **paths):
        met.wait(20)
        if own["experiment_id"] == "e1_b":
            raise ValueError("too few games")
        return own["methodology"]["game_universe"]

    monkeypatch.setattr(experiment, "run_experiment", run)
    assert experiment.run_situational(spark, config(), None, {"a": 1, "c": 2}) == {"a": 1, "c": 2}
    with pytest.raises(ValueError, match="too few"):
        experiment.run_situational(spark, config(), None, {"a": 1, "b": 2})
