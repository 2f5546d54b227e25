"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose the
data and the cores, ``BENCH_TREES`` (default 300, the full setting) the size of the fit. Each query runs once to warm up and is timed on its second run; writing
to the no-op sink runs the whole plan without collecting rows.
"""

from __future__ import annotations

import json
import os
import time

from fieldmark.checks import all_queries
from fieldmark.checks.views import views
from fieldmark.operators import folds
from fieldmark.plans import experiment
from fieldmark.schemas import model_columns
from fieldmark.session import build_session

HEADLINE = [
    "e11_team_rating",
    "c1_curated_plays",
    "b3_declared_columns",
    "d33_closing_line_audit",
    "d32_all_checks",
    "c2_base_stats_on_spine",
    "e18_cold_start_features",
    "e7_form",
    "c5_game_matrix",
    "e9_mismatch_flag",
    "d17_fixed_scorer_folds",
    "d25_calibration",
    "d40_quintile_accuracy",
    "m13_run_comparison",
    "c17_game_detail",
    "c15_reference_errors",
    "r3_completed_configs",
    "a11_replaced_partition",
]


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def run_all(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def full_experiment(spark, sf_dir: str, trees: int) -> None:
    """Plays to scored folds: features, matrix, every model column, fit, score, totals."""
    v = views(spark, sf_dir)
    matrix = experiment.experiment_matrix(v.plays, v.games)
    result = experiment.walk_forward(
        matrix, folds.season_folds(matrix, 4), model_columns(), hyperparams={"n_estimators": trees}
    )
    run_all(result.totals)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    trees = int(os.environ.get("BENCH_TREES", "300"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    seconds = {}
    for name in HEADLINE:
        run_all(queries[name](spark, sf_dir))
        seconds[name] = timed(lambda name=name: run_all(queries[name](spark, sf_dir)))
    seconds[f"experiment_{trees}_trees"] = timed(lambda: full_experiment(spark, sf_dir, trees))
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
