"""Folds, scoring, evaluation, comparison, profiles and models."""

from __future__ import annotations

import json
from contextlib import suppress

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldmark.checks.q_matrix import stored
from fieldmark.checks.register import query
from fieldmark.checks.sql_views import VIEWS
from fieldmark.checks.views import RUN_WEIGHTS
from fieldmark.functions.expr import abs_spread_bucket, correct_flag, predicted_side
from fieldmark.operators import compare, folds, mismatch, models, permute, profile, scoring, versions
from fieldmark.plans import experiment, lifecycle
from fieldmark.schemas import RUNS, model_columns
from fieldmark.session import scratch_path
from fieldmark.sources.coerce import project_to
from fieldmark.sources.sinks import append

RECORD = "wins:i losses:i pushes:i n_games:i hit_rate:f"
RECORD_SQL = """COUNT(*) FILTER (WHERE correct = 1) AS wins, COUNT(*) FILTER (WHERE correct = 0) AS losses,
  COUNT(*) FILTER (WHERE correct IS NULL) AS pushes, COUNT(correct) AS n_games,
  CAST(COUNT(*) FILTER (WHERE correct = 1) AS DOUBLE) / NULLIF(COUNT(correct), 0) AS hit_rate"""
LOSS = """AVG(CASE WHEN actual_home_covered THEN -ln(LEAST(GREATEST(predicted_home_cover_prob, 1e-7), 1 - 1e-7))
  WHEN NOT actual_home_covered THEN -ln(1 - LEAST(GREATEST(predicted_home_cover_prob, 1e-7), 1 - 1e-7)) END)"""

# --- folds --------------------------------------------------------------------------------

VIEWS["v_folds"] = """
SELECT t.season - f.first - 3 AS fold, t.season AS test_season, t.season - 4 AS train_from, t.season - 1 AS train_to
FROM (SELECT DISTINCT season FROM v_games) t CROSS JOIN (SELECT MIN(season) AS first FROM v_games) f WHERE t.season >= f.first + 4
"""
VIEWS["v_roles"] = """
SELECT f.fold, CASE WHEN g.season = f.test_season THEN 'test' ELSE 'train' END AS role, g.*
FROM v_matrix g JOIN v_folds f ON g.season BETWEEN f.train_from AND f.test_season
WHERE g.season = f.test_season OR g.home_covered IS NOT NULL
"""


@query("m1_folds", "fold:i test_season:i train_from:i train_to:i", "SELECT * FROM v_folds")
def _m1(v):
    return folds.season_folds(v.games, 4)


@query("m2_fold_roles", "fold:i role season:i game_id home_covered:b", "SELECT * FROM v_roles")
def _m2(v):
    return folds.assign_roles(v.games, folds.season_folds(v.games, 4))


_STD = ["home_ol_pass_epa_per_att", "away_def_sack_rate", "home_qb_cpoe", "temp", "home_advantage"]


@query(
    "m3_standardised",
    "fold:i role game_id " + " ".join(f"{c}:f" for c in _STD),
    "SELECT r.fold, r.role, r.game_id, "
    + ", ".join(
        f"(COALESCE(r.{c}, s.m_{c}, 0) - COALESCE(s.m_{c}, 0)) / CASE WHEN s.s_{c} > 1e-12 THEN s.s_{c} ELSE 1 END AS {c}"
        for c in _STD
    )
    + " FROM v_roles r JOIN (SELECT fold, "
    + ", ".join(f"AVG({c}) AS m_{c}, sqrt(var_pop({c}) * COUNT({c}) / COUNT(*)) AS s_{c}" for c in _STD)
    + " FROM v_roles WHERE role = 'train' GROUP BY 1) s ON s.fold = r.fold",
)
def _m3(v):
    roles = folds.role_seasons(folds.season_folds(v.games, 4))
    moments = models.fold_moments(models.season_moments(stored(v), _STD), roles, _STD)
    return models.standardise(folds.with_roles(stored(v), roles), _STD, moments)


@query("m9_always_home", "game_id predicted_home_cover_prob:f baseline_predicted_side baseline_correct:i", """
SELECT game_id, 1.0 AS predicted_home_cover_prob, 'home' AS baseline_predicted_side, CAST(home_covered AS INT) AS baseline_correct FROM v_games""")
def _m9(v):
    return models.always_home(v.games)


_SCORED = """
SELECT game_id, season, week, home_team, away_team, home_spread_close, p AS predicted_home_cover_prob,
  CASE WHEN p > 0.5 THEN 'home' ELSE 'away' END AS predicted_side, home_covered AS actual_home_covered,
  CASE WHEN home_covered IS NOT NULL THEN CASE WHEN (p > 0.5) = home_covered THEN 1 ELSE 0 END END AS correct, ol_mismatch_flag, fold
FROM (SELECT r.game_id, r.season, r.week, r.home_team, r.away_team, r.home_spread_close, r.home_covered, r.fold, f.ol_mismatch_flag,
  1 / (1 + exp(-COALESCE(f.home_ol_composite - f.away_def_composite - f.away_ol_composite + f.home_def_composite, 0))) AS p
  FROM v_roles r JOIN v_flag f ON f.game_id = r.game_id WHERE r.role = 'test') s
"""
_PRED_SPEC = (
    "game_id season:i week:i home_team away_team home_spread_close:f predicted_home_cover_prob:f predicted_side "
    "actual_home_covered:b correct:i ol_mismatch_flag:i fold:i"
)


def _fixed_scores(v):
    flagged = mismatch.mismatch_flag(stored(v))
    test = folds.assign_roles(flagged, folds.season_folds(v.games, 4)).where(F.col("role") == "test")
    return scoring.score(test.withColumn("predicted_home_cover_prob", models.fixed_scorer()))


@query("m7_m18_fixed_scorer", _PRED_SPEC, _SCORED)
def _m7(v):
    return _fixed_scores(v)


VIEWS["v_scored"] = _SCORED


@query(
    "d17_fixed_scorer_folds",
    f"fold:i {RECORD} model_log_loss:f baseline_hit_rate:f",
    f"""SELECT fold, {RECORD_SQL}, {LOSS} AS model_log_loss,
        CAST(COUNT(*) FILTER (WHERE actual_home_covered) AS DOUBLE) / COUNT(actual_home_covered) AS baseline_hit_rate FROM v_scored GROUP BY 1""",
)
def _d17_fixed(v):
    return scoring.fold_metrics(_fixed_scores(v))


# --- evaluation on stored predictions -----------------------------------------------------


@query("b17_predicted_side", "run_id game_id predicted_side", "SELECT run_id, game_id, predicted_side FROM v_preds")
def _b17(v):
    return v.predictions.withColumn("predicted_side", predicted_side(F.col("predicted_home_cover_prob")))


@query("b18_correct_flag", "run_id game_id correct:i", "SELECT run_id, game_id, correct FROM v_preds")
def _b18(v):
    return v.predictions.withColumn("correct", correct_flag(F.col("predicted_side"), F.col("actual_home_covered")))


@query("b16_abs_spread_buckets", "game_id spread_bucket", """
SELECT game_id, CASE WHEN abs(home_spread_close) <= 3 THEN '<=3' WHEN abs(home_spread_close) <= 7 THEN '(3,7]'
  WHEN abs(home_spread_close) <= 10 THEN '(7,10]' ELSE '>10' END AS spread_bucket FROM v_games""")
def _b16(v):
    return v.games.withColumn("spread_bucket", abs_spread_bucket(F.col("home_spread_close")))


@query("d17_fold_record", f"run_id fold:i {RECORD}", f"SELECT run_id, fold, {RECORD_SQL} FROM v_preds GROUP BY 1, 2")
def _d17(v):
    return scoring.record(v.predictions, ["run_id", "fold"])


@query("d18_log_loss", "run_id fold:i model_log_loss:f", f"SELECT run_id, fold, {LOSS} AS model_log_loss FROM v_preds GROUP BY 1, 2")
def _d18(v):
    return scoring.fold_metrics(v.predictions, ["run_id", "fold"])


_TOTALS = """
SELECT run_id, wins AS total_wins, losses AS total_losses, pushes AS total_pushes, n_games AS total_n_games,
  hit_rate AS overall_hit_rate, b AS baseline_hit_rate, hit_rate >= 0.5 AND n_games >= 250 AS gate_passed
FROM (SELECT run_id, {record}, CAST(COUNT(*) FILTER (WHERE actual_home_covered) AS DOUBLE) / COUNT(actual_home_covered) AS b
  FROM v_preds GROUP BY 1) t
""".replace("{record}", RECORD_SQL)


@query(
    "d19_m10_totals_and_gate",
    "run_id total_wins:i total_losses:i total_pushes:i total_n_games:i overall_hit_rate:f baseline_hit_rate:f gate_passed:b",
    _TOTALS,
)
def _d19(v):
    return scoring.totals(scoring.fold_metrics(v.predictions, ["run_id", "fold"]), ["run_id"], threshold=0.5)


@query("m10_gate_on_stored_runs", "run_id seq:i gate_passed:b", """
SELECT run_id, seq, COALESCE(ats_hit_rate >= 0.54 AND n_games_evaluated >= 250, FALSE) AND notes IS NULL AS gate_passed FROM v_runs""")
def _m10(v):
    return experiment.gate_rows(v.runs)


@query("d20_baseline_record", f"season:i {RECORD}", f"""
SELECT season, {RECORD_SQL} FROM (SELECT season, CAST(home_covered AS INT) AS correct FROM v_games) g GROUP BY 1""")
def _d20(v):
    return scoring.baseline_record(v.games, ["season"])


@query("d21_season_record", f"run_id season:i {RECORD}", f"SELECT run_id, season, {RECORD_SQL} FROM v_preds GROUP BY 1, 2")
def _d21(v):
    from fieldmark.operators.serve import run_season_records

    return run_season_records(v.predictions)


@query("d22_mismatch_record", f"run_id flag_value:i {RECORD}", f"""
SELECT run_id, 1 AS flag_value, {RECORD_SQL} FROM v_preds WHERE ol_mismatch_flag = 1 GROUP BY 1""")
def _d22(v):
    return scoring.subset_record(v.predictions, 1, ["run_id"])


VIEWS["v_imp"] = """
SELECT run_id, seq, concat('home_', imp_name) AS feature, k / 128.0 AS importance FROM v_runs
UNION ALL SELECT run_id, seq, concat('away_', imp_name), (100 - k) / 128.0 FROM v_runs
"""


@query("d23_mean_importance", "feature importance:f", "SELECT feature, AVG(importance) AS importance FROM v_imp GROUP BY 1")
def _d23(v):
    return scoring.mean_importance(compare.importance_long(v.runs))


@query("f3_top_features", "feature importance:f", """
SELECT feature, AVG(importance) AS importance FROM v_imp GROUP BY 1 ORDER BY importance DESC, feature LIMIT 10""")
def _f3(v):
    return compare.top_features(scoring.mean_importance(compare.importance_long(v.runs)), 10)


@query("d24_spread_slices", "run_id spread_bucket wins:i losses:i n_games:i hit_rate:f", """
SELECT r.run_id, b.spread_bucket, COALESCE(wins, 0) AS wins, COALESCE(n_games, 0) - COALESCE(wins, 0) AS losses, COALESCE(n_games, 0) AS n_games,
  CAST(wins AS DOUBLE) / n_games AS hit_rate
FROM (SELECT DISTINCT run_id FROM v_preds) r CROSS JOIN (VALUES ('<=3'), ('(3,7]'), ('(7,10]'), ('>10')) AS b(spread_bucket)
LEFT JOIN (SELECT run_id, CASE WHEN abs(home_spread_close) <= 3 THEN '<=3' WHEN abs(home_spread_close) <= 7 THEN '(3,7]'
    WHEN abs(home_spread_close) <= 10 THEN '(7,10]' ELSE '>10' END AS spread_bucket,
  COUNT(*) FILTER (WHERE correct = 1) AS wins, COUNT(*) AS n_games FROM v_preds WHERE correct IS NOT NULL GROUP BY 1, 2) c
  ON c.run_id = r.run_id AND c.spread_bucket = b.spread_bucket""")
def _d24(v):
    return scoring.spread_slices(v.predictions, ["run_id"])


@query("d25_calibration", "bin:i bin_from:f bin_to:f n_games:i correct_rate:f actual_cover_rate:f mean_pred:f", """
SELECT bin, MIN(lo + bin * w) AS bin_from, MIN(lo + (bin + 1) * w) AS bin_to, COUNT(*) AS n_games, AVG(correct) AS correct_rate,
  AVG(CAST(actual_home_covered AS INT)) AS actual_cover_rate, AVG(p) AS mean_pred
FROM (SELECT *, CAST(LEAST(9, GREATEST(0, ceil((p - lo) / w) - 1)) AS INT) AS bin
  FROM (SELECT correct, actual_home_covered, predicted_home_cover_prob AS p, MIN(predicted_home_cover_prob) OVER () AS lo,
    (MAX(predicted_home_cover_prob) OVER () - MIN(predicted_home_cover_prob) OVER ()) / 10 AS w FROM v_preds WHERE correct IS NOT NULL) a) b
GROUP BY bin""")
def _d25(v):
    return scoring.calibration(v.predictions)


# --- profiles -----------------------------------------------------------------------------


@query("d38_side_distribution", "predicted_side n_rows:i share:f accuracy:f mean_prob:f sd_prob:f min_prob:f max_prob:f", """
SELECT predicted_side, COUNT(*) AS n_rows, COUNT(*) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM v_preds) AS share, AVG(correct) AS accuracy,
  AVG(predicted_home_cover_prob) AS mean_prob, stddev_samp(predicted_home_cover_prob) AS sd_prob,
  MIN(predicted_home_cover_prob) AS min_prob, MAX(predicted_home_cover_prob) AS max_prob FROM v_preds GROUP BY 1""")
def _d38(v):
    return profile.side_distribution(v.predictions)


@query("d39_season_comparison", "season:i model_rate:f cover_rate:f n_games:i", """
SELECT season, AVG(correct) AS model_rate, AVG(CAST(actual_home_covered AS INT)) AS cover_rate, COUNT(correct) AS n_games FROM v_preds GROUP BY 1""")
def _d39(v):
    return profile.season_comparison(v.predictions)


@query("d40_quintile_accuracy", "quintile:i n_games:i accuracy:f min_prob:f max_prob:f", """
SELECT CASE WHEN p <= e[1] THEN 1 WHEN p <= e[2] THEN 2 WHEN p <= e[3] THEN 3 WHEN p <= e[4] THEN 4 ELSE 5 END AS quintile,
  COUNT(*) AS n_games, AVG(correct) AS accuracy, MIN(p) AS min_prob, MAX(p) AS max_prob
FROM (SELECT correct, predicted_home_cover_prob AS p FROM v_preds WHERE correct IS NOT NULL) a
CROSS JOIN (SELECT quantile_cont(predicted_home_cover_prob, [0.2, 0.4, 0.6, 0.8]) AS e FROM v_preds WHERE correct IS NOT NULL) q GROUP BY 1""")
def _d40(v):
    return profile.quintile_accuracy(v.predictions)


@query("d41_b27_favourite_crosstab", "home_favoured:b home:i away:i", """
SELECT home_spread_close > 0 AS home_favoured, COUNT(*) FILTER (WHERE predicted_side = 'home') AS home,
  COUNT(*) FILTER (WHERE predicted_side = 'away') AS away FROM v_preds GROUP BY 1""")
def _d41(v):
    return profile.favourite_crosstab(v.predictions)


_EDGES = [-30, -10, -6, -3, 0, 3, 6, 10, 30]


@query("d42_cover_by_spread_bin", "spread_bin n_games:i cover_rate:f", "SELECT CASE " + " ".join(
    f"WHEN home_spread_close > {a} AND home_spread_close <= {b} THEN '({a}, {b}]'" for a, b in zip(_EDGES, _EDGES[1:])
) + """ END AS spread_bin, COUNT(*) AS n_games, AVG(CAST(home_covered AS INT)) AS cover_rate
FROM v_games WHERE home_covered IS NOT NULL GROUP BY 1""")
def _d42(v):
    return profile.cover_by_spread_bin(v.games)


@query("g3_all_predictions", "run_id fold:i game_id predicted_home_cover_prob:f", "SELECT run_id, fold, game_id, predicted_home_cover_prob FROM v_preds")
def _g3(v):
    from functools import reduce

    parts = [v.predictions.where(F.col("run_id") == f"run_p{r}") for r, _, _ in RUN_WEIGHTS]
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- comparison ---------------------------------------------------------------------------


@query("e17_ranked_importance", "run_id rank:i feature importance:f", """
SELECT run_id, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY importance DESC, feature) AS rank, feature, importance FROM v_pimp""")
def _e17(v):
    newest = compare.latest(v.prediction_runs, ["run_id"], ["run_at", "experiment_id"])
    return compare.ranked_importance(compare.importance_long(newest), ["run_id"])


_RUNS = [f"run_p{r}" for r, _, _ in RUN_WEIGHTS]
_LATEST = "(SELECT * FROM v_pruns WHERE gate_passed)"


@query(
    "m13_run_comparison",
    "metric " + " ".join(_RUNS),
    "SELECT metric, "
    + ", ".join(f"MAX(value) FILTER (WHERE run_id = '{r}') AS {r}" for r in _RUNS)
    + f""" FROM (
  SELECT run_id, 'name' AS metric, name AS value FROM {_LATEST} a
  UNION ALL SELECT run_id, 'hit_rate', CAST(ROUND(ats_hit_rate, 4) AS VARCHAR) FROM {_LATEST} b
  UNION ALL SELECT run_id, 'n_games', CAST(n_games_evaluated AS VARCHAR) FROM {_LATEST} c
  UNION ALL SELECT run_id, 'gate_passed', CAST(gate_passed AS VARCHAR) FROM {_LATEST} d
  UNION ALL SELECT run_id, concat('season_', season), CAST(ROUND(CAST(COUNT(*) FILTER (WHERE correct = 1) AS DOUBLE) / COUNT(correct), 4) AS VARCHAR)
    FROM v_preds GROUP BY run_id, season
  UNION ALL SELECT run_id, concat('top_feature_', ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY importance DESC, feature)), feature FROM v_pimp
) u GROUP BY 1""",
)
def _m13(v):
    return compare.compare_runs(v.prediction_runs, v.predictions, _RUNS)


@query("m16_diagnostics", "experiment_id folds_above:i folds:i seed_spread:f shuffled_rate:f folds_majority:b probe_clean:b", """
WITH s AS (SELECT experiment_id, training_window_years AS seed, AVG(ats_hit_rate) FILTER (WHERE notes IS NULL) AS seed_rate,
    COUNT(*) FILTER (WHERE notes IS NULL AND ats_hit_rate > 0.54) AS fa, COUNT(*) FILTER (WHERE notes IS NULL) AS f,
    AVG(ats_hit_rate) FILTER (WHERE notes IS NOT NULL) AS probe FROM v_runs WHERE status = 'complete' GROUP BY 1, 2)
SELECT experiment_id, SUM(fa) AS folds_above, SUM(f) AS folds, MAX(seed_rate) - MIN(seed_rate) AS seed_spread, MAX(probe) AS shuffled_rate,
  SUM(fa) * 2 > SUM(f) AS folds_majority, COALESCE(MAX(probe) <= 0.52, TRUE) AS probe_clean FROM s GROUP BY 1""")
def _m16(v):
    rows = v.runs.where("status = 'complete'").select(
        "experiment_id",
        F.col("training_window_years").alias("seed"),
        F.col("folds_complete").alias("fold"),
        F.col("ats_hit_rate").alias("hit_rate"),
        F.col("notes").isNotNull().alias("shuffled"),
    )
    return compare.diagnostics(rows)


@query("m12_folds_from_runs", "run_id seq:i fold:i test_season:i train_from:i train_to:i", """
SELECT run_id, seq, i - training_window_years + 1 AS fold, 1995 + i AS test_season, 1995 + i - training_window_years AS train_from, 1994 + i AS train_to
FROM v_runs CROSS JOIN (SELECT unnest(range(1, 7)) AS i) t WHERE i >= training_window_years""")
def _m12(v):
    """Folds of each stored run from its training window and the seasons it evaluated."""
    meta = v.runs.select(
        "run_id",
        "seq",
        F.to_json(F.sequence(1995 + F.col("training_window_years"), F.lit(2001))).alias("seasons_evaluated"),
        F.col("training_window_years").alias("train_seasons"),
    )
    seasons = F.from_json("seasons_evaluated", "array<int>")
    ranges = meta.select(
        "run_id",
        "seq",
        "train_seasons",
        (F.array_min(seasons) - F.col("train_seasons")).alias("start_season"),
        F.array_max(seasons).alias("end_season"),
    )
    return folds.folds_from_ranges(ranges)


# --- permutations and fits: properties only -----------------------------------------------


@query("e15_shuffled_labels", "season:i n:i covers:i pushes:i moved:b repeats:b", """
SELECT season, COUNT(*) AS n, COUNT(*) FILTER (WHERE home_covered) AS covers, COUNT(*) FILTER (WHERE home_covered IS NULL) AS pushes,
  TRUE AS moved, TRUE AS repeats FROM v_games GROUP BY 1""")
def _e15(v):
    """A permutation keeps the labels of each season, moves them, and comes out the same again."""
    label = F.col("home_covered")
    named = [df.select("game_id", label.alias(c)) for df, c in ((v.games, "was"), (permute.shuffle_labels(v.games, 7), "again"))]
    joined = permute.shuffle_labels(v.games, 7).join(named[0], "game_id").join(named[1], "game_id")
    return joined.groupBy("season").agg(
        F.count("*").alias("n"),
        F.count_if(label).alias("covers"),
        F.count_if(label.isNull()).alias("pushes"),
        F.max(~label.eqNullSafe(F.col("was"))).alias("moved"),
        F.min(label.eqNullSafe(F.col("again"))).alias("repeats"),
    )


@query("e16_permuted_feature", "season:i n:i total:f moved:b repeats:b", """
SELECT season, COUNT(*) AS n, SUM(home_spread_close) AS total, TRUE AS moved, TRUE AS repeats FROM v_games GROUP BY 1""")
def _e16(v):
    def permuted():
        return permute.permute_column(v.games, "home_spread_close", ["season"], ["game_id"], 11)

    value = F.col("home_spread_close")
    joined = permuted().join(v.games.select("game_id", value.alias("was")), "game_id")
    joined = joined.join(permuted().select("game_id", value.alias("again")), "game_id")
    return joined.groupBy("season").agg(
        F.count("*").alias("n"),
        F.sum(value).alias("total"),
        F.max(~value.eqNullSafe(F.col("was"))).alias("moved"),
        F.min(value.eqNullSafe(F.col("again"))).alias("repeats"),
    )


COLUMNS_SQL = "(VALUES " + ", ".join(f"('{c}')" for c in model_columns()) + ") AS t(feature)"
_stored_runs: dict = {}


def _config(v, **method) -> dict:
    seasons = v.games.agg(F.min("season"), F.max("season")).first()
    base = experiment.default_config(seasons[0], seasons[1], 4)
    return {**base, "methodology": {**base["methodology"], **method}}


def _full_run(v):
    """The standalone run with its declared settings, written once and shared by the queries that describe it."""
    key = (v.spark.sparkContext.applicationId, v.dir)
    if key not in _stored_runs:
        runs, preds = scratch_path(v.spark, "runs"), scratch_path(v.spark, "predictions")
        _stored_runs[key] = experiment.run_experiment(v.spark, _config(v), stored(v), runs, preds), runs, preds
    return _stored_runs[key]


@query("m4_m5_m8_walk_forward", "fold:i n:i n_games:i pushes:i in_range:b", """
SELECT fold, COUNT(*) AS n, COUNT(correct) AS n_games, COUNT(*) FILTER (WHERE correct IS NULL) AS pushes, TRUE AS in_range
FROM v_preds WHERE run_id = 'run_p1' GROUP BY 1""")
def _m8(v):
    """Fitted probabilities are checked by property: every test game once, in [0, 1]."""
    p = F.col("predicted_home_cover_prob")
    return _full_run(v)[0].predictions.groupBy("fold").agg(
        F.count("*").alias("n"),
        F.count("correct").alias("n_games"),
        F.count_if(F.col("correct").isNull()).alias("pushes"),
        F.min(p.between(0, 1)).alias("in_range"),
    )


@query("m6_importance", "feature not_negative:b total:f", f"SELECT feature, TRUE AS not_negative, 1.0 AS total FROM {COLUMNS_SQL} WHERE EXISTS (SELECT 1 FROM v_games)")
def _m6(v):
    """A row per model column, and all importances together are 1."""
    found = _full_run(v)[0].importance
    total = found.agg(F.sum("importance").alias("total"))
    return found.withColumn("not_negative", F.col("importance") >= 0).withColumn("total", total.scalar())


@query("m11_permutation_importance", "feature base_is_hit_rate:b drop_is_difference:b", f"""
SELECT feature, TRUE AS base_is_hit_rate, TRUE AS drop_is_difference FROM {COLUMNS_SQL} WHERE EXISTS (SELECT 1 FROM v_games)""")
def _m11(v):
    """A row per model column: the baseline is the run's hit rate, the drop its difference to the permuted one."""
    run, runs, _ = _full_run(v)
    rate = v.spark.read.parquet(runs).select("ats_hit_rate").scalar()
    found = experiment.permutation_importance(run, model_columns())
    return found.select(
        "feature",
        (F.abs(F.col("baseline_hr") - rate) < 1e-9).alias("base_is_hit_rate"),
        (F.abs(F.col("baseline_hr") - F.col("permuted_hr") - F.col("hr_drop")) < 1e-9).alias("drop_is_difference"),
    )


@query("m14_configured_run", "experiment_id status games:i predictions:i folds_complete:i folds_total:i features:i", f"""
SELECT 'default' AS experiment_id, 'complete' AS status, COUNT(correct) AS games, COUNT(*) AS predictions,
  COUNT(DISTINCT fold) AS folds_complete, COUNT(DISTINCT fold) AS folds_total, {len(model_columns())} AS features
FROM v_preds WHERE run_id = 'run_p1'""")
def _m14(v):
    """A run written and read back: one run row, one prediction per test game."""
    _, runs, preds = _full_run(v)
    counts = v.spark.read.parquet(preds).groupBy("experiment_id").agg(F.count("*").alias("predictions"))
    return v.spark.read.parquet(runs).select(
        "experiment_id",
        "status",
        F.col("n_games_evaluated").alias("games"),
        "folds_complete",
        "folds_total",
        F.size(F.from_json("features", "array<string>")).alias("features"),
    ).join(counts, "experiment_id")


def _small(v, **changes) -> dict:
    """The declared run with few trees: what is checked around it does not depend on the fit."""
    trees = {"type": "ol_xgb_v2", "hyperparams": {"n_estimators": 3, "max_depth": 2}}
    return {**_config(v), "model": trees, "target": "home_covered", **changes}


def _stored_configs(v, path: str, configs: list[dict]) -> None:
    """The versions that the events make of their users' configs, then the given configs as drafts."""
    made = v.config_log.withColumns({"created_at": F.col("updated_at"), "run_count": F.lit(0)})
    made = made.withColumn("based_on", F.lag("seq").over(Window.partitionBy("experiment_id").orderBy("seq")))
    rows = project_to(made, lifecycle.CONFIG_LOG).drop("writer")
    append(rows, f"{path}/writer=events")
    text = [{k: json.dumps(x) if k in lifecycle.SHAPES else x for k, x in c.items()} for c in configs]
    lifecycle.add_configs(v.spark, path, v.spark.createDataFrame(text))


_UNKNOWN = [{"dataset": "curated", "column": "mystery_metric", "semantic_name": "mystery_metric"}]
_SMALL_GUARDS = {"min_plays": 1, "min_games": 1, "max_null_pct": 100.0}


@query("m14_config_lifecycle", "experiment_id status versions:i run_count:i runs:i predictions:i", """
SELECT c.experiment_id, arg_max(c.status, c.seq) AS status, COUNT(*) AS versions, 0 AS run_count, 0 AS runs, 0 AS predictions FROM v_cfg_log c GROUP BY 1
UNION ALL SELECT 'sound', 'complete', 3, 1, 1, COUNT(*) FROM v_preds WHERE run_id = 'run_p1'
UNION ALL SELECT 'unknown_feature', 'failed', 3, 1, 1, 0 UNION ALL SELECT 'half_loaded', 'failed', 3, 1, 1, 0""")
def _m14_lifecycle(v):
    """Every config of the log as it stands after three of them have been run from it."""
    log, runs, preds = (scratch_path(v.spark, n) for n in ("configs", "runs", "predictions"))
    names = {"sound": {}, "unknown_feature": {"features": _UNKNOWN}, "half_loaded": {}}
    _stored_configs(v, log, [_small(v, experiment_id=n, name=n, **more) for n, more in names.items()])
    for name in names:
        guards = {**_SMALL_GUARDS, "min_games": 10**12 if name == "half_loaded" else 1}
        with suppress(ValueError):
            lifecycle.run_config(v.spark, log, name, v.plays, v.games, stored(v), runs, preds, guards=guards)
    stand = lifecycle.config_log(v.spark, log)
    versions = stand.groupBy("experiment_id").agg(F.count("*").alias("versions"))
    done = v.spark.read.schema(RUNS).parquet(runs).groupBy("experiment_id").agg(F.count("*").alias("runs"))
    found = v.spark.read.parquet(preds).groupBy("experiment_id").agg(F.count("*").alias("predictions"))
    own = lifecycle.heads(stand, "experiment_id").select("experiment_id", "status", "run_count")
    return own.join(versions, "experiment_id").join(done, "experiment_id", "left").join(found, "experiment_id", "left").fillna(0)


@query("m17_refresh_production", "experiment_id status run_count:i error_kept:b games:i", """
SELECT 'first' AS experiment_id, 'complete' AS status, 1 AS run_count, FALSE AS error_kept, COUNT(correct) AS games FROM v_preds WHERE run_id = 'run_p1'
UNION ALL SELECT 'second', 'complete', 1, FALSE, COUNT(correct) FROM v_preds WHERE run_id = 'run_p1'
UNION ALL SELECT 'broken', 'failed', 1, TRUE, NULL""")
def _m17_refresh(v):
    """A refresh of all configs that passed their gate: one of them fails, and the others run on."""
    log, runs, preds = (scratch_path(v.spark, n) for n in ("configs", "runs", "predictions"))
    configs = [_small(v, experiment_id=n, name=n) for n in ("first", "second")]
    configs.append(_small(v, experiment_id="broken", name="broken", features=_UNKNOWN))
    text = [{k: json.dumps(x) if k in lifecycle.SHAPES else x for k, x in c.items()} for c in configs]
    lifecycle.add_configs(v.spark, log, v.spark.createDataFrame(text))
    for c in configs:
        own = lifecycle.load_config(v.spark, log, c["experiment_id"])
        lifecycle.next_version(v.spark, log, own, status="complete", gate_passed=True)
    lifecycle.refresh_production(v.spark, log, v.plays, v.games, stored(v), runs, preds, _SMALL_GUARDS)
    done = v.spark.read.schema(RUNS).parquet(runs)
    done = done.select("experiment_id", F.col("n_games_evaluated").alias("games"), F.col("error_message").isNotNull().alias("error_kept"))
    own = lifecycle.heads(lifecycle.config_log(v.spark, log), "experiment_id")
    return own.select("experiment_id", "status", "run_count").join(done, "experiment_id")


@query("r2_rejected_versions", "experiment_id seq:i based_on:i accepted:b", """
SELECT experiment_id, seq, based_on, rank = 1 AS accepted FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment_id, based_on ORDER BY updated_at, seq) AS rank FROM (
    SELECT experiment_id, seq, updated_at, CASE WHEN seq % 5 = 0 THEN LAG(seq, 2) OVER w ELSE LAG(seq) OVER w END AS based_on
    FROM v_cfg_log WINDOW w AS (PARTITION BY experiment_id ORDER BY seq)) s) r""")
def _r2_rejected(v):
    """Every version of the log, and whether it stands; every fifth was made from a version older than the newest."""
    w = Window.partitionBy("experiment_id").orderBy("seq")
    on = F.when(F.col("seq") % 5 == 0, F.lag("seq", 2).over(w)).otherwise(F.lag("seq").over(w))
    log = v.config_log.withColumns({"based_on": on, "writer": F.lpad(F.col("seq").cast("string"), 20, "0")})
    return versions.judged(log, "experiment_id")


@query("m15_situational_runs", "experiment_id status games:i", """
SELECT 'default_late' AS experiment_id, 'complete' AS status, COUNT(correct) AS games FROM v_preds WHERE run_id = 'run_p1' AND week >= 6
UNION ALL SELECT 'default_same_region', 'complete', COUNT(correct) FROM v_preds p JOIN v_games g USING (game_id) WHERE p.run_id = 'run_p1' AND g.div_game""")
def _m15(v):
    universes = {
        "late": {"field": "week", "operator": "gte", "value": "6"},
        "same_region": {"field": "div_game", "operator": "eq", "value": "true"},
    }
    runs, preds = scratch_path(v.spark, "runs"), scratch_path(v.spark, "predictions")
    config = _config(v, min_universe=50)
    experiment.run_situational(v.spark, config, stored(v), universes, runs_path=runs, predictions_path=preds)
    return v.spark.read.parquet(runs).select("experiment_id", "status", F.col("n_games_evaluated").alias("games"))


@query("m17_refresh_selection", "experiment_id status gate_passed:b", """
SELECT experiment_id, status, gate_passed FROM v_cfg WHERE gate_passed AND status <> 'running'""")
def _m17(v):
    from fieldmark.operators.registry import refresh_candidates

    return refresh_candidates(v.configs).orderBy(F.desc("updated_at"), "experiment_id")


@query("m19_standalone_run", "ol_mismatch_flag:i games:i pushes:i", """
SELECT f.ol_mismatch_flag, COUNT(p.correct) AS games, COUNT(*) FILTER (WHERE p.correct IS NULL) AS pushes
FROM v_preds p JOIN v_flag f USING (game_id) WHERE p.run_id = 'run_p1' GROUP BY 1""")
def _m19(v):
    """All model columns with mismatch flags, as the first standalone run has them."""
    flagged = mismatch.mismatch_flag(stored(v))
    run = experiment.walk_forward(flagged, folds.season_folds(v.games, 4), model_columns(), model="ol_xgb_v1")
    found = scoring.record(run.predictions, ["ol_mismatch_flag"])
    return found.select("ol_mismatch_flag", (F.col("wins") + F.col("losses")).alias("games"), "pushes")
