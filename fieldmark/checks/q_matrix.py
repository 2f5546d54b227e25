"""Game matrix, user datasets and the mismatch flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.checks.register import query
from fieldmark.checks.sql_views import Z_INPUTS
from fieldmark.operators import folds, matrix, mismatch, situational, team_week
from fieldmark.plans.experiment import experiment_matrix
from fieldmark.plans import features
from fieldmark.session import materialise, scratch_path
from fieldmark.schemas import PLAYS, SITUATIONAL, TEAM_FEATURES, both_sides, model_columns
from fieldmark.sources.coerce import project_to
from fieldmark.sources.readers import feature_games, feature_plays
from fieldmark.sources.sinks import replace_partitions


def build(v):
    return matrix.build_matrix(feature_plays(v.plays), feature_games(v.games))


def stored(v):
    """The matrix as experiments use it: built once, read back by every later step."""
    return experiment_matrix(feature_plays(v.plays), feature_games(v.games))


def _floats(cols) -> str:
    return " ".join(f"{c}:f" for c in cols)


@query("c4_merged_families", "team season:i week:i " + _floats(TEAM_FEATURES), "SELECT * FROM v_team")
def _c4(v):
    return matrix.merge_families(team_week.team_features(v.plays), situational.situational_features(v.games))


@query("c5_game_matrix", "game_id season:i week:i home_covered:b " + _floats(model_columns()), "SELECT * FROM v_matrix")
def _c5(v):
    return build(v)


@query("c5_matrix_of_bucketed_features", "game_id season:i week:i home_covered:b " + _floats(model_columns()), "SELECT * FROM v_matrix")
def _c5_bucketed(v):
    """Plays to sums, sums to bucketed team features, features to games."""
    plays, sums = scratch_path(v.spark, "plays"), scratch_path(v.spark, "sums")
    stored_plays = project_to(v.plays, PLAYS)
    replace_partitions(stored_plays, plays, ["game_id"])
    features.replace_sums(v.spark, plays, sums, [r["season"] for r in stored_plays.select("season").distinct().collect()])
    return features.matrix_from_sums(v.spark, sums, feature_games(v.games))


@query(
    "b19_b26_context",
    "game_id home_advantage:i div_game:i roof_dome:i temp:f wind:f",
    "SELECT * FROM v_matrix",
)
def _b19(v):
    return matrix.add_context(v.games)


@query("b25_rest_differential", "game_id rest_differential:f", "SELECT game_id, rest_differential FROM v_matrix")
def _b25(v):
    sit = situational.situational_features(v.games)
    spine = team_week.spine(v.plays)
    known = sit.join(spine, ["team", "season", "week"], "left_semi")
    return situational.add_rest_differential(matrix.attach_sides(v.games, known, SITUATIONAL))


@query(
    "d16_median_temperature",
    "median_temp:f",
    "SELECT quantile_cont(temp0, 0.5) AS median_temp FROM v_indoor",
)
def _d16(v):
    indoor = F.coalesce(F.col("roof").isin(matrix.INDOOR_ROOFS), F.lit(False))
    return matrix.median_temperature(
        v.games.withColumn("temp", F.when(indoor, F.lit(matrix.INDOOR_TEMP)).otherwise(F.col("temp")))
    )


def _null_any(side: str) -> str:
    return " OR ".join(f"{side}_{c} IS NULL" for c in TEAM_FEATURES)


@query(
    "c16_join_gaps",
    "home_gaps:i away_gaps:i n_games:i",
    f"""SELECT COUNT(*) FILTER (WHERE {_null_any('home')}) AS home_gaps,
        COUNT(*) FILTER (WHERE {_null_any('away')}) AS away_gaps, COUNT(*) AS n_games FROM v_matrix""",
)
def _c16(v):
    return matrix.join_gaps(build(v), TEAM_FEATURES)


@query(
    "c6_user_games",
    "game_id crowd:f",
    "SELECT g.game_id, COALESCE(CAST(u.crowd AS DOUBLE), 0) AS crowd FROM v_games g LEFT JOIN v_user_games u USING (game_id)",
)
def _c6(v):
    return matrix.join_user(v.games, v.user_games, ["crowd"], "game_id")


@query(
    "c7_user_team_weeks",
    "game_id home_travel:f away_travel:f",
    """SELECT g.game_id, COALESCE(h.travel, 0) AS home_travel, COALESCE(a.travel, 0) AS away_travel FROM v_games g
       LEFT JOIN v_user_team_weeks h ON h.team_name = g.home_team AND h.year = g.season AND h.week_number = g.week
       LEFT JOIN v_user_team_weeks a ON a.team_name = g.away_team AND a.year = g.season AND a.week_number = g.week""",
)
def _c7(v):
    keys = {"team": "team_name", "season": "year", "week": "week_number"}
    return matrix.join_user(v.games, v.user_team_weeks, ["travel"], "team_season_week", keys)


@query("g6_pooled_sides", "season:i week:i " + _floats(Z_INPUTS), "SELECT * FROM v_pool")
def _g6(v):
    return mismatch.pool_sides(stored(v), Z_INPUTS)


_Z = [f"{s}_{c}_z" for s in ("home", "away") for c in Z_INPUTS]


@query(
    "e8_expanding_zscores",
    "game_id " + _floats(_Z),
    "SELECT h.game_id, "
    + ", ".join([f"h.{c}_z AS home_{c}_z" for c in Z_INPUTS] + [f"a.{c}_z AS away_{c}_z" for c in Z_INPUTS])
    + " FROM v_z h JOIN v_z a ON h.game_id = a.game_id AND h.side = 'home' AND a.side = 'away'",
)
def _e8(v):
    return mismatch.expanding_zscores(stored(v), Z_INPUTS)


_COMPOSITES = "home_ol_composite:f away_ol_composite:f home_def_composite:f away_def_composite:f"


@query("e10_composites", f"game_id {_COMPOSITES}", "SELECT * FROM v_flag")
def _e10(v):
    return mismatch.composites(stored(v))


@query("e9_quartile_cutoffs", "season:i week:i off_p75:f off_n:i def_p25:f def_n:i", "SELECT * FROM v_cut")
def _e9(v):
    return mismatch.expanding_cutoffs(materialise(mismatch.composites(stored(v)), "composites"))


@query("e9_mismatch_flag", f"game_id season:i week:i ol_mismatch_flag:i {_COMPOSITES}", "SELECT * FROM v_flag")
def _e9_flag(v):
    return mismatch.mismatch_flag(stored(v))


@query(
    "b12_universe",
    "game_id season:i week:i div_game:i",
    "SELECT game_id, season, week, div_game FROM v_matrix WHERE week >= 10 AND div_game <> 1",
)
def _b12(v):
    games = matrix.add_context(v.games)
    late = games.where(folds.universe_condition("week", "gte", "10"))
    return late.where(folds.universe_condition("div_game", "ne", "true"))
