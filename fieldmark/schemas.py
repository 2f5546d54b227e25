"""Declared table schemas, JSON payload shapes and feature name lists."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _struct(text: str) -> T.StructType:
    """``"name type[!]"`` lines to a StructType; ``!`` marks a required column."""
    fields = []
    for line in text.strip().splitlines():
        name, kind = line.split()
        required = kind.endswith("!")
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not required))
    return T.StructType(fields)


# Column names and types of the stored tables.
GAMES = _struct(
    """
    game_id string!
    season int!
    week int!
    game_date date!
    home_team string!
    away_team string!
    home_score int
    away_score int
    home_spread_close double
    total_close double
    home_covered boolean
    season_type string!
    roof string
    surface string
    div_game boolean
    stadium string
    temp double
    wind double
    """
)

PLAYS = _struct(
    """
    play_id bigint!
    game_id string!
    season int!
    week int!
    posteam string!
    defteam string!
    play_type string!
    down int
    ydstogo int
    yardline_100 int
    yards_gained int
    epa double
    wpa double
    qb_hit boolean!
    sack boolean!
    touchdown boolean!
    interception boolean!
    fumble boolean!
    fumble_lost boolean!
    cpoe double
    air_yards double
    yards_after_catch double
    score_differential int
    game_half string
    passer_player_id string
    passer_player_name string
    rusher_player_id string
    rusher_player_name string
    receiver_player_id string
    receiver_player_name string
    penalty boolean!
    penalty_type string
    penalty_team string
    """
)

RUNS = _struct(
    """
    run_id string
    experiment_id string!
    name string!
    run_at timestamp!
    completed_at timestamp
    model_type string!
    features string
    status string
    ats_hit_rate double
    ats_record_wins bigint
    ats_record_losses bigint
    ats_record_pushes bigint
    n_games_evaluated bigint
    gate_passed boolean
    training_window_years int
    seasons_evaluated string
    folds_complete int
    folds_total int
    error_message string
    notes string
    success_criteria string
    feature_importances string
    """
)

PREDICTIONS = _struct(
    """
    run_id string
    experiment_id string!
    fold int!
    game_id string!
    season int!
    week int!
    home_team string!
    away_team string!
    home_spread_close double
    predicted_home_cover_prob double!
    predicted_side string!
    actual_home_covered boolean
    correct int
    ol_mismatch_flag int!
    """
)

DATASETS = _struct(
    """
    dataset_id string!
    name string!
    description string
    upload_date timestamp!
    file_path string
    join_key_type string
    row_count bigint
    column_count bigint
    license_tag string
    status string!
    schema_source string
    error_message string
    created_at timestamp!
    updated_at timestamp!
    """
)

DATASET_COLUMNS = _struct(
    """
    dataset_id string!
    column_name string!
    semantic_name string
    description string
    data_type string
    is_join_key boolean!
    join_key_role string
    null_rate double
    sample_values string
    created_at timestamp!
    updated_at timestamp!
    """
)

EXPERIMENT_CONFIGS = _struct(
    """
    experiment_id string!
    name string!
    description string
    created_at timestamp!
    updated_at timestamp!
    target string!
    features string!
    evaluation string!
    methodology string!
    model string!
    status string!
    gate_passed boolean
    latest_run_id string
    run_count bigint!
    """
)

FRAMEWORKS = _struct(
    """
    framework_id string!
    name string!
    description string
    created_at timestamp!
    updated_at timestamp!
    base_experiment_id string
    config_snapshot string!
    """
)

# JSON payloads stay text on disk and are parsed with these shapes on read.
FEATURE_REFS_JSON = "array<struct<dataset:string,column:string,semantic_name:string>>"
EVALUATION_JSON = "struct<metric:string,success_threshold:double,min_sample:int>"
METHODOLOGY_JSON = (
    "struct<type:string,train_seasons:int,test_seasons:int,start_season:int,end_season:int,"
    "game_universe:struct<field:string,operator:string,value:string>,"
    "random_seed:int,shuffle_labels:boolean>"
)
MODEL_JSON = "struct<type:string,hyperparams:map<string,double>>"
IMPORTANCES_JSON = "map<string,double>"

# Flags that read as false when missing.
FLAGS_DEFAULT_FALSE = [
    "qb_hit",
    "sack",
    "touchdown",
    "interception",
    "fumble",
    "fumble_lost",
    "penalty",
]

# Raw schedule column -> curated column.
RAW_GAME_NAMES = {
    "gameday": "game_date",
    "spread_line": "home_spread_close",
    "total_line": "total_close",
    "game_type": "season_type",
}

# Text that stands for a missing value in raw files.
NULL_TEXT = ["nan", "None", "NaT", "<NA>", "none", "NaN"]

# Column-name endings whose values are identifiers, kept as text.
ID_ENDINGS = ["_player_id", "_player_name", "nfl_detail_id", "jersey_number"]

# Names of the team-week rates.
OFFENCE_RATES = [
    "ol_sack_rate",
    "ol_qb_hit_rate",
    "ol_pressure_proxy_rate",
    "ol_pass_epa_per_att",
    "ol_rush_epa_per_att",
    "ol_rush_yards_per_att",
]
DEFENCE_RATES = [
    "def_sack_rate",
    "def_qb_hit_rate",
    "def_pressure_proxy_rate",
    "def_pass_epa_allowed_per_att",
    "def_rush_epa_allowed_per_att",
    "def_rush_yards_allowed_per_att",
]
BASE_RATES = OFFENCE_RATES + DEFENCE_RATES
ADDED_RATES = [
    "qb_cpoe",
    "qb_epa_under_pressure",
    "pass_explosive_rate",
    "rush_explosive_rate",
    "def_epa_per_play",
    "def_explosive_pass_allowed_rate",
    "def_explosive_rush_allowed_rate",
    "rolling_3wk_epa_trend",
]
SITUATIONAL = ["rest_days", "prior_week_margin", "season_win_pct"]
TEAM_FEATURES = BASE_RATES + ADDED_RATES + SITUATIONAL
GAME_CONTEXT = ["home_advantage", "div_game", "roof_dome", "temp", "wind"]
REST_DIFFERENTIAL = "rest_differential"

# Sample threshold, guard term and gate of the scoring rules.
MIN_SAMPLE = 20
EPS = 1e-9
GATE_HIT_RATE = 0.54
GATE_MIN_GAMES = 250


def both_sides(cols: list[str]) -> list[str]:
    return [f"{side}_{c}" for side in ("home", "away") for c in cols]


def model_columns(team_cols: list[str] | None = None) -> list[str]:
    """Ordered model inputs: home block, away block, context, rest differential."""
    return both_sides(TEAM_FEATURES if team_cols is None else team_cols) + GAME_CONTEXT + [
        REST_DIFFERENTIAL
    ]
