"""Curation steps and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.checks.register import query
from fieldmark.functions.expr import signed_spread_bucket
from fieldmark.operators import curate, quality
from fieldmark.schemas import PLAYS
from fieldmark.session import materialise
from fieldmark.sources import coerce

CHECK = "check scope value:f low:f high:f passed:b"
GAME_RANGE = (100, 200)
PLAY_RANGE = (100, 100_000_000)


def _bounds(low, high, value="value") -> str:
    ok = " AND ".join([f"{value} >= {low}"] * (low is not None) + [f"{value} <= {high}"] * (high is not None)) or "TRUE"
    num = ["CAST(NULL AS DOUBLE)" if b is None else str(b) for b in (low, high)]
    return f"{num[0]} AS low, {num[1]} AS high, COALESCE({ok}, FALSE) AS passed"


def check_sql(check: str, body: str, low=None, high=None) -> str:
    """``body`` gives scope and value."""
    return f"SELECT '{check}' AS \"check\", CAST(scope AS VARCHAR) AS scope, CAST(value AS DOUBLE) AS value, {_bounds(low, high)} FROM ({body}) AS b"


# --- curation -----------------------------------------------------------------------------

_GAME_SPEC = (
    "game_id season:i week:i game_date home_team away_team home_score:i away_score:i home_spread_close:f total_close:f "
    "home_covered:b season_type roof surface div_game:b stadium temp:f wind:f"
)
_CURATED_GAMES = """
SELECT game_id, season, week, game_date, home_team, away_team, home_score, away_score, home_spread_close, total_close,
  home_covered, 'REG' AS season_type, roof, NULL AS surface, div_game, NULL AS stadium, temp, wind
FROM v_games WHERE week <> 12
"""


@query("b1_regular_season", "game_id game_type", "SELECT game_id, game_type FROM v_raw_games WHERE game_type = 'REG'")
def _b1(v):
    return curate.regular_season(v.raw_games)


@query(
    "b2_renamed_games",
    "game_id game_date home_spread_close:f total_close:f season_type",
    "SELECT game_id, gameday AS game_date, spread_line AS home_spread_close, total_line AS total_close, game_type AS season_type FROM v_raw_games",
)
def _b2(v):
    return curate.rename_raw_games(v.raw_games)


@query("b3_declared_columns", _GAME_SPEC, _CURATED_GAMES)
def _b3(v):
    return curate.curate_games(coerce.harmonise(v.raw_games))


@query("b4_cover_label", "game_id home_covered:b", "SELECT game_id, home_covered FROM v_games")
def _b4(v):
    return curate.with_cover_label(curate.rename_raw_games(v.raw_games))


@query("b5_division_flag", "game_id div_game:b", "SELECT game_id, div_game FROM v_games WHERE week <> 12")
def _b5(v):
    return curate.curate_games(v.raw_games)


@query("b6_default_flags", "season:i sacks:i hits:i touchdowns:i n:i", """
SELECT season, COUNT(*) FILTER (WHERE COALESCE(sack, 0) <> 0) AS sacks, COUNT(*) FILTER (WHERE COALESCE(qb_hit, 0) <> 0) AS hits,
  0 AS touchdowns, COUNT(*) AS n FROM v_raw_plays GROUP BY 1""")
def _b6(v):
    return (
        curate.default_flags(v.raw_plays)
        .groupBy("season")
        .agg(
            F.count_if("sack").alias("sacks"),
            F.count_if("qb_hit").alias("hits"),
            F.count_if("touchdown").alias("touchdowns"),
            F.count("*").alias("n"),
        )
    )


@query("b7_sided_plays", "season:i week:i n:i", """
SELECT season, week, COUNT(*) AS n FROM v_raw_plays WHERE posteam IS NOT NULL AND defteam IS NOT NULL GROUP BY 1, 2""")
def _b7(v):
    return curate.drop_sideless(v.raw_plays).groupBy("season", "week").agg(F.count("*").alias("n"))


@query("b8_play_types", "play_type n:i", """
SELECT COALESCE(play_type, 'no_play') AS play_type, COUNT(*) AS n FROM v_raw_plays GROUP BY 1""")
def _b8(v):
    return curate.default_play_type(v.raw_plays).groupBy("play_type").agg(F.count("*").alias("n"))


@query("c1_plays_of_curated_games", "game_id n:i", """
SELECT p.game_id, COUNT(*) AS n FROM v_plays p JOIN v_games g ON g.game_id = p.game_id WHERE g.week <> 12 GROUP BY 1""")
def _c1(v):
    return (
        curate.in_curated_games(v.plays, v.games.where("week <> 12")).groupBy("game_id").agg(F.count("*").alias("n"))
    )


@query(
    "c1_curated_plays",
    "play_id:i game_id season:i week:i posteam defteam play_type down:i yards_gained:i epa:f qb_hit:b sack:b fumble:b cpoe:f passer_player_name rusher_player_id penalty_team",
    """SELECT play_id, game_id, season, week, posteam, defteam, COALESCE(play_type, 'no_play') AS play_type, CAST(down AS INT) AS down,
       TRY_CAST(yards_gained AS INT) AS yards_gained, epa, COALESCE(qb_hit, 0) <> 0 AS qb_hit, COALESCE(sack, 0) <> 0 AS sack,
       FALSE AS fumble, cpoe, CASE WHEN passer_player_name NOT IN ('none', 'NaN') THEN passer_player_name END AS passer_player_name,
       CAST(CAST(rusher_player_id AS BIGINT) AS VARCHAR) AS rusher_player_id, NULL AS penalty_team
       FROM v_raw_plays WHERE posteam IS NOT NULL AND defteam IS NOT NULL
         AND game_id IN (SELECT game_id FROM v_games WHERE week <> 12)""",
)
def _c1_plays(v):
    """Landed rows, as a refresh reads them, through to the declared schema."""
    games = curate.curate_games(coerce.harmonise(v.raw_games))
    landed = materialise(v.raw_plays, "landed")
    return curate.curate_plays(coerce.harmonise(landed), games)


# --- checks -------------------------------------------------------------------------------


@query("c9_orphan_plays", "game_id n:i", """
SELECT game_id, COUNT(*) AS n FROM v_plays WHERE game_id NOT IN (SELECT game_id FROM v_games) GROUP BY 1""")
def _c9(v):
    return quality.orphan_counts(v.plays, v.games)


_D26 = check_sql("plays_rows", "SELECT season AS scope, COUNT(*) AS value FROM v_plays GROUP BY 1", *PLAY_RANGE)


@query("d26_rows_per_season", CHECK, _D26)
def _d26(v):
    return quality.rows_per_season(v.plays, "plays_rows", *PLAY_RANGE)


@query("d27_null_rates", "season:i nulls:i total:i null_pct:f", """
SELECT season, COUNT(*) FILTER (WHERE epa IS NULL) AS nulls, COUNT(*) AS total,
  ROUND(100.0 * COUNT(*) FILTER (WHERE epa IS NULL) / COUNT(*), 2) AS null_pct
FROM v_plays WHERE play_type IN ('pass', 'run') GROUP BY 1""")
def _d27(v):
    return quality.null_rate_by_season(v.plays.where(F.col("play_type").isin("pass", "run")), "epa")


_ZERO = " UNION ALL ".join(
    check_sql("zero_nulls", f"SELECT '{c}' AS scope, COUNT(*) FILTER (WHERE {c} IS NULL) AS value FROM v_raw_plays", None, 0)
    for c in ("qb_hit", "sack", "play_type")
)


@query("d28_zero_nulls", CHECK, _ZERO)
def _d28(v):
    return quality.zero_null_check(v.raw_plays, ["qb_hit", "sack", "play_type"])


_BUCKET = """CASE WHEN home_spread_close <= -10 THEN 'home_dog_10+' WHEN home_spread_close <= -3 THEN 'home_dog_3-10'
  WHEN home_spread_close < 3 THEN 'pick_em' WHEN home_spread_close < 10 THEN 'home_fav_3-10' ELSE 'home_fav_10+' END"""
_PCT = "ROUND(100.0 * COUNT(*) FILTER (WHERE home_covered) / COUNT(*), 1)"


@query("b15_spread_buckets", "game_id bucket", f"SELECT game_id, {_BUCKET} AS bucket FROM v_games")
def _b15(v):
    return v.games.withColumn("bucket", signed_spread_bucket(F.col("home_spread_close")))


_COVER = (
    check_sql(
        "cover_pct",
        f"SELECT {_BUCKET} AS scope, {_PCT} AS value FROM v_games WHERE home_covered IS NOT NULL GROUP BY 1",
        45.0,
        55.0,
    )
    + " UNION ALL "
    + check_sql(
        "cover_pct_overall", f"SELECT 'all' AS scope, {_PCT} AS value FROM v_games WHERE home_covered IS NOT NULL", 46.0, 54.0
    )
)


@query("d29_cover_rates", CHECK, _COVER)
def _d29(v):
    return quality.cover_checks(v.games)


@query("d30_duplicate_keys", "order_id:i line_no:i copies:i", """
SELECT order_id, line_no, COUNT(*) AS copies FROM v_plays GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def _d30(v):
    return quality.duplicate_keys(v.plays, ["order_id", "line_no"])


@query("d31_season_range", "min_season:i max_season:i in_scope:b", """
SELECT MIN(season) AS min_season, MAX(season) AS max_season, MIN(season) >= 1995 AND MAX(season) <= 2000 AS in_scope FROM v_plays""")
def _d31(v):
    return quality.season_range(v.plays, 1995, 2000)


_VALIDATION = " UNION ALL ".join(
    [
        check_sql("games_rows", "SELECT season AS scope, COUNT(*) AS value FROM v_games GROUP BY 1", *GAME_RANGE),
        _D26,
        check_sql(
            "home_spread_close_null_pct",
            "SELECT season AS scope, ROUND(100.0 * COUNT(*) FILTER (WHERE home_spread_close IS NULL) / COUNT(*), 2) AS value FROM v_games GROUP BY 1",
            None,
            5.0,
        ),
        check_sql(
            "epa_null_pct",
            "SELECT season AS scope, ROUND(100.0 * COUNT(*) FILTER (WHERE epa IS NULL) / COUNT(*), 2) AS value FROM v_plays WHERE play_type IN ('pass', 'run') GROUP BY 1",
            None,
            5.0,
        ),
        check_sql("zero_nulls", "SELECT 'qb_hit' AS scope, COUNT(*) FILTER (WHERE qb_hit IS NULL) AS value FROM v_plays", None, 0),
        check_sql("zero_nulls", "SELECT 'sack' AS scope, COUNT(*) FILTER (WHERE sack IS NULL) AS value FROM v_plays", None, 0),
        _COVER,
        check_sql(
            "orphan_plays",
            "SELECT 'all' AS scope, COUNT(*) AS value FROM v_plays WHERE game_id NOT IN (SELECT game_id FROM v_games)",
            None,
            0,
        ),
        check_sql(
            "duplicate_game_ids",
            "SELECT 'all' AS scope, COUNT(*) AS value FROM (SELECT game_id FROM v_games GROUP BY 1 HAVING COUNT(*) > 1) d",
            None,
            0,
        ),
        check_sql("season_range", "SELECT 'all' AS scope, CAST(MIN(season) >= 1990 AND MAX(season) <= 2010 AS INT) AS value FROM v_games", 1, None),
    ]
)


def _validation(v):
    return quality.validation_checks(v.plays, v.games, PLAY_RANGE, GAME_RANGE, (1990, 2010))


@query("d32_all_checks", CHECK, _VALIDATION)
def _d32_rows(v):
    return _validation(v)


@query(
    "d32_check_summary",
    "total_checks:i passed_checks:i failed_checks:i all_passed:b",
    f"""SELECT COUNT(*) AS total_checks, COUNT(*) FILTER (WHERE passed) AS passed_checks,
        COUNT(*) FILTER (WHERE NOT passed) AS failed_checks, BOOL_AND(passed) AS all_passed FROM ({_VALIDATION}) c""",
)
def _d32(v):
    return quality.summarise(_validation(v))


@query("d33_closing_line_audit", "season:i nulls:i total:i null_pct:f passed:b", """
SELECT season, nulls, total, ROUND(100.0 * nulls / total, 2) AS null_pct, ROUND(100.0 * nulls / total, 2) <= 5 AS passed
FROM (SELECT season, COUNT(*) FILTER (WHERE temp IS NULL) AS nulls, COUNT(*) AS total FROM v_raw_games GROUP BY ROLLUP (season)) a""")
def _d33(v):
    return quality.closing_line_audit(v.raw_games, "temp")


@query("d34_value_counts", "yards_gained:i n_rows:i", """
SELECT yards_gained, COUNT(*) AS n_rows FROM v_plays GROUP BY 1 ORDER BY 1 LIMIT 20""")
def _d34(v):
    return quality.value_counts(v.plays, "yards_gained")


@query("d43_ingest_validation", "check scope level", """
SELECT 'row_count' AS "check", CAST(COUNT(*) AS VARCHAR) AS scope,
  CASE WHEN COUNT(*) < 1000 THEN 'error' WHEN COUNT(*) > 50000 THEN 'warning' ELSE 'ok' END AS level FROM v_raw_plays
UNION ALL SELECT 'required_column', c, l FROM (VALUES ('game_id', 'ok'), ('play_id', 'ok'), ('wpa', 'error')) AS t(c, l)""")
def _d43(v):
    return quality.validate_ingest(v.raw_plays, ["game_id", "play_id", "wpa"], 1000, 50_000)


@query("d44_seam_checks", CHECK, " UNION ALL ".join([
    check_sql("label_without_scores", "SELECT 'games' AS scope, COUNT(*) FILTER (WHERE home_covered IS NOT NULL AND (home_score IS NULL OR away_score IS NULL)) AS value FROM v_games", None, 0),
    check_sql("null_game_ids", "SELECT 'games' AS scope, COUNT(*) FILTER (WHERE game_id IS NULL) AS value FROM v_games", None, 0),
    check_sql("probability_out_of_range", "SELECT 'predictions' AS scope, COUNT(*) FILTER (WHERE predicted_home_cover_prob NOT BETWEEN 0 AND 1) AS value FROM v_preds", None, 0),
]))
def _d44(v):
    return quality.seam_checks(v.games, v.predictions)


@query("d45_spread_null_check", CHECK, check_sql(
    "temp_null_pct", "SELECT season AS scope, ROUND(100.0 * COUNT(*) FILTER (WHERE temp IS NULL) / COUNT(*), 2) AS value FROM v_games GROUP BY 1", None, 5.0))
def _d45(v):
    return quality.null_rate_check(v.games, "temp")


# Where the landed plays differ from the contract.
_D46 = {
    "down": ("int", "string"),
    "yards_gained": ("int", "string"),
    "qb_hit": ("boolean", "double"),
    "sack": ("boolean", "double"),
    "rusher_player_id": ("string", "double"),
}
_D46_MISSING = {
    "int": "ydstogo yardline_100 score_differential",
    "double": "wpa air_yards yards_after_catch",
    "boolean": "touchdown interception fumble fumble_lost penalty",
    "string": "game_half passer_player_id rusher_player_name receiver_player_id receiver_player_name penalty_type penalty_team",
}
_D46_ROWS = [f"('{c}', '{e}', '{a}', 'type')" for c, (e, a) in _D46.items()] + [
    f"('{c}', '{e}', NULL, 'missing')" for e, names in _D46_MISSING.items() for c in names.split()
]


@query("d46_schema_contract", "column expected actual problem season:i n:i", f"""
SELECT c AS "column", e AS expected, a AS actual, p AS problem, s.season, s.n
FROM (VALUES {", ".join(_D46_ROWS)}) AS t(c, e, a, p)
CROSS JOIN (SELECT season, COUNT(*) AS n FROM v_raw_plays GROUP BY 1) s""")
def _d46(v):
    """Every column of the raw plays that differs from the contract, with the rows per season it affects."""
    wrong = quality.schema_contract(v.spark, v.raw_plays.schema, PLAYS)
    per_season = v.raw_plays.groupBy("season").agg(F.count("*").alias("n"))
    names = [tuple(r) for r in wrong.collect()]
    listed = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(r, wrong.columns)]) for r in names])
    return per_season.select("season", "n", F.inline(listed))


@query("d47_load_guards", CHECK, " UNION ALL ".join([
    check_sql("min_plays", "SELECT 'all' AS scope, COUNT(*) AS value FROM v_plays", 10000, None),
    check_sql("min_games", "SELECT 'all' AS scope, COUNT(*) AS value FROM v_games", 2800, None),
    check_sql("spread_null_pct", "SELECT 'all' AS scope, ROUND(100.0 * COUNT(*) FILTER (WHERE home_spread_close IS NULL) / COUNT(*), 2) AS value FROM v_games", None, 5.0),
]))
def _d47(v):
    return quality.load_guards(v.plays, v.games, min_plays=10_000)


