"""Hand-made frames for the feature rules that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import matrix, situational, team_week
from fieldmark.schemas import ADDED_RATES, BASE_RATES

PLAY = (
    "posteam string, defteam string, season int, week int, play_type string, down int, sack int, qb_hit int, "
    "epa double, yards_gained int, cpoe double"
)


def play(off="A", dfn="B", season=2000, week=1, kind="pass", down=1, sack=0, hit=0, epa=0.5, yards=5, cpoe=None):
    return (off, dfn, season, week, kind, down, sack, hit, epa, yards, cpoe)


def features(spark, rows):
    df = team_week.team_features(spark.createDataFrame(rows, PLAY))
    return {(r["team"], r["season"], r["week"]): r for r in df.collect()}


def test_current_week_is_excluded_and_bye_is_a_missing_row(spark):
    rows = [play(week=1, epa=1.0), play(week=2, epa=3.0), play(week=4, epa=100.0)]
    out = features(spark, rows)
    assert out[("A", 2000, 2)]["ol_pass_epa_per_att"] == pytest.approx(1.0)
    assert out[("A", 2000, 4)]["ol_pass_epa_per_att"] == pytest.approx(2.0)
    assert out[("A", 2000, 4)]["rolling_3wk_epa_trend"] == pytest.approx(2.0)


def test_zero_denominator_gives_zero_and_only_week_one_is_filled(spark):
    out = features(spark, [play(week=2), play(week=3)])
    first = out[("A", 2000, 2)]
    assert first["ol_sack_rate"] == 0.0
    assert first["qb_cpoe"] is None
    assert first["rolling_3wk_epa_trend"] is None


def test_week_one_takes_last_season_else_league_mean(spark):
    rows = [
        play(season=2000, week=1, epa=2.0),
        play("C", "D", season=2000, week=1, epa=4.0),
        play(season=2001, week=1, epa=9.0),
        play("E", "B", season=2001, week=1, epa=9.0),
    ]
    out = features(spark, rows)
    assert out[("A", 2001, 1)]["ol_pass_epa_per_att"] == pytest.approx(2.0)
    # unweighted mean over the four teams of the earliest season (two have no offence: 0)
    assert out[("E", 2001, 1)]["ol_pass_epa_per_att"] == pytest.approx(6.0 / 4)
    assert out[("A", 2000, 1)]["ol_pass_epa_per_att"] == pytest.approx(6.0 / 4)


def test_a_gap_season_is_not_a_prior_season(spark):
    rows = [play(season=2000, epa=2.0), play(season=2002, epa=5.0)]
    out = features(spark, rows)
    assert out[("A", 2002, 1)]["ol_pass_epa_per_att"] == pytest.approx(1.0)  # league mean (2 + 0) / 2


def test_missing_epa_counts_as_attempt_but_not_in_the_additional_counts(spark):
    stats = team_week.team_week_stats(
        spark.createDataFrame([play(epa=None, yards=25), play(epa=1.0, hit=1), play(kind="no_play", epa=7.0)], PLAY)
    )
    row = stats.where("team = 'A'").first()
    assert (row["pass_att"], row["pass_att_v2"], row["pass_explosive_count"]) == (2, 1, 1)
    assert (row["pressure_play_count"], row["pressure_epa_sum"]) == (1, 1.0)
    defence = stats.where("team = 'B'").first()
    assert (defence["def_total_play_count"], defence["def_total_epa_sum"]) == (2, 8.0)


def test_spine_needs_a_pass_or_run_play(spark):
    rows = [play(kind="no_play"), play("C", "D", down=None)]
    df = spark.createDataFrame(rows, PLAY)
    assert {r["team"] for r in team_week.team_week_stats(df).collect()} == {"C", "D"}
    assert {r["team"] for r in team_week.spine(df).collect()} == {"C", "D"}


def test_no_look_ahead(spark):
    """Changing week 3 leaves every feature of weeks up to 3 as it was."""
    base = [play(week=w, epa=float(w), yards=w * 5) for w in (1, 2, 3, 4)] + [play("B", "A", week=w) for w in (1, 2, 3)]
    early = [play(season=1999, week=1, epa=0.25), play("B", "A", season=1999, week=1, epa=0.75)]
    changed = [r if r[3] != 3 else play(r[0], r[1], week=3, epa=-50.0, yards=90, sack=1) for r in base]
    rates = BASE_RATES + ADDED_RATES
    before, after = features(spark, early + base), features(spark, early + changed)
    for key, row in before.items():
        if key[2] <= 3:
            assert [row[c] for c in rates] == [after[key][c] for c in rates], key
    assert before[("A", 2000, 4)]["ol_sack_rate"] != after[("A", 2000, 4)]["ol_sack_rate"]


GAME = (
    "game_id string, season int, week int, game_date string, home_team string, away_team string, home_score int, "
    "away_score int, home_spread_close double, home_covered boolean, roof string, div_game boolean, temp double, wind double"
)


def game(week, day, home="A", away="B", hs=20, as_=10, roof=None, temp=None, wind=None):
    return (f"2000_{week:02d}_{away}_{home}", 2000, week, day, home, away, hs, as_, 3.0, True, roof, None, temp, wind)


def test_rest_and_form(spark):
    games = spark.createDataFrame(
        [
            game(1, "2000-09-03"),
            game(2, "2000-09-05", hs=None, as_=None),
            game(3, "2000-09-20", hs=14, as_=14),
            game(4, "2000-12-01"),
        ],
        GAME,
    )
    rows = {
        r["week"]: (r["rest_days"], r["prior_week_margin"], r["season_win_pct"])
        for r in situational.situational_features(games).where("team = 'A'").collect()
    }
    assert rows == {1: (14, 0, 0.5), 2: (3, 10, 1.0), 3: (15, 0, 1.0), 4: (21, 0, 1.0)}


def test_weather_defaults(spark):
    games = spark.createDataFrame(
        [
            game(1, "2000-09-03", roof="dome", temp=10.0, wind=9.0),
            game(2, "2000-09-10", roof="outdoors", temp=40.0),
            game(3, "2000-09-17", roof="outdoors"),
        ],
        GAME,
    )
    rows = {r["week"]: (r["temp"], r["wind"], r["roof_dome"], r["div_game"]) for r in matrix.add_context(games).collect()}
    assert rows == {1: (70.0, 0.0, 1, 0), 2: (40.0, 0.0, 0, 0), 3: (55.0, 0.0, 0, 0)}
    early = matrix.add_context(games.withColumn("season", F.col("week")), as_of=1).where("week = 3").first()
    assert early["temp"] == 70.0


def test_repeated_user_keys_are_refused(spark):
    games = spark.createDataFrame([game(1, "2000-09-03")], GAME)
    user = spark.createDataFrame([("2000_01_B_A", "1"), ("2000_01_B_A", "2")], "game_id string, x string")
    with pytest.raises(ValueError, match="repeat"):
        matrix.join_user(games, user, ["x"], "game_id")
    with pytest.raises(ValueError, match="player_season_week"):
        matrix.join_user(games, user, ["x"], "player_season_week")
