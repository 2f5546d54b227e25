"""Readers, writers and the refresh plan on small files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.operators import quality
from fieldmark.operators.curate import curate_games
from fieldmark.operators.profile import column_profile
from fieldmark.plans.refresh import refresh
from fieldmark.schemas import GAMES, PLAYS
from fieldmark.sources import coerce, readers, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_csv_and_json_uploads(spark, tmp_path):
    (tmp_path / "u.csv").write_text("team,score,ok\nA,1.5,true\nB,,false\n")
    csv = readers.typed_text(readers.read_csv(spark, str(tmp_path / "u.csv")))
    assert rows(csv) == [("A", 1.5, True), ("B", None, False)]
    (tmp_path / "u.json").write_text(json.dumps([{"team": "A", "score": 1}, {"team": "B"}], indent=1))
    data = readers.read_json_records(spark, str(tmp_path / "u.json"), whole_file=True)
    assert rows(data.select("team", "score")) == [("A", 1), ("B", None)]
    got = {r["column_name"]: (r["data_type"], r["null_rate"]) for r in column_profile(csv).collect()}
    assert got == {"team": ("categorical", 0.0), "score": ("numeric", 0.5), "ok": ("boolean", 0.0)}


def test_harmonise_ids_and_null_text(spark):
    df = spark.createDataFrame(
        [(1234.0, 7, "nan", "x"), (None, 8, "00-1", "None")],
        "rusher_player_id double, jersey_number int, passer_player_id string, note string",
    )
    assert rows(coerce.harmonise(df)) == sorted([("1234", "7", None, "x"), (None, "8", "00-1", None)], key=repr)


def test_widen_and_conform(spark):
    df = spark.createDataFrame([(1, 2, "3.0"), (1, 3, "bad")], "season int, week int, down string").withColumn("x", F.lit(None))
    wide = coerce.widen(df)
    assert [f.dataType.simpleString() for f in wide.schema] == ["int", "double", "string", "string"]
    target = T.StructType([T.StructField("down", T.IntegerType())])
    assert [r["down"] for r in coerce.conform(df, target).orderBy("week").collect()] == [3, None]


def test_large_ids_stay_exact(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, str(big), "7.0", "x")], "a bigint, b string, c string, d string")
    target = T.StructType([T.StructField(n, T.LongType()) for n in "abcd"])
    assert tuple(coerce.conform(df, target).first()) == (big, big, 7, None)
    assert tuple(coerce.project_to(df, target).first()) == (big, big, 7, None)


def test_replacing_a_partition_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(2000, "a", 1), (2001, "b", 2)], "season int, k string, v int")
    sinks.replace_partitions(df, path, ["k"])
    new = spark.createDataFrame([(2001, "b", 9), (2001, "c", 3)], "season int, k string, v int")
    for _ in range(2):
        sinks.replace_partitions(new, path, ["k"])
        got = rows(readers.read_table(spark, path).select("season", "k", "v"))
        assert got == [(2000, "a", 1), (2001, "b", 9), (2001, "c", 3)]


def test_columns_can_be_added(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append(spark.createDataFrame([(1, "a")], "season int, k string"), path, "season")
    sinks.append(spark.createDataFrame([(2, "b", 5)], "season int, k string, extra int"), path, "season")
    assert rows(readers.read_table(spark, path, merge=True).select("season", "k", "extra")) == [(1, "a", None), (2, "b", 5)]


RAW_GAME = (
    "game_id string, season int, week int, gameday string, home_team string, away_team string, home_score string, "
    "away_score string, spread_line double, total_line double, game_type string, div_game string"
)


def raw_game(i, hs, as_, spread, kind="REG", season=2000, div="1"):
    return (f"{season}_{i:02d}_B_A", season, i, "2000-09-03", "A", "B", hs, as_, spread, 40.0, kind, div)


def test_cover_label_is_three_valued(spark):
    raw = spark.createDataFrame(
        [
            raw_game(1, "20", "10", 7.0),
            raw_game(2, "20", "15", 7.0),
            raw_game(3, "17", "10", 7.0),
            raw_game(4, "nan", "10", 7.0),
            raw_game(5, "20", "10", None),
            raw_game(6, "20", "10", 3.0, kind="POST"),
            raw_game(7, "20", "10", float("nan")),
        ],
        RAW_GAME,
    )
    games = curate_games(raw)
    assert [f.name for f in games.schema] == GAMES.names
    got = {r["week"]: r["home_covered"] for r in games.collect()}
    assert got == {1: True, 2: False, 3: None, 4: None, 5: None, 7: None}
    assert quality.schema_contract(spark, games.schema, GAMES).count() == 0


def test_refresh_twice_gives_the_same_tables(spark, tmp_path):
    paths = {k: str(tmp_path / k) for k in ("raw_games", "raw_plays", "games", "plays")}
    games = [raw_game(w, "20", "10", 3.0, season=s) for s in (2000, 2001) for w in (1, 2, 3)]
    sinks.append(spark.createDataFrame(games, RAW_GAME), paths["raw_games"], "season")
    plays = [(i, f"2000_0{1 + i % 4}_B_A", 2000, 1 + i % 4, "A" if i % 5 else None, "B", None, "1", 1.0, float(i % 2)) for i in range(40)]
    sinks.append(
        spark.createDataFrame(
            plays,
            "play_id int, game_id string, season int, week int, posteam string, defteam string, play_type string, down string, epa double, sack double",
        ),
        paths["raw_plays"],
        "season",
    )
    args = [paths["raw_games"], paths["raw_plays"], paths["games"], paths["plays"]]
    first_checks = rows(refresh(spark, *args, games_range=(1, 10), plays_range=(1, 100)))
    first = rows(spark.read.parquet(paths["plays"])), rows(spark.read.parquet(paths["games"]))
    second_checks = rows(refresh(spark, *args, games_range=(1, 10), plays_range=(1, 100)))
    second = rows(spark.read.parquet(paths["plays"])), rows(spark.read.parquet(paths["games"]))
    assert first == second and first_checks == second_checks
    stored = spark.read.parquet(paths["plays"])
    assert stored.count() == 24  # week 4 has no curated game; a fifth of the rest has no side
    assert set(stored.columns) == set(PLAYS.names)
    assert {r["play_type"] for r in stored.collect()} == {"no_play"}


def test_audit_stops_on_missing_lines(spark, tmp_path):
    raw = spark.createDataFrame([raw_game(1, "1", "2", None)], RAW_GAME)
    sinks.append(raw, str(tmp_path / "g"), "season")
    with pytest.raises(ValueError, match="closing_line_null_pct"):
        refresh(spark, str(tmp_path / "g"), "unused", str(tmp_path / "o"), "unused")


def test_season_filter_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(2000, "a"), (2001, "b")], "season int, k string"), path, ["k"])
    plan = readers.read_table(spark, path, season=2001)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
