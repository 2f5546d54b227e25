"""Sums kept per season and features kept in buckets: what is read, replaced and exchanged."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import matrix, team_week
from fieldmark.plans import features
from fieldmark.plans.refresh import refresh
from fieldmark.schemas import PLAYS
from fieldmark.sources.coerce import project_to
from fieldmark.sources.sinks import append, replace_partitions
from tests.test_tables import RAW_GAME, raw_game

PLAY = "play_id long, game_id string, season int, week int, posteam string, defteam string, play_type string, down int, sack int, qb_hit int, epa double, yards_gained int, cpoe double"


def plays_of(spark, season, n=300, seed=0):
    rng = random.Random(1000 * season + seed)
    some = lambda x, p=0.1: None if rng.random() < p else x
    made = [
        (
            i, "g", season, rng.randint(1, 4), some(rng.choice("ABCD")), some(rng.choice("EFGA")), some(rng.choice(["pass", "run", "punt"])),
            some(rng.randint(1, 4)), some(rng.randint(0, 1)), some(rng.randint(0, 1)), some(rng.randint(-9, 9) / 4, 0.3), some(rng.randint(-5, 40)), some(rng.randint(-8, 8) / 8, 0.5),
        )
        for i in range(n)
    ]
    return project_to(spark.createDataFrame(made, PLAY), PLAYS)


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_sums_of_one_season_read_no_other(spark, tmp_path):
    plays, sums = str(tmp_path / "plays"), str(tmp_path / "sums")
    parts = {s: plays_of(spark, s) for s in (2000, 2001, 2002)}
    replace_partitions(parts[2000].union(parts[2001]).union(parts[2002]), plays, ["game_id"])
    features.replace_sums(spark, plays, sums, [2000, 2001, 2002])
    # quarters and eighths add up exactly in any order
    assert rows(features.stats_from_sums(spark, sums)) == rows(team_week.team_week_stats(spark.read.parquet(plays)))
    changed = plays_of(spark, 2001, 200, seed=1)
    replace_partitions(changed, plays, ["game_id"])
    for season in (2000, 2002):
        for path in glob.glob(f"{plays}/season={season}/*.parquet"):
            with open(path, "wb") as f:
                f.write(b"not a table")
    with pytest.raises(Exception):
        spark.read.schema(PLAYS).parquet(plays).agg(F.sum("epa")).collect()
    features.replace_sums(spark, plays, sums, [2001])
    whole = parts[2000].union(changed).union(parts[2002])
    assert rows(features.stats_from_sums(spark, sums)) == rows(team_week.team_week_stats(whole))
    assert {r["season"] for r in features.read_sums(spark, sums, season=2001).collect()} == {2001}


def test_a_season_without_plays_is_emptied(spark, tmp_path):
    plays, sums = str(tmp_path / "plays"), str(tmp_path / "sums")
    replace_partitions(plays_of(spark, 2000).union(plays_of(spark, 2001)), plays, ["game_id"])
    features.replace_sums(spark, plays, sums, [2000, 2001])
    replace_partitions(plays_of(spark, 2001).withColumn("play_type", F.lit("punt")).withColumn("down", F.lit(None).cast("int")), plays, ["game_id"])
    features.replace_sums(spark, plays, sums, [2001])
    assert {r["season"] for r in features.stats_from_sums(spark, sums).select("season").distinct().collect()} == {2000}
    features.replace_sums(spark, plays, sums, [])
    assert rows(features.stats_from_sums(spark, sums)) == rows(team_week.team_week_stats(plays_of(spark, 2000)))


def test_parts_of_the_plays_merge(spark):
    first, second = plays_of(spark, 2000), plays_of(spark, 2000, seed=2)
    merged = team_week.pair_week_sums(first).union(team_week.pair_week_sums(second))
    assert rows(team_week.stats_of_sums(merged)) == rows(team_week.team_week_stats(first.union(second)))


def test_per_side_families_agree_with_the_stats(spark):
    plays = plays_of(spark, 2000)
    stats = {tuple(r[k] for k in team_week.KEY): r for r in team_week.team_week_stats(plays).collect()}
    for side, prefix in (("offence", ""), ("defence", "def_")):
        for family, (_, cols, _) in team_week.FAMILIES.items():
            if not all(prefix + c in team_week.COUNTS for c in cols):
                continue
            for r in team_week.side_stats(plays, side, family).collect():
                assert all(r[prefix + c] == stats[r["team"], r["season"], r["week"]][prefix + c] for c in cols)


def test_side_joins_take_the_buckets_as_they_lie(spark):
    team_weeks = spark.createDataFrame([(t, 2000, w, float(w), 7.0) for t in "ABCD" for w in range(1, 5)], "team string, season int, week int, a double, b double")
    games = spark.createDataFrame([(f"{w}{h}", 2000, w, h, v) for w in range(1, 6) for h, v in ("AB", "CD", "XA")], "game_id string, season int, week int, home_team string, away_team string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = features.store_bucketed(team_weeks, buckets=5)
        joined = matrix.attach_sides(games, stored, ["a", "b"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        want = matrix.attach_sides(games, team_weeks, ["a", "b"])
        loose = want._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and loose.count("Exchange hashpartitioning") == 4
        assert plan.count("Bucketed: true") == 2
        assert rows(joined) == rows(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_refresh_replaces_the_sums_of_landed_seasons(spark, tmp_path):
    paths = {k: str(tmp_path / k) for k in ("raw_games", "raw_plays", "games", "plays", "sums")}
    games = [raw_game(w, "20", "10", 3.0, season=s) for s in (2000, 2001) for w in (1, 2, 3)]
    append(spark.createDataFrame(games, RAW_GAME), paths["raw_games"], "season")
    landed = [(i, f"{s}_0{1 + i % 3}_B_A", s, 1 + i % 3, "A", "B", "pass", "1", i / 4, 0.0) for s in (2000, 2001) for i in range(12)]
    raw = spark.createDataFrame(landed, "play_id int, game_id string, season int, week int, posteam string, defteam string, play_type string, down string, epa double, sack double")
    append(raw, paths["raw_plays"], "season")
    args = [paths[k] for k in ("raw_games", "raw_plays", "games", "plays")]
    refresh(spark, *args, sums_path=paths["sums"], games_range=(1, 10), plays_range=(1, 100))
    stats = features.stats_from_sums(spark, paths["sums"])
    assert stats.select("season").distinct().count() == 2
    assert rows(stats) == rows(team_week.team_week_stats(spark.read.schema(PLAYS).parquet(paths["plays"])))
    assert stats.agg(F.sum("def_total_play_count")).first()[0] == 24
