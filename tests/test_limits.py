"""Nothing is cut, dropped or skipped in silence, and no plan joins without keys."""

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import catalog, matrix, models, registry, serve
from fieldmark.operators.quantiles import quantiles
from fieldmark.session import shared_root
from fieldmark.sources import readers, sinks


def test_error_messages_are_kept_whole(spark):
    from datetime import datetime

    run = {"run_id": "r", "experiment_id": "e", "name": "n", "run_at": datetime(2002, 1, 1), "model_type": "m"}
    row = sinks.error_record(spark, run, "x" * 9000).first()
    assert len(row["error_message"]) == 9000 and row["status"] == "failed" and row["gate_passed"] is False


def test_snapshot_names_keep_the_whole_id(spark):
    configs = spark.createDataFrame([("exp_10", "a"), ("exp_1999", "b")], "experiment_id string, name string")
    name = F.get_json_object("config_snapshot", "$.name")
    got = {r[0] for r in registry.snapshot(configs).select(name).collect()}
    assert got == {"Framework config fw_exp_10", "Framework config fw_exp_1999"}


def test_lookups_find_games_of_any_season(spark):
    games = spark.createDataFrame([("1999_a", 1999, 1, 2), ("2003_b", 2003, None, None)], "game_id string, season int, home_score int, away_score int")
    ids = spark.createDataFrame([("1999_a",), ("2003_b",), ("x",)], "game_id string")
    assert serve.lookup(games, ids).count() == 2
    assert [serve.game_by_id(games, g).count() for g in ("1999_a", "2003_b", "1997_c")] == [1, 1, 0]


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError, match="reg_lambda"):
        models.estimator("xgboost", 1, {"reg_lambda": 1.0})
    features = spark.createDataFrame([("A", 1, 1, 0.5)], "team string, season int, week int, ol_x double")
    with pytest.raises(ValueError, match="nothing"):
        matrix.game_matrix(features, features, ["nothing"])
    keys = spark.createDataFrame([(i // 2,) for i in range(40)], "k int")
    with pytest.raises(ValueError, match="20 keys on 40 rows"):
        matrix.require_unique(keys, ["k"])


def test_context_names_resolve_and_unknown_ones_do_not():
    refs = [{"dataset": catalog.CURATED, "column": c} for c in ("temp", f"home_{catalog.TEAM_FEATURES[0]}")]
    assert catalog.resolve_columns(refs)[0] == [catalog.TEAM_FEATURES[0]]
    with pytest.raises(ValueError, match="no_such"):
        catalog.resolve_columns([{"dataset": catalog.CURATED, "column": "no_such"}])


def test_ungrouped_quantiles_join_on_keys(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 5).alias("w"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kwargs in ({}, {"by": ["w"]}, {"by": ["w"], "order": "x"}):
            found = quantiles(df, "x", {"q1": 0.25, "q3": 0.75}, **kwargs)
            found.collect()
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = df.agg(F.percentile("x", 0.25), F.percentile("x", 0.75)).first()
    got = quantiles(df, "x", {"q1": 0.25, "q3": 0.75}).first()
    assert (got["q1"], got["q3"]) == tuple(want)


def test_a_hot_season_is_split_over_files(spark, tmp_path):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 50 == 0, 2001).otherwise(2000).alias("season"), F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "1m")
    try:
        sinks.replace_partitions(df, str(tmp_path / "t"), ["k"])
    finally:
        spark.conf.set(size, before)
    assert len(list((tmp_path / "t" / "season=2000").glob("part-*"))) > 1
    assert readers.read_table(spark, str(tmp_path / "t"), season=2000).count() == 196_000


def test_clusters_need_a_shared_folder(spark):
    class Context:
        master, applicationId = "spark://host:7077", "a"

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Session())


def test_orphans_and_game_details_shuffle_counts_and_read_plays_once(spark, tmp_path):
    from fieldmark.operators import quality, serve

    path = str(tmp_path / "plays")
    rows = [("g1", 1, "A", "pass", 5), ("g1", 1, None, "punt", None), ("g1", 1, "B", "run", 3), (None, 1, "A", "run", 1), ("g9", 1, "A", "run", 2), ("g9", 1, "A", "run", 2)]
    spark.createDataFrame(rows, "game_id string, season int, posteam string, play_type string, yards_gained int").write.parquet(path)
    plays = spark.read.parquet(path)
    games = spark.createDataFrame([("g1", 1, "A", "B", 1, 0), ("g2", 1, "A", "B", None, None)], "game_id string, season int, home_team string, away_team string, home_score int, away_score int")
    lost = quality.orphan_counts(plays, games)
    assert {r["game_id"]: r["n"] for r in lost.collect()} == {None: 1, "g9": 2}
    assert sorted((r["game_id"], r["yards_gained"]) for r in quality.orphan_plays(plays, games).collect() if r["game_id"]) == [("g9", 2), ("g9", 2)]
    assert quality.orphan_plays(plays, games).count() == 3
    plan = lost._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftAnti") < plan.index("Aggregate")  # the plays are summed below the join
    detail = serve.game_detail(games, plays)
    found = {r["game_id"]: (r["play_count"], r["home_stats"] and r["home_stats"]["total_yards"], r["away_stats"] and r["away_stats"]["rush_yards"]) for r in detail.collect()}
    assert found == {"g1": (3, 5, 3), "g2": (0, None, None)}
    assert detail._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Scan parquet") == 1


def test_weekly_cutoffs_meet_the_games_without_dealing_them_by_week(spark):
    from fieldmark.operators import mismatch

    rows = [(s, w, f"g{s}_{w}_{k}", *[float((7 * k + w * i) % 11) for i in range(1, 9)]) for s in (1, 2) for w in range(1, 9) for k in range(12)]
    names = [f"{side}_{c} double" for side in ("home", "away") for c in mismatch.COMPOSITE_INPUTS]
    games = spark.createDataFrame(rows, "season int, week int, game_id string, " + ", ".join(names))
    flagged = mismatch.mismatch_flag(games)
    assert flagged.count() == len(rows) and {r[0] for r in flagged.select("ol_mismatch_flag").distinct().collect()} > {0}
    plan = flagged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
