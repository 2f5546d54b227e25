"""Tables whose columns change, read by their schema log."""

import pytest
from pyspark.sql import functions as F

from fieldmark.sources import schema_log as S
from fieldmark.sources import sinks


def test_columns_come_from_the_log(spark, tmp_path):
    path, log = str(tmp_path / "t"), str(tmp_path / "log")
    old = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "game_id string, season int, crowd int")
    S.write_logged(old, path, log, ["game_id"])
    S.write_logged(spark.createDataFrame([("c", 2, 2**40, "open")], "game_id string, season int, crowd long, roof string"), path, log, ["game_id"])
    found = S.read_logged(spark, path, log)
    assert dict(found.dtypes) == {"game_id": "string", "crowd": "bigint", "roof": "string", "season": "int"}
    assert sorted((tuple(r) for r in found.select("game_id", "season", "crowd", "roof").collect()), key=str) == [("a", 1, 5, None), ("c", 2, 2**40, "open")]
    one = S.read_logged(spark, path, log, season=2, columns=["game_id"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "ReadSchema: struct<game_id:string>" in plan
    assert [tuple(r) for r in one.collect()] == [("c",)]
    # season 1 loses its column to a replacement: only what is stored now is listed
    S.write_logged(old.where("season = 1").drop("crowd"), path, log, ["game_id"])
    S.write_logged(old.where("season = 2").drop("crowd"), path, log, ["game_id"])
    assert S.read_logged(spark, path, log).columns == ["game_id", "season"]


def test_a_write_that_broke_off_hides_nothing(spark, tmp_path, monkeypatch):
    path, log = str(tmp_path / "t"), str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1, 5)], "game_id string, season int, crowd int")
    S.write_logged(rows, path, log, ["game_id"])

    def broken(*args):
        raise OSError("lost")

    monkeypatch.setattr(S, "replace_partitions", broken)
    with pytest.raises(OSError, match="lost"):
        S.write_logged(rows.select("game_id", "season", F.lit("x").alias("roof")), path, log, ["game_id"])
    assert [r.asDict() for r in S.read_logged(spark, path, log).collect()] == [{"game_id": "a", "crowd": 5, "roof": None, "season": 1}]


def test_types_that_do_not_widen_are_refused(spark, tmp_path):
    path, log = str(tmp_path / "t"), str(tmp_path / "log")
    for season, kind in ((1, "int"), (2, "string")):
        S.write_logged(spark.createDataFrame([("a", season)], "game_id string, season int").withColumn("crowd", F.lit(7).cast(kind)), path, log, ["game_id"])
    with pytest.raises(ValueError, match="crowd is stored as"):
        S.logged_schema(spark, log)
    assert sinks.table_exists(spark, log)
