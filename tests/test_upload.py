"""Uploads with bad rows, refused and broken files; pages by seeking; saved configs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.operators import registry, serve, versions
from fieldmark.plans import upload

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("_line", T.StringType()), T.StructField("x", T.DoubleType())])


def places(tmp_path):
    return [str(tmp_path / n) for n in ("log", "tables", "columns", "rejects")]


def land(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def head(spark, log, name):
    return versions.heads(upload.dataset_log(spark, log).where(F.col("dataset_id") == name), "dataset_id").first()


def test_good_rows_replace_the_table_and_bad_ones_are_kept(spark, tmp_path):
    log, tables, columns, rejects = places(tmp_path)
    lines = ["id,_line,x", "1,a,2.5", "2,,", "3,b,zzz", ",c,1.0", "4,d,1.5,9", "5", "6,é,-1"]
    upload.add_upload(spark, log, "d1", "first", land(tmp_path, "a.csv", lines))
    assert upload.process_upload(spark, "d1", SCHEMA, log, tables, columns, rejects, most_bad=0.9) == "ready"
    assert sorted(map(tuple, spark.read.parquet(f"{tables}/d1").collect())) == [(1, "a", 2.5), (2, None, None), (6, "é", -1.0)]
    lost = {(r["line"], *r["reasons"]) for r in spark.read.parquet(rejects).collect()}
    assert lost == {("3,b,zzz", "malformed"), ("4,d,1.5,9", "malformed"), ("5", "malformed"), ('{"_line":"c","x":1.0}', "missing id")}
    now = head(spark, log, "d1")
    assert (now["status"], now["row_count"], now["column_count"], now["seq"]) == ("ready", 3, 3, 2)
    found = {r["column_name"]: (r["data_type"], round(r["null_rate"], 3)) for r in spark.read.parquet(columns).collect()}
    assert found == {"id": ("numeric", 0.0), "_line": ("categorical", 0.333), "x": ("numeric", 0.333)}
    with pytest.raises(ValueError, match="ready"):
        upload.process_upload(spark, "d1", SCHEMA, log, tables, columns, rejects)


def test_a_refused_or_broken_upload_leaves_the_table(spark, tmp_path):
    log, tables, columns, rejects = places(tmp_path)
    upload.add_upload(spark, log, "d1", "first", land(tmp_path, "a.json", ['{"id":1,"x":1}', '[{"id":2},{"id":3,"_line":"t"}]']))
    assert upload.process_upload(spark, "d1", SCHEMA, log, tables, columns, rejects, "json") == "ready"
    other = land(tmp_path, "b.json", ['{"id":7}', '{"id":', '{"x":1.5}'])
    row = {**head(spark, log, "d1").asDict(), "status": "uploading", "file_path": other, "based_on": 2, "seq": 3}
    upload._commit(spark, log, row, "again")
    assert upload.process_upload(spark, "d1", SCHEMA, log, tables, columns, rejects, "json", most_bad=0.5) == "error"
    assert "2 of 3" in head(spark, log, "d1")["error_message"]
    assert sorted(r["id"] for r in spark.read.parquet(f"{tables}/d1").collect()) == [1, 2, 3]
    upload.add_upload(spark, log, "d2", "second", str(tmp_path / "absent.csv"))
    with pytest.raises(Exception, match="absent"):
        upload.process_upload(spark, "d2", SCHEMA, log, tables, columns, rejects)
    assert head(spark, log, "d2")["status"] == "error" and "absent" in head(spark, log, "d2")["error_message"]
    upload.add_upload(spark, log, "d3", "empty", land(tmp_path, "c.csv", ["id,_line,x"]))
    assert upload.process_upload(spark, "d3", SCHEMA, log, tables, columns, rejects) == "error"
    with pytest.raises(LookupError):
        upload.process_upload(spark, "d9", SCHEMA, log, tables, columns, rejects)


def test_pages_by_seeking_have_no_offset_and_push_the_comparison_down(spark, tmp_path):
    rows = [(s, w, f"g{k}", None, None) for s in (2001, 2002, 2003) for w in range(1, 8) for k in range(9)]
    path = str(tmp_path / "games")
    spark.createDataFrame(rows, "season int, week int, game_id string, home_score int, away_score int").write.partitionBy("season").parquet(path)
    games = spark.read.parquet(path)
    seen, after = [], None
    while True:
        page = serve.games_after(games, 40, after)
        got, more = serve.has_more([(r["season"], r["week"], r["game_id"]) for r in page.collect()], 40)
        seen += got
        if not more:
            break
        after = got[-1]
    assert seen == sorted([r[:3] for r in rows], key=lambda r: (-r[0], -r[1], r[2]))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "Offset" not in plan and "TakeOrderedAndProject" in plan and "PartitionFilters: [isnotnull(season" in plan
    assert serve.games_after(games, 40, (2001, 1, "g8")).isEmpty()


def test_saved_configs_are_listed_looked_up_and_deleted(spark):
    at = datetime(2024, 5, 1)
    configs = spark.createDataFrame([(f"e{k}", f"n{k}", "home_covered", "[]") for k in range(5)], "experiment_id string, name string, target string, features string")
    log = registry.snapshot(configs).withColumns({"created_at": F.lit(at), "updated_at": F.lit(at), "seq": F.lit(1).cast("long"), "based_on": F.lit(None).cast("long"), "writer": F.lit("w"), "deleted": F.lit(None).cast("boolean")})
    gone = registry.deleted_saved(log, spark.createDataFrame([("fw_e1",), ("fw_none",)], "framework_id string"), F.lit(at))
    log = log.unionByName(gone)
    first = [r["framework_id"] for r in registry.list_saved(log, 2).collect()]
    assert first == ["fw_e0", "fw_e2", "fw_e3"]
    assert [r["framework_id"] for r in registry.list_saved(log, 2, (at, "fw_e2")).collect()] == ["fw_e3", "fw_e4"]
    assert registry.saved_config(log, "fw_e1").isEmpty() and registry.saved_config(log, "nobody").isEmpty()
    found = registry.saved_config(log, "fw_e2").first()
    assert (found["config"]["experiment_id"], found["config"]["target"], found["config"]["status"]) == ("fw_e2", "home_covered", "draft")
