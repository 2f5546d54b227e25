"""Scans, type clean-up and written tables read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.checks.register import query
from fieldmark.checks.sql_views import VIEWS
from fieldmark.operators import versions
from fieldmark.operators.scoring import fold_metrics
from fieldmark.plans import upload
from fieldmark.schemas import PREDICTIONS, RUNS
from fieldmark.session import scratch_path
from fieldmark.sources import coerce, readers, schema_log, sinks

_GAME = "game_id season:i week:i home_team away_team home_score:i away_score:i home_spread_close:f home_covered:b"


@query("a1_one_season", _GAME, "SELECT * FROM v_games WHERE season = 1997")
def _a1(v):
    path = scratch_path(v.spark, "games")
    sinks.replace_partitions(v.games, path, ["home_team"])
    return readers.read_table(v.spark, path, season=1997)


_PLAY = "season:i week:i play_type n:i epa_sum:f yards:i cpoe_sum:f sacks:i hits:i downs:i"


@query("a2_pruned_plays", _PLAY, """
SELECT season, week, play_type, COUNT(*) AS n, SUM(epa) AS epa_sum, SUM(yards_gained) AS yards, SUM(cpoe) AS cpoe_sum, SUM(sack) AS sacks,
  SUM(qb_hit) AS hits, SUM(down) AS downs FROM v_plays GROUP BY 1, 2, 3""")
def _a2(v):
    return (
        readers.feature_plays(v.plays)
        .groupBy("season", "week", "play_type")
        .agg(
            F.count("*").alias("n"),
            F.sum("epa").alias("epa_sum"),
            F.sum("yards_gained").alias("yards"),
            F.sum("cpoe").alias("cpoe_sum"),
            F.sum("sack").alias("sacks"),
            F.sum("qb_hit").alias("hits"),
            F.sum("down").alias("downs"),
        )
    )


@query("a3_pruned_games", _GAME + " game_date total_close:f roof div_game:b temp:f wind:f", "SELECT * FROM v_games")
def _a3(v):
    return readers.feature_games(v.games)


@query("a4_stamped_source", "game_id season:i week:f old_player_id source license_tag", """
SELECT game_id, season, week, CASE WHEN old_player_id LIKE '%.0' THEN substr(old_player_id, 1, length(old_player_id) - 2) ELSE old_player_id END AS old_player_id,
  'schedules' AS source, 'open' AS license_tag FROM v_raw_games""")
def _a4(v):
    path = scratch_path(v.spark, "landed")
    sinks.append(v.raw_games, path)
    adapter = readers.LandedTable(path, ["game_id", "season"], 0, 1_000_000, source="schedules")
    return adapter.normalize(adapter.fetch(v.spark))


@query("a5_csv_source", "game_id season:i home_spread_close:f home_covered:b roof", "SELECT * FROM v_games")
def _a5(v):
    path = scratch_path(v.spark, "csv")
    sinks.write_csv(v.games.select("game_id", "season", "home_spread_close", "home_covered", "roof"), path)
    return readers.typed_text(readers.read_csv(v.spark, path))


@query("a6_json_source", "event_id:i user_id:i event_type value:f", "SELECT event_id, user_id, event_type, value FROM events")
def _a6(v):
    """Arrays of at most a thousand objects, one per line, written from the events."""
    path = scratch_path(v.spark, "json")
    rows = v.table("events").select("event_id", "user_id", "event_type", "value")
    chunk = F.floor(F.col("event_id") / 1000).alias("chunk")
    lines = rows.groupBy(chunk).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("line"))
    lines.select("line").write.text(path)
    return readers.read_json_records(v.spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@query("a7_harmonised", "game_id home_score away_score old_player_id", """
SELECT game_id, CASE WHEN home_score <> 'nan' THEN home_score END AS home_score, CASE WHEN away_score <> 'None' THEN away_score END AS away_score,
  CASE WHEN old_player_id LIKE '%.0' THEN substr(old_player_id, 1, length(old_player_id) - 2) ELSE old_player_id END AS old_player_id
FROM v_raw_games""")
def _a7(v):
    return coerce.harmonise(v.raw_games)


@query("a8_widened", "name kind season:i total:f", """
SELECT name, kind, season, total FROM (SELECT season, CAST(SUM(week) AS DOUBLE) AS total FROM v_raw_games GROUP BY 1) s
CROSS JOIN (VALUES ('season', 'int'), ('week', 'double'), ('surface', 'string')) AS t(name, kind)""")
def _a8(v):
    wide = coerce.widen(v.raw_games.withColumn("surface", F.lit(None)))
    kinds = [(f.name, f.dataType.simpleString()) for f in wide.schema.fields if f.name in ("season", "week", "surface")]
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind")) for n, k in kinds])
    return wide.groupBy("season").agg(F.sum("week").alias("total")).select("season", "total", F.inline(listed))


@query("a9_numbers_from_text", "season:i n:i numbers:i total:f", """
SELECT season, COUNT(*) AS n, COUNT(TRY_CAST(yards_gained AS DOUBLE)) AS numbers, SUM(TRY_CAST(yards_gained AS DOUBLE)) AS total FROM v_raw_plays GROUP BY 1""")
def _a9(v):
    return (
        coerce.to_numeric(v.raw_plays, ["yards_gained"])
        .groupBy("season")
        .agg(F.count("*").alias("n"), F.count("yards_gained").alias("numbers"), F.sum("yards_gained").alias("total"))
    )


@query("a10_conformed", "season:i n:i yards:i downs:i passers:i extra:i", """
SELECT season, COUNT(*) AS n, SUM(TRY_CAST(yards_gained AS INT)) AS yards, SUM(CAST(down AS INT)) AS downs,
  COUNT(CASE WHEN passer_player_name NOT IN ('none', 'NaN') THEN 1 END) AS passers, COUNT(*) AS extra FROM v_raw_plays GROUP BY 1""")
def _a10(v):
    target = T.StructType(
        [
            T.StructField("yards_gained", T.IntegerType()),
            T.StructField("down", T.IntegerType()),
            T.StructField("passer_player_name", T.StringType()),
            T.StructField("play_id", T.StringType()),
        ]
    )
    out = coerce.conform(v.raw_plays.withColumn("unlisted", F.lit(1)), target)
    return out.groupBy("season").agg(
        F.count("*").alias("n"),
        F.sum("yards_gained").alias("yards"),
        F.sum("down").alias("downs"),
        F.count("passer_player_name").alias("passers"),
        F.sum("unlisted").alias("extra"),
    )


@query("a11_replaced_partition", _GAME, """
SELECT game_id, season, week, home_team, away_team, home_score, away_score,
  CASE WHEN season = 1998 THEN home_spread_close + 1 ELSE home_spread_close END AS home_spread_close, home_covered FROM v_games""")
def _a11(v):
    """Replacing one season twice leaves the other seasons and no duplicates."""
    path = scratch_path(v.spark, "games")
    sinks.replace_partitions(v.games, path, ["home_team"])
    changed = v.games.where("season = 1998").withColumn("home_spread_close", F.col("home_spread_close") + 1)
    for _ in range(2):
        sinks.replace_partitions(changed, path, ["home_team"])
    return readers.read_table(v.spark, path)


@query("a12_partitioned_table", "season:i posteam n:i", "SELECT season, posteam, COUNT(*) AS n FROM v_plays GROUP BY 1, 2")
def _a12(v):
    path = scratch_path(v.spark, "plays")
    sinks.create_table(v.spark, path, v.plays.schema, "season")
    sinks.replace_partitions(v.plays, path, ["game_id", "posteam"], files=2)
    return readers.read_table(v.spark, path).groupBy("season", "posteam").agg(F.count("*").alias("n"))


@query("a13_appended_predictions", "run_id experiment_id fold:i game_id season:i week:i predicted_home_cover_prob:f predicted_side correct:i ol_mismatch_flag:i",
       "SELECT * FROM v_preds")
def _a13(v):
    path = scratch_path(v.spark, "predictions")
    sinks.create_table(v.spark, path, PREDICTIONS, "season")
    for run in ("run_p1", "run_p2", "run_p3"):
        sinks.append_predictions(v.predictions.where(F.col("run_id") == run), path)
    return readers.read_table(v.spark, path)


@query("a14_appended_runs", "run_id experiment_id ats_hit_rate:f n_games_evaluated:i gate_passed:b seasons_evaluated", """
SELECT p.run_id, p.experiment_id, hit AS ats_hit_rate, n AS n_games_evaluated, FALSE AS gate_passed, s AS seasons_evaluated
FROM (SELECT run_id, experiment_id, CAST(COUNT(*) FILTER (WHERE correct = 1) AS DOUBLE) / COUNT(correct) AS hit, COUNT(correct) AS n,
  concat('[', string_agg(DISTINCT season, ',' ORDER BY season), ']') AS s FROM v_preds GROUP BY 1, 2) p""")
def _a14(v):
    path = scratch_path(v.spark, "runs")
    per_run = v.predictions.groupBy("run_id", "experiment_id").agg(
        F.try_divide(F.count_if(F.col("correct") == 1).cast("double"), F.count("correct")).alias("ats_hit_rate"),
        F.count("correct").alias("n_games_evaluated"),
        F.sort_array(F.collect_set("season")).alias("seasons_evaluated"),
    )
    stamped = per_run.withColumns(
        {
            "name": F.lit("stored"),
            "run_at": F.current_timestamp(),
            "model_type": F.lit("fixed"),
            "gate_passed": F.lit(False),
        }
    )
    sinks.append(sinks.run_record(stamped), path)
    return v.spark.read.parquet(path)


@query("a15_failed_run_record", "run_id experiment_id status gate_passed:b message_length:i games:i", """
SELECT run_id, experiment_id, 'failed' AS status, FALSE AS gate_passed, 5000 + length(run_id) AS message_length, CAST(NULL AS BIGINT) AS games
FROM v_runs WHERE status = 'failed'""")
def _a15(v):
    """Records of the failed runs, written with a long message and read back whole."""
    path = scratch_path(v.spark, "runs")
    keys = ["run_id", "experiment_id", "name", "run_at", "model_type"]
    named = v.runs.where("status = 'failed'")
    have = [c for c in keys if c in named.columns]
    rest = {"name": F.col("experiment_id"), "model_type": F.lit("xgboost")}
    named = named.select(*have, *[rest[c].alias(c) for c in keys if c not in have])
    sinks.append(sinks.failed_records(named, F.concat(F.repeat(F.lit("x"), 5000), "run_id")), path)
    stored = readers.read_table(v.spark, path, schema=RUNS)
    return stored.select(
        "run_id", "experiment_id", "status", "gate_passed", F.length("error_message").alias("message_length"), F.col("n_games_evaluated").alias("games")
    )


@query("a16_evolved_schema", "game_id season:i crowd:i roof", """
SELECT game_id, season, NULL AS crowd, roof FROM v_games WHERE season < 1998
UNION ALL SELECT game_id, season, hk AS crowd, NULL AS roof FROM v_games WHERE season >= 1998""")
def _a16(v):
    path, log = scratch_path(v.spark, "evolving"), scratch_path(v.spark, "schemas")
    old = v.games.where("season < 1998").select("game_id", "season", "roof")
    new = v.games.where("season >= 1998").select("game_id", "season", F.col("hk").alias("crowd"))
    schema_log.write_logged(old, path, log, ["game_id"])
    schema_log.write_logged(new, path, log, ["game_id"])
    stored = schema_log.read_logged(v.spark, path, log)
    return sinks.evolve(stored.where("season < 1998").drop("crowd"), stored.where("season >= 1998").drop("roof"))


@query("a17_replaced_table", "game_id crowd:f", "SELECT * FROM v_user_games WHERE CAST(crowd AS INT) > 10")
def _a17(v):
    path = scratch_path(v.spark, "user")
    sinks.replace_table(v.user_games, path)
    sinks.replace_table(v.user_games.where(F.col("crowd").cast("int") > 10), path)
    return v.spark.read.parquet(path)


@query("a18_artifacts", "season:i wins:i losses:i model_log_loss:f", """
SELECT season, COUNT(*) FILTER (WHERE correct = 1) AS wins, COUNT(*) FILTER (WHERE correct = 0) AS losses,
  AVG(CASE WHEN actual_home_covered THEN -ln(predicted_home_cover_prob) WHEN NOT actual_home_covered THEN -ln(1 - predicted_home_cover_prob) END) AS model_log_loss
FROM v_preds GROUP BY 1""")
def _a18(v):
    csv, js = scratch_path(v.spark, "per_season_csv"), scratch_path(v.spark, "per_season_json")
    metrics = fold_metrics(v.predictions, ["season"])
    sinks.write_csv(metrics, csv)
    sinks.write_json(metrics.select("season", "model_log_loss"), js)
    return readers.typed_text(readers.read_csv(v.spark, csv)).drop("model_log_loss").join(v.spark.read.json(js), "season")


@query("a19_sample_rows", "game_id season:i", "SELECT game_id, season FROM v_games ORDER BY game_id LIMIT 20")
def _a19(v):
    return sinks.sample_rows(v.games, 20, ["game_id"])


# --- uploads: every order is a landed row of its status's dataset; some rows are spoilt, most of P's among them

_UPLOAD = T.StructType(
    [T.StructField("id", T.LongType(), False), T.StructField("owner", T.LongType(), False), T.StructField("price", T.DoubleType()), T.StructField("kind", T.StringType())]
)
_MALFORMED = "(o_orderkey % 31 = 0 OR o_orderkey % 37 = 0 OR o_orderstatus = 'P' AND o_orderkey % 7 = 0)"
_MISSING = f"(NOT {_MALFORMED} AND o_orderkey % 41 = 0)"
VIEWS["v_upload"] = f"""
SELECT concat('ds_', o_orderstatus) AS dataset_id, {_MALFORMED} AS malformed, {_MISSING} AS missing, NOT ({_MALFORMED} OR {_MISSING}) AS good,
  o_orderkey % 5 = 0 AS no_kind FROM orders
"""
_UPLOAD_SQL = """
SELECT dataset_id, CASE WHEN COUNT(*) FILTER (WHERE NOT good) > 0.1 * COUNT(*) THEN 'error' ELSE 'ready' END AS status,
  COUNT(*) FILTER (WHERE malformed) AS malformed, COUNT(*) FILTER (WHERE missing) AS missing,
  CASE WHEN COUNT(*) FILTER (WHERE NOT good) > 0.1 * COUNT(*) THEN NULL ELSE COUNT(*) FILTER (WHERE good) END AS stored FROM v_upload GROUP BY 1"""


def _landed(v, kind: str):
    """(dataset, line) of every order as text of a CSV or JSON file."""
    key, kept = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))
    owner = F.when(key % 41 != 0, F.col("o_custkey").cast("string"))
    price = F.when(key % 31 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    spoilt = (key % 37 == 0) | ((F.col("o_orderstatus") == "P") & (key % 7 == 0))
    if kind == "csv":
        line = F.concat_ws(",", key.cast("string"), F.coalesce(owner, F.lit("")), price, F.coalesce(kept, F.lit("")))
        line = F.when(spoilt, F.concat(line, F.lit(",more"))).otherwise(line)
    else:
        quoted = F.when(key % 31 == 0, F.lit('"n/a"')).otherwise(price)
        line = F.concat(F.lit('{"id":'), key.cast("string"), F.lit(',"owner":'), F.coalesce(owner, F.lit("null")), F.lit(',"price":'), quoted, F.lit(',"kind":'), F.coalesce(F.concat(F.lit('"'), kept, F.lit('"')), F.lit("null")), F.lit("}"))
        line = F.when(spoilt, F.substring(line, 1, 12)).otherwise(line)
    return v.table("orders").select(F.concat(F.lit("ds_"), F.col("o_orderstatus")).alias("dataset_id"), line.alias("line"))


def _uploaded(v, kind: str):
    """(log, tables, columns, rejects) after each dataset's landed file has been processed."""
    root = scratch_path(v.spark, f"upload-{kind}")
    log, tables, columns, rejects = (f"{root}/{n}" for n in ("log", "tables", "columns", "rejects"))
    _landed(v, kind).write.partitionBy("dataset_id").text(f"{root}/landed")
    for name in ("ds_F", "ds_O", "ds_P"):
        upload.add_upload(v.spark, log, name, name, f"{root}/landed/dataset_id={name}")
        upload.process_upload(v.spark, name, _UPLOAD, log, tables, columns, rejects, kind, header=False, most_bad=0.1)
    return log, tables, columns, rejects


def _upload_report(v, kind: str):
    log, _, _, rejects = _uploaded(v, kind)
    own = versions.heads(upload.dataset_log(v.spark, log), "dataset_id").select("dataset_id", "status", F.col("row_count").alias("stored"))
    lost = v.spark.read.parquet(rejects).groupBy("dataset_id").agg(
        F.count_if(F.array_contains("reasons", "malformed")).alias("malformed"), F.count_if(F.array_contains("reasons", "missing owner")).alias("missing")
    )
    return own.join(lost, "dataset_id")


@query("a5_upload_csv", "dataset_id status malformed:i missing:i stored:i", _UPLOAD_SQL)
def _a5_upload(v):
    """Every landed CSV row is stored or rejected with its reason; too many bad ones refuse the upload."""
    return _upload_report(v, "csv")


@query("a6_upload_json", "dataset_id status malformed:i missing:i stored:i", _UPLOAD_SQL)
def _a6_upload(v):
    return _upload_report(v, "json")


@query("r5_upload_columns", "dataset_id column_name data_type null_rate:f is_join_key:b", """
SELECT dataset_id, t.c AS column_name, CASE WHEN t.c = 'kind' THEN 'categorical' ELSE 'numeric' END AS data_type,
  CASE WHEN t.c = 'kind' THEN ROUND(AVG(CASE WHEN no_kind THEN 1.0 ELSE 0.0 END), 6) ELSE 0 END AS null_rate, FALSE AS is_join_key
FROM v_upload CROSS JOIN (VALUES ('id'), ('owner'), ('price'), ('kind')) AS t(c)
WHERE good AND dataset_id <> 'ds_P' GROUP BY 1, 2""")
def _r5_upload(v):
    """Column rows of the accepted uploads."""
    return v.spark.read.parquet(_uploaded(v, "csv")[2])
