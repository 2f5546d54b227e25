"""Read-side queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.checks.register import query
from fieldmark.operators import serve

RATING = """
SELECT team, season, week, SUM(rush_epa) OVER w / NULLIF(SUM(rush_att) OVER w, 0) AS ol_rush_epa_per_att,
  SUM(pass_epa) OVER w / NULLIF(SUM(pass_att) OVER w, 0) AS ol_pass_epa_per_att
FROM (SELECT posteam AS team, season, week,
  COUNT(*) FILTER (WHERE play_type = 'pass' AND down IS NOT NULL) AS pass_att, COUNT(*) FILTER (WHERE play_type = 'run' AND down IS NOT NULL) AS rush_att,
  SUM(CASE WHEN play_type = 'pass' AND down IS NOT NULL THEN COALESCE(epa, 0) ELSE 0 END) AS pass_epa,
  SUM(CASE WHEN play_type = 'run' AND down IS NOT NULL THEN COALESCE(epa, 0) ELSE 0 END) AS rush_epa
  FROM v_plays GROUP BY 1, 2, 3) t
WINDOW w AS (PARTITION BY team, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""
_RATING_SPEC = "team season:i week:i ol_rush_epa_per_att:f ol_pass_epa_per_att:f"


@query("e11_team_rating", _RATING_SPEC, RATING)
def _e11(v):
    return serve.team_rating(v.plays)


@query("e11_one_team_rating", _RATING_SPEC, f"SELECT * FROM ({RATING}) r WHERE team = 'NATION_7' AND season = 1998")
def _e11_one(v):
    return serve.team_rating(v.plays, "NATION_7", 1998)


@query("e19_latest_rating", _RATING_SPEC, f"""
SELECT * FROM ({RATING}) r QUALIFY ROW_NUMBER() OVER (PARTITION BY team ORDER BY season DESC, week DESC) = 1""")
def _e19(v):
    return serve.latest_rating(serve.team_rating(v.plays))


@query("e19_rating_seasons", "team season:i", f"SELECT DISTINCT team, season FROM ({RATING}) r")
def _e19_seasons(v):
    return serve.rating_seasons(serve.team_rating(v.plays))


_STATUS = "CASE WHEN home_score IS NOT NULL AND away_score IS NOT NULL THEN 'final' ELSE 'scheduled' END"


@query("b10_game_status", "game_id status", f"SELECT game_id, {_STATUS} AS status FROM v_games")
def _b10(v):
    return serve.with_status(v.games)


@query("b11_game_filter", "game_id season:i week:i status", f"""
SELECT game_id, season, week, {_STATUS} AS status FROM v_games
WHERE season = 2001 AND (home_team = 'NATION_4' OR away_team = 'NATION_4') AND {_STATUS} = 'final'""")
def _b11(v):
    return serve.find_games(v.games, 2001, team="NATION_4", status="complete")


@query("f1_game_page", "game_id season:i week:i", """
SELECT game_id, season, week FROM v_games WHERE season = 1999 ORDER BY season DESC, week DESC, game_id LIMIT 21 OFFSET 40""")
def _f1(v):
    return serve.list_games(v.games, 20, 40, season=1999)


@query("b13_season_of_id", "game_id parsed:i", """
SELECT game_id, CASE WHEN TRY_CAST(split_part(game_id, '_', 1) AS INT) BETWEEN 2000 AND 2100 THEN TRY_CAST(split_part(game_id, '_', 1) AS INT) END AS parsed FROM v_games""")
def _b13(v):
    from fieldmark.functions.expr import season_of_game_id

    return v.games.withColumn("parsed", season_of_game_id(F.col("game_id")))


@query("b14_valid_team_codes", "code n:i", """
SELECT upper(code) AS code, COUNT(*) AS n FROM (SELECT split_part(p_name, ' ', 2) AS code FROM part) p
WHERE regexp_matches(upper(code), '^[A-Z]{2,4}$') GROUP BY 1""")
def _b14(v):
    coded = v.table("part").select(F.split("p_name", " ").getItem(1).alias("code"))
    return serve.valid_teams(coded, "code").groupBy("code").agg(F.count("*").alias("n"))


@query("b30_point_lookups", "game_id season:i home_team", """
SELECT g.game_id, g.season, g.home_team FROM v_games g
WHERE g.game_id IN (SELECT game_id FROM v_plays WHERE sack = 1)""")
def _b30(v):
    return serve.lookup(v.games, v.plays.where("sack = 1").select("game_id"))


_STATS = """
SELECT game_id, season, posteam AS team, COUNT(*) FILTER (WHERE play_type = 'pass') AS pass_attempts, COUNT(*) FILTER (WHERE play_type = 'run') AS rush_attempts,
  SUM(yards_gained) AS total_yards, COALESCE(SUM(yards_gained) FILTER (WHERE play_type = 'pass'), 0) AS pass_yards,
  COALESCE(SUM(yards_gained) FILTER (WHERE play_type = 'run'), 0) AS rush_yards FROM v_plays GROUP BY 1, 2, 3
"""


@query("d35_team_game_stats", "game_id season:i team pass_attempts:i rush_attempts:i total_yards:i pass_yards:i rush_yards:i", _STATS)
def _d35(v):
    return serve.team_game_stats(v.plays)


@query("d36_play_counts", "game_id season:i play_count:i", "SELECT game_id, season, COUNT(*) AS play_count FROM v_plays GROUP BY 1, 2")
def _d36(v):
    return serve.play_counts(v.plays)


@query("c17_game_detail", "game_id status play_count:i home_pass_attempts:i home_total_yards:i away_rush_attempts:i away_total_yards:i", f"""
SELECT g.game_id, {_STATUS} AS status, COALESCE(c.n, 0) AS play_count, h.pass_attempts AS home_pass_attempts, h.total_yards AS home_total_yards,
  a.rush_attempts AS away_rush_attempts, a.total_yards AS away_total_yards
FROM v_games g LEFT JOIN (SELECT game_id, COUNT(*) AS n FROM v_plays GROUP BY 1) c ON c.game_id = g.game_id
LEFT JOIN ({_STATS}) h ON h.game_id = g.game_id AND h.team = g.home_team
LEFT JOIN ({_STATS}) a ON a.game_id = g.game_id AND a.team = g.away_team""")
def _c17(v):
    return serve.game_detail(v.games, v.plays).select(
        "game_id",
        "status",
        "play_count",
        F.col("home_stats.pass_attempts").alias("home_pass_attempts"),
        F.col("home_stats.total_yards").alias("home_total_yards"),
        F.col("away_stats.rush_attempts").alias("away_rush_attempts"),
        F.col("away_stats.total_yards").alias("away_total_yards"),
    )


_PRED = "run_id game_id season:i week:i fold:i predicted_home_cover_prob:f predicted_side correct:i"


@query("b20_prediction_filter", _PRED, "SELECT * FROM v_preds WHERE season = 2000 AND fold = 2 AND ol_mismatch_flag = 1")
def _b20(v):
    return serve.filter_predictions(v.predictions, 2000, 2, 1)


_NEWEST = "SELECT experiment_id, run_id FROM v_pruns QUALIFY ROW_NUMBER() OVER (PARTITION BY experiment_id ORDER BY run_at DESC, run_id DESC) = 1"


@query("c11_latest_predictions", _PRED, f"SELECT p.* FROM v_preds p JOIN ({_NEWEST}) n USING (experiment_id, run_id) WHERE season = 2000")
def _c11(v):
    return serve.latest_predictions(v.predictions, v.prediction_runs, 2000)


@query("f5_chronological_page", _PRED, f"""
SELECT p.* FROM v_preds p JOIN ({_NEWEST}) n USING (experiment_id, run_id) WHERE season = 1999 ORDER BY season, week, game_id, experiment_id LIMIT 51 OFFSET 25""")
def _f5(v):
    return serve.list_predictions(v.predictions, v.prediction_runs, 50, 25, season=1999)


@query("c14_production_experiment", "experiment_id run_id completed_at experiment_name", """
SELECT r.experiment_id, r.run_id, strftime(r.completed_at, '%Y-%m-%dT%H:%M:%SZ') AS completed_at, c.name AS experiment_name
FROM v_runs r JOIN v_cfg c USING (experiment_id) WHERE r.gate_passed AND c.gate_passed ORDER BY r.completed_at DESC, r.run_id DESC LIMIT 1""")
def _c14(v):
    out = serve.production_experiment(v.runs, v.configs)
    return out.withColumn("completed_at", F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


@query("c14_production_predictions", _PRED, f"""
SELECT p.* FROM v_preds p JOIN (SELECT experiment_id, run_id FROM v_pruns WHERE gate_passed ORDER BY completed_at DESC, run_id DESC LIMIT 1) r
USING (experiment_id, run_id) WHERE p.season = 2001 AND p.week = 3""")
def _c14_predictions(v):
    configs = v.prediction_runs.select("experiment_id", F.lit(True).alias("gate_passed"), F.col("experiment_id").alias("name")).distinct()
    production = serve.production_experiment(v.prediction_runs, configs)
    return serve.production_predictions(v.predictions, production, 2001, 3)


@query("f7_run_history", "run_id experiment_id status", """
SELECT run_id, experiment_id, status FROM v_runs WHERE experiment_id = 'exp_5'""")
def _f7(v):
    return serve.run_history(v.runs, "exp_5")


@query("f2_latest_run", "run_id experiment_id status", """
SELECT run_id, experiment_id, status FROM v_runs ORDER BY run_at DESC, run_id DESC LIMIT 1""")
def _f2(v):
    return serve.run_history(v.runs).limit(1)


@query("e14_latest_run_per_experiment", "experiment_id run_id seq:i status ats_hit_rate:f", "SELECT * FROM v_latest_runs")
def _e14(v):
    return serve.latest_runs(v.runs)


@query("e14_first_row_per_run", "run_id seq:i status", """
SELECT run_id, seq, status FROM v_runs QUALIFY ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY run_at DESC, seq DESC) = 1""")
def _e14_run(v):
    from fieldmark.operators.compare import latest

    return latest(v.runs, ["run_id"], ["run_at", "seq"])


@query("c18_experiment_detail", "experiment_id name run_id ats_hit_rate:f test_season:i wins:i losses:i hit_rate:f", """
SELECT c.experiment_id, c.name, r.run_id, r.ats_hit_rate, s.season AS test_season, s.wins, s.losses, s.hit_rate
FROM (SELECT DISTINCT experiment_id, name FROM (SELECT experiment_id, concat('config ', experiment_id) AS name FROM v_pruns UNION ALL SELECT experiment_id, name FROM v_cfg) u) c
LEFT JOIN v_pruns r ON r.experiment_id = c.experiment_id
LEFT JOIN (SELECT run_id, season, COUNT(*) FILTER (WHERE correct = 1) AS wins, COUNT(*) FILTER (WHERE correct = 0) AS losses,
  CAST(COUNT(*) FILTER (WHERE correct = 1) AS DOUBLE) / NULLIF(COUNT(correct), 0) AS hit_rate FROM v_preds GROUP BY 1, 2) s ON s.run_id = r.run_id""")
def _c18(v):
    own = v.prediction_runs.select(
        "experiment_id", F.concat(F.lit("config "), "experiment_id").alias("name"), F.lit("complete").alias("status"), F.lit("[]").alias("features")
    ).distinct()
    configs = own.unionByName(v.configs.select("experiment_id", "name", "status", "features"))
    return serve.experiment_detail(configs, v.prediction_runs, v.predictions)


@query("s1_season_of_date", "july_season:i september_season:i n:i", """
SELECT year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS july_season,
  year(o_orderdate) - CASE WHEN month(o_orderdate) < 9 THEN 1 ELSE 0 END AS september_season, COUNT(*) AS n FROM orders GROUP BY 1, 2""")
def _s1(v):
    """Season a calendar date falls in, under both season starts in use."""
    from fieldmark.functions.expr import season_of_date

    day = F.col("o_orderdate")
    return (
        v.table("orders")
        .groupBy(season_of_date(day, 7).alias("july_season"), season_of_date(day, 9).alias("september_season"))
        .agg(F.count("*").alias("n"))
    )


def _pages(first, key: list[str], limit: int):
    """All pages, each begun after the last row of the one before, with the page's number; as a client turns them."""
    out, after, number = None, None, 0
    while True:
        rows = first(after)
        shown = rows.limit(limit).withColumn("page", F.lit(number))
        out = shown if out is None else out.unionByName(shown)
        seen, more = serve.has_more(rows.select(*key).collect(), limit)
        if not more:
            return out
        after, number = tuple(seen[-1]), number + 1


@query("f1_seek_pages", "game_id season:i week:i page:i", """
SELECT game_id, season, week, (ROW_NUMBER() OVER (ORDER BY season DESC, week DESC, game_id) - 1) // 300 AS page FROM v_games""")
def _f1_seek(v):
    """Every page of all games, strung together."""
    return _pages(lambda after: serve.games_after(v.games, 300, after), list(serve.NEWEST_FIRST), 300)


@query("f5_seek_pages", "experiment_id run_id game_id season:i week:i page:i", f"""
SELECT experiment_id, run_id, game_id, season, week, (ROW_NUMBER() OVER (ORDER BY season, week, game_id, experiment_id) - 1) // 100 AS page
FROM v_preds p JOIN ({_NEWEST}) n USING (experiment_id, run_id) WHERE season = 1999""")
def _f5_seek(v):
    key = [*serve.CHRONOLOGICAL, "experiment_id"]
    return _pages(lambda after: serve.predictions_after(v.predictions, v.prediction_runs, 100, after, season=1999), key, 100)
