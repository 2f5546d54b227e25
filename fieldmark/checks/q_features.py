"""Team-week aggregates, windows, cold start and situational features."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.checks.register import query
from fieldmark.checks.sql_views import COUNT_COLUMNS, RATES, SIDE_AGGREGATES
from fieldmark.operators import situational, team_week
from fieldmark.plans import features
from fieldmark.schemas import ADDED_RATES, BASE_RATES, PLAYS
from fieldmark.session import scratch_path
from fieldmark.sources.coerce import project_to
from fieldmark.sources.sinks import replace_partitions

KEY = "team season:i week:i"


def _spec(cols) -> str:
    return KEY + " " + " ".join(f"{c}:f" for c in cols)


def _family(name: str, side: str, family: str, keep: str) -> None:
    cols = team_week.FAMILIES[family][1]
    prefix = "def_" if side == "defence" else ""
    team = "posteam" if side == "offence" else "defteam"
    body = f"SELECT {team} AS team, season, week, " + ", ".join(
        f"COALESCE({SIDE_AGGREGATES[c]}, 0) AS {prefix}{c}" for c in cols
    )
    body += f" FROM v_plays WHERE {keep} GROUP BY 1, 2, 3"
    query(name, _spec(prefix + c for c in cols), body)(
        lambda v: team_week.side_stats(v.plays, side, family)
    )


PASS = "play_type = 'pass' AND down IS NOT NULL"
RUN = "play_type = 'run' AND down IS NOT NULL"

_family("d1_offence_pass", "offence", "pass", PASS)
_family("d2_offence_run", "offence", "run", RUN)
_family("d3_defence_pass", "defence", "pass", PASS)
_family("d4_defence_run", "defence", "run", RUN)
_family("d5_offence_pass_added", "offence", "pass_added", PASS)
_family("d6_offence_pressure", "offence", "pressure", f"{PASS} AND (qb_hit = 1 OR sack = 1)")
_family("d7_offence_cpoe", "offence", "cpoe", f"{PASS} AND cpoe IS NOT NULL")
_family("d8_offence_run_added", "offence", "run_added", RUN)
_family("d9_defence_all_plays", "defence", "all", "down IS NOT NULL")
_family("d10_defence_pass_added", "defence", "pass_added", PASS)
_family("d11_defence_run_added", "defence", "run_added", RUN)


@query(
    "d12_offence_epa_per_play",
    _spec(["off_all_play_count", "off_all_epa_sum", "off_epa_per_play_raw"]),
    """SELECT posteam AS team, season, week, COUNT(epa) AS off_all_play_count, COALESCE(SUM(epa), 0) AS off_all_epa_sum,
       COALESCE(SUM(epa), 0) / GREATEST(COUNT(epa), 1) AS off_epa_per_play_raw
       FROM v_plays WHERE play_type IN ('pass', 'run') AND down IS NOT NULL GROUP BY 1, 2, 3""",
)
def _d12(v):
    return team_week.offence_epa_per_play(v.plays)


@query("b9_scrimmage_plays", "season:i week:i play_type n:i", f"""
SELECT season, week, play_type, COUNT(*) AS n FROM v_plays WHERE ({PASS}) OR ({RUN}) GROUP BY 1, 2, 3""")
def _b9(v):
    return team_week.scrimmage_plays(v.plays).groupBy("season", "week", "play_type").agg(F.count("*").alias("n"))


@query("b23_b24_play_flags", "posteam season:i explosive:i pressured:i n:i", """
SELECT posteam, season, COUNT(*) FILTER (WHERE yards_gained >= CASE WHEN play_type = 'pass' THEN 20 ELSE 10 END) AS explosive,
  COUNT(*) FILTER (WHERE play_type = 'pass' AND (qb_hit = 1 OR sack = 1)) AS pressured, COUNT(*) AS n
FROM v_plays WHERE play_type IN ('pass', 'run') AND down IS NOT NULL GROUP BY 1, 2""")
def _b23(v):
    return (
        team_week.play_flags(v.plays)
        .groupBy("posteam", "season")
        .agg(F.sum("is_explosive").alias("explosive"), F.sum("is_pressure").alias("pressured"), F.count("*").alias("n"))
    )


@query("g1_team_week_spine", KEY, "SELECT * FROM v_spine")
def _g1(v):
    return team_week.spine(v.plays)


@query("c2_base_stats_on_spine", _spec(team_week.BASE_COUNTS), "SELECT * FROM v_stats")
def _c2(v):
    return team_week.team_week_stats(v.plays)


@query(
    "c3_added_stats_on_spine",
    _spec([*team_week.ADDED_COUNTS, "off_all_play_count", "off_all_epa_sum", "off_epa_per_play_raw"]),
    "SELECT * FROM v_stats",
)
def _c3(v):
    return team_week.team_week_stats(v.plays)


@query(
    "a11_stats_from_stored_sums",
    _spec([*team_week.COUNTS, "off_epa_per_play_raw"]),
    "SELECT team, season, week, "
    + ", ".join(f"CASE WHEN season = 1998 THEN 2 * {c} ELSE {c} END AS {c}" for c in team_week.COUNTS)
    + ", off_epa_per_play_raw FROM v_stats",
)
def _a11_sums(v):
    """Sums of all seasons; then the plays of one season land twice and only that season is summed anew."""
    plays, sums = scratch_path(v.spark, "plays"), scratch_path(v.spark, "sums")
    stored = project_to(v.plays, PLAYS)
    replace_partitions(stored, plays, ["game_id"])
    features.replace_sums(v.spark, plays, sums, [r["season"] for r in stored.select("season").distinct().collect()])
    again = stored.where("season = 1998")
    replace_partitions(again.union(again), plays, ["game_id"])
    features.replace_sums(v.spark, plays, sums, [1998])
    return features.stats_from_sums(v.spark, sums)


@query("e1_prior_sums_base", _spec(f"{c}_cum" for c in team_week.BASE_COUNTS), "SELECT * FROM v_cum")
def _e1(v):
    return team_week.prior_sums(team_week.team_week_stats(v.plays), team_week.BASE_COUNTS)


@query("e2_prior_sums_added", _spec(f"{c}_cum" for c in team_week.ADDED_COUNTS), "SELECT * FROM v_cum")
def _e2(v):
    return team_week.prior_sums(team_week.team_week_stats(v.plays), team_week.ADDED_COUNTS)


@query("e3_base_rates", _spec(BASE_RATES), "SELECT * FROM v_rates")
def _e3(v):
    return team_week.season_to_date(team_week.team_week_stats(v.plays))


@query("e4_added_rates", _spec([c for c in ADDED_RATES if c in RATES]), "SELECT * FROM v_rates")
def _e4(v):
    return team_week.season_to_date(team_week.team_week_stats(v.plays))


@query("e5_trailing_epa", _spec(["rolling_3wk_epa_trend"]), "SELECT * FROM v_cum")
def _e5(v):
    stats = team_week.team_week_stats(v.plays)
    return team_week.trailing_mean(stats, "off_epa_per_play_raw", 3, "rolling_3wk_epa_trend")


@query(
    "e12_final_weeks",
    KEY + " pass_att:i def_pass_att:i",
    "SELECT * FROM v_stats QUALIFY week = MAX(week) OVER (PARTITION BY team, season)",
)
def _e12(v):
    return team_week.final_weeks(team_week.team_week_stats(v.plays))


_FLAGS = {"ol_pass": "pass_att", "ol_rush": "rush_att", "def_pass": "def_pass_att", "def_rush": "def_rush_att"}


@query(
    "e13_sample_flags",
    KEY + " " + " ".join(f"{k}_sample_size:i {k}_sufficient:b" for k in _FLAGS),
    "SELECT team, season, week, "
    + ", ".join(f"{c}_cum AS {k}_sample_size, {c}_cum >= 20 AS {k}_sufficient" for k, c in _FLAGS.items())
    + " FROM v_cum",
)
def _e13(v):
    return team_week.sample_flags(team_week.season_to_date(team_week.team_week_stats(v.plays)))


_RATE_SPEC = " ".join(f"{c}:f" for c in BASE_RATES)
_ADDED_SPEC = " ".join(f"{c}:f" for c in ADDED_RATES)


@query("d13_full_season_base", f"team season:i {_RATE_SPEC}", "SELECT * FROM v_season")
def _d13(v):
    return team_week.full_season_rates(team_week.team_week_stats(v.plays))


@query("d14_full_season_added", f"team season:i {_ADDED_SPEC}", "SELECT * FROM v_season")
def _d14(v):
    return team_week.full_season_rates(team_week.team_week_stats(v.plays))


@query("d15_league_means", f"{_RATE_SPEC} {_ADDED_SPEC}", "SELECT * FROM v_league")
def _d15(v):
    rates = team_week.full_season_rates(team_week.team_week_stats(v.plays))
    return team_week.league_means(rates, BASE_RATES + ADDED_RATES)


@query(
    "c8_prior_season_rates",
    f"team season:i {_RATE_SPEC}",
    "SELECT c.team, c.season, "
    + ", ".join(f"p.{c}" for c in BASE_RATES)
    + " FROM (SELECT DISTINCT team, season FROM v_stats) c LEFT JOIN v_season p ON p.team = c.team AND p.season = c.season - 1",
)
def _c8(v):
    prior = team_week.with_prior_season(team_week.team_week_stats(v.plays))
    names = [F.col(f"prior_{c}").alias(c) for c in BASE_RATES]
    return prior.select("team", "season", *names).distinct()


@query("e18_cold_start_features", _spec(BASE_RATES + ADDED_RATES), "SELECT * FROM v_feat")
def _e18(v):
    return team_week.team_features(v.plays)


@query(
    "g2_team_games",
    KEY + " game_id game_date margin:f win:i loss:i",
    """SELECT *, CASE WHEN margin > 0 THEN 1 ELSE 0 END AS win, CASE WHEN margin < 0 THEN 1 ELSE 0 END AS loss FROM v_tg""",
)
def _g2(v):
    return situational.team_games(v.games)


@query("e6_rest_days", _spec(["rest_days"]), "SELECT * FROM v_sit")
def _e6(v):
    return situational.situational_features(v.games)


@query("e7_form", _spec(["prior_week_margin", "season_win_pct"]), "SELECT * FROM v_sit")
def _e7(v):
    return situational.situational_features(v.games)
