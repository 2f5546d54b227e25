"""The same derived inputs in SQL. ``compose`` heads a query with the views it mentions."""

from __future__ import annotations

import re

from fieldmark.schemas import ADDED_RATES, BASE_RATES, SITUATIONAL, TEAM_FEATURES

NAMES = "[" + ", ".join(f"'{n}'" for n in TEAM_FEATURES) + "]"
N = len(TEAM_FEATURES)

VIEWS: dict[str, str] = {}

VIEWS["v_plays"] = """
SELECT p.*,
  CASE WHEN p.pk = p.bk THEN concat(p.season, '_', lpad(CAST(p.week AS VARCHAR), 2, '0'), '_BYE_', p.posteam)
       WHEN ((p.season + p.week) % 2 = 0) = (p.pk < p.bk)
         THEN concat(p.season, '_', lpad(CAST(p.week AS VARCHAR), 2, '0'), '_', nb.n_name, '_', p.posteam)
       ELSE concat(p.season, '_', lpad(CAST(p.week AS VARCHAR), 2, '0'), '_', p.posteam, '_', nb.n_name) END AS game_id
FROM (
  SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, l.l_suppkey AS supp_key,
    c.c_nationkey AS pk,
    ((2 * month(o.o_orderdate) + year(o.o_orderdate) - c.c_nationkey) % 25 + 25) % 25 AS bk,
    n1.n_name AS posteam, n2.n_name AS defteam,
    CAST(year(o.o_orderdate) AS INT) AS season, CAST(month(o.o_orderdate) AS INT) AS week,
    CASE l.l_returnflag WHEN 'R' THEN 'pass' WHEN 'A' THEN 'run' ELSE 'no_play' END AS play_type,
    CASE WHEN l.l_linenumber <= 4 THEN l.l_linenumber END AS down,
    CASE WHEN l.l_returnflag = 'R' AND l.l_tax >= 0.07 THEN 1 ELSE 0 END AS sack,
    CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' AND l.l_discount >= 0.08 THEN 1 ELSE 0 END AS qb_hit,
    CAST(l.l_quantity AS INT) - 15 AS yards_gained,
    CASE WHEN l.l_linenumber = 7 AND l.l_linestatus = 'F' THEN NULL
         ELSE ROUND((l.l_discount - l.l_tax) * 100) / 4.0 END AS epa,
    CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber <= 3 THEN (l.l_quantity - 25) / 2.0 END AS cpoe
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n1 ON c.c_nationkey = n1.n_nationkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n2 ON s.s_nationkey = n2.n_nationkey
) p JOIN nation nb ON nb.n_nationkey = p.bk
"""

VIEWS["v_raw_plays"] = """
SELECT order_id * 8 + line_no AS play_id, game_id, season, week,
  CASE WHEN line_no = 6 AND yards_gained % 5 = 0 THEN NULL ELSE posteam END AS posteam,
  CASE WHEN line_no = 5 AND yards_gained % 7 = 0 THEN NULL ELSE defteam END AS defteam,
  CASE WHEN play_type = 'no_play' THEN NULL ELSE play_type END AS play_type,
  CAST(down AS VARCHAR) AS down,
  CASE WHEN line_no = 7 THEN 'n/a' ELSE CAST(yards_gained AS VARCHAR) END AS yards_gained,
  epa, CASE WHEN line_no = 5 THEN NULL ELSE CAST(qb_hit AS DOUBLE) END AS qb_hit,
  CASE WHEN line_no = 5 THEN NULL ELSE CAST(sack AS DOUBLE) END AS sack, cpoe,
  CASE line_no WHEN 4 THEN 'none' WHEN 3 THEN 'NaN' ELSE CAST(supp_key AS VARCHAR) END AS passer_player_name,
  CASE WHEN line_no = 2 THEN NULL ELSE CAST(supp_key AS DOUBLE) END AS rusher_player_id
FROM v_plays
"""

VIEWS["v_pts"] = """
SELECT c.c_nationkey AS k, CAST(year(o.o_orderdate) AS INT) AS season, CAST(month(o.o_orderdate) AS INT) AS week,
  CAST(COUNT(*) * 7 % 38 AS INT) AS score
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3
"""

VIEWS["v_games"] = """
SELECT g.*, CASE WHEN home_score - away_score > home_spread_close THEN TRUE
                 WHEN home_score - away_score < home_spread_close THEN FALSE END AS home_covered
FROM (
  SELECT concat(CAST(hw.season AS VARCHAR), '_', lpad(CAST(hw.week AS VARCHAR), 2, '0'), '_', hw.away_team, '_', hw.home_team) AS game_id,
    hw.season, hw.week, make_date(hw.season, hw.week, 1 + (hw.hk % 7)) AS game_date, hw.home_team, hw.away_team,
    CASE WHEN hw.season = 2001 AND hw.week >= 7 THEN NULL ELSE h.score END AS home_score,
    CASE WHEN hw.season = 2001 AND hw.week >= 7 THEN NULL ELSE a.score END AS away_score,
    CAST((hw.hk - hw.ak) % 15 AS DOUBLE) / 2.0 AS home_spread_close,
    40.5 + (hw.hk + hw.ak) % 9 AS total_close,
    CASE hw.hk % 4 WHEN 0 THEN 'dome' WHEN 1 THEN 'retractable' WHEN 2 THEN 'outdoors' END AS roof,
    CASE WHEN hw.hk % 5 = 0 THEN NULL ELSE (hn.n_regionkey = an.n_regionkey) END AS div_game,
    CASE WHEN hw.hk % 6 = 0 THEN NULL ELSE CAST(30 + hw.week * 4 AS DOUBLE) END AS temp,
    CASE WHEN hw.ak % 6 = 0 THEN NULL ELSE CAST(hw.ak AS DOUBLE) END AS wind, hw.hk, hw.ak
  FROM (
    SELECT season, week,
      CASE WHEN (season + week) % 2 = 0 THEN ka ELSE kb END AS hk, CASE WHEN (season + week) % 2 = 0 THEN kb ELSE ka END AS ak,
      CASE WHEN (season + week) % 2 = 0 THEN na ELSE nb END AS home_team, CASE WHEN (season + week) % 2 = 0 THEN nb ELSE na END AS away_team
    FROM (
      SELECT cal.season, cal.week, a.n_nationkey AS ka, b.n_nationkey AS kb, a.n_name AS na, b.n_name AS nb
      FROM (SELECT DISTINCT season, week FROM v_pts) cal CROSS JOIN nation a CROSS JOIN nation b
      WHERE a.n_nationkey < b.n_nationkey AND (a.n_nationkey + b.n_nationkey) % 25 = (cal.week * 2 + cal.season) % 25
    ) pairs
  ) hw
  LEFT JOIN v_pts h ON h.k = hw.hk AND h.season = hw.season AND h.week = hw.week
  LEFT JOIN v_pts a ON a.k = hw.ak AND a.season = hw.season AND a.week = hw.week
  JOIN nation hn ON hn.n_nationkey = hw.hk JOIN nation an ON an.n_nationkey = hw.ak
) g
"""

VIEWS["v_raw_games"] = """
SELECT game_id, season, week, CAST(game_date AS VARCHAR) AS gameday, home_team, away_team,
  COALESCE(CAST(home_score AS VARCHAR), 'nan') AS home_score, COALESCE(CAST(away_score AS VARCHAR), 'None') AS away_score,
  home_spread_close AS spread_line, total_close AS total_line,
  CASE WHEN week = 12 THEN 'POST' ELSE 'REG' END AS game_type, roof,
  CASE WHEN div_game THEN CASE WHEN hk % 2 = 0 THEN 'True' ELSE '1' END
       WHEN NOT div_game THEN CASE WHEN hk % 2 = 0 THEN 'False' ELSE '0' END END AS div_game,
  temp, wind,
  CASE WHEN season % 2 = 1 THEN concat(hk + 1000, '.0') ELSE concat('id-', hk) END AS old_player_id
FROM v_games
"""

VIEWS["v_user_games"] = """
SELECT game_id, CAST(hk * 2 + ak AS VARCHAR) AS crowd FROM v_games WHERE (hk * 3 + ak + week) % 10 <> 0
"""

VIEWS["v_user_team_weeks"] = """
SELECT n.n_name AS team_name, p.season AS year, p.week AS week_number, p.score / 2.0 AS travel
FROM v_pts p JOIN nation n ON n.n_nationkey = p.k WHERE p.k <> 3
"""

# --- team-week features -------------------------------------------------------------------

_PASS = "play_type = 'pass' AND down IS NOT NULL"
_RUN = "play_type = 'run' AND down IS NOT NULL"
_PRESS = f"{_PASS} AND (qb_hit = 1 OR sack = 1)"

SIDE_AGGREGATES = {
    "pass_att": f"COUNT(*) FILTER (WHERE {_PASS})",
    "sacks": f"SUM(sack) FILTER (WHERE {_PASS})",
    "qb_hits": f"SUM(qb_hit) FILTER (WHERE {_PASS})",
    "pass_epa_sum": f"SUM(epa) FILTER (WHERE {_PASS})",
    "rush_att": f"COUNT(*) FILTER (WHERE {_RUN})",
    "rush_epa_sum": f"SUM(epa) FILTER (WHERE {_RUN})",
    "rush_yards_sum": f"SUM(yards_gained) FILTER (WHERE {_RUN})",
    "pass_att_v2": f"COUNT(epa) FILTER (WHERE {_PASS})",
    "pass_explosive_count": f"COUNT(*) FILTER (WHERE {_PASS} AND yards_gained >= 20)",
    "pressure_play_count": f"COUNT(epa) FILTER (WHERE {_PRESS})",
    "pressure_epa_sum": f"SUM(epa) FILTER (WHERE {_PRESS})",
    "cpoe_sum": f"SUM(cpoe) FILTER (WHERE {_PASS})",
    "cpoe_count": f"COUNT(cpoe) FILTER (WHERE {_PASS})",
    "rush_att_v2": f"COUNT(epa) FILTER (WHERE {_RUN})",
    "rush_explosive_count": f"COUNT(*) FILTER (WHERE {_RUN} AND yards_gained >= 10)",
    "total_play_count": "COUNT(epa) FILTER (WHERE down IS NOT NULL)",
    "total_epa_sum": "SUM(epa) FILTER (WHERE down IS NOT NULL)",
}
OFFENCE = [c for c in SIDE_AGGREGATES if not c.startswith("total_")]
DEFENCE = [
    "pass_att",
    "sacks",
    "qb_hits",
    "pass_epa_sum",
    "rush_att",
    "rush_epa_sum",
    "rush_yards_sum",
    "total_play_count",
    "total_epa_sum",
    "pass_att_v2",
    "pass_explosive_count",
    "rush_att_v2",
    "rush_explosive_count",
]
COUNT_COLUMNS = OFFENCE + [f"def_{c}" for c in DEFENCE]


def _side(team: str, cols: list[str], prefix: str) -> str:
    return (
        f"SELECT {team} AS team, season, week, "
        + ", ".join(f"COALESCE({SIDE_AGGREGATES[c]}, 0) AS {prefix}{c}" for c in cols)
        + f" FROM v_plays WHERE {team} IS NOT NULL GROUP BY 1, 2, 3"
    )


VIEWS["v_off"] = _side("posteam", OFFENCE, "")
VIEWS["v_def"] = _side("defteam", DEFENCE, "def_")
VIEWS["v_spine"] = """
SELECT posteam AS team, season, week FROM v_plays WHERE play_type IN ('pass', 'run')
UNION SELECT defteam, season, week FROM v_plays WHERE play_type IN ('pass', 'run')
"""
VIEWS["v_stats"] = (
    "SELECT s.team, s.season, s.week, "
    + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in COUNT_COLUMNS)
    + ", COALESCE(pass_att_v2 + rush_att_v2, 0) AS off_all_play_count"
    + ", COALESCE(pass_epa_sum + rush_epa_sum, 0) AS off_all_epa_sum"
    + ", COALESCE((pass_epa_sum + rush_epa_sum) / GREATEST(pass_att_v2 + rush_att_v2, 1), 0) AS off_epa_per_play_raw"
    + " FROM v_spine s LEFT JOIN v_off o ON o.team = s.team AND o.season = s.season AND o.week = s.week"
    + " LEFT JOIN v_def d ON d.team = s.team AND d.season = s.season AND d.week = s.week"
)

# rate -> (numerator, denominator, minimum sample)
RATES = {
    "ol_sack_rate": ("sacks", "pass_att", 0),
    "ol_qb_hit_rate": ("qb_hits", "pass_att", 0),
    "ol_pressure_proxy_rate": ("sacks + qb_hits", "pass_att", 0),
    "ol_pass_epa_per_att": ("pass_epa_sum", "pass_att", 0),
    "ol_rush_epa_per_att": ("rush_epa_sum", "rush_att", 0),
    "ol_rush_yards_per_att": ("rush_yards_sum", "rush_att", 0),
    "def_sack_rate": ("def_sacks", "def_pass_att", 0),
    "def_qb_hit_rate": ("def_qb_hits", "def_pass_att", 0),
    "def_pressure_proxy_rate": ("def_sacks + def_qb_hits", "def_pass_att", 0),
    "def_pass_epa_allowed_per_att": ("def_pass_epa_sum", "def_pass_att", 0),
    "def_rush_epa_allowed_per_att": ("def_rush_epa_sum", "def_rush_att", 0),
    "def_rush_yards_allowed_per_att": ("def_rush_yards_sum", "def_rush_att", 0),
    "qb_cpoe": ("cpoe_sum", "cpoe_count", 20),
    "qb_epa_under_pressure": ("pressure_epa_sum", "pressure_play_count", 20),
    "pass_explosive_rate": ("pass_explosive_count", "pass_att_v2", 0),
    "rush_explosive_rate": ("rush_explosive_count", "rush_att_v2", 0),
    "def_epa_per_play": ("def_total_epa_sum", "def_total_play_count", 0),
    "def_explosive_pass_allowed_rate": ("def_pass_explosive_count", "def_pass_att_v2", 0),
    "def_explosive_rush_allowed_rate": ("def_rush_explosive_count", "def_rush_att_v2", 0),
}


def _rate(name: str, suffix: str) -> str:
    num, den, minimum = RATES[name]
    num = " + ".join(f"{n}{suffix}" for n in num.split(" + "))
    return f"CASE WHEN {den}{suffix} >= {minimum} THEN ({num}) / ({den}{suffix} + 1e-9) END AS {name}"


VIEWS["v_cum"] = (
    "SELECT *, "
    + ", ".join(f"COALESCE(SUM({c}) OVER prior, 0) AS {c}_cum" for c in COUNT_COLUMNS)
    + ", AVG(off_epa_per_play_raw) OVER (PARTITION BY team, season ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
    + " AS rolling_3wk_epa_trend FROM v_stats"
    + " WINDOW prior AS (PARTITION BY team, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)
VIEWS["v_rates"] = "SELECT *, " + ", ".join(_rate(r, "_cum") for r in RATES) + " FROM v_cum"
VIEWS["v_season"] = (
    "SELECT team, season, "
    + ", ".join(_rate(r, "") for r in RATES)
    + ", off_all_epa_sum / GREATEST(off_all_play_count, 1) AS rolling_3wk_epa_trend FROM (SELECT team, season, "
    + ", ".join(f"SUM({c}) AS {c}" for c in [*COUNT_COLUMNS, "off_all_play_count", "off_all_epa_sum"])
    + " FROM v_stats GROUP BY 1, 2) t"
)
_ALL = BASE_RATES + ADDED_RATES
VIEWS["v_league"] = (
    "SELECT "
    + ", ".join(f"AVG({c}) AS {c}" for c in _ALL)
    + " FROM v_season WHERE season = (SELECT MIN(season) FROM v_season)"
)
VIEWS["v_feat"] = (
    "SELECT r.team, r.season, r.week, r.pass_att_cum, r.rush_att_cum, r.def_pass_att_cum, r.def_rush_att_cum, "
    + ", ".join(f"CASE WHEN r.week = 1 THEN COALESCE(p.{c}, l.{c}) ELSE r.{c} END AS {c}" for c in _ALL)
    + " FROM v_rates r LEFT JOIN v_season p ON p.team = r.team AND p.season + 1 = r.season CROSS JOIN v_league l"
)
VIEWS["v_tg"] = """
SELECT game_id, season, week, game_date, home_team AS team, COALESCE(home_score - away_score, 0) AS margin FROM v_games
UNION ALL
SELECT game_id, season, week, game_date, away_team, COALESCE(away_score - home_score, 0) FROM v_games
"""
VIEWS["v_sit"] = """
SELECT team, season, week,
  LEAST(21, GREATEST(3, COALESCE(date_diff('day', LAG(game_date) OVER w, game_date), 14))) AS rest_days,
  COALESCE(LAG(margin) OVER w, 0) AS prior_week_margin,
  CASE WHEN COALESCE(SUM(CASE WHEN margin <> 0 THEN 1 ELSE 0 END) OVER p, 0) = 0 THEN 0.5
       ELSE SUM(CASE WHEN margin > 0 THEN 1 ELSE 0 END) OVER p * 1.0 / SUM(CASE WHEN margin <> 0 THEN 1 ELSE 0 END) OVER p END AS season_win_pct
FROM v_tg
WINDOW w AS (PARTITION BY team, season ORDER BY week),
  p AS (PARTITION BY team, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""
VIEWS["v_team"] = (
    "SELECT f.team, f.season, f.week, "
    + ", ".join(f"f.{c}" for c in _ALL)
    + ", "
    + ", ".join(f"s.{c}" for c in SITUATIONAL)
    + " FROM v_feat f LEFT JOIN v_sit s ON s.team = f.team AND s.season = f.season AND s.week = f.week"
)
VIEWS["v_indoor"] = """
SELECT *, COALESCE(roof IN ('dome', 'retractable'), FALSE) AS indoor,
  CASE WHEN COALESCE(roof IN ('dome', 'retractable'), FALSE) THEN 70.0 ELSE temp END AS temp0
FROM v_games
"""
VIEWS["v_matrix"] = (
    "SELECT g.game_id, g.season, g.week, g.game_date, g.home_team, g.away_team, g.home_score, g.away_score,"
    " g.home_spread_close, g.total_close, g.home_covered, g.roof, g.hk, g.ak, 1 AS home_advantage,"
    " CASE WHEN g.div_game THEN 1 ELSE 0 END AS div_game, CASE WHEN g.indoor THEN 1 ELSE 0 END AS roof_dome,"
    " COALESCE(g.temp0, (SELECT quantile_cont(temp0, 0.5) FROM v_indoor)) AS temp,"
    " CASE WHEN g.indoor THEN 0.0 ELSE COALESCE(g.wind, 0.0) END AS wind, "
    + ", ".join(f"h.{c} AS home_{c}" for c in TEAM_FEATURES)
    + ", "
    + ", ".join(f"a.{c} AS away_{c}" for c in TEAM_FEATURES)
    + ", h.rest_days - a.rest_days AS rest_differential"
    + " FROM v_indoor g LEFT JOIN v_team h ON h.team = g.home_team AND h.season = g.season AND h.week = g.week"
    + " LEFT JOIN v_team a ON a.team = g.away_team AND a.season = g.season AND a.week = g.week"
)

# --- mismatch -----------------------------------------------------------------------------

Z_INPUTS = ["ol_pass_epa_per_att", "ol_pressure_proxy_rate", "def_pressure_proxy_rate", "def_pass_epa_allowed_per_att"]
_UPTO = "PARTITION BY season ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
VIEWS["v_pool"] = (
    "SELECT game_id, season, week, 'home' AS side, "
    + ", ".join(f"home_{c} AS {c}" for c in Z_INPUTS)
    + " FROM v_matrix UNION ALL SELECT game_id, season, week, 'away', "
    + ", ".join(f"away_{c}" for c in Z_INPUTS)
    + " FROM v_matrix"
)
VIEWS["v_z"] = (
    "SELECT game_id, season, week, side, "
    + ", ".join(
        f"CASE WHEN stddev_samp({c}) OVER w > 1e-9 THEN ({c} - AVG({c}) OVER w) / stddev_samp({c}) OVER w ELSE 0 END AS {c}_z"
        for c in Z_INPUTS
    )
    + f" FROM v_pool WINDOW w AS ({_UPTO})"
)
VIEWS["v_comp"] = (
    "SELECT *, ol_pass_epa_per_att_z - ol_pressure_proxy_rate_z AS ol_composite,"
    " def_pressure_proxy_rate_z - def_pass_epa_allowed_per_att_z AS def_composite FROM v_z"
)
VIEWS["v_cut"] = (
    "SELECT DISTINCT season, week, quantile_cont(ol_composite, 0.75) OVER w AS off_p75, COUNT(ol_composite) OVER w AS off_n,"
    " quantile_cont(def_composite, 0.25) OVER w AS def_p25, COUNT(def_composite) OVER w AS def_n"
    f" FROM v_comp WINDOW w AS ({_UPTO})"
)
VIEWS["v_flag"] = """
SELECT h.game_id, h.season, h.week, h.ol_composite AS home_ol_composite, a.ol_composite AS away_ol_composite,
  h.def_composite AS home_def_composite, a.def_composite AS away_def_composite,
  CASE WHEN c.off_n < 4 OR c.def_n < 4 THEN 0
       WHEN h.ol_composite >= c.off_p75 AND a.def_composite <= c.def_p25 THEN 1
       WHEN a.ol_composite >= c.off_p75 AND h.def_composite <= c.def_p25 THEN 2 ELSE 0 END AS ol_mismatch_flag
FROM v_comp h JOIN v_comp a ON a.game_id = h.game_id AND a.side = 'away' AND h.side = 'home'
LEFT JOIN v_cut c ON c.season = h.season AND c.week = h.week
"""

# --- predictions and registries -----------------------------------------------------------

VIEWS["v_preds"] = """
SELECT concat('run_p', w.r) AS run_id, concat('exp_p', w.r % 2) AS experiment_id,
  g.season - f.first - 3 AS fold, g.game_id, g.season, g.week, g.home_team, g.away_team, g.home_spread_close,
  g.p AS predicted_home_cover_prob, CASE WHEN g.p > 0.5 THEN 'home' ELSE 'away' END AS predicted_side,
  g.home_covered AS actual_home_covered,
  CASE WHEN g.home_covered IS NOT NULL THEN CASE WHEN (g.p > 0.5) = g.home_covered THEN 1 ELSE 0 END END AS correct,
  g.hk % 3 AS ol_mismatch_flag
FROM (
  SELECT g.*, w.r, ((g.hk * w.a + g.ak * w.b + g.week * 5 + g.season) % 100 + 0.5) / 100.0 AS p
  FROM v_games g CROSS JOIN (VALUES (1, 37, 17), (2, 13, 29), (3, 7, 3)) AS w(r, a, b)
) g JOIN (VALUES (1), (2), (3)) AS w(r) ON w.r = g.r
CROSS JOIN (SELECT MIN(season) AS first FROM v_games) f
WHERE g.season >= f.first + 4
"""
VIEWS["v_pruns"] = f"""
SELECT b.run_id, b.experiment_id, concat('scores ', b.run_id) AS name,
  TIMESTAMP '2002-01-01 00:00:00' + to_days(CAST(b.i + v.v * 10 AS INT)) AS run_at,
  TIMESTAMP '2002-01-01 01:00:00' + to_days(CAST(b.i + v.v * 10 AS INT)) AS completed_at,
  CASE WHEN v.v = 0 THEN 0.5 ELSE b.hit END AS ats_hit_rate, b.n AS n_games_evaluated, v.v = 1 AS gate_passed,
  'complete' AS status, b.i
FROM (
  SELECT run_id, experiment_id, CAST(substr(run_id, 6) AS INT) AS i,
    CAST(COUNT(*) FILTER (WHERE correct = 1) AS DOUBLE) / NULLIF(COUNT(correct), 0) AS hit, COUNT(correct) AS n
  FROM v_preds GROUP BY 1, 2
) b CROSS JOIN (VALUES (0), (1)) AS v(v)
"""
VIEWS["v_pimp"] = f"""
SELECT DISTINCT run_id, unnest([concat('home_', {NAMES}[i % {N} + 1]), concat('away_', {NAMES}[(i + 1) % {N} + 1]), 'temp']) AS feature,
  unnest([0.25, 0.5, 0.125]) AS importance
FROM v_pruns
"""
VIEWS["v_ev"] = "SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"
VIEWS["v_cfg_log"] = f"""
SELECT concat('exp_', user_id) AS experiment_id, event_id AS seq, ts AS updated_at, concat('experiment ', user_id) AS name,
  CASE WHEN user_id % 4 = 0 THEN 'home_margin' ELSE 'home_covered' END AS target,
  CASE event_type WHEN 'signup' THEN 'draft' WHEN 'view' THEN 'draft' WHEN 'click' THEN 'running'
    WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS status,
  CASE WHEN event_type = 'purchase' THEN value >= 50 END AS gate_passed,
  {NAMES}[k % {N} + 1] AS ref_base, {NAMES}[(k * 7 + 1) % {N} + 1] AS ref_side, event_id % 1600 AS ref_ds, k % 6 AS ref_col, k
FROM v_ev
"""
VIEWS["v_cfg"] = """
SELECT * FROM v_cfg_log QUALIFY ROW_NUMBER() OVER (PARTITION BY experiment_id ORDER BY updated_at DESC, seq DESC) = 1
"""
VIEWS["v_refs"] = """
SELECT experiment_id, 0 AS pos, 'curated' AS dataset, ref_base AS "column" FROM v_cfg
UNION ALL SELECT experiment_id, 1, 'curated', concat('home_', ref_side) FROM v_cfg
UNION ALL SELECT experiment_id, 2, 'curated', concat('away_', ref_side) FROM v_cfg
UNION ALL SELECT experiment_id, 3, concat('user_datasets.ds_', ref_ds), concat('c', ref_col) FROM v_cfg
UNION ALL SELECT experiment_id, 4, 'curated', 'mystery_metric' FROM v_cfg WHERE k % 5 = 0
"""
VIEWS["v_runs"] = f"""
SELECT concat('run_', event_id - event_id % 3) AS run_id, concat('exp_', user_id) AS experiment_id, event_id AS seq,
  concat('run of ', user_id) AS name, ts AS run_at, ts + INTERVAL 2 MINUTE AS completed_at,
  CASE WHEN event_type = 'purchase' THEN 'complete' ELSE 'failed' END AS status,
  CASE WHEN event_type = 'purchase' THEN 0.45 + k / 500.0 END AS ats_hit_rate,
  CASE WHEN event_type = 'purchase' THEN 200 + k END AS n_games_evaluated,
  CASE WHEN event_type = 'purchase' THEN 0.45 + k / 500.0 >= 0.54 AND 200 + k >= 250 ELSE FALSE END AS gate_passed,
  k % 7 AS folds_complete, 6 AS folds_total, 2 + k % 3 AS training_window_years,
  CASE WHEN k % 10 = 0 THEN '[SHUFFLE_LABELS=True]' END AS notes,
  CASE WHEN event_type <> 'purchase' THEN 'model fit failed' END AS error_message, {NAMES}[k % {N} + 1] AS imp_name, k
FROM v_ev WHERE event_type IN ('purchase', 'error') AND user_id % 7 <> 0
"""
VIEWS["v_latest_runs"] = """
SELECT * FROM v_runs QUALIFY ROW_NUMBER() OVER (PARTITION BY experiment_id ORDER BY run_at DESC, run_id DESC) = 1
"""
VIEWS["v_ds_log"] = """
SELECT concat('ds_', o_custkey) AS dataset_id, o_orderkey AS seq, o_orderdate AS updated_at, o_orderdate AS upload_date,
  CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'uploading' ELSE 'mapping' END AS status,
  CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN 'restricted' WHEN '1' THEN NULL ELSE 'open' END AS license_tag,
  CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 'game_id' WHEN '3' THEN 'team_season_week' WHEN '4' THEN 'player_season_week' END AS join_key_type,
  o_orderkey % 11 = 0 AS deleted
FROM orders
"""
VIEWS["v_ds"] = """
SELECT * FROM v_ds_log QUALIFY ROW_NUMBER() OVER (PARTITION BY dataset_id ORDER BY updated_at DESC, seq DESC) = 1
"""
VIEWS["v_dcols"] = """
SELECT concat('ds_', o_custkey) AS dataset_id, concat('c', o_orderkey % 6) AS column_name, o_orderkey AS seq,
  CASE WHEN o_orderkey % 4 <> 0 THEN concat('metric ', o_orderkey % 6) END AS semantic_name,
  CASE o_orderkey % 3 WHEN 0 THEN 'categorical' WHEN 1 THEN 'numeric' END AS data_type,
  o_orderkey % 6 = 0 AS is_join_key, (o_orderkey % 100) / 100.0 AS null_rate
FROM orders
QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderkey % 6 ORDER BY o_orderkey DESC) = 1
"""


def _used(text: str) -> list[str]:
    found = set(re.findall(r"\bv_[a-z0-9_]+\b", text))
    return [name for name in VIEWS if name in found]


def compose(body: str) -> str:
    """``WITH`` the views a statement needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _used(text):
            if name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order) + "\n" + body
