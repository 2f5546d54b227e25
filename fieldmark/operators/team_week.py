"""Season-to-date team-week features from plays.

Plan: plays are first reduced to one row per (offence, defence, season, week) - a partial
aggregate that shrinks the data map-side whatever the team mix - and both team perspectives
are read off that small table. Windows then run over at most one row per week of a season.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.expr import at_least, eps_rate, pressured, sampled_rate
from fieldmark.schemas import ADDED_RATES, BASE_RATES, MIN_SAMPLE

KEY = ["team", "season", "week"]
PAIR_KEY = ["posteam", "defteam", "season", "week", "kind"]

# Explosive gain thresholds in yards.
PASS_EXPLOSIVE_YARDS = 20
RUN_EXPLOSIVE_YARDS = 10


# Output column -> measure, as seen by the team with the ball and by the team without it.
OFFENCE_BASE = {
    c: c
    for c in ["pass_att", "sacks", "qb_hits", "pass_epa_sum", "rush_att", "rush_epa_sum", "rush_yards_sum"]
}
DEFENCE_BASE = {f"def_{c}": c for c in OFFENCE_BASE}
OFFENCE_ADDED = {
    c: c
    for c in [
        "pass_att_v2",
        "pass_explosive_count",
        "pressure_play_count",
        "pressure_epa_sum",
        "cpoe_sum",
        "cpoe_count",
        "rush_att_v2",
        "rush_explosive_count",
    ]
}
DEFENCE_ADDED = {
    f"def_{c}": c
    for c in [
        "total_play_count",
        "total_epa_sum",
        "pass_att_v2",
        "pass_explosive_count",
        "rush_att_v2",
        "rush_explosive_count",
    ]
}
BASE_COUNTS = [*OFFENCE_BASE, *DEFENCE_BASE]
ADDED_COUNTS = [*OFFENCE_ADDED, *DEFENCE_ADDED]
COUNTS = BASE_COUNTS + ADDED_COUNTS

# Families of the per-side aggregates: the kinds of play they cover, the columns they carry, and the
# measure that is above 0 where a team has such plays.
FAMILIES = {
    "pass": (["pass"], ["pass_att", "sacks", "qb_hits", "pass_epa_sum"], "n"),
    "run": (["run"], ["rush_att", "rush_epa_sum", "rush_yards_sum"], "n"),
    "pass_added": (["pass"], ["pass_att_v2", "pass_explosive_count"], "n"),
    "run_added": (["run"], ["rush_att_v2", "rush_explosive_count"], "n"),
    "pressure": (["pass"], ["pressure_play_count", "pressure_epa_sum"], "hurried"),
    "cpoe": (["pass"], ["cpoe_sum", "cpoe_count"], "cpoe_n"),
    "all": (["pass", "run", "other"], ["total_play_count", "total_epa_sum"], "n"),
}


def scrimmage_plays(plays: DataFrame, kinds=("pass", "run")) -> DataFrame:
    return plays.where(F.col("play_type").isin(*kinds) & F.col("down").isNotNull())


def play_flags(plays: DataFrame) -> DataFrame:
    """Explosive and pressure indicators on scrimmage plays; missing yards count as 0."""
    limit = F.when(F.col("play_type") == "pass", PASS_EXPLOSIVE_YARDS).otherwise(RUN_EXPLOSIVE_YARDS)
    return scrimmage_plays(plays).withColumns(
        {
            "is_explosive": at_least(F.col("yards_gained"), limit),
            "is_pressure": F.when(F.col("play_type") == "pass", pressured(F.col("qb_hit"), F.col("sack"))).otherwise(0),
        }
    )


def side_stats(plays: DataFrame, side: str, family: str) -> DataFrame:
    """One aggregate family from one perspective; teams without such plays have no row."""
    kinds, cols, present = FAMILIES[family]
    prefix, parts = ("def_", _DEFENCE_PARTS) if side == "defence" else ("", _OFFENCE_PARTS)
    mine = F.col("has_ball") if side == "offence" else ~F.col("has_ball")
    return (
        side_sums(pair_week_sums(plays))
        .where(mine & F.col("kind").isin(kinds))
        .groupBy(*KEY)
        .agg(F.sum(present).alias("_present"), *[F.coalesce(F.sum(parts[prefix + c][1]), F.lit(0)).alias(prefix + c) for c in cols])
        .where("_present > 0")
        .drop("_present")
    )


def offence_epa_per_play(plays: DataFrame) -> DataFrame:
    """All pass and run plays with a down: count, EPA sum and EPA per play (count at least 1)."""
    return (
        side_sums(pair_week_sums(plays))
        .where(F.col("has_ball") & F.col("kind").isin("pass", "run"))
        .groupBy(*KEY)
        .agg(F.sum("epa_n").alias("off_all_play_count"), F.coalesce(F.sum("epa"), F.lit(0)).alias("off_all_epa_sum"))
        .withColumn("off_epa_per_play_raw", _epa_per_play())
    )


def _epa_per_play() -> Column:
    return F.col("off_all_epa_sum") / F.greatest(F.col("off_all_play_count"), F.lit(1))


def spine(plays: DataFrame) -> DataFrame:
    """Team-weeks with at least one pass or run play on either side."""
    live = plays.where(F.col("play_type").isin("pass", "run"))
    off = live.select(F.col("posteam").alias("team"), "season", "week")
    dfn = live.select(F.col("defteam").alias("team"), "season", "week")
    return off.union(dfn).where(F.col("team").isNotNull()).distinct()


def play_kind() -> Column:
    """pass / run / other for plays with a down, ``live`` for pass and run plays without one."""
    live = F.col("play_type").isin("pass", "run")
    downed = F.col("down").isNotNull()
    return F.when(downed, F.when(live, F.col("play_type")).otherwise("other")).when(live, "live")


# Additive measures of a group of plays of one kind. Inside a kind no condition on the play
# type is left, so each row costs a handful of plain sums.
def kind_measures() -> dict[str, Column]:
    epa, yards = F.col("epa"), F.col("yards_gained")
    sack, hit = F.coalesce(F.col("sack").cast("int"), F.lit(0)), F.coalesce(F.col("qb_hit").cast("int"), F.lit(0))
    limit = F.when(F.col("kind") == "pass", PASS_EXPLOSIVE_YARDS).otherwise(RUN_EXPLOSIVE_YARDS)
    under_pressure = pressured(hit, sack) == 1
    hurried = F.when(under_pressure, epa)
    return {
        "n": F.count("*"),
        "sacks": F.sum(sack),
        "hits": F.sum(hit),
        "epa": F.sum(epa),
        "epa_n": F.count(epa),
        "yards": F.sum(yards),
        "explosive": F.sum(at_least(yards, limit)),
        "hurried": F.count_if(under_pressure),
        "hurried_n": F.count(hurried),
        "hurried_epa": F.sum(hurried),
        "cpoe": F.sum("cpoe"),
        "cpoe_n": F.count("cpoe"),
    }


# Output count -> (kinds it covers, measure).
_OFFENCE_PARTS = {
    "pass_att": (["pass"], "n"),
    "sacks": (["pass"], "sacks"),
    "qb_hits": (["pass"], "hits"),
    "pass_epa_sum": (["pass"], "epa"),
    "rush_att": (["run"], "n"),
    "rush_epa_sum": (["run"], "epa"),
    "rush_yards_sum": (["run"], "yards"),
    "pass_att_v2": (["pass"], "epa_n"),
    "pass_explosive_count": (["pass"], "explosive"),
    "pressure_play_count": (["pass"], "hurried_n"),
    "pressure_epa_sum": (["pass"], "hurried_epa"),
    "cpoe_sum": (["pass"], "cpoe"),
    "cpoe_count": (["pass"], "cpoe_n"),
    "rush_att_v2": (["run"], "epa_n"),
    "rush_explosive_count": (["run"], "explosive"),
}
_DEFENCE_PARTS = {
    "def_total_play_count": (["pass", "run", "other"], "epa_n"),
    "def_total_epa_sum": (["pass", "run", "other"], "epa"),
    **{f"def_{c}": _OFFENCE_PARTS[c] for c in DEFENCE_BASE.values()},
    **{f"def_{c}": _OFFENCE_PARTS[c] for c in DEFENCE_ADDED.values() if not c.startswith("total_")},
}


def pair_week_sums(plays: DataFrame) -> DataFrame:
    """Plain sums per (offence, defence, season, week, kind). Sums of parts of the plays may be kept and summed again."""
    return (
        plays.withColumn("kind", play_kind())
        .where(F.col("kind").isNotNull())
        .groupBy(*PAIR_KEY)
        .agg(*[e.alias(n) for n, e in kind_measures().items()])
    )


def side_sums(pair_weeks: DataFrame) -> DataFrame:
    """The same sums per team-week and kind, with the ball and without it."""
    both = F.array(
        F.struct(F.col("posteam").alias("team"), F.lit(True).alias("has_ball")),
        F.struct(F.col("defteam").alias("team"), F.lit(False).alias("has_ball")),
    )
    return (
        pair_weeks.select("*", F.inline(both))
        .where(F.col("team").isNotNull())
        .groupBy(*KEY, "has_ball", "kind")
        .agg(*[F.sum(n).alias(n) for n in kind_measures()])
    )


def team_week_stats(plays: DataFrame) -> DataFrame:
    """All 28 counts on the team-week spine from one scan and without a join.

    First pass: plain sums per (offence, defence, season, week, kind). Second pass, on that
    small table: each row is seen by both teams, summed per team and kind, then the few rows of
    a team-week are spread over the 28 columns.
    """
    return stats_of_sums(pair_week_sums(plays))


def stats_of_sums(pair_weeks: DataFrame) -> DataFrame:
    """``team_week_stats`` of the plays behind ``pair_week_sums``."""

    def total(has_ball: bool, kinds: list[str], measure: str) -> Column:
        mine = F.col("has_ball") if has_ball else ~F.col("has_ball")
        picked = F.sum(F.when(mine & F.col("kind").isin(kinds), F.col(measure)))
        return F.coalesce(picked.cast("double"), F.lit(0.0))

    parts = {**{c: (True, *p) for c, p in _OFFENCE_PARTS.items()}, **{c: (False, *p) for c, p in _DEFENCE_PARTS.items()}}
    return (
        side_sums(pair_weeks)
        .groupBy(*KEY)
        .agg(
            F.max(F.col("kind") != "other").alias("_live"),
            *[total(*parts[c]).alias(c) for c in COUNTS],
        )
        .where("_live")
        .drop("_live")
        .withColumns(
            {
                "off_all_play_count": F.col("pass_att_v2") + F.col("rush_att_v2"),
                "off_all_epa_sum": F.col("pass_epa_sum") + F.col("rush_epa_sum"),
            }
        )
        .withColumn("off_epa_per_play_raw", _epa_per_play())
    )


def _season_order():
    return Window.partitionBy("team", "season").orderBy("week")


def prior_sums(stats: DataFrame, cols: list[str]) -> DataFrame:
    """Running sums over earlier weeks of the season as ``<col>_cum``; 0 before the first."""
    before = _season_order().rowsBetween(Window.unboundedPreceding, -1)
    return stats.withColumns(
        {f"{c}_cum": F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in cols}
    )


def base_rates(suffix: str) -> dict[str, Column]:
    """The 12 base rates over counts named with the suffix."""

    def n(name: str) -> Column:
        return F.col(name + suffix)

    out = {}
    for prefix, side, allowed in (("", "ol", ""), ("def_", "def", "_allowed")):
        att, rush = n(f"{prefix}pass_att"), n(f"{prefix}rush_att")
        sacks, hits = n(f"{prefix}sacks"), n(f"{prefix}qb_hits")
        out[f"{side}_sack_rate"] = eps_rate(sacks, att)
        out[f"{side}_qb_hit_rate"] = eps_rate(hits, att)
        out[f"{side}_pressure_proxy_rate"] = eps_rate(sacks + hits, att)
        out[f"{side}_pass_epa{allowed}_per_att"] = eps_rate(n(f"{prefix}pass_epa_sum"), att)
        out[f"{side}_rush_epa{allowed}_per_att"] = eps_rate(n(f"{prefix}rush_epa_sum"), rush)
        out[f"{side}_rush_yards{allowed}_per_att"] = eps_rate(n(f"{prefix}rush_yards_sum"), rush)
    return out


def added_rates(suffix: str) -> dict[str, Column]:
    """The 7 additional rates; the two sparse ones need a minimum sample."""

    def n(name: str) -> Column:
        return F.col(name + suffix)

    return {
        "qb_cpoe": sampled_rate(n("cpoe_sum"), n("cpoe_count")),
        "qb_epa_under_pressure": sampled_rate(n("pressure_epa_sum"), n("pressure_play_count")),
        "pass_explosive_rate": eps_rate(n("pass_explosive_count"), n("pass_att_v2")),
        "rush_explosive_rate": eps_rate(n("rush_explosive_count"), n("rush_att_v2")),
        "def_epa_per_play": eps_rate(n("def_total_epa_sum"), n("def_total_play_count")),
        "def_explosive_pass_allowed_rate": eps_rate(n("def_pass_explosive_count"), n("def_pass_att_v2")),
        "def_explosive_rush_allowed_rate": eps_rate(n("def_rush_explosive_count"), n("def_rush_att_v2")),
    }


def trailing_mean(stats: DataFrame, column: str, rows: int, name: str) -> DataFrame:
    """Mean of the previous rows of the season, current row excluded; a bye is a missing row."""
    window = _season_order().rowsBetween(-rows, -1)
    return stats.withColumn(name, F.avg(column).over(window))


def season_to_date(stats: DataFrame) -> DataFrame:
    """Rates from earlier weeks only, before the week-1 fill."""
    summed = prior_sums(stats, COUNTS)
    rates = summed.withColumns({**base_rates("_cum"), **added_rates("_cum")})
    return trailing_mean(rates, "off_epa_per_play_raw", 3, "rolling_3wk_epa_trend")


def sample_flags(df: DataFrame, minimum: int = MIN_SAMPLE) -> DataFrame:
    sizes = {
        "ol_pass": "pass_att_cum",
        "ol_rush": "rush_att_cum",
        "def_pass": "def_pass_att_cum",
        "def_rush": "def_rush_att_cum",
    }
    return df.withColumns(
        {
            **{f"{k}_sample_size": F.col(c) for k, c in sizes.items()},
            **{f"{k}_sufficient": F.col(c) >= minimum for k, c in sizes.items()},
        }
    )


def full_season_rates(stats: DataFrame) -> DataFrame:
    """Rates over whole seasons; the trend is total EPA over total plays."""
    totals = stats.groupBy("team", "season").agg(
        *[F.sum(c).alias(c) for c in [*COUNTS, "off_all_play_count", "off_all_epa_sum"]]
    )
    return totals.select(
        "team",
        "season",
        *[e.alias(n) for n, e in {**base_rates(""), **added_rates("")}.items()],
        _epa_per_play().alias("rolling_3wk_epa_trend"),
    )


def final_weeks(stats: DataFrame) -> DataFrame:
    """Rows of each team's last week of a season."""
    last = F.max("week").over(Window.partitionBy("team", "season"))
    return stats.withColumn("_last", last).where(F.col("week") == F.col("_last")).drop("_last")


def league_means(season_rates: DataFrame, cols: list[str], as_of: int | None = None) -> DataFrame:
    """Unweighted mean over teams in the earliest season, one row.

    ``as_of`` limits the seasons considered, for callers that must not look ahead.
    """
    known = season_rates if as_of is None else season_rates.where(F.col("season") <= as_of)
    by_season = known.groupBy("season").agg(*[F.avg(c).alias(c) for c in cols])
    return by_season.agg(*[F.min_by(c, "season").alias(c) for c in cols])


def with_prior_season(stats: DataFrame) -> DataFrame:
    """Add last season's full rates as ``prior_<rate>``, NULL where the team did not play it.

    A range frame of exactly one season back replaces a self-join; a team's history is at most
    one row per week, so partitioning by team alone stays small.
    """
    back = Window.partitionBy("team").orderBy("season").rangeBetween(-1, -1)
    names = [*COUNTS, "off_all_play_count", "off_all_epa_sum"]
    totals = stats.withColumns({f"{c}_prior": F.sum(c).over(back) for c in names})
    trend = F.col("off_all_epa_sum_prior") / F.greatest(F.col("off_all_play_count_prior"), F.lit(1))
    rates = {**base_rates("_prior"), **added_rates("_prior")}
    rates["rolling_3wk_epa_trend"] = F.when(F.col("off_all_play_count_prior").isNotNull(), trend)
    return totals.withColumns({f"prior_{n}": e for n, e in rates.items()}).drop(*[f"{c}_prior" for c in names])


def fill_week_one(df: DataFrame, league: DataFrame, cols: list[str]) -> DataFrame:
    """Week 1 takes last season's full rates (``prior_<rate>``), else the one-row league mean."""
    means = league.select(F.struct(*cols)).scalar()
    return (
        df.withColumn("_league", means)
        .withColumns(
            {
                c: F.when(
                    F.col("week") == 1, F.coalesce(F.col(f"prior_{c}"), F.col("_league").getField(c))
                ).otherwise(F.col(c))
                for c in cols
            }
        )
        .drop("_league", *[f"prior_{c}" for c in cols])
    )


def team_features(plays: DataFrame, as_of: int | None = None) -> DataFrame:
    """Base and additional features per team-week, week 1 filled, with sample flags."""
    return features_of_stats(team_week_stats(plays), as_of)


def features_of_stats(stats: DataFrame, as_of: int | None = None) -> DataFrame:
    """``team_features`` from the counts of ``team_week_stats``."""
    rates = sample_flags(season_to_date(with_prior_season(stats)))
    cols = BASE_RATES + ADDED_RATES
    return fill_week_one(rates, league_means(full_season_rates(stats), cols, as_of), cols)
