"""Read-side queries: lists, lookups, details and rating series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.expr import game_status, is_scrimmage, season_of_game_id, team_code_ok
from fieldmark.operators.compare import latest
from fieldmark.operators.scoring import record
from fieldmark.session import materialise


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page plus one extra row, which tells whether more rows follow."""
    return df.orderBy(*order).offset(offset).limit(limit + 1)


def seek(df: DataFrame, keys: dict[str, bool], limit: int, after: tuple | None = None) -> DataFrame:
    """The page after a row, plus one extra row: ``keys`` maps the order's columns to ascending or not.

    ``after`` has that row's values of the key columns. A row comparison takes the place of an offset, so no
    page reads or sorts what earlier ones showed: its first column prunes partitions and row groups, and each task
    keeps ``limit + 1`` rows. The keys hold no nulls and tell rows apart; rows equal in all of
    them would be passed over together.
    """
    order = [F.asc(c) if up else F.desc(c) for c, up in keys.items()]
    if after is not None:
        past = F.lit(False)
        for (c, up), value in reversed(list(zip(keys.items(), after, strict=True))):
            ahead = F.col(c) > F.lit(value) if up else F.col(c) < F.lit(value)
            past = ahead | ((F.col(c) == F.lit(value)) & past)
        first, up = next(iter(keys.items()))
        df = df.where((F.col(first) >= F.lit(after[0]) if up else F.col(first) <= F.lit(after[0])) & past)
    return df.orderBy(*order).limit(limit + 1)


def seek_pages(df: DataFrame, keys: dict[str, bool], limit: int) -> DataFrame:
    """Every page that turning ``seek`` from the first one shows, as rows with ``page`` (from 0), in a fixed number of jobs.

    Turned one by one, n rows are n / limit reads of the frame. Here the rows are sorted by ranges of the keys once
    and stored, and a row's place is its place in its range plus the rows of the ranges before it, so no task holds more
    than a range. The keys tell rows apart, as for ``seek``; rows without the first key follow no row, so only the first
    page can hold them.
    """
    order = [F.asc(c) if up else F.desc(c) for c, up in keys.items()]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    ranged = materialise(ranged, "pages").withColumn("_range", F.shiftright("_place", 33))
    sizes = ranged.groupBy("_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(sizes.select("_range", "_first", before.alias("_before")), "_range")
    page = F.expr(f"(_before + _place - _first) div {int(limit)}").cast("int")
    numbered = placed.withColumn("page", page).drop("_place", "_range", "_first", "_before")
    return numbered.where((F.col("page") == 0) | F.col(next(iter(keys))).isNotNull())


def has_more(rows: list, limit: int) -> tuple[list, bool]:
    return rows[:limit], len(rows) > limit


def with_status(games: DataFrame) -> DataFrame:
    return games.withColumn("status", game_status(F.col("home_score"), F.col("away_score")))


def find_games(
    games: DataFrame, season: int, week: int | None = None, team: str | None = None, status: str | None = None
) -> DataFrame:
    """Games of a season, optionally by week, either side's team and derived status.

    ``complete`` is accepted for ``final``.
    """
    out = with_status(games.where(F.col("season") == season))
    if week is not None:
        out = out.where(F.col("week") == week)
    if team is not None:
        out = out.where((F.col("home_team") == team) | (F.col("away_team") == team))
    if status is not None:
        out = out.where(F.col("status") == ("final" if status == "complete" else status))
    return out


def list_games(games: DataFrame, limit: int, offset: int = 0, **filters) -> DataFrame:
    order = [F.desc("season"), F.desc("week"), F.asc("game_id")]
    return page(find_games(games, **filters), order, limit, offset)


NEWEST_FIRST = {"season": False, "week": False, "game_id": True}


def games_after(games: DataFrame, limit: int, after: tuple | None = None, season: int | None = None, **filters) -> DataFrame:
    """A page of games, newest first, after the given (season, week, game_id)."""
    found = find_games(games, season, **filters) if season is not None else with_status(games)
    return seek(found, NEWEST_FIRST, limit, after)


def game_by_id(games: DataFrame, game_id: str) -> DataFrame:
    """Point lookup. The id decides; its season, where it names one, only skips partitions.

    Ids of other seasons than B13 accepts carry no season to prune by, and are looked up all the same.
    """
    year = game_id.split("_")[0]
    found = games.where(F.col("game_id") == game_id)
    if year.isdigit() and 2000 <= int(year) <= 2100:
        found = found.where(F.col("season") == int(year))
    return with_status(found)


def lookup(df: DataFrame, ids: DataFrame, key: str = "game_id") -> DataFrame:
    """Many point lookups at once, by id alone."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def valid_teams(df: DataFrame, column: str) -> DataFrame:
    return df.where(team_code_ok(F.col(column))).withColumn(column, F.upper(column))


def play_counts(plays: DataFrame) -> DataFrame:
    return plays.groupBy("game_id", "season").agg(F.count("*").alias("play_count"))


STAT_LINE = ["pass_attempts", "rush_attempts", "total_yards", "pass_yards", "rush_yards"]


def _ball_lines(plays: DataFrame) -> DataFrame:
    """Plays, attempts and yards per game and team with the ball; plays of no team have a line of their own."""
    passing, rushing = F.col("play_type") == "pass", F.col("play_type") == "run"
    yards = F.col("yards_gained")
    return plays.groupBy("game_id", "season", F.col("posteam").alias("team")).agg(
        F.count("*").alias("plays"),
        F.count_if(passing).alias("pass_attempts"),
        F.count_if(rushing).alias("rush_attempts"),
        F.sum(yards).alias("total_yards"),
        F.sum(F.when(passing, yards).otherwise(0)).alias("pass_yards"),
        F.sum(F.when(rushing, yards).otherwise(0)).alias("rush_yards"),
    )


def team_game_stats(plays: DataFrame) -> DataFrame:
    """Pass and rush attempts and yards per game and team with the ball."""
    return _ball_lines(plays.where(F.col("posteam").isNotNull())).drop("plays")


def game_detail(games: DataFrame, plays: DataFrame) -> DataFrame:
    """Each game with its play count and both teams' stat lines, as nested columns.

    Plays are read and reduced to (game, team) once; the game rows pick their two lines from a map.
    """
    line = F.when(F.col("team").isNotNull(), F.struct("team", F.struct(*STAT_LINE)))
    per_game = _ball_lines(plays).groupBy("game_id", "season").agg(
        F.sum("plays").alias("play_count"), F.map_from_entries(F.collect_list(line)).alias("_lines")
    )
    return (
        with_status(games)
        .join(per_game, ["game_id", "season"], "left")
        .withColumns(
            {
                "play_count": F.coalesce("play_count", F.lit(0)),
                "home_stats": F.col("_lines")[F.col("home_team")],
                "away_stats": F.col("_lines")[F.col("away_team")],
            }
        )
        .drop("_lines")
    )


def team_rating(plays: DataFrame, team: str | None = None, season: int | None = None) -> DataFrame:
    """Season-to-date pass and rush EPA per attempt through each week, that week included."""
    if team is not None:
        plays = plays.where(F.col("posteam") == team)
    if season is not None:
        plays = plays.where(F.col("season") == season)
    cols = {}
    for kind, name in (("pass", "pass"), ("run", "rush")):
        keep = is_scrimmage(F.col("play_type"), F.col("down"), (kind,))
        cols[f"_{name}_att"] = F.count_if(keep)
        cols[f"_{name}_epa"] = F.sum(F.when(keep, F.coalesce("epa", F.lit(0.0))).otherwise(0.0))
    weekly = plays.where(F.col("posteam").isNotNull()).groupBy(F.col("posteam").alias("team"), "season", "week").agg(
        *[e.alias(n) for n, e in cols.items()]
    )
    upto = Window.partitionBy("team", "season").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    rate = {
        f"ol_{name}_epa_per_att": F.try_divide(F.sum(f"_{name}_epa").over(upto), F.sum(f"_{name}_att").over(upto))
        for name in ("rush", "pass")
    }
    return weekly.select("team", "season", "week", *[e.alias(n) for n, e in rate.items()])


def latest_rating(rating: DataFrame) -> DataFrame:
    """Last point of each team's series."""
    return latest(rating, ["team"], ["season", "week"])


def rating_seasons(rating: DataFrame) -> DataFrame:
    return rating.select("team", "season").distinct()


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run of each experiment."""
    return latest(runs, ["experiment_id"], ["run_at", "run_id"])


def latest_predictions(
    preds: DataFrame, runs: DataFrame, season: int, fold: int | None = None, ol_mismatch_flag: int | None = None
) -> DataFrame:
    """Predictions of each experiment's newest run; the season filter prunes partitions."""
    newest = latest_runs(runs).select("experiment_id", "run_id")
    out = filter_predictions(preds, season, fold, ol_mismatch_flag)
    return out.join(newest, ["experiment_id", "run_id"], "left_semi")


def filter_predictions(
    preds: DataFrame, season: int, fold: int | None = None, ol_mismatch_flag: int | None = None
) -> DataFrame:
    out = preds.where(F.col("season") == season)
    if fold is not None:
        out = out.where(F.col("fold") == fold)
    if ol_mismatch_flag is not None:
        out = out.where(F.col("ol_mismatch_flag") == int(ol_mismatch_flag))
    return out


CHRONOLOGICAL = ["season", "week", "game_id"]


def list_predictions(preds: DataFrame, runs: DataFrame, limit: int, offset: int = 0, **filters) -> DataFrame:
    order = [F.asc(c) for c in [*CHRONOLOGICAL, "experiment_id"]]
    return page(latest_predictions(preds, runs, **filters), order, limit, offset)


def predictions_after(preds: DataFrame, runs: DataFrame, limit: int, after: tuple | None = None, **filters) -> DataFrame:
    """A page of each experiment's newest predictions in time order, after the given (season, week, game_id, experiment_id)."""
    return seek(latest_predictions(preds, runs, **filters), {c: True for c in [*CHRONOLOGICAL, "experiment_id"]}, limit, after)


def production_experiment(runs: DataFrame, configs: DataFrame, experiment_id: str | None = None) -> DataFrame:
    """Newest run whose run and config both passed the gate."""
    passed = runs.where("gate_passed")
    if experiment_id is not None:
        passed = passed.where(F.col("experiment_id") == experiment_id)
    allowed = configs.where("gate_passed").select("experiment_id", F.col("name").alias("experiment_name"))
    return (
        passed.select("experiment_id", "run_id", "completed_at")
        .join(allowed, "experiment_id")
        .orderBy(F.desc("completed_at"), F.desc("run_id"))
        .limit(1)
    )


def production_predictions(preds: DataFrame, production: DataFrame, season: int, week: int) -> DataFrame:
    """Week's predictions of the production run only, so reruns do not repeat games."""
    out = preds.where((F.col("season") == season) & (F.col("week") == week))
    return out.join(production.select("experiment_id", "run_id"), ["experiment_id", "run_id"], "left_semi")


def run_history(runs: DataFrame, experiment_id: str | None = None) -> DataFrame:
    out = runs if experiment_id is None else runs.where(F.col("experiment_id") == experiment_id)
    return out.orderBy(F.desc("run_at"), F.desc("run_id"))


def run_season_records(preds: DataFrame, run_id: str | None = None) -> DataFrame:
    """Per-season record of stored predictions."""
    out = preds if run_id is None else preds.where(F.col("run_id") == run_id)
    return record(out, ["run_id", "season"])


def experiment_detail(configs: DataFrame, runs: DataFrame, preds: DataFrame) -> DataFrame:
    """Configs with their runs and each run's per-season record, one row per combination.

    Kept flat: an experiment's history has no bound, so it is not folded into one row.
    """
    seasons = run_season_records(preds).withColumnRenamed("season", "test_season")
    return (
        configs.select("experiment_id", "name", "status", "features")
        .join(runs.select("experiment_id", "run_id", "run_at", "ats_hit_rate"), "experiment_id", "left")
        .join(seasons, "run_id", "left")
    )
