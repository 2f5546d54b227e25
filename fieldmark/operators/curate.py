"""Raw schedule and play rows -> typed curated tables, all seasons in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.expr import cover_label, flag, number, text_boolean
from fieldmark.schemas import FLAGS_DEFAULT_FALSE, GAMES, PLAYS, RAW_GAME_NAMES
from fieldmark.sources.coerce import project_to


def regular_season(df: DataFrame, kind: str = "REG") -> DataFrame:
    """Keep one season type; accepts either raw spelling of the column."""
    for name in ("game_type", "season_type"):
        if name in df.columns:
            return df.where(F.col(name) == kind)
    raise ValueError("neither game_type nor season_type is present")


def rename_raw_games(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(
        {old: new for old, new in RAW_GAME_NAMES.items() if new not in df.columns}
    )


def with_cover_label(df: DataFrame) -> DataFrame:
    inputs = [number(F.col(c)) for c in ("home_score", "away_score", "home_spread_close")]
    return df.withColumn("home_covered", cover_label(*inputs))


def curate_games(raw: DataFrame) -> DataFrame:
    """Regular-season games in the declared schema, labelled."""
    df = with_cover_label(rename_raw_games(regular_season(raw)))
    if "div_game" in df.columns:
        df = df.withColumn("div_game", text_boolean(F.col("div_game")))
    return project_to(df, GAMES)


def in_curated_games(plays: DataFrame, games: DataFrame) -> DataFrame:
    """Plays whose game is curated. A semi join never repeats a play."""
    return plays.join(games.select("game_id"), "game_id", "left_semi")


def default_flags(df: DataFrame, flags: list[str] = FLAGS_DEFAULT_FALSE) -> DataFrame:
    return df.withColumns(
        {c: flag(F.col(c)) if c in df.columns else F.lit(False) for c in flags}
    )


def drop_sideless(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["posteam", "defteam"])


def default_play_type(df: DataFrame) -> DataFrame:
    return df.fillna("no_play", subset=["play_type"])


def curate_plays(raw: DataFrame, games: DataFrame) -> DataFrame:
    """Plays of curated games in the declared schema. Filters run before the join."""
    df = default_play_type(default_flags(drop_sideless(raw)))
    return project_to(in_curated_games(df, games), PLAYS)
