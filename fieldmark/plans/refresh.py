"""Raw landed tables -> curated tables, audited. All seasons go through one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators.curate import curate_games, curate_plays
from fieldmark.operators.quality import closing_line_audit, require, validation_checks
from fieldmark.plans.features import replace_sums
from fieldmark.schemas import GAMES, PLAYS
from fieldmark.sources.coerce import harmonise
from fieldmark.sources.readers import read_table
from fieldmark.sources.sinks import replace_partitions


def audit_or_stop(schedules: DataFrame, column: str = "spread_line") -> DataFrame:
    """Closing-line coverage; too many gaps overall stop the refresh."""
    audit = closing_line_audit(schedules, column)
    total = audit.where(F.col("season").isNull())
    require(total.select(F.lit("closing_line_null_pct").alias("check"), F.lit("all").alias("scope"), F.col("null_pct").alias("value"), "passed"))
    return audit


def refresh(
    spark: SparkSession,
    raw_games_path: str,
    raw_plays_path: str,
    games_path: str,
    plays_path: str,
    files_per_season: int | None = None,
    sums_path: str | None = None,
    **ranges,
) -> DataFrame:
    """Curate and replace the seasons present in the raw tables; returns the check table.

    Games are written before plays read them back, so the referential filter uses the stored
    table. Rerunning replaces the same partitions with the same rows. Landed seasons may differ in
    columns, so only the raw reads merge schemas; ``files_per_season`` overrides the writers' own sizing.
    With ``sums_path`` the stored sums of the landed seasons are replaced too (see ``plans/features.py``).
    """
    raw_games = harmonise(read_table(spark, raw_games_path, merge=True))
    audit_or_stop(raw_games)
    replace_partitions(curate_games(raw_games), games_path, ["home_team", "away_team"])
    games = read_table(spark, games_path, schema=GAMES)
    raw_plays = harmonise(read_table(spark, raw_plays_path, merge=True))
    replace_partitions(curate_plays(raw_plays, games), plays_path, ["game_id", "posteam"], files=files_per_season)
    if sums_path:
        replace_sums(spark, plays_path, sums_path, [r["season"] for r in raw_plays.select(F.col("season").cast("int")).distinct().collect()])
    return validation_checks(read_table(spark, plays_path, schema=PLAYS), games, **ranges)
