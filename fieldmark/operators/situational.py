"""Schedule and form features per team-week, from games alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rest for a season opener, accepted rest range, neutral win share.
OPENER_REST_DAYS = 14
REST_RANGE = (3, 21)
NEUTRAL_WIN_PCT = 0.5


def team_games(games: DataFrame) -> DataFrame:
    """Two rows per game, one per team, from a single scan. Unplayed games count as margin 0."""

    def view(team: str, mine: str, theirs: str):
        return F.struct(
            F.col(team).alias("team"),
            F.coalesce((F.col(mine) - F.col(theirs)).cast("double"), F.lit(0.0)).alias("margin"),
        )

    both = F.array(view("home_team", "home_score", "away_score"), view("away_team", "away_score", "home_score"))
    return games.select("game_id", "season", "week", F.to_date("game_date").alias("game_date"), F.inline(both)).withColumns(
        {
            "win": F.when(F.col("margin") > 0, 1.0).otherwise(0.0),
            "loss": F.when(F.col("margin") < 0, 1.0).otherwise(0.0),
        }
    )


def situational_features(games: DataFrame) -> DataFrame:
    order = Window.partitionBy("team", "season").orderBy("week", "game_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.datediff("game_date", F.lag("game_date").over(order)).cast("double")
    low, high = REST_RANGE
    return (
        team_games(games)
        .withColumns(
            {
                "rest_days": F.greatest(
                    F.lit(float(low)),
                    F.least(F.lit(float(high)), F.coalesce(gap, F.lit(float(OPENER_REST_DAYS)))),
                ),
                "prior_week_margin": F.coalesce(F.lag("margin").over(order), F.lit(0.0)),
                "_wins": F.sum("win").over(before),
                "_losses": F.sum("loss").over(before),
            }
        )
        .select(
            "team",
            "season",
            "week",
            "rest_days",
            "prior_week_margin",
            F.coalesce(
                F.try_divide(F.col("_wins"), F.col("_wins") + F.col("_losses")), F.lit(NEUTRAL_WIN_PCT)
            ).alias("season_win_pct"),
        )
    )


def add_rest_differential(games: DataFrame) -> DataFrame:
    if "home_rest_days" not in games.columns:
        raise ValueError("attach home_rest_days and away_rest_days first")
    return games.withColumn("rest_differential", F.col("home_rest_days") - F.col("away_rest_days"))
