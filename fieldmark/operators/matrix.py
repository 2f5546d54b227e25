"""One row per game with both teams' features, context and user columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.expr import any_null, number
from fieldmark.operators.situational import add_rest_differential, situational_features
from fieldmark.operators.team_week import team_features
from fieldmark.schemas import ADDED_RATES, BASE_RATES, SITUATIONAL, TEAM_FEATURES

KEY = ["team", "season", "week"]

# Roofs played indoors and the weather assumed there.
INDOOR_ROOFS = ["dome", "retractable"]
INDOOR_TEMP = 70.0
INDOOR_WIND = 0.0


def merge_families(rates: DataFrame, situational: DataFrame) -> DataFrame:
    """All team features on the play-derived spine."""
    return rates.select(*KEY, *BASE_RATES, *ADDED_RATES).join(
        situational.select(*KEY, *SITUATIONAL), KEY, "left"
    )


def attach_sides(games: DataFrame, features: DataFrame, cols: list[str], key: str = "team") -> DataFrame:
    """Left join the same features as ``home_*`` and ``away_*``."""
    for side in ("home", "away"):
        named = features.select(
            F.col(key).alias(f"{side}_team"),
            "season",
            "week",
            *[F.col(c).alias(f"{side}_{c}") for c in cols],
        )
        games = games.join(named, [f"{side}_team", "season", "week"], "left")
    return games


def add_context(games: DataFrame, as_of: int | None = None) -> DataFrame:
    """Constant home edge, division flag, indoor flag and weather with indoor defaults.

    Missing outdoor temperatures take the exact median over all games once indoor games are
    set; ``as_of`` restricts the games it is taken from. The median is computed from counts
    per distinct temperature, so its state does not grow with the number of games.
    """
    indoor = F.coalesce(F.col("roof").isin(INDOOR_ROOFS), F.lit(False))
    df = games.withColumns(
        {
            "home_advantage": F.lit(1),
            "div_game": F.coalesce(F.col("div_game"), F.lit(False)).cast("int"),
            "roof_dome": indoor.cast("int"),
            "temp": F.when(indoor, F.lit(INDOOR_TEMP)).otherwise(F.col("temp")),
            "wind": F.when(indoor, F.lit(INDOOR_WIND)).otherwise(F.coalesce(F.col("wind"), F.lit(0.0))),
        }
    )
    return df.withColumn("temp", F.coalesce(F.col("temp"), median_temperature(df, as_of).scalar()))


def median_temperature(df: DataFrame, as_of: int | None = None) -> DataFrame:
    known = df if as_of is None else df.where(F.col("season") <= as_of)
    counts = known.where(F.col("temp").isNotNull()).groupBy("temp").agg(F.count("*").alias("n"))
    return counts.agg(F.percentile("temp", 0.5, F.col("n")).alias("median_temp"))


def game_matrix(
    games: DataFrame, features: DataFrame, cols: list[str] | None = None, as_of: int | None = None
) -> DataFrame:
    """Features of both teams plus context; a requested column that does not exist is an error."""
    missing = [c for c in cols or [] if c not in features.columns]
    if missing:
        raise ValueError(f"features without these columns: {missing}")
    available = [c for c in TEAM_FEATURES if c in features.columns] if cols is None else cols
    out = attach_sides(add_context(games, as_of), features, available)
    return add_rest_differential(out) if "rest_days" in available else out


def build_matrix(plays: DataFrame, games: DataFrame, as_of: int | None = None) -> DataFrame:
    """Plays and games -> the full game matrix."""
    return game_matrix(
        games, merge_families(team_features(plays, as_of), situational_features(games)), as_of=as_of
    )


def join_gaps(matrix: DataFrame, cols: list[str]) -> DataFrame:
    """Games with at least one missing feature per side."""
    return matrix.agg(
        F.count_if(any_null([f"home_{c}" for c in cols])).alias("home_gaps"),
        F.count_if(any_null([f"away_{c}" for c in cols])).alias("away_gaps"),
        F.count("*").alias("n_games"),
    )


def require_unique(df: DataFrame, keys: list[str]) -> None:
    """A repeated key would multiply games, so it is refused: how many repeat, and five examples.

    ``repeated_keys`` has them all.
    """
    bad = repeated_keys(df, keys)
    total, rows = bad.agg(F.count("*"), F.sum("copies")).first()
    if total:
        some = ", ".join(str(tuple(r[k] for k in keys)) for r in bad.limit(5).collect())
        raise ValueError(f"keys {keys} repeat: {total} keys on {rows} rows, such as {some}")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every key that occurs more than once, with its count."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: number(F.col(c)) for c in cols})


def join_user_games(matrix: DataFrame, user: DataFrame, cols: list[str], key: str = "game_id") -> DataFrame:
    """User columns keyed by game; missing numbers become 0."""
    require_unique(user, [key])
    picked = numeric(user, cols).select(F.col(key).alias("game_id"), *cols)
    return matrix.join(picked, "game_id", "left").fillna(0.0, subset=cols)


def join_user_team_weeks(
    matrix: DataFrame, user: DataFrame, cols: list[str], keys: dict[str, str] | None = None
) -> DataFrame:
    """User columns keyed by team-season-week, under the user's own key names."""
    names = {**{k: k for k in KEY}, **(keys or {})}
    require_unique(user, [names[k] for k in KEY])
    picked = numeric(user, cols).select(*[F.col(names[k]).alias(k) for k in KEY], *cols)
    out = attach_sides(matrix, picked, cols)
    return out.fillna(0.0, subset=[f"{side}_{c}" for side in ("home", "away") for c in cols])


def join_user(matrix: DataFrame, user: DataFrame, cols: list[str], key_type: str, keys=None) -> DataFrame:
    """Dispatch on the dataset's key type; player-level data has no place on a game row."""
    if key_type == "game_id":
        return join_user_games(matrix, user, cols, (keys or {}).get("game_id", "game_id"))
    if key_type == "team_season_week":
        return join_user_team_weeks(matrix, user, cols, keys)
    raise ValueError(f"cannot attach a dataset keyed by {key_type} to games; aggregate it to team-weeks first")
