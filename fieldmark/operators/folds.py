"""Walk-forward folds, train/test roles and the game-universe filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First and last test season of the first standalone run, and its window.
DEFAULT_START, DEFAULT_END, DEFAULT_TRAIN = 2015, 2024, 4

# Universe-filter operators, fields and the smallest accepted universe.
UNIVERSE_OPERATORS = {
    "eq": lambda c, v: c == v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "ne": lambda c, v: c != v,
}
UNIVERSE_FIELDS = ["div_game", "week"]
MIN_UNIVERSE = 100


def fold_list(start: int, end: int, train: int, step: int = 1) -> list[tuple[int, int, int]]:
    """(test season, train from, train to) per fold; each fold tests one season.

    A step above 1 skips seasons between tests.
    """
    return [(t, t - train, t - 1) for t in range(start + train, end + 1, step)]


def folds(spark: SparkSession, start: int, end: int, train: int, step: int = 1) -> DataFrame:
    rows = [(i, *f) for i, f in enumerate(fold_list(start, end, train, step), 1)]
    return spark.createDataFrame(rows, "fold int, test_season int, train_from int, train_to int")


def folds_from_ranges(ranges: DataFrame, step: int = 1) -> DataFrame:
    """Fold rows for every row of (start_season, end_season, train_seasons), other columns kept."""
    first = F.col("start_season") + F.col("train_seasons")
    tests = F.when(first <= F.col("end_season"), F.sequence(first, F.col("end_season"), F.lit(step)))
    keep = [c for c in ranges.columns if c not in ("start_season", "end_season", "train_seasons")]
    return ranges.select(
        *keep, "train_seasons", F.posexplode(F.coalesce(tests, F.array().cast("array<int>"))).alias("_i", "test_season")
    ).select(
        *keep,
        (F.col("_i") + 1).alias("fold"),
        "test_season",
        (F.col("test_season") - F.col("train_seasons")).alias("train_from"),
        (F.col("test_season") - 1).alias("train_to"),
    )


def season_folds(games: DataFrame, train: int, step: int = 1) -> DataFrame:
    """Folds spanning the seasons present in a table."""
    ranges = games.agg(F.min("season").alias("start_season"), F.max("season").alias("end_season"))
    return folds_from_ranges(ranges.withColumn("train_seasons", F.lit(train)), step)


def role_seasons(fold_rows: DataFrame) -> DataFrame:
    """(fold, role, season): the seasons each fold trains on, and the one it tests."""
    train = fold_rows.select(
        "fold", F.lit("train").alias("role"), F.explode(F.sequence("train_from", "train_to")).alias("season")
    )
    return train.unionByName(fold_rows.select("fold", F.lit("test").alias("role"), F.col("test_season").alias("season")))


def with_roles(matrix: DataFrame, roles: DataFrame, label: str = "home_covered") -> DataFrame:
    """Games of the given (fold, role, season) rows. Training rows need a label; test rows keep pushes."""
    return matrix.join(roles, "season").where((F.col("role") == "test") | F.col(label).isNotNull())


def assign_roles(matrix: DataFrame, fold_rows: DataFrame, label: str = "home_covered") -> DataFrame:
    """Each game once per fold it trains or is tested in; an equi-join on season."""
    return with_roles(matrix, role_seasons(fold_rows), label)


def universe_condition(field: str, operator: str, value) -> Column:
    if field not in UNIVERSE_FIELDS or operator not in UNIVERSE_OPERATORS:
        raise ValueError(f"unsupported universe filter: {field} {operator}")
    number = {"true": 1, "false": 0}.get(str(value).lower(), value)
    return UNIVERSE_OPERATORS[operator](F.col(field).cast("int"), F.lit(int(number)))


def filter_universe(matrix: DataFrame, universe: dict | None, minimum: int = MIN_UNIVERSE) -> DataFrame:
    """Restrict the games after features are built, so history stays complete."""
    if not universe:
        return matrix
    out = matrix.where(universe_condition(universe["field"], universe["operator"], universe["value"]))
    n = out.count()
    if n < minimum:
        raise ValueError(f"universe {universe} keeps {n} games, fewer than {minimum}")
    return out
