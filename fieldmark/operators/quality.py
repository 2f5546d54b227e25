"""Data checks. Each check is rows of (check, scope, value, low, high, passed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.functions.expr import signed_spread_bucket

CHECK_COLUMNS = ["check", "scope", "value", "low", "high", "passed"]

# Accepted ranges of the checks.
RAW_PLAYS_RANGE = (40_000, 70_000)
RAW_GAMES_RANGE = (256, 290)
CURATED_GAMES_RANGE = (256, 285)
CURATED_PLAYS_RANGE = (35_000, 60_000)
MIN_ROSTER_ROWS = 501
MAX_NULL_PCT = 5.0
BUCKET_COVER_RANGE = (45.0, 55.0)
OVERALL_COVER_RANGE = (46.0, 54.0)
LOAD_MIN_PLAYS = 400_000
LOAD_MIN_GAMES = 2_800


def check_rows(df: DataFrame, check: str, scope: Column, value: Column, low=None, high=None) -> DataFrame:
    """Shape one check; a missing bound is open."""
    v = value.cast("double")
    passed = F.lit(True)
    if low is not None:
        passed = passed & (v >= low)
    if high is not None:
        passed = passed & (v <= high)
    return df.select(
        F.lit(check).alias("check"),
        scope.cast("string").alias("scope"),
        v.alias("value"),
        F.lit(low).cast("double").alias("low"),
        F.lit(high).cast("double").alias("high"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def rows_per_season(df: DataFrame, check: str, low=None, high=None) -> DataFrame:
    counts = df.groupBy("season").agg(F.count("*").alias("n"))
    return check_rows(counts, check, F.col("season"), F.col("n"), low, high)


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)


def null_rate_by_season(df: DataFrame, column: str) -> DataFrame:
    return (
        df.groupBy("season")
        .agg(F.count_if(F.col(column).isNull()).alias("nulls"), F.count("*").alias("total"))
        .withColumn("null_pct", pct(F.col("nulls"), F.col("total")))
    )


def null_rate_check(df: DataFrame, column: str, max_pct: float = MAX_NULL_PCT) -> DataFrame:
    return check_rows(
        null_rate_by_season(df, column), f"{column}_null_pct", F.col("season"), F.col("null_pct"), high=max_pct
    )


def zero_null_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """One pass over all columns, one check row per column."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counted.unpivot([], columns, "column", "nulls")
    return check_rows(long, "zero_nulls", F.col("column"), F.col("nulls"), high=0)


def cover_rate_by_bucket(games: DataFrame) -> DataFrame:
    return (
        games.where(F.col("home_covered").isNotNull())
        .groupBy(signed_spread_bucket(F.col("home_spread_close")).alias("bucket"))
        .agg(F.count_if("home_covered").alias("covers"), F.count("*").alias("total"))
        .withColumn("cover_pct", pct(F.col("covers"), F.col("total"), 1))
    )


def cover_rate_overall(games: DataFrame) -> DataFrame:
    return (
        games.where(F.col("home_covered").isNotNull())
        .agg(
            F.count_if("home_covered").alias("covers"),
            F.count("*").alias("total"),
            F.min("season").alias("min_season"),
            F.max("season").alias("max_season"),
        )
        .withColumn("cover_pct", pct(F.col("covers"), F.col("total"), 1))
    )


def cover_checks(games: DataFrame) -> DataFrame:
    return check_rows(
        cover_rate_by_bucket(games), "cover_pct", F.col("bucket"), F.col("cover_pct"), *BUCKET_COVER_RANGE
    ).unionByName(
        check_rows(
            cover_rate_overall(games), "cover_pct_overall", F.lit("all"), F.col("cover_pct"), *OVERALL_COVER_RANGE
        )
    )


def orphan_counts(plays: DataFrame, games: DataFrame) -> DataFrame:
    """(game_id, n): plays per game id that has no game. Only one row a game and task is shuffled, no play."""
    counts = plays.groupBy("game_id").agg(F.count("*").alias("n"))
    return counts.join(games.select("game_id"), "game_id", "left_anti")


def orphan_plays(plays: DataFrame, games: DataFrame) -> DataFrame:
    """The plays themselves, found by the few ids that have no game; a null id has none."""
    lost = orphan_counts(plays, games).select(F.col("game_id").alias("_lost"))
    return plays.join(lost, F.col("game_id").eqNullSafe(F.col("_lost")), "left_semi")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def season_range(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    out = df.agg(F.min("season").alias("min_season"), F.max("season").alias("max_season"))
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col("min_season") >= low)
    if high is not None:
        ok = ok & (F.col("max_season") <= high)
    return out.withColumn("in_scope", F.coalesce(ok, F.lit(False)))


def count_check(df: DataFrame, check: str, low=None, high=None) -> DataFrame:
    return check_rows(df.agg(F.count("*").alias("n")), check, F.lit("all"), F.col("n"), low, high)


def union_checks(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def summarise(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count("*").alias("total_checks"),
        F.count_if("passed").alias("passed_checks"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
        (F.count_if(~F.col("passed")) == 0).alias("all_passed"),
    )


def season_checks(
    df: DataFrame,
    rows: tuple[str, float | None, float | None],
    null_pct: dict[str, Column] | None = None,
    zero_nulls: list[str] | None = None,
) -> DataFrame:
    """Row counts, null shares and zero-null checks of one table from a single scan.

    ``rows`` is (check, low, high). ``null_pct`` maps a column to the rows it is checked on.
    The scan yields one row per season; the checks are read off that small table.
    """
    null_pct, zero_nulls = null_pct or {}, zero_nulls or []
    per_season = df.groupBy("season").agg(
        F.count("*").alias("n"),
        *[F.count_if(cond).alias(f"of_{c}") for c, cond in null_pct.items()],
        *[F.count_if(cond & F.col(c).isNull()).alias(f"null_{c}") for c, cond in null_pct.items()],
        *[F.count_if(F.col(c).isNull()).alias(f"zero_{c}") for c in zero_nulls],
    )
    season = F.col("season").cast("string")

    def part(check: str, scope: Column, num: Column, den: Column, low, high) -> Column:
        return F.struct(
            F.lit(check).alias("check"),
            scope.alias("scope"),
            num.cast("bigint").alias("num"),
            den.cast("bigint").alias("den"),
            F.lit(low).cast("double").alias("low"),
            F.lit(high).cast("double").alias("high"),
        )

    none = F.lit(None)
    parts = [part(rows[0], season, F.col("n"), none, rows[1], rows[2])]
    parts += [
        part(f"{c}_null_pct", season, F.col(f"null_{c}"), F.col(f"of_{c}"), None, MAX_NULL_PCT) for c in null_pct
    ]
    parts += [part("zero_nulls", F.lit(c), F.col(f"zero_{c}"), none, None, 0) for c in zero_nulls]
    summed = (
        per_season.select(F.inline(F.array(*parts)))
        .groupBy("check", "scope", "low", "high")
        .agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    )
    value = F.when(F.col("den").isNull(), F.col("num").cast("double")).otherwise(pct(F.col("num"), F.col("den")))
    inside = (F.col("low").isNull() | (value >= F.col("low"))) & (F.col("high").isNull() | (value <= F.col("high")))
    return summed.select(
        "check", "scope", value.alias("value"), "low", "high", F.coalesce(inside, F.lit(False)).alias("passed")
    )


def validation_checks(
    plays: DataFrame,
    games: DataFrame,
    plays_range=CURATED_PLAYS_RANGE,
    games_range=CURATED_GAMES_RANGE,
    seasons=(None, None),
) -> DataFrame:
    """The full curated-layer audit as one check table; plays are scanned twice in all."""
    scope = season_range(games, *seasons)
    orphans = orphan_counts(plays, games).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return union_checks(
        [
            season_checks(games, ("games_rows", *games_range), {"home_spread_close": F.lit(True)}),
            season_checks(
                plays,
                ("plays_rows", *plays_range),
                {"epa": F.col("play_type").isin("pass", "run")},
                ["qb_hit", "sack"],
            ),
            cover_checks(games),
            check_rows(orphans, "orphan_plays", F.lit("all"), F.col("n"), high=0),
            count_check(duplicate_keys(games, ["game_id"]), "duplicate_game_ids", high=0),
            check_rows(scope, "season_range", F.lit("all"), F.col("in_scope").cast("int"), low=1),
        ]
    )


def closing_line_audit(schedules: DataFrame, column: str, max_pct: float = MAX_NULL_PCT) -> DataFrame:
    """Null rate of the closing line per season, plus a total row with a NULL season."""
    return (
        schedules.rollup("season")
        .agg(F.count_if(F.col(column).isNull()).alias("nulls"), F.count("*").alias("total"))
        .withColumn("null_pct", pct(F.col("nulls"), F.col("total")))
        .withColumn("passed", F.col("null_pct") <= max_pct)
    )


def value_counts(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """Counts of the n lowest values, missing ones last."""
    return (
        df.groupBy(column)
        .agg(F.count("*").alias("n_rows"))
        .orderBy(F.col(column).asc_nulls_last())
        .limit(n)
    )


def validate_ingest(
    df: DataFrame, required: list[str], low: int | None = None, high: int | None = None
) -> DataFrame:
    """Row count below the range is an error, above it a warning; a missing column is an error."""
    spark = df.sparkSession
    have = set(df.columns)
    missing = spark.createDataFrame(
        [(c, c in have) for c in required], "column string, present boolean"
    ).select(
        F.lit("required_column").alias("check"),
        F.col("column").alias("scope"),
        F.when(F.col("present"), "ok").otherwise("error").alias("level"),
    )
    n = F.col("n")
    level = F.lit("ok")
    if high is not None:
        level = F.when(n > high, "warning").otherwise(level)
    if low is not None:
        level = F.when(n < low, "error").otherwise(level)
    counted = df.agg(F.count("*").alias("n")).select(
        F.lit("row_count").alias("check"), n.cast("string").alias("scope"), level.alias("level")
    )
    return counted.unionByName(missing)


def seam_checks(games: DataFrame, predictions: DataFrame) -> DataFrame:
    """Label without scores, ids missing, probability outside [0, 1]."""
    g = games.agg(
        F.count_if(
            F.col("home_covered").isNotNull()
            & (F.col("home_score").isNull() | F.col("away_score").isNull())
        ).alias("label_without_scores"),
        F.count_if(F.col("game_id").isNull()).alias("null_game_ids"),
    )
    p = predictions.agg(
        F.count_if(~F.col("predicted_home_cover_prob").between(0, 1)).alias("probability_out_of_range")
    )
    return union_checks(
        [
            check_rows(g, "label_without_scores", F.lit("games"), F.col("label_without_scores"), high=0),
            check_rows(g, "null_game_ids", F.lit("games"), F.col("null_game_ids"), high=0),
            check_rows(
                p, "probability_out_of_range", F.lit("predictions"), F.col("probability_out_of_range"), high=0
            ),
        ]
    )


def schema_contract(spark: SparkSession, actual: T.StructType, expected: T.StructType) -> DataFrame:
    """One row per missing, unexpected or differently typed column; empty when they agree."""
    have = {f.name: f.dataType.simpleString() for f in actual.fields}
    want = {f.name: f.dataType.simpleString() for f in expected.fields}
    rows = [
        (name, want.get(name), have.get(name))
        for name in [*want, *[n for n in have if n not in want]]
        if want.get(name) != have.get(name)
    ]
    return spark.createDataFrame(rows, "column string, expected string, actual string").withColumn(
        "problem",
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("expected").isNull(), "unexpected")
        .otherwise("type"),
    )


def load_guards(
    plays: DataFrame,
    games: DataFrame,
    min_plays: int = LOAD_MIN_PLAYS,
    min_games: int = LOAD_MIN_GAMES,
    max_null_pct: float = MAX_NULL_PCT,
) -> DataFrame:
    """Refuse to run an experiment on a half-loaded table."""
    g = games.agg(
        F.count("*").alias("n"),
        pct(F.count_if(F.col("home_spread_close").isNull()), F.count("*")).alias("null_pct"),
    )
    return union_checks(
        [
            count_check(plays, "min_plays", low=min_plays),
            check_rows(g, "min_games", F.lit("all"), F.col("n"), low=min_games),
            check_rows(g, "spread_null_pct", F.lit("all"), F.col("null_pct"), high=max_null_pct),
        ]
    )


def require(checks: DataFrame) -> None:
    """Raise with the number of failed checks and the first of them; ``failed`` has them all."""
    bad = failed(checks)
    total = bad.count()
    if total:
        some = "; ".join(f"{r['check']}[{r['scope']}]={r['value']}" for r in bad.limit(20).collect())
        raise ValueError(f"{total} checks failed: {some}")


def failed(checks: DataFrame) -> DataFrame:
    return checks.where(~F.col("passed"))
