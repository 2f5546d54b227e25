"""Features kept between refreshes: sums per season from the plays, team-weeks from the sums, games from both.

A refresh scans the plays of the seasons it replaces and no others. What follows reads the stored
sums, at most teams^2 x weeks x kinds rows a season, however many plays lie behind them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.operators.matrix import KEY, game_matrix, merge_families
from fieldmark.operators.situational import situational_features
from fieldmark.operators.team_week import features_of_stats, pair_week_sums, stats_of_sums
from fieldmark.schemas import PLAYS
from fieldmark.session import scratch_path
from fieldmark.sources.coerce import project_to
from fieldmark.sources.readers import feature_plays, read_table
from fieldmark.sources.sinks import replace_partitions

_COUNTS = ["n", "sacks", "hits", "epa_n", "explosive", "hurried", "hurried_n", "cpoe_n"]
_TOTALS = ["epa", "yards", "hurried_epa", "cpoe"]
SUMS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("posteam", "defteam")]
    + [T.StructField(c, T.IntegerType()) for c in ("season", "week")]
    + [T.StructField("kind", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in _COUNTS]
    + [T.StructField(c, T.DoubleType()) for c in _TOTALS]
)
#: rows of a bucket of the stored team features
BUCKET_ROWS = 1_000_000


def replace_sums(spark: SparkSession, plays_path: str, sums_path: str, seasons: list[int]) -> None:
    """Sum the stored plays of ``seasons`` anew and replace those seasons' sums; other seasons are neither read nor written.

    Each season gets a row without a kind, so that one whose plays are gone is emptied and not left as it was.
    """
    if not seasons:
        return
    plays = feature_plays(read_table(spark, plays_path, schema=PLAYS)).where(F.col("season").isin(list(seasons)))
    emptied = spark.createDataFrame([(int(s),) for s in seasons], "season int")
    rows = project_to(pair_week_sums(plays), SUMS).unionByName(emptied, allowMissingColumns=True)
    replace_partitions(rows, sums_path, ["posteam", "defteam", "week"])


def read_sums(spark: SparkSession, sums_path: str, season: int | None = None) -> DataFrame:
    """The stored sums, of all seasons or of one."""
    return read_table(spark, sums_path, season=season, schema=SUMS).where(F.col("kind").isNotNull())


def stats_from_sums(spark: SparkSession, sums_path: str) -> DataFrame:
    """``team_week_stats`` of all stored plays, without reading them."""
    return stats_of_sums(read_sums(spark, sums_path))


def team_features_from_sums(spark: SparkSession, sums_path: str, games: DataFrame, as_of: int | None = None) -> DataFrame:
    """Base, additional and situational features per team-week, from the stored sums."""
    return merge_families(features_of_stats(stats_from_sums(spark, sums_path), as_of), situational_features(games))


def store_bucketed(features: DataFrame, table: str | None = None, buckets: int | None = None) -> DataFrame:
    """Team-week features as a table bucketed and sorted by team, season and week.

    Home and away joins take its buckets as they lie: only the games are exchanged, to as many parts. There are as
    many buckets as the session has shuffle partitions, or more where buckets would pass ``BUCKET_ROWS``
    rows; each is one file. The files lie in the shared folder, the table's name in the session catalog.
    """
    spark = features.sparkSession
    table = table or f"team_features_{uuid.uuid4().hex[:12]}"
    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-features.count() // BUCKET_ROWS))
    (
        features.repartition(buckets, *KEY)
        .write.bucketBy(buckets, *KEY)
        .sortBy(*KEY)
        .option("path", scratch_path(spark, table))
        .saveAsTable(table)
    )
    return spark.table(table)


def matrix_from_sums(spark: SparkSession, sums_path: str, games: DataFrame, as_of: int | None = None) -> DataFrame:
    """The full game matrix from stored sums, over bucketed team features."""
    return game_matrix(games, store_bucketed(team_features_from_sums(spark, sums_path, games, as_of)), as_of=as_of)
