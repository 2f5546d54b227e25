"""Scans of stored and landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns the feature builders read from each curated table.
FEATURE_PLAY_COLUMNS = [
    "game_id",
    "season",
    "week",
    "posteam",
    "defteam",
    "play_type",
    "down",
    "sack",
    "qb_hit",
    "epa",
    "yards_gained",
    "cpoe",
]
FEATURE_GAME_COLUMNS = [
    "game_id",
    "season",
    "week",
    "game_date",
    "home_team",
    "away_team",
    "home_score",
    "away_score",
    "home_spread_close",
    "total_close",
    "home_covered",
    "roof",
    "div_game",
    "temp",
    "wind",
]


def read_table(
    spark: SparkSession, path: str, season=None, columns=None, schema: T.StructType | None = None, merge: bool = False
) -> DataFrame:
    """Parquet table, optionally one season (a partition filter) and a column subset.

    With the declared ``schema`` no footer is read before the scan. ``merge`` opens every footer,
    which only a table whose files differ in columns needs.
    """
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", str(merge).lower())
    return season_slice(reader.parquet(path), season, columns)


def season_slice(df: DataFrame, season=None, columns=None) -> DataFrame:
    if season is not None:
        df = df.where(F.col("season") == season)
    return df.select(*columns) if columns else df


def feature_plays(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in FEATURE_PLAY_COLUMNS if c in df.columns])


def feature_games(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in FEATURE_GAME_COLUMNS if c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without a schema every column is text, for ``typed_text`` to decide on in one profile."""
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader).csv(path)


def typed_text(df: DataFrame) -> DataFrame:
    """Text columns cast to bigint, double or boolean where every value present reads as one; one pass decides."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    kinds = ("bigint", "double")
    fits = df.agg(
        *[F.count(c).alias(f"{i}_n") for i, c in enumerate(texts)],
        *[F.count(F.col(c).try_cast(k)).alias(f"{i}_{k}") for i, c in enumerate(texts) for k in kinds],
        *[F.count_if(F.lower(c).isin("true", "false")).alias(f"{i}_boolean") for i, c in enumerate(texts)],
    ).first()
    out = {}
    for i, c in enumerate(texts):
        kind = next((k for k in (*kinds, "boolean") if fits[f"{i}_n"] and fits[f"{i}_{k}"] == fits[f"{i}_n"]), None)
        if kind:
            out[c] = F.col(c).cast(kind)
    return df.withColumns(out)


def read_json_records(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, whole_file: bool = False
) -> DataFrame:
    """JSON arrays of objects, one row per object.

    Every line holds an array or an object, so Spark can split large files. ``whole_file`` reads
    each file as one document in one task.
    """
    reader = spark.read.option("multiLine", str(whole_file).lower())
    return (reader.schema(schema) if schema else reader).json(path)


def stamp_source(df: DataFrame, source: str, license_tag: str = "open") -> DataFrame:
    """Mark rows with where they came from and under which license."""
    return df.withColumns({"source": F.lit(source), "license_tag": F.lit(license_tag)})


class SourceAdapter:
    """Pluggable source: fetch landed rows, check them, bring them to stable types.

    Subclasses override ``fetch``; ``validate`` returns check rows and ``normalize``
    returns the typed, stamped frame.
    """

    source = "unknown"
    license_tag = "open"

    def fetch(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def validate(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def normalize(self, df: DataFrame) -> DataFrame:
        from fieldmark.sources.coerce import harmonise, widen

        return stamp_source(widen(harmonise(df)), self.source, self.license_tag)


class LandedTable(SourceAdapter):
    """Adapter over files already landed as Parquet."""

    def __init__(self, path: str, required: list[str], low: int, high: int, source="landed"):
        self.path, self.required, self.low, self.high = path, required, low, high
        self.source = source

    def fetch(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, self.path)

    def validate(self, df: DataFrame) -> DataFrame:
        from fieldmark.operators.quality import validate_ingest

        return validate_ingest(df, self.required, self.low, self.high)
