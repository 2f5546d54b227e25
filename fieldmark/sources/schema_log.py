"""Season tables whose columns change over time, read by a log of schemas instead of by every file's footer.

Each write appends the columns of the partitions it replaces to the log, once before and once after
the files change. A reader takes, per partition, the last finished write and whatever began since,
so a write that broke off hides no column that is still stored. Only distinct schemas reach the
driver: as many as there were changes, however many partitions and files the table has.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.sources.readers import season_slice
from fieldmark.sources.sinks import append, replace_partitions

LOG = T.StructType(
    [
        T.StructField("part", T.StringType()),
        T.StructField("columns", T.StringType()),
        T.StructField("write_id", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("finished", T.BooleanType()),
    ]
)
#: a later type holds every value of those before it; Parquet files of the earlier ones are read as the later
WIDENING = [T.IntegerType(), T.LongType()]


def write_logged(df: DataFrame, path: str, log: str, cluster: list[str], partition: str = "season") -> None:
    """Replace the partitions present in the frame and log their columns. Writers' clocks order the log."""
    spark, write_id = df.sparkSession, uuid.uuid4().hex
    columns = T.StructType([f for f in df.schema.fields if f.name != partition]).json()
    begun = df.select(F.col(partition).cast("string").alias("part")).distinct()
    stamp = [F.lit(columns).alias("columns"), F.lit(write_id).alias("write_id")]
    append(begun.select("part", *stamp, F.lit(time.time_ns()).alias("at"), F.lit(False).alias("finished")), log)
    replace_partitions(df, path, cluster, partition)
    own = spark.read.schema(LOG).parquet(log).where((F.col("write_id") == write_id) & ~F.col("finished"))
    append(own.withColumns({"at": F.lit(time.time_ns()), "finished": F.lit(True)}), log)


def merged(schemas: list[T.StructType]) -> T.StructType:
    """All columns of the schemas, nullable, in order of first mention; types that do not widen into one another are an error."""
    types: dict[str, T.DataType] = {}
    for field in (f for s in schemas for f in s.fields):
        have = types.setdefault(field.name, field.dataType)
        if have != field.dataType:
            if have not in WIDENING or field.dataType not in WIDENING:
                raise ValueError(f"column {field.name} is stored as {have.simpleString()} and {field.dataType.simpleString()}")
            types[field.name] = max(have, field.dataType, key=WIDENING.index)
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


def logged_schema(spark: SparkSession, log: str) -> T.StructType:
    """The columns stored in any partition now."""
    since = F.coalesce(F.max(F.when(F.col("finished"), F.col("at"))).over(Window.partitionBy("part")), F.lit(0))
    entries = spark.read.schema(LOG).parquet(log).withColumn("since", since).where(F.col("at") >= F.col("since"))
    found = entries.groupBy("columns").agg(F.min("at").alias("at")).orderBy("at", "columns").collect()
    return merged([T.StructType.fromJson(json.loads(r["columns"])) for r in found])


def read_logged(
    spark: SparkSession, path: str, log: str, season=None, columns=None, partition: T.StructField | None = None
) -> DataFrame:
    """The table with all columns of its log, NULL where a partition lacks one; no footer is read before the scan."""
    key = partition or T.StructField("season", T.IntegerType())
    schema = T.StructType([*logged_schema(spark, log).fields, key])
    return season_slice(spark.read.schema(schema).parquet(path), season, columns)
