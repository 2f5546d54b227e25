"""Writers. Every table is Parquet; season tables are partitioned by season."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.schemas import PREDICTIONS, RUNS
from fieldmark.sources.coerce import project_to

SALT = "_write_salt"


def spread_for_write(df: DataFrame, partition: str, cluster: list[str], files: int | None = None) -> DataFrame:
    """Rows dealt to writers by partition value and cluster columns, sorted so row groups prune well.

    Spark sizes the writers as the data needs (a rebalance): it merges small ones and splits a large
    or hot partition value over several. ``files`` deals each value to that many writers first, and Spark
    splits those that are large in the same way, so no writer grows with the table.
    """
    if files is None:
        return df.hint("rebalance", F.col(partition)).sortWithinPartitions(partition, *cluster)
    salt = F.pmod(F.xxhash64(*cluster), F.lit(files))
    return (
        df.withColumn(SALT, salt)
        .hint("rebalance", F.col(partition), F.col(SALT))
        .sortWithinPartitions(partition, *cluster)
        .drop(SALT)
    )


def create_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    partition: str | None = None,
) -> None:
    """Make an empty table with a declared schema unless rows or files are already there."""
    if table_exists(spark, path):
        return
    empty = spark.createDataFrame([], schema)
    (empty.write.partitionBy(partition) if partition else empty.write).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored at the path; an unreadable table is an error, not an absent one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def replace_partitions(
    df: DataFrame, path: str, cluster: list[str], partition: str = "season", files: int | None = None
) -> None:
    """Replace only the partitions present in the frame, so a rerun leaves the same table."""
    (
        spread_for_write(df, partition, cluster, files)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


_turns: dict[str, threading.Lock] = defaultdict(threading.Lock)


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Append rows. Spark's writers of one folder share a staging folder, which the first to finish removes,
    so the threads of one driver take turns; drivers at the same time write folders of their own."""
    writer = df.write.mode("append")
    with _turns[path]:
        (writer.partitionBy(partition) if partition else writer).parquet(path)


def append_predictions(df: DataFrame, path: str) -> None:
    append(project_to(df, PREDICTIONS), path, "season")


def run_record(metrics: DataFrame) -> DataFrame:
    """Bring a one-row metrics frame to the run table; nested columns become JSON text."""
    out = [
        F.to_json(f.name).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        else F.col(f.name)
        for f in metrics.schema.fields
    ]
    return project_to(metrics.select(*out), RUNS)


def error_record(spark: SparkSession, run: dict, message: str) -> DataFrame:
    """Record of a run that failed, with its whole message."""
    have = [f for f in RUNS.fields if f.name in run]
    one = spark.createDataFrame(
        [tuple(run[f.name] for f in have)], T.StructType([T.StructField(f.name, f.dataType) for f in have])
    )
    return failed_records(one, F.lit(message))


def failed_records(runs: DataFrame, message: Column) -> DataFrame:
    """The run-table rows of runs that failed with ``message``: status, no gate, the whole message."""
    failed = {"status": F.lit("failed"), "gate_passed": F.lit(False), "error_message": message}
    return project_to(runs.withColumns(failed), RUNS)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, with columns only one side has filled with NULL in the other."""
    return old.unionByName(new, allowMissingColumns=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sample_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First n rows under an explicit order, so the sample is repeatable."""
    return df.orderBy(*order).limit(n)
