"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # the JVM never compiles methods above 8000 bytes of bytecode; wide projections would run
    # interpreted, so fall back to operator-wise evaluation for those stages
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # wide feature plans have thousands of column calls; recording each call site is slow
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "fieldmark", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings every job here assumes; extra settings override them.

    Keyword names use ``__`` for ``.``: ``build_session(spark__sql__shuffle__partitions="8")``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    given = {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in {**SETTINGS, **given}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_fallback: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Without the setting a local master gets a temporary folder, which its one process sees; on a
    cluster executors would not see each other's files, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app_id = spark.sparkContext.applicationId
    if app_id not in _fallback:
        _fallback[app_id] = tempfile.mkdtemp(prefix="fieldmark-")
    return _fallback[app_id]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let ``DataFrame.checkpoint()`` and iterative fits cut lineage reliably."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one intermediate table."""
    return f"{shared_root(spark).rstrip('/')}/fieldmark/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str = "step", partition: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives later stages column pruning and sizes. With
    ``partition`` later stages read only the values of that column they ask for.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.scratch_path = path
    return stored


@contextmanager
def untagged(spark: SparkSession):
    """Jobs of this thread that a cancellation by job tag does not reach: what records how a cancelled run ended."""
    sc = spark.sparkContext
    tags = sc.getJobTags()
    sc.clearJobTags()
    try:
        yield
    finally:
        for tag in tags:
            sc.addJobTag(tag)


def discard(*stored: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` wrote, once nothing reads them any more.

    The folder is reached through Hadoop's file systems, so it may lie in any store Spark writes to.
    """
    for df in stored:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
