"""Compare-and-set on an append-only log: every version states the one it was made from.

``seq`` numbers an entry's versions and ``based_on`` is the ``seq`` its writer had read (null for the
first). Each writer appends to a folder of its own (``writer=...``, a partition column), so writers of any
number of drivers never meet in one; two that read the same version both append, and the log decides: of all versions made from the same one, the first by (updated_at, writer) stands
and the others are rejected. Both are sums per key with a min, so a hot entry combines before
the shuffle and nothing is locked.

A writer learns the outcome by reading after its append (``commit``). Writers' clocks decide between
them: a version that arrives later with an earlier time would still win, so clocks may differ by no more than
an append and a read take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators.compare import latest
from fieldmark.session import untagged
from fieldmark.sources.sinks import append

FIRST = ["updated_at", "writer"]


class StaleVersion(RuntimeError):
    """Another writer's version was made from the same one and stands."""


def _winners(log: DataFrame, key: str) -> DataFrame:
    return log.groupBy(key, "based_on").agg(F.min(F.struct(*FIRST, "seq")).alias("_first"))


def judged(log: DataFrame, key: str) -> DataFrame:
    """The log with ``accepted``: whether each version stands against others made from the same one."""
    winners = _winners(log, key).withColumnsRenamed({key: "_key", "based_on": "_on"})
    joined = log.join(winners, (F.col(key) == F.col("_key")) & F.col("based_on").eqNullSafe(F.col("_on")))
    own = F.struct(*FIRST, "seq")
    return joined.withColumn("accepted", own == F.col("_first")).drop("_key", "_on", "_first")


def rejected(log: DataFrame, key: str) -> DataFrame:
    """Versions that lost against another made from the same one, with the reason."""
    return judged(log, key).where(~F.col("accepted")).drop("accepted").withColumn("reason", F.lit("stale_version"))


def heads(log: DataFrame, key: str) -> DataFrame:
    """The newest accepted version of every entry."""
    winners = _winners(log, key).select(key, "_first.*")
    newest = latest(winners, [key], ["seq"]).select(key, "seq", "writer")
    return log.join(newest, [key, "seq", "writer"])


def commit(spark: SparkSession, path: str, versions: DataFrame, key: str, writer: str) -> None:
    """Append versions of one writer (a name fit for a folder); raises if one of them lost.

    ``versions`` have ``seq``, ``based_on`` and ``updated_at``. The rows stay in the log either way and
    ``rejected`` lists the ones that lost. A cancellation by job tag does not reach the reading: it would leave a
    version that others see and whose writer does not know that it stands.
    """
    append(versions, f"{path.rstrip('/')}/writer={writer}")
    with untagged(spark):
        log = spark.read.schema(versions.withColumn("writer", F.lit(writer)).schema).parquet(path)
        touched = log.join(log.where(F.col("writer") == writer).select(key).distinct(), key, "left_semi")
        lost = rejected(touched, key).where(F.col("writer") == writer)
        names = [r[key] for r in lost.select(key).limit(20).collect()]
    if names:
        raise StaleVersion(f"another version stands for {names}")
