"""Positions inside groups of any size: rows are sorted by ranges, and ranges are joined by their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import store


def positions(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with ``position`` (long, from 1) and ``size`` (rows) of their group; stored.

    ``group`` columns hold no nulls; in ``order`` nulls come first. A group that holds a third of all
    rows is spread over many sort ranges, which no window does: only one row a group and
    range meets in a window. Rows equal in all columns named here get positions in any order.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = store(ranged.withColumn("place", F.monotonically_increasing_id()), name)
    ranged = ranged.withColumn("part", F.shiftright("place", 33))
    parts = ranged.groupBy(*group, "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.withColumn("size", F.sum("n").over(whole)).drop("n")
    found = ranged.join(parts, [*group, "part"]).withColumn("position", F.expr("before + place - first + 1"))
    return found.drop("place", "part", "first", "before")
