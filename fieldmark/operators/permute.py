"""Seeded permutations inside groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 4096


def hash_positions(
    df: DataFrame, group: list[str], key: list[str], seed: int, name: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Number the rows of each group 1..n in the order of a seeded hash of their key.

    Ordering by a hash cuts evenly into ranges: rows are ranked inside a hash range of about
    ``slice_rows`` rows and shifted by the sizes of the earlier ranges, so a larger group has more
    ranges and no larger sort. The order itself does not depend on the ranges.
    """
    h = F.xxhash64(F.lit(seed), *key)
    part = F.shiftright(h, 32) + F.lit(2**31)
    slices = df.groupBy(*group).agg(F.ceil(F.count("*") / slice_rows).alias("_slices"))
    ranged = df.withColumn("_h", h).join(slices, group)
    ranged = ranged.withColumn("_part", F.floor(part * F.col("_slices") / F.lit(2**32)).cast("int")).drop("_slices")
    sizes = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*group, "_part").orderBy("_h", *key)
    return (
        ranged.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*group, "_part"])
        .withColumn(name, F.col("_rank") + F.col("_offset"))
        .drop("_h", "_part", "_rank", "_offset")
    )


def permute_column(df: DataFrame, column: str, group: list[str], key: list[str], seed: int) -> DataFrame:
    """Reassign a column's values among the rows of each group; repeatable for a seed."""
    receivers = hash_positions(df.drop(column), group, key, seed * 2 + 1, "_slot")
    donors = hash_positions(df.select(*group, *[k for k in key if k not in group], column), group, key, seed * 2, "_slot")
    return receivers.join(donors.select(*group, "_slot", column), [*group, "_slot"]).drop("_slot").select(*df.columns)


def shuffle_labels(games: DataFrame, seed: int, label: str = "home_covered") -> DataFrame:
    """Break the link between features and labels inside each season (leakage probe)."""
    return permute_column(games, label, ["season"], ["game_id"], seed)


def permuted_copies(
    test: DataFrame, cols: list[str], group: list[str], key: list[str], seed: int, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One copy of the test rows per column, with that column permuted inside the group.

    ``carry`` names further columns that stay with their rows. Donor values come from one long table, so the work is one pass whatever the column count.
    """
    width = F.array(*[F.col(c).cast("double") for c in cols])
    base = test.select(*group, *key, *carry, width.alias("_values"))
    receivers = hash_positions(base, group, key, seed * 2 + 1, "_slot")
    donors = hash_positions(base, group, key, seed * 2, "_slot").select(
        *group, "_slot", F.col("_values").alias("_donor")
    )
    paired = receivers.join(donors, [*group, "_slot"])
    index = F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))).alias("_i")
    copies = paired.select(*group, *key, *carry, "_values", "_donor", index)
    swapped = F.transform(
        "_values", lambda v, i: F.when(i == F.col("_i"), F.get(F.col("_donor"), F.col("_i"))).otherwise(v)
    )
    names = F.array(*[F.lit(c) for c in cols])
    return copies.select(
        *group, *key, *carry, F.get(names, F.col("_i")).alias("permuted_feature"), swapped.alias("_swapped")
    ).select(*group, *key, *carry, "permuted_feature", *[F.get("_swapped", F.lit(i)).alias(c) for i, c in enumerate(cols)])
