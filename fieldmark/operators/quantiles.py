"""Exact linear-interpolated quantiles without gathering a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a
histogram locates the bucket that holds each wanted order statistic, and only the values of
those buckets are then ranked. Bucket edges come from a mergeable quantile sketch, so buckets
stay even whatever the distribution; the sketch only decides where values are ranked and never
enters a result.

One cut makes a ranked bucket the group's size over the number of buckets. With ``ranked_rows``
wanted buckets are cut again until none is above it, each cut dividing them by the number of
buckets again, so no task ranks more than that however large a group is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.session import discard, materialise

BUCKETS = 256
RANKED_ROWS = 1_000_000


def _bucket_of(counts: DataFrame, buckets: int) -> DataFrame:
    """Add ``_b``, the number of edges below the value, by binary search over the edges."""
    out = counts.withColumn("_b", F.lit(0))
    half = buckets // 2
    while half:
        above = F.col("_v") > F.get("_edges", F.col("_b") + (half - 1))
        out = out.withColumn("_b", F.col("_b") + F.when(above, half).otherwise(0))
        half //= 2
    return out.drop("_edges")


def _same(left: str, right: str, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols])


def _edges(counts: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """A boundary between neighbouring buckets per key. The first is the least value, so a bucket of two values or more is divided."""
    cuts = [i / (buckets - 1) for i in range(buckets - 1)]
    return counts.groupBy(*key).agg(F.percentile_approx("_v", cuts, 10 * buckets).alias("_edges"))


def _running(hist: DataFrame, key: list[str], step: str, steps: DataFrame | None, buckets: int) -> DataFrame:
    """Rows before and in each bucket (``_start``, ``_end``) and in all (``_total``), up to each of ``steps``."""
    if steps is not None:  # running sums per bucket over a row for each step and bucket
        grid = steps.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_b"), F.lit(0).cast("bigint").alias("_n"))
        filled = grid.unionByName(hist).groupBy(*key, step, "_b").agg(F.sum("_n").alias("_n"))
        earlier = Window.partitionBy(*key, "_b").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
        hist = filled.withColumn("_n", F.sum("_n").over(earlier)).where("_n > 0")
    in_step = Window.partitionBy(*key, step)
    running = in_step.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumns(
        {"_end": F.sum("_n").over(running), "_total": F.sum("_n").over(in_step)}
    ).withColumn("_start", F.col("_end") - F.col("_n"))


def _cut_again(counts: DataFrame, targets: DataFrame, key: list[str], step: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Divide every wanted bucket into ``buckets``: values and targets with the narrower ``_path``."""
    cut = counts.alias("c").join(_edges(counts, key, buckets).alias("e"), _same("c", "e", key)).select("c.*", "e._edges")
    cut = _bucket_of(cut, buckets)
    hist = cut.groupBy(*key, step, "_b").agg(F.sum("_n").alias("_n"))
    found = _running(hist, key, step, targets.select(*key, step).distinct(), buckets)
    meet = _same("t", "h", [*key, step]) & (F.col("t._skip") >= F.col("h._start")) & (F.col("t._skip") < F.col("h._end"))
    narrow = F.col("_path") * buckets + F.col("_b")
    met = targets.alias("t").join(found.alias("h"), meet).select("t.*", "h._b", "h._start")
    targets = met.withColumns({"_skip": F.col("_skip") - F.col("_start"), "_path": narrow}).drop("_b", "_start")
    return cut.withColumn("_path", narrow).drop("_b"), targets


def _wanted_values(counts: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """The values in a bucket that some target asks for."""
    wanted = targets.select(*key).distinct()
    return counts.alias("c").join(wanted.alias("w"), _same("c", "w", key), "left_semi")


def _narrowed(
    counts: DataFrame, targets: DataFrame, key: list[str], step: str, buckets: int, ranked_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Cut until no wanted bucket holds more than ``ranked_rows`` distinct values, or a single one."""
    counts = counts.withColumn("_path", F.col("_path").cast("decimal(38,0)"))
    targets = targets.withColumn("_path", F.col("_path").cast("decimal(38,0)"))
    before: tuple[DataFrame, ...] = ()
    while True:
        targets = materialise(targets, "order-statistics")
        counts = materialise(_wanted_values(counts, targets, key), "order-values")
        discard(*before)
        before = (targets, counts)
        sizes = counts.groupBy(*key, "_v").count().groupBy(*key).agg(F.count("*").alias("n"))
        if not sizes.where(F.col("n") > max(1, ranked_rows)).limit(1).count():
            return counts, targets
        counts, targets = _cut_again(counts, targets, key, step, buckets)
        kind = F.col("_path").cast("decimal(38,0)")
        counts, targets = counts.withColumn("_path", kind), targets.withColumn("_path", kind)


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: list[str] | None = None,
    order: str | None = None,
    buckets: int = BUCKETS,
    ranked_rows: int | None = None,
) -> DataFrame:
    """Quantiles per group, one column per entry of ``probs``, plus ``n_values``.

    ``buckets`` is a power of two. With ``order`` the result has one row per (group, order value) and covers all rows of the
    group up to and including that order value. ``ranked_rows`` bounds the distinct values ranked together; it stores
    intermediate tables, so the call runs jobs. Without it the result is one lazy plan with one cut.
    """
    group = list(by or [])
    if not group:
        df, group = df.withColumn("_all", F.lit(0)), ["_all"]
    step = order or "_step"
    if order is None:
        df = df.withColumn(step, F.lit(0))

    every_step = df.select(*group, step).distinct()
    v = df.select(*group, step, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = v.groupBy(*group, step, "_v").agg(F.count("*").alias("_n"))
    # ties were merged above, so a repeated value fills no bucket
    edges = _edges(counts, group, buckets)
    if by:
        counts = counts.alias("c").join(edges.alias("e"), _same("c", "e", group)).select("c.*", "e._edges")
    else:  # one row of edges: a join would have no key
        counts = counts.withColumn("_edges", edges.select("_edges").scalar())
    counts = _bucket_of(counts, buckets).withColumnRenamed("_b", "_path")

    # histogram of everything up to each step: at most buckets rows per (group, step)
    hist = counts.groupBy(*group, step, F.col("_path").alias("_b")).agg(F.sum("_n").alias("_n"))
    at_step = _running(hist, group, step, every_step if order is not None else None, buckets)

    # wanted order statistics: the two neighbours of q * (n - 1)
    wanted = [
        F.struct(
            F.lit(name).alias("_q"),
            F.lit(edge).alias("_edge"),
            rounding(F.lit(p) * (F.col("_total") - 1)).cast("bigint").alias("_rank"),
            (F.lit(p) * (F.col("_total") - 1)).alias("_pos"),
        )
        for name, p in probs.items()
        for edge, rounding in (("lo", F.floor), ("hi", F.ceil))
    ]
    targets = at_step.select("*", F.inline(F.array(*wanted))).where(
        (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end"))
    )
    targets = targets.select(
        *group, step, F.col("_b").alias("_path"), "_q", "_edge", "_pos", "_total", (F.col("_rank") - F.col("_start")).alias("_skip")
    )
    key = [*group, "_path"]
    if ranked_rows is not None:
        counts, targets = _narrowed(counts, targets, key, step, buckets, ranked_rows)

    # rank only the values of the target buckets
    slot = [*group, step, "_q", "_edge"]
    inside = (
        targets.alias("t")
        .join(
            counts.alias("c"),
            _same("t", "c", group) & (F.col("t._path") == F.col("c._path")) & (F.col(f"t.{step}") >= F.col(f"c.{step}")),
        )
        .select(*[F.col(f"t.{c}") for c in [*slot, "_pos", "_total", "_skip"]], "c._v", "c._n")
        .groupBy(*slot, "_pos", "_total", "_skip", "_v")
        .agg(F.sum("_n").alias("_n"))
    )
    ranked = Window.partitionBy(*slot).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        inside.withColumn("_end", F.sum("_n").over(ranked))
        .where((F.col("_skip") < F.col("_end")) & (F.col("_skip") >= F.col("_end") - F.col("_n")))
    )

    def edge_of(name: str, edge: str):
        return F.max(F.when((F.col("_q") == name) & (F.col("_edge") == edge), F.col("_v")))

    def value_of(name: str):
        low, high = edge_of(name, "lo"), edge_of(name, "hi")
        pos = F.max(F.when(F.col("_q") == name, F.col("_pos")))
        return (low + (high - low) * (pos - F.floor(pos))).alias(name)

    out = picked.groupBy(*group, step).agg(
        F.max("_total").alias("n_values"), *[value_of(name) for name in probs]
    )
    return out.drop(*[c for c in ("_all", "_step") if c in out.columns])
