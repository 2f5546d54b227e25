"""Within-season expanding z-scores, composites and the mismatch flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.operators.quantiles import RANKED_ROWS, quantiles
from fieldmark.session import materialise

# The composites' inputs and cut-offs.
OFF_EPA = "ol_pass_epa_per_att"
OFF_PRESSURE = "ol_pressure_proxy_rate"
DEF_PRESSURE = "def_pressure_proxy_rate"
DEF_EPA = "def_pass_epa_allowed_per_att"
COMPOSITE_INPUTS = [OFF_EPA, OFF_PRESSURE, DEF_PRESSURE, DEF_EPA]
TOP_QUARTILE = 0.75
BOTTOM_QUARTILE = 0.25
MIN_POOL = 4
MIN_SD = 1e-9


def pool_sides(games: DataFrame, cols: list[str]) -> DataFrame:
    """Home and away values of each game as two rows."""
    views = [F.struct(*[F.col(f"{side}_{c}").alias(c) for c in cols]) for side in ("home", "away")]
    return games.select("season", "week", F.inline(F.array(*views)))


def expanding_moments(games: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and sample sd of the pooled values of the season up to each week.

    Values are reduced to (n, mean, M2) per week first, so the window sees one row per week.
    Deviations are taken from the season's first weekly mean to keep the sums well scaled.
    """
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"{c}_n"),
            F.avg(c).alias(f"{c}_mean"),
            (F.var_pop(c) * F.count(c)).alias(f"{c}_m2"),
        ]
    weekly = pool_sides(games, cols).groupBy("season", "week").agg(*aggs)
    order = Window.partitionBy("season").orderBy("week")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)

    shifted = weekly.withColumns(
        {
            f"{c}_c": F.first(f"{c}_mean", ignorenulls=True).over(
                order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            )
            for c in cols
        }
    )
    out = {}
    for c in cols:
        n, d = F.col(f"{c}_n"), F.col(f"{c}_mean") - F.col(f"{c}_c")
        total = F.sum(n).over(upto)
        first = F.sum(n * d).over(upto)
        second = F.sum(F.col(f"{c}_m2") + n * d * d).over(upto)
        out[f"{c}_mu"] = F.col(f"{c}_c") + F.try_divide(first, total)
        spread = F.greatest(F.lit(0.0), second - F.try_divide(first * first, total))
        out[f"{c}_sd"] = F.sqrt(F.try_divide(spread, total - 1))
    return shifted.select("season", "week", *[e.alias(k) for k, e in out.items()])


def _z(value: Column, mu: Column, sd: Column) -> Column:
    """0 where the pool has no spread; a missing value stays missing where it has."""
    return F.when(sd > MIN_SD, (value - mu) / sd).otherwise(F.lit(0.0))


def expanding_zscores(games: DataFrame, cols: list[str]) -> DataFrame:
    """Add ``home_<c>_z`` and ``away_<c>_z``.

    The moments, one row a week, are stored first: Spark then sees their size and broadcasts them, and the games are
    not dealt by a handful of hot weeks.
    """
    joined = games.join(materialise(expanding_moments(games, cols), "weekly"), ["season", "week"], "left")
    z = {
        f"{side}_{c}_z": _z(F.col(f"{side}_{c}"), F.col(f"{c}_mu"), F.col(f"{c}_sd"))
        for side in ("home", "away")
        for c in cols
    }
    return joined.withColumns(z).drop(*[f"{c}_{s}" for c in cols for s in ("mu", "sd")])


def composites(games: DataFrame) -> DataFrame:
    """Offence: EPA less pressure. Defence: pressure less EPA allowed. Higher is better."""
    scored = expanding_zscores(games, COMPOSITE_INPUTS)
    out = {}
    for side in ("home", "away"):
        out[f"{side}_ol_composite"] = F.col(f"{side}_{OFF_EPA}_z") - F.col(f"{side}_{OFF_PRESSURE}_z")
        out[f"{side}_def_composite"] = F.col(f"{side}_{DEF_PRESSURE}_z") - F.col(f"{side}_{DEF_EPA}_z")
    return scored.withColumns(out)


def expanding_cutoffs(scored: DataFrame) -> DataFrame:
    """Season-so-far quartile cut-offs of both composites, one row per (season, week)."""
    pooled = pool_sides(scored, ["ol_composite", "def_composite"])
    long = pooled.unpivot(["season", "week"], ["ol_composite", "def_composite"], "kind", "score")
    both = quantiles(
        long, "score", {"p25": BOTTOM_QUARTILE, "p75": TOP_QUARTILE}, by=["season", "kind"], order="week", ranked_rows=RANKED_ROWS
    )
    return both.groupBy("season", "week").agg(
        F.max(F.when(F.col("kind") == "ol_composite", F.col("p75"))).alias("off_p75"),
        F.max(F.when(F.col("kind") == "ol_composite", F.col("n_values"))).alias("off_n"),
        F.max(F.when(F.col("kind") == "def_composite", F.col("p25"))).alias("def_p25"),
        F.max(F.when(F.col("kind") == "def_composite", F.col("n_values"))).alias("def_n"),
    )


def mismatch_flag(games: DataFrame) -> DataFrame:
    """1: strong home offence meets weak away defence; 2: the reverse; 0: neither.

    The scored games are stored once, since the cut-offs read them several times, and so are the cut-offs, which
    Spark broadcasts by their size.
    """
    scored = materialise(composites(games), "composites")
    cut = materialise(expanding_cutoffs(scored), "cutoffs")
    joined = scored.join(cut, ["season", "week"], "left")
    enough = (F.col("off_n") >= MIN_POOL) & (F.col("def_n") >= MIN_POOL)

    def hit(attack: str, defend: str) -> Column:
        return (
            enough
            & (F.col(f"{attack}_ol_composite") >= F.col("off_p75"))
            & (F.col(f"{defend}_def_composite") <= F.col("def_p25"))
        )

    flag = F.when(hit("home", "away"), 1).when(hit("away", "home"), 2).otherwise(0)
    zcols = [f"{side}_{c}_z" for side in ("home", "away") for c in COMPOSITE_INPUTS]
    return joined.withColumn("ol_mismatch_flag", flag).drop(*zcols, "off_p75", "off_n", "def_p25", "def_n")
