"""Predictions and their records: hit rates, log loss, gates, slices, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.expr import (
    ABS_SPREAD_BUCKETS,
    abs_spread_bucket,
    clipped_log_loss,
    correct_flag,
    predicted_side,
)
from fieldmark.schemas import GATE_HIT_RATE, GATE_MIN_GAMES

# The output contract of a scored game.
PREDICTION_COLUMNS = [
    "game_id",
    "season",
    "week",
    "home_team",
    "away_team",
    "home_spread_close",
    "predicted_home_cover_prob",
    "predicted_side",
    "actual_home_covered",
    "correct",
    "ol_mismatch_flag",
    "fold",
]


def score(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Games with a probability and a label -> prediction rows; no flag column reads as 0."""
    if "ol_mismatch_flag" not in df.columns:
        df = df.withColumn("ol_mismatch_flag", F.lit(0))
    side = predicted_side(F.col("predicted_home_cover_prob"))
    return df.withColumns(
        {
            "predicted_side": side,
            "actual_home_covered": F.col("home_covered"),
            "correct": correct_flag(side, F.col("home_covered")),
        }
    ).select(*keep, *PREDICTION_COLUMNS)


def record_columns(correct: str = "correct") -> dict[str, Column]:
    """Wins, losses, pushes, decided games and hit rate as aggregates."""
    c = F.col(correct)
    return {
        "wins": F.count_if(c == 1),
        "losses": F.count_if(c == 0),
        "pushes": F.count_if(c.isNull()),
        "n_games": F.count(c),
        "hit_rate": F.try_divide(F.count_if(c == 1).cast("double"), F.count(c)),
    }


def record(preds: DataFrame, by: list[str] | None = None, correct: str = "correct") -> DataFrame:
    return preds.groupBy(*(by or [])).agg(*[e.alias(n) for n, e in record_columns(correct).items()])


def fold_metrics(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Record, log loss over decided games and the always-home record, per fold."""
    label = F.col("actual_home_covered")
    loss = clipped_log_loss(F.col("predicted_home_cover_prob"), label)
    return preds.groupBy(*(by or ["fold"])).agg(
        *[e.alias(n) for n, e in record_columns().items()],
        F.avg(loss).alias("model_log_loss"),
        F.count_if(label).alias("baseline_wins"),
        F.count_if(~label).alias("baseline_losses"),
        F.try_divide(F.count_if(label).cast("double"), F.count(label)).alias("baseline_hit_rate"),
    )


def totals(
    metrics: DataFrame,
    by: list[str] | None = None,
    threshold: float = GATE_HIT_RATE,
    min_games: int = GATE_MIN_GAMES,
) -> DataFrame:
    """Sum folds and decide the gate."""
    out = metrics.groupBy(*(by or [])).agg(
        F.sum("wins").alias("total_wins"),
        F.sum("losses").alias("total_losses"),
        F.sum("pushes").alias("total_pushes"),
        F.sum("baseline_wins").alias("baseline_total_wins"),
        F.sum("baseline_losses").alias("baseline_total_losses"),
    )
    n = F.col("total_wins") + F.col("total_losses")
    base = F.col("baseline_total_wins") + F.col("baseline_total_losses")
    return out.withColumns(
        {
            "total_n_games": n,
            "overall_hit_rate": F.try_divide(F.col("total_wins").cast("double"), n),
            "baseline_hit_rate": F.try_divide(F.col("baseline_total_wins").cast("double"), base),
        }
    ).withColumn("gate_passed", gate(F.col("overall_hit_rate"), F.col("total_n_games"), threshold, min_games))


def gate(
    hit_rate: Column,
    n_games: Column,
    threshold: float = GATE_HIT_RATE,
    min_games: int = GATE_MIN_GAMES,
    shuffled: Column | None = None,
) -> Column:
    """Hit rate and sample both reach the bar; a run on permuted labels never passes."""
    ok = F.coalesce((hit_rate >= threshold) & (n_games >= min_games), F.lit(False))
    return ok if shuffled is None else ok & ~F.coalesce(shuffled, F.lit(False))


def baseline_record(games: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Record of always picking home."""
    return record(games.withColumn("_home", F.col("home_covered").cast("int")), by, "_home")


def subset_record(preds: DataFrame, flag: int, by: list[str] | None = None) -> DataFrame:
    """Record on the games carrying one mismatch flag."""
    return record(preds.where(F.col("ol_mismatch_flag") == flag), by).withColumn("flag_value", F.lit(flag))


def mean_importance(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feature").agg(F.avg("importance").alias("importance"))


def spread_slices(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Record per absolute spread band; bands without games stay in, with a NULL rate."""
    by = by or []
    labels = F.array(*[F.lit(b) for b in ABS_SPREAD_BUCKETS])
    frame = preds.select(*by).distinct() if by else preds.sparkSession.range(1)
    bands = frame.select(*by, F.explode(labels).alias("spread_bucket"))
    decided = preds.where(F.col("correct").isNotNull())
    counted = decided.groupBy(*by, abs_spread_bucket(F.col("home_spread_close")).alias("spread_bucket")).agg(
        F.count_if(F.col("correct") == 1).alias("wins"), F.count("*").alias("n_games")
    )
    joined = bands.join(counted, [*by, "spread_bucket"], "left").fillna(0, subset=["wins", "n_games"])
    return joined.withColumns(
        {
            "losses": F.col("n_games") - F.col("wins"),
            "hit_rate": F.try_divide(F.col("wins").cast("double"), F.col("n_games")),
        }
    )


def calibration(preds: DataFrame, n_bins: int = 10) -> DataFrame:
    """Equal-width right-closed bins over the observed range; the minimum joins the first bin.

    ``correct_rate`` is the share of right calls, ``actual_cover_rate`` the share of covers.
    Bins without games give no row; when all probabilities agree there is one bin.
    """
    decided = preds.where(F.col("correct").isNotNull())
    p = F.col("predicted_home_cover_prob")
    span = decided.agg(F.struct(F.min(p).alias("lo"), F.max(p).alias("hi")).alias("span")).scalar()
    binned = decided.withColumn("_span", span)
    width = (F.col("_span.hi") - F.col("_span.lo")) / n_bins
    index = F.when(
        width > 0, F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), F.ceil((p - F.col("_span.lo")) / width) - 1))
    ).otherwise(0)
    return binned.groupBy(index.cast("int").alias("bin")).agg(
        F.min(F.col("_span.lo") + index * width).alias("bin_from"),
        F.min(F.col("_span.lo") + (index + 1) * width).alias("bin_to"),
        F.count("*").alias("n_games"),
        F.avg("correct").alias("correct_rate"),
        F.avg(F.col("actual_home_covered").cast("int")).alias("actual_cover_rate"),
        F.avg(p).alias("mean_pred"),
    )
