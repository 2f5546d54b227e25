"""Distribution views of predictions and column profiles of uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.functions.expr import right_closed_bin
from fieldmark.operators.quantiles import RANKED_ROWS, quantiles

# Edges of the signed spread histogram.
SPREAD_EDGES = [-30, -10, -6, -3, 0, 3, 6, 10, 30]


def type_class(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "numeric" if isinstance(kind, T.NumericType) else "categorical"


def column_profile(df: DataFrame) -> DataFrame:
    """Type class and null rate of every column from one aggregate."""
    total = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = total.unpivot(["_n"], df.columns, "column_name", "nulls")
    classes = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, type_class(f.dataType))])
    return long.select(
        "column_name",
        F.element_at(classes, F.col("column_name")).alias("data_type"),
        F.round(F.coalesce(F.try_divide(F.col("nulls").cast("double"), F.col("_n")), F.lit(0.0)), 6).alias("null_rate"),
    )


def side_distribution(preds: DataFrame) -> DataFrame:
    """Share of each predicted side, its accuracy and the spread of its probabilities."""
    p = F.col("predicted_home_cover_prob")
    out = preds.groupBy("predicted_side").agg(
        F.count("*").alias("n_rows"),
        F.avg("correct").alias("accuracy"),
        F.avg(p).alias("mean_prob"),
        F.stddev_samp(p).alias("sd_prob"),
        F.min(p).alias("min_prob"),
        F.max(p).alias("max_prob"),
    )
    whole = preds.agg(F.count("*")).scalar()
    return out.withColumn("share", F.col("n_rows") / whole)


def season_comparison(preds: DataFrame) -> DataFrame:
    """Model accuracy beside the cover rate, per season."""
    return preds.groupBy("season").agg(
        F.avg("correct").alias("model_rate"),
        F.avg(F.col("actual_home_covered").cast("int")).alias("cover_rate"),
        F.count("correct").alias("n_games"),
    )


def quintile_accuracy(preds: DataFrame) -> DataFrame:
    """Accuracy per probability quintile with exact interpolated edges, bins right-closed."""
    decided = preds.where(F.col("correct").isNotNull())
    probs = {f"e{i}": i / 5 for i in range(1, 5)}
    edges = quantiles(decided, "predicted_home_cover_prob", probs, ranked_rows=RANKED_ROWS).select(F.struct(*probs)).scalar()
    p = F.col("predicted_home_cover_prob")
    tagged = decided.withColumn("_e", edges)
    number: Column = F.lit(5)
    for i in range(4, 0, -1):
        number = F.when(p <= F.col(f"_e.e{i}"), i).otherwise(number)
    return tagged.groupBy(number.alias("quintile")).agg(
        F.count("*").alias("n_games"), F.avg("correct").alias("accuracy"), F.min(p).alias("min_prob"), F.max(p).alias("max_prob")
    )


def favourite_crosstab(preds: DataFrame) -> DataFrame:
    """Home favoured (positive spread) against the predicted side."""
    return (
        preds.groupBy((F.col("home_spread_close") > 0).alias("home_favoured"))
        .pivot("predicted_side", ["home", "away"])
        .agg(F.count(F.lit(1)))
        .fillna(0, subset=["home", "away"])
    )


def cover_by_spread_bin(games: DataFrame, edges: list[float] | None = None) -> DataFrame:
    label = right_closed_bin(F.col("home_spread_close"), edges or SPREAD_EDGES)
    return (
        games.where(F.col("home_covered").isNotNull())
        .groupBy(label.alias("spread_bin"))
        .agg(F.count("*").alias("n_games"), F.avg(F.col("home_covered").cast("int")).alias("cover_rate"))
        .where(F.col("spread_bin").isNotNull())
    )
