"""Column expressions shared by the operators. Everything stays in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmark.schemas import EPS, MIN_SAMPLE


def number(c: Column) -> Column:
    """Value as a double; bad text and not-a-number are both missing."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def eps_rate(num: Column, den: Column) -> Column:
    """Ratio that is 0.0, not NULL, on an empty denominator."""
    return num / (den + F.lit(EPS))


def sampled_rate(num: Column, den: Column, minimum: int = MIN_SAMPLE) -> Column:
    """``eps_rate`` that is NULL below a minimum sample."""
    return F.when(den >= minimum, eps_rate(num, den))


def cover_label(home_score: Column, away_score: Column, spread: Column) -> Column:
    """True / false / NULL on a push or a missing input; a positive spread favours home."""
    margin = home_score - away_score
    return F.when(margin > spread, True).when(margin < spread, False)


def text_boolean(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isin("True", "1"), True).when(text.isin("False", "0"), False)


def flag(c: Column) -> Column:
    """Boolean flag, false when missing."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def is_scrimmage(play_type: Column, down: Column, kinds=("pass", "run")) -> Column:
    return play_type.isin(*kinds) & down.isNotNull()


def at_least(c: Column, limit: float) -> Column:
    """0/1 indicator; a missing value counts as 0."""
    return F.when(c >= limit, 1).otherwise(0)


def pressured(qb_hit: Column, sack: Column) -> Column:
    return F.when((qb_hit.cast("int") == 1) | (sack.cast("int") == 1), 1).otherwise(0)


def game_status(home_score: Column, away_score: Column) -> Column:
    return F.when(home_score.isNotNull() & away_score.isNotNull(), "final").otherwise("scheduled")


def season_of_game_id(game_id: Column) -> Column:
    """Season encoded before the first underscore, NULL unless within 2000..2100."""
    year = F.split(game_id, "_").getItem(0).try_cast("int")
    return F.when(year.between(2000, 2100), year)


def team_code_ok(c: Column) -> Column:
    return F.upper(c).rlike("^[A-Z]{2,4}$")


def signed_spread_bucket(spread: Column) -> Column:
    """Five bands by signed spread; labels follow the sign rule (positive favours home)."""
    return (
        F.when(spread <= -10, "home_dog_10+")
        .when(spread <= -3, "home_dog_3-10")
        .when(spread < 3, "pick_em")
        .when(spread < 10, "home_fav_3-10")
        .when(spread.isNotNull(), "home_fav_10+")
    )


# Labels of the absolute spread bands, in report order.
ABS_SPREAD_BUCKETS = ["<=3", "(3,7]", "(7,10]", ">10"]


def abs_spread_bucket(spread: Column) -> Column:
    size = F.abs(spread)
    return (
        F.when(size <= 3, "<=3")
        .when(size <= 7, "(3,7]")
        .when(size <= 10, "(7,10]")
        .when(size > 10, ">10")
    )


def right_closed_bin(c: Column, edges: list[float]) -> Column:
    """Label ``(a, b]`` of the bin holding the value, NULL outside all bins."""
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        out = F.when((c > low) & (c <= high), f"({low:g}, {high:g}]").otherwise(out)
    return out


def predicted_side(prob: Column) -> Column:
    """Strictly above one half picks home."""
    return F.when(prob > 0.5, "home").otherwise("away")


def correct_flag(side: Column, label: Column) -> Column:
    """1 / 0, NULL on a push."""
    return F.when(label.isNotNull(), ((side == "home") == label).cast("int"))


def clipped_log_loss(prob: Column, label: Column, edge: float = 1e-7) -> Column:
    """Per-row log loss, NULL where the label is NULL."""
    p = F.least(F.greatest(prob, F.lit(edge)), F.lit(1 - edge))
    return F.when(label, -F.ln(p)).when(~label, -F.ln(1 - p))


def season_of_date(day: Column, first_month: int) -> Column:
    """Season a date belongs to when seasons start in ``first_month``."""
    return F.year(day) - F.when(F.month(day) < first_month, 1).otherwise(0)


def any_null(cols: list[str]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.col(c).isNull()
    return out
