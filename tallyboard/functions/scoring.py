"""Rules that turn scores, periods and odds into points, hits and returns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
OVERTIME_MARGIN = 0.25
TIE_BREAK_BONUS = 0.5


def is_true(condition: Column) -> Column:
    """A comparison with a missing score counts as false."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return is_true(condition).cast("int")


def in_regulation(period: Column) -> Column:
    return period.eqNullSafe(F.lit("REG"))


def won(own: Column, other: Column) -> Column:
    return is_true(own > other)


def lost_in_regulation(own: Column, other: Column, period: Column) -> Column:
    return is_true(own < other) & in_regulation(period)


def lost_after_regulation(
    own: Column, other: Column, period: Column, count_shootout: bool = True
) -> Column:
    """Loss outside regulation; without shootouts only the period 'OT' counts."""
    late = ~in_regulation(period) if count_shootout else period.eqNullSafe(F.lit("OT"))
    return is_true(own < other) & late


def game_points(own: Column, other: Column, period: Column, unplayed: str = "zero") -> Column:
    """2 for a win, 1 for any other result outside regulation, else 0.

    A game without a period has not been played. With `unplayed="reference"`
    each side gets 1 point for it, with `unplayed="zero"` none.
    """
    if unplayed not in ("zero", "reference"):
        raise ValueError("unplayed must be 'zero' or 'reference'")
    late = ~in_regulation(period)
    if unplayed == "zero":
        late = late & period.isNotNull()
    return F.when(won(own, other), 2).when(late, 1).otherwise(0)


def correct_outcome(
    home_actual: Column, away_actual: Column, home_predicted: Column, away_predicted: Column
) -> Column:
    """1 if win, loss or tie was called right; missing scores are never right."""
    return flag(
        F.signum(home_actual - away_actual) == F.signum(home_predicted - away_predicted)
    )


def call_period(home: Column, away: Column, margin: float = OVERTIME_MARGIN) -> Column:
    return F.when(F.abs(home - away) < margin, "OT").otherwise("REG")


def break_tie(home: Column, away: Column, bonus: float = TIE_BREAK_BONUS) -> Column:
    """Home score after an exactly tied forecast has been settled for the home side."""
    return F.when(home == away, home + bonus).otherwise(home)


def winner_odds(correct: Column, home: Column, away: Column, home_odds: Column, away_odds: Column) -> Column:
    """American odds of the side that was rightly picked; 0 for a wrong pick or a tie."""
    return (
        F.when((correct == 1) & (home > away), home_odds)
        .when((correct == 1) & (home < away), away_odds)
        .otherwise(0.0)
    )


def unit_return(odds: Column, missing_odds: str = "loss") -> Column:
    """Return on one unit: o/100 on positive odds, 100/|o| on negative ones, else -1.

    A right pick without odds is a loss, or null with `missing_odds="skip"`.
    """
    if missing_odds not in ("loss", "skip"):
        raise ValueError("missing_odds must be 'loss' or 'skip'")
    result = F.when(odds > 0, odds / 100).when(odds < 0, F.try_divide(F.lit(100.0), F.abs(odds)))
    if missing_odds == "skip":
        result = result.when(odds.isNull(), F.lit(None))
    return result.otherwise(-1.0)


def seed_from_sequences(wildcard: Column, division: Column) -> Column:
    """Seed code from the published wildcard and division sequences."""
    return (
        F.when(wildcard == 0, F.concat(F.lit("div_"), division.cast("string")))
        .when(wildcard < 3, F.concat(F.lit("wc_"), wildcard.cast("string")))
        .when(wildcard >= 3, F.lit("missed"))
    )
