"""Stored forecasts against results and betting odds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.functions import scoring

_SCORES = ("homeTeamScore", "awayTeamScore")


def _correct() -> Column:
    return scoring.correct_outcome(
        *(F.col(f"{c}_actual") for c in _SCORES), *(F.col(f"{c}_predicted") for c in _SCORES)
    )


def _suffixed(df: DataFrame, keep: Sequence[str], suffix: str) -> DataFrame:
    moved = [c for c in (*_SCORES, "lastPeriod") if c in df.columns]
    return df.select(*keep, *[F.col(c).alias(f"{c}_{suffix}") for c in moved])


def compare_results(
    predicted: DataFrame, actual: DataFrame, since: str | None = None, until: str | None = None
) -> DataFrame:
    """Predicted next to actual scores of the same games, with the call's success.

    The period is half-open, [since, until). Games without a result drop out.
    """
    keys = ["gameId", "gameDate", "homeTeamName", "awayTeamName"]
    if since:
        predicted = predicted.where(F.col("gameDate") >= F.lit(since).cast("date"))
    if until:
        predicted = predicted.where(F.col("gameDate") < F.lit(until).cast("date"))
    played = actual.where(F.col("homeTeamScore").isNotNull() & F.col("awayTeamScore").isNotNull())
    return (
        _suffixed(predicted, keys, "predicted")
        .join(_suffixed(played, keys, "actual"), keys)
        .withColumn("correctOutcome", _correct())
    )


def snapshot_accuracy(snapshots: DataFrame, actual: DataFrame) -> DataFrame:
    """Success of each day's own forecast: only rows dated on the snapshot's date count."""
    own_day = snapshots.where(F.col("gameDate") == F.col("predDate"))
    keys = ["gameId", "gameDate", "homeTeamName", "awayTeamName"]
    return (
        _suffixed(own_day, keys, "predicted")
        .join(_suffixed(actual, ["gameId"], "actual"), "gameId")
        .withColumn("correctOutcome", _correct())
    )


def daily_accuracy(compared: DataFrame, overall: bool = False) -> DataFrame:
    """Share and number of right calls per day; `overall` adds a row without a date."""
    grouped = compared.rollup("gameDate") if overall else compared.groupBy("gameDate")
    return grouped.agg(
        F.avg("correctOutcome").alias("accuracy"),
        F.sum("correctOutcome").alias("correct"),
        F.count("correctOutcome").alias("games"),
    )


def with_odds(compared: DataFrame, odds: DataFrame) -> DataFrame:
    """Compared games with their odds; games without odds keep nulls.

    Odds belong to a game if the id and both names agree. With the library's
    session settings the join keeps the partitioning by id of the compared games.
    """
    keys = ["gameId", "homeTeamName", "awayTeamName"]
    offered = odds.select(*keys, "homeTeamOdds", "awayTeamOdds")
    return compared.join(offered, keys, "left").select(*compared.columns, "homeTeamOdds", "awayTeamOdds")


def missing_odds(priced: DataFrame) -> DataFrame:
    """One row: how many home and away odds are missing."""
    missing = F.count_if(F.col("homeTeamOdds").isNull()) + F.count_if(F.col("awayTeamOdds").isNull())
    return priced.agg(missing.alias("missingOdds"))


def game_returns(priced: DataFrame, missing: str = "loss") -> DataFrame:
    """Odds of the rightly picked winner and the return on one unit, per game."""
    odds = scoring.winner_odds(
        F.col("correctOutcome"),
        F.col("homeTeamScore_predicted"),
        F.col("awayTeamScore_predicted"),
        F.col("homeTeamOdds"),
        F.col("awayTeamOdds"),
    )
    return priced.withColumn("winnerOdds", odds).withColumn(
        "winnings", scoring.unit_return(F.col("winnerOdds"), missing)
    )


def daily_returns(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Winnings per day, their running total, and whether the day was all right.

    Games are summed per day before the running total, so that window sees one
    row per calendar day (and per value of `by`).
    """
    hit = F.avg("correctOutcome")
    days = returns.groupBy(*by, "gameDate").agg(
        F.count(F.lit(1)).alias("games"),
        F.sum("correctOutcome").alias("correct"),
        F.sum("winnings").alias("winnings"),
        F.when(hit == 1.0, "all_right").when(hit == 0.0, "all_wrong").otherwise("mixed").alias("dayClass"),
    )
    running = (
        Window.partitionBy(*by).orderBy("gameDate").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return days.withColumn("runningReturn", F.sum("winnings").over(running))


def regression_metrics(
    compared: DataFrame,
    targets: Sequence[tuple[str, str]] = tuple((f"{c}_actual", f"{c}_predicted") for c in _SCORES),
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean squared error and R², each the plain mean over the targets, and outcome accuracy.

    The first two targets are the home and the away score, actual before predicted.
    """
    complete = compared
    for pair in targets:
        for column in pair:
            complete = complete.where(F.col(column).isNotNull())
    (home, home_p), (away, away_p) = targets[0], targets[1]
    hit = scoring.correct_outcome(F.col(home), F.col(away), F.col(home_p), F.col(away_p))
    sums = [F.count(F.lit(1)).alias("games"), F.avg(hit).alias("accuracy")]
    for i, (actual, predicted) in enumerate(targets):
        sums.append(F.avg(F.pow(F.col(actual) - F.col(predicted), 2)).alias(f"_mse{i}"))
        sums.append(F.var_pop(actual).alias(f"_var{i}"))
    n = len(targets)
    mse = sum((F.col(f"_mse{i}") for i in range(1, n)), F.col("_mse0")) / n
    parts = [1 - F.try_divide(F.col(f"_mse{i}"), F.col(f"_var{i}")) for i in range(n)]
    r2 = sum(parts[1:], parts[0]) / n
    return complete.groupBy(*by).agg(*sums).select(
        *by, "games", mse.alias("mse"), r2.alias("r2"), "accuracy"
    )
