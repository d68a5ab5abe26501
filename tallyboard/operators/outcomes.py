"""Outcome tallies over many scenarios, in one aggregate per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.operators.timeline import lead

# Seeds, and the stage reached after winning k rounds.
SEEDS = ("div_1", "div_2", "div_3", "wc_1", "wc_2", "missed")
STAGES = {1: "make_round_2", 2: "make_round_3", 3: "make_cup_final", 4: "win_cup"}
RINGS = ("playoff_%", "make_round_2_%", "make_round_3_%", "make_cup_final_%", "win_cup_%")
_ALIVE = {1: "playoff_%", 2: "make_round_2_%", 3: "make_round_3_%", 4: "make_cup_final_%"}


def scenario_outcomes(table: DataFrame, results: DataFrame, scenario: str | None = "iteration") -> DataFrame:
    """Seed and number of series won, per scenario and team.

    `table` holds the final standings and `results` the bracket of all rounds,
    with the winner of each decided series.
    """
    keys = [*lead(scenario), "seasonName", "teamName"]
    won = (
        results.where(F.col("winner").isNotNull())
        .groupBy(*keys[:-1], F.col("winner").alias("teamName"))
        .agg(F.count(F.lit(1)).alias("roundsWon"))
    )
    return table.join(won, keys, "left").select(
        *keys, "playoffSeed", F.coalesce("roundsWon", F.lit(0)).alias("roundsWon")
    )


def _seed_counts() -> list[Column]:
    return [F.count_if(F.col("playoffSeed") == seed).alias(seed) for seed in SEEDS]


def _stage_counts() -> list[Column]:
    return [F.count_if(F.col("roundsWon") >= k).alias(stage) for k, stage in STAGES.items()]


def _tally(
    outcomes: DataFrame,
    counts: list[Column],
    names: list[str],
    teams: DataFrame | None,
    by: Sequence[str],
    scenario: str,
) -> DataFrame:
    """Counts per team with their share of all runs; teams without any get zeros.

    A run is one season of one scenario, so shares stay within 100 whatever seasons
    a group holds. The runs are counted from their key columns alone.
    """
    by = list(by)
    run = [c for c in (scenario, "seasonName") if c in outcomes.columns]
    runs = outcomes.select(*{*by, *run}).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    tally = outcomes.groupBy(*by, "teamName").agg(*counts)
    if teams is not None:
        league = teams.agg(F.collect_set("teamName")).scalar()
        every = runs.select(*by, "_n", F.explode(league).alias("teamName"))
        counted = every.join(tally, [*by, "teamName"], "left").na.fill(0, names)
    elif by:
        counted = tally.join(runs, by)
    else:
        counted = tally.withColumn("_n", runs.scalar())
    share = {f"{name}_%": F.col(name) / F.col("_n") * 100 for name in names}
    if "missed" in names:
        share["playoff_%"] = (F.col("_n") - F.col("missed")) / F.col("_n") * 100
    return counted.withColumns(share).drop("_n")


def seed_probabilities(
    outcomes: DataFrame, teams: DataFrame | None = None, by: Sequence[str] = (), scenario: str = "iteration"
) -> DataFrame:
    """How often each team ended on each seed, as counts and percentages."""
    return _tally(outcomes, _seed_counts(), list(SEEDS), teams, by, scenario)


def round_probabilities(
    outcomes: DataFrame, teams: DataFrame | None = None, by: Sequence[str] = (), scenario: str = "iteration"
) -> DataFrame:
    """How often each team reached each round, as counts and percentages."""
    return _tally(outcomes, _stage_counts(), list(STAGES.values()), teams, by, scenario)


def outcome_probabilities(
    outcomes: DataFrame, teams: DataFrame | None = None, by: Sequence[str] = (), scenario: str = "iteration"
) -> DataFrame:
    """Seeds and rounds together, in one aggregate; `by=["seasonName"]` keeps seasons apart."""
    names = [*SEEDS, *STAGES.values()]
    return _tally(outcomes, [*_seed_counts(), *_stage_counts()], names, teams, by, scenario)


def probability_report(table: DataFrame) -> DataFrame:
    """Percentages per seed in report order, most likely playoff team first."""
    shares = [f"{seed}_%" for seed in SEEDS]
    order = [F.desc("playoff_%"), *[F.desc(c) for c in shares[:-1]], F.asc("teamName")]
    return table.select("teamName", *shares, "playoff_%").orderBy(*order)


def alive_teams(table: DataFrame, playoff_round: int) -> DataFrame:
    """Teams that can still play in the given round; round 0 keeps all."""
    if playoff_round == 0:
        return table
    return table.where(F.col(_ALIVE[playoff_round]) > 0)


def ring_shares(table: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Share of each team in each ring, with its start and end angle.

    One ring per stage from reaching the playoffs to winning the cup; the shares
    of a ring sum to 1. Teams go by name, or by `position` of the table `order`
    (teamName, position), for instance their bracket slots.
    """
    if order is not None:
        table = table.join(order.select("teamName", "position"), "teamName")
    else:
        table = table.withColumn("position", F.lit(0))
    long = table.unpivot(["teamName", "position"], list(RINGS), "ring", "percent")
    ring = Window.partitionBy("ring")
    turn = ring.orderBy("position", "teamName").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        long.withColumn("share", F.try_divide(F.col("percent"), F.sum("percent").over(ring)))
        .withColumn("endAngle", F.sum("share").over(turn) * 360)
        .withColumn("startAngle", F.col("endAngle") - F.col("share") * 360)
        .select("ring", "teamName", F.col("percent"), "share", "startAngle", "endAngle")
    )
