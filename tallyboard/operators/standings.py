"""Standings: totals, seeds and the wildcard view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.functions import scoring
from tallyboard.operators.timeline import lead, team_games

# Tie-break order and the column order of a standings table.
TIEBREAKERS = [
    "totalPoints",
    "pointsPercentage",
    "totalRegWins",
    "totalRegOTWins",
    "totalWins",
    "goalDifferential",
    "totalGoalsFor",
]
STANDINGS_COLUMNS = [
    "conferenceName",
    "conferenceSeed",
    "divisionName",
    "divisionSeed",
    "playoffSeed",
    "teamName",
    "totalGames",
    "totalWins",
    "totalLosses",
    "totalOTLs",
    "totalPoints",
    "pointsPercentage",
    "totalRegWins",
    "totalRegOTWins",
    "goalDifferential",
    "totalGoalsFor",
]
_COUNTED = ["Games", "Points", "Wins", "Losses", "OTLs", "RegWins", "RegOTWins", "GoalsFor", "GoalsAgainst"]


def game_points(games: DataFrame, unplayed: str = "zero") -> DataFrame:
    """The log with the points each side earned in each game."""
    home, away, period = F.col("homeTeamScore"), F.col("awayTeamScore"), F.col("lastPeriod")
    return games.withColumns(
        {
            "homeTeamPoints": scoring.game_points(home, away, period, unplayed),
            "awayTeamPoints": scoring.game_points(away, home, period, unplayed),
        }
    )


def _roster(games: DataFrame, teams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The (season, team) rows of the result.

    `teams` may be a roster with `seasonName`. A plain dimension stands for every
    season: each season's row is then unfolded into the league's teams, which is
    just the grain of the result.
    """
    if "seasonName" in teams.columns:
        season = teams.select("seasonName", "teamName")
        return games.select(*keys).distinct().join(season, "seasonName") if len(keys) > 1 else season
    league = teams.agg(F.collect_set("teamName")).scalar()
    return games.select(*keys).distinct().select(*keys, F.explode(league).alias("teamName"))


def team_totals(
    games: DataFrame,
    teams: DataFrame,
    scenario: str | None = None,
    game_types: Sequence[int] = (2,),
    count_shootout: bool = False,
    unplayed: str = "zero",
    split: bool = False,
) -> DataFrame:
    """Season totals per team in one scan and one aggregate.

    `split=True` adds each total for home and away games apart.
    """
    keys = [*lead(scenario), "seasonName"]
    own, other, period = F.col("teamScore"), F.col("opponentScore"), F.col("lastPeriod")
    win = scoring.won(own, other)
    stats = {
        "Games": own.isNotNull().cast("long"),
        "Points": scoring.game_points(own, other, period, unplayed).cast("long"),
        "Wins": win.cast("long"),
        "Losses": scoring.lost_in_regulation(own, other, period).cast("long"),
        "OTLs": scoring.lost_after_regulation(own, other, period, count_shootout).cast("long"),
        "RegWins": (win & scoring.in_regulation(period)).cast("long"),
        "RegOTWins": (win & ~period.eqNullSafe(F.lit("SO"))).cast("long"),
        "GoalsFor": F.coalesce(own, F.lit(0.0)),
        "GoalsAgainst": F.coalesce(other, F.lit(0.0)),
    }
    played = games.where(F.col("gameType").isin(*game_types))
    rows = team_games(played, scenario).select(
        *keys, "teamName", "side", *[value.alias(name) for name, value in stats.items()]
    )
    zeros = [F.lit(0).cast(rows.schema[name].dataType).alias(name) for name in _COUNTED]
    nobody = _roster(played, teams, keys).select(*keys, "teamName", F.lit(None).cast("string").alias("side"), *zeros)
    sums = [F.sum(name).alias(f"total{name}") for name in _COUNTED]
    if split:
        for side in ("home", "away"):
            sums += [
                F.sum(F.when(F.col("side") == side, F.col(name)).otherwise(0)).alias(f"total{side.title()}{name}")
                for name in _COUNTED
            ]
    # Teams without a game have their zeros from the roster, in the same aggregate.
    totals = rows.unionByName(nobody).groupBy(*keys, "teamName").agg(*sums)
    on = ["seasonName", "teamName"] if "seasonName" in teams.columns else ["teamName"]
    filled = totals.join(teams, on)
    return filled.withColumns(
        {
            "goalDifferential": F.col("totalGoalsFor") - F.col("totalGoalsAgainst"),
            "pointsPercentage": F.try_divide(
                F.col("totalPoints").cast("double"), (F.col("totalGames") * 2).cast("double")
            ),
        }
    )


def home_away_split(games: DataFrame, teams: DataFrame, scenario: str | None = None, **options) -> DataFrame:
    """Totals with their home and away parts, for every team of the dimension."""
    return team_totals(games, teams, scenario, split=True, **options)


def seeds(totals: DataFrame, scenario: str | None = None) -> DataFrame:
    """Division, conference and playoff seed; ties that are left go by team name.

    The windows run over team totals, so a group is one division or conference.
    """
    keys = [*lead(scenario), "seasonName"]
    order = [F.desc_nulls_last(c) for c in TIEBREAKERS] + [F.asc("teamName")]
    division = Window.partitionBy(*keys, "conferenceName", "divisionName").orderBy(*order)
    conference = Window.partitionBy(*keys, "conferenceName").orderBy(*order)
    chasing = Window.partitionBy(*keys, "conferenceName", "_placed").orderBy(*order)
    return (
        totals.withColumn("divisionSeed", F.row_number().over(division))
        .withColumn("conferenceSeed", F.row_number().over(conference))
        .withColumn("_placed", F.col("divisionSeed") <= 3)
        .withColumn("_chase", F.row_number().over(chasing))
        .withColumn(
            "playoffSeed",
            F.when(F.col("_placed"), F.concat(F.lit("div_"), F.col("divisionSeed").cast("string")))
            .when(F.col("_chase") <= 2, F.concat(F.lit("wc_"), F.col("_chase").cast("string")))
            .otherwise(F.lit("missed")),
        )
        .drop("_placed", "_chase")
    )


def standings(games: DataFrame, teams: DataFrame, scenario: str | None = None, **options) -> DataFrame:
    """Final standings of every season (and scenario) in the log."""
    table = seeds(team_totals(games, teams, scenario, **options), scenario)
    return table.select(*lead(scenario), "seasonName", *STANDINGS_COLUMNS)


def standings_order(table: DataFrame, scenario: str | None = None) -> DataFrame:
    """Standings sorted for output: tie-breakers, best first."""
    return table.orderBy(
        *lead(scenario), "seasonName", *[F.desc_nulls_last(c) for c in TIEBREAKERS], "teamName"
    )


def wildcard_table(table: DataFrame, scenario: str | None = None) -> DataFrame:
    """Rank of each team in its conference's wildcard view.

    Division seeds come first, division by division, then wildcards, then the
    rest; points descend within each part and missing points come last.
    """
    keys = [*lead(scenario), "seasonName", "conferenceName"]
    code = F.lower(F.coalesce(F.col("playoffSeed"), F.lit("missed")))
    group = F.when(code.startswith("div"), 0).when(code.startswith("wc"), 1).otherwise(2)
    wildcard = (
        F.when(code.startswith("div"), 0)
        .when(code.startswith("wc"), F.substring(code, -1, 1).cast("int"))
        .when(code == "missed", 3)
    )
    placed = table.withColumns({"seedGroup": group, "wildcardSeed": wildcard}).withColumn(
        "_division", F.when(F.col("seedGroup") == 0, F.col("divisionName")).otherwise(F.lit(""))
    )
    view = Window.partitionBy(*keys).orderBy(
        "seedGroup", "_division", F.desc_nulls_last("totalPoints"), "teamName"
    )
    return placed.withColumn("viewRank", F.row_number().over(view)).drop("_division")
