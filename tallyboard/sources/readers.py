"""Typed scans and the flattening of nested feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyboard.functions.scoring import seed_from_sequences
from tallyboard.schemas import GAME_LOG, ODDS, RAW_SCHEDULE, RAW_STANDINGS, RAW_TEAMS, VENUES
from tallyboard.sources.league import team_dim

# Regular season and playoffs.
LEAGUE_GAMES = (2, 3)
REGULAR, PLAYOFF = "regularseason", "playoff"


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """One scan of all files under `path` with an explicit schema.

    CSV files carry a header, and columns are found by name, wherever they stand;
    a value that does not fit its type becomes null, as does a column that is
    missing.
    """
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def _documents(spark: SparkSession, path: str, schema: StructType, multi_line: bool) -> DataFrame:
    """Landed JSON: one value per line, or with `multi_line` one value per file."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_games(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType = GAME_LOG
) -> DataFrame:
    """The game log of every season under `path`; the season is a string even as a folder name."""
    return read_table(spark, path, schema, fmt)


def read_venues(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, VENUES, "csv")


def read_odds(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, ODDS, "csv")


def flatten_schedule(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Game log rows from nested weekly schedules; days without games give no rows.

    Only regular and playoff games are kept. A game without an outcome has neither
    scores nor a period. Columns of the documents named in `keep` follow their games.
    """
    games = (
        raw.select(*keep, F.explode("gameWeek").alias("day"))
        .select(*keep, F.explode("day.games").alias("g"))
        .where(F.col("g.gameType").isin(*LEAGUE_GAMES))
    )

    def score(side: str) -> Column:
        return F.when(F.col("g.gameOutcome").isNotNull(), F.col(f"g.{side}.score"))

    def name(side: str) -> Column:
        return F.concat_ws(" ", f"g.{side}.placeName.default", f"g.{side}.commonName.default")

    return games.select(
        F.col("g.id").alias("gameId"),
        F.col("g.season").cast("string").alias("seasonName"),
        "g.gameType",
        "g.startTimeUTC",
        "g.venueTimezone",
        F.col("g.venue.default").alias("venue"),
        name("awayTeam").alias("awayTeamName"),
        name("homeTeam").alias("homeTeamName"),
        score("awayTeam").alias("awayTeamScore"),
        score("homeTeam").alias("homeTeamScore"),
        F.col("g.gameOutcome.lastPeriodType").alias("lastPeriod"),
        *keep,
    )


def read_schedule(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Landed schedule documents as a game log."""
    return flatten_schedule(_documents(spark, path, RAW_SCHEDULE, multi_line))


def flatten_standings(raw: DataFrame) -> DataFrame:
    """Published standings as a flat table with the seed code of each team."""
    return (
        raw.select(F.explode("standings").alias("s"))
        .select("s.*")
        .select(
            F.col("teamName.default").alias("teamName"),
            "conferenceName",
            "divisionName",
            F.col("points").alias("totalPoints"),
            seed_from_sequences(F.col("wildcardSequence"), F.col("divisionSequence")).alias("playoffSeed"),
        )
    )


def read_standings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return flatten_standings(_documents(spark, path, RAW_STANDINGS, multi_line))


def read_teams(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return team_dim(_documents(spark, path, RAW_TEAMS, multi_line))


def read_snapshots(snapshots: DataFrame, since: str, until: str) -> DataFrame:
    """Forecast snapshots dated in [since, until).

    `snapshots` is partitioned by `predDate` and `kind`, so the range prunes
    folders. Per date the regular-season run is taken, and the playoff run only
    where there is no other. Which days have a regular run is one short array, a
    place per day of the range, so the forecasts themselves are only filtered.
    """
    first, end = (F.lit(d).cast("date") for d in (since, until))
    ranged = snapshots.where((F.col("predDate") >= first) & (F.col("predDate") < end))
    days = ranged.where(F.col("kind") == REGULAR).agg(F.collect_set("predDate").alias("days"))
    span = F.sequence(F.lit(0), F.greatest(F.datediff(end, first), F.lit(0)))
    regular = days.select(F.transform(span, lambda i: F.array_contains("days", F.date_add(first, i)))).scalar()
    has_regular = F.get(regular, F.datediff("predDate", first))
    return ranged.where((F.col("kind") == REGULAR) | ((F.col("kind") != REGULAR) & ~has_regular))


def latest_run(runs: DataFrame) -> DataFrame:
    """Rows of the run with the most scenarios per date; `n` is a run's scenario count.

    The largest count of each day goes to an array with a place per calendar day,
    so the runs are only filtered.
    """
    largest = runs.where(F.col("predDate").isNotNull()).groupBy("predDate").agg(F.max("n").alias("n"))
    packed = largest.agg(
        F.min("predDate").alias("first"),
        F.max("predDate").alias("last"),
        F.map_from_entries(F.collect_list(F.struct("predDate", "n"))).alias("most"),
    )
    place = F.sequence(F.lit(0), F.datediff("last", "first"))
    table = packed.select(
        F.struct(
            "first",
            F.transform(place, lambda i: F.try_element_at("most", F.date_add("first", i))).alias("most"),
        )
    ).scalar()
    most = F.get(table.getField("most"), F.datediff("predDate", table.getField("first")))
    return runs.where(F.col("n") == most)
