"""Default dimension tables; pass your own to the operators for another league."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.functions.geo import haversine_km
from tallyboard.schemas import TEAMS, VENUES
from tallyboard.session import stage

# Team, conference, division.
LEAGUE = [
    ("Anaheim Ducks", "Western", "Pacific"),
    ("Boston Bruins", "Eastern", "Atlantic"),
    ("Buffalo Sabres", "Eastern", "Atlantic"),
    ("Calgary Flames", "Western", "Pacific"),
    ("Carolina Hurricanes", "Eastern", "Metropolitan"),
    ("Chicago Blackhawks", "Western", "Central"),
    ("Colorado Avalanche", "Western", "Central"),
    ("Columbus Blue Jackets", "Eastern", "Metropolitan"),
    ("Dallas Stars", "Western", "Central"),
    ("Detroit Red Wings", "Eastern", "Atlantic"),
    ("Edmonton Oilers", "Western", "Pacific"),
    ("Florida Panthers", "Eastern", "Atlantic"),
    ("Los Angeles Kings", "Western", "Pacific"),
    ("Minnesota Wild", "Western", "Central"),
    ("Montréal Canadiens", "Eastern", "Atlantic"),
    ("Nashville Predators", "Western", "Central"),
    ("New Jersey Devils", "Eastern", "Metropolitan"),
    ("New York Islanders", "Eastern", "Metropolitan"),
    ("New York Rangers", "Eastern", "Metropolitan"),
    ("Ottawa Senators", "Eastern", "Atlantic"),
    ("Philadelphia Flyers", "Eastern", "Metropolitan"),
    ("Pittsburgh Penguins", "Eastern", "Metropolitan"),
    ("San Jose Sharks", "Western", "Pacific"),
    ("Seattle Kraken", "Western", "Pacific"),
    ("St. Louis Blues", "Western", "Central"),
    ("Tampa Bay Lightning", "Eastern", "Atlantic"),
    ("Toronto Maple Leafs", "Eastern", "Atlantic"),
    ("Utah Mammoth", "Western", "Central"),
    ("Vancouver Canucks", "Western", "Pacific"),
    ("Vegas Golden Knights", "Western", "Pacific"),
    ("Washington Capitals", "Eastern", "Metropolitan"),
    ("Winnipeg Jets", "Western", "Central"),
]

# Venues that geocoding does not find, with latitude and longitude.
VENUE_OVERRIDES = [
    ("Amalie Arena", 27.9439, -82.4519),
    ("FLA Live Arena", 26.1583, -80.3256),
    ("Gila River Arena", 33.5325, -112.2611),
]


def league_teams(spark: SparkSession) -> DataFrame:
    """The default team dimension."""
    return spark.createDataFrame(LEAGUE, TEAMS)


def venue_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VENUE_OVERRIDES, VENUES)


def team_dim(raw_teams: DataFrame) -> DataFrame:
    """Team dimension from records with nested conference and division names."""
    return raw_teams.select(
        F.col("name").alias("teamName"),
        F.col("conference.name").alias("conferenceName"),
        F.col("division.name").alias("divisionName"),
    )


def resolve_venues(
    games: DataFrame, geocoded: DataFrame, overrides: DataFrame | None = None
) -> DataFrame:
    """Coordinates of every venue in the log: geocoded, else from the overrides, else null."""
    if overrides is None:
        overrides = venue_overrides(games.sparkSession)
    known = geocoded.select("venue", F.col("venue_lat").alias("_lat"), F.col("venue_long").alias("_long"))
    manual = overrides.select(
        "venue", F.col("venue_lat").alias("_manual_lat"), F.col("venue_long").alias("_manual_long")
    )
    # Take both coordinates from one source.
    found = F.col("_lat").isNotNull() & F.col("_long").isNotNull()
    return (
        games.select("venue")
        .distinct()
        .join(known, "venue", "left")
        .join(manual, "venue", "left")
        .select(
            "venue",
            F.when(found, F.col("_lat")).otherwise(F.col("_manual_lat")).alias("venue_lat"),
            F.when(found, F.col("_long")).otherwise(F.col("_manual_long")).alias("venue_long"),
        )
    )


def suspect_venues(games: DataFrame, venues: DataFrame, factor: float = 8.0) -> DataFrame:
    """venue, homeTeamName, distance_km and suspect: venues too far from where their home team travels.

    The distance is that to the middle of the team's visits, the median latitude and longitude of its
    away games. A venue is suspect if its distance is beyond the median one by more than `factor`
    times the median deviation from it. A venue's home team is the one with most games there, of
    equal ones the first by name; venues without coordinates or games are left out.
    """
    known = venues.where("venue_lat IS NOT NULL AND venue_long IS NOT NULL").select("venue", "venue_lat", "venue_long")
    played = games.select("venue", "homeTeamName", "awayTeamName").join(known, "venue")
    middle = played.groupBy(F.col("awayTeamName").alias("_team")).agg(F.median("venue_lat").alias("_lat"), F.median("venue_long").alias("_long"))
    host = played.groupBy("venue", "homeTeamName").agg(
        F.count(F.lit(1)).alias("_games"), F.first("venue_lat").alias("venue_lat"), F.first("venue_long").alias("venue_long")
    )
    first = F.min_by(F.struct("homeTeamName", "venue_lat", "venue_long"), F.struct(-F.col("_games"), "homeTeamName"))
    hosts = host.groupBy("venue").agg(first.alias("h")).select("venue", "h.*")
    away = hosts.join(middle, F.col("homeTeamName") == F.col("_team")).select(
        "venue", "homeTeamName", haversine_km(F.col("venue_lat"), F.col("venue_long"), F.col("_lat"), F.col("_long")).alias("distance_km")
    )
    # One row a venue: a small table, whose medians are scalars.
    away = stage(away, "venue-distances")
    usual = away.agg(F.median("distance_km")).scalar()
    spread = away.select(F.abs(F.col("distance_km") - usual).alias("off")).agg(F.median("off")).scalar()
    return away.withColumn("suspect", F.col("distance_km") - usual > factor * spread)
