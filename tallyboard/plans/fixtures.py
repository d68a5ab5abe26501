"""Views of the shared test tables in the shape the operators expect.

Each view exists twice: as a DataFrame plan here and as a SQL text in
`oracle.VIEWS`, so that a query and its SQL answer start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game per order, between the customer's nation and another one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation")
    home = nation.select(F.col("n_nationkey").alias("homeKey"), F.col("n_name").alias("homeTeamName"))
    away = nation.select(F.col("n_nationkey").alias("awayKey"), F.col("n_name").alias("awayTeamName"))
    key, price, day = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderdate")
    unplayed = key % 11 == 0
    last_digit = key % 10
    log = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("awayKey", ((F.col("c_nationkey") + 1 + key % 24) % 25).cast("int"))
        .join(home, F.col("c_nationkey") == F.col("homeKey"))
        .join(away, "awayKey")
    )
    return log.select(
        key.alias("gameId"),
        F.concat(F.year(day).cast("string"), (F.year(day) + 1).cast("string")).alias("seasonName"),
        F.when(F.month(day) >= 10, 3).otherwise(2).alias("gameType"),
        F.to_date(day).alias("gameDate"),
        ((key * 37) % 1440).cast("int").alias("gameTimeEST"),
        F.when(key % 13 == 0, F.lit("Neutral Site"))
        .otherwise(F.concat(F.lit("Arena "), F.col("homeTeamName")))
        .alias("venue"),
        "homeTeamName",
        "awayTeamName",
        F.when(~unplayed, (F.floor(price) % 7).cast("double")).alias("homeTeamScore"),
        F.when(~unplayed, (F.floor(price / 7) % 6).cast("double")).alias("awayTeamScore"),
        F.when(~unplayed, F.when(last_digit == 1, "SO").when(last_digit <= 3, "OT").otherwise("REG")).alias(
            "lastPeriod"
        ),
    )


def timed_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with a UTC start time and a venue time zone."""
    start = F.col("gameDate").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("gameTimeEST"))
    zone = F.concat(F.lit("Zone "), F.substring("homeTeamName", 1, 1))
    return games(spark, sf_dir).withColumns({"startTimeUTC": start, "venueTimezone": zone})


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .where(F.col("n_regionkey") <= 3)
        .select(
            F.col("n_name").alias("teamName"),
            F.col("r_name").alias("divisionName"),
            F.when(F.col("n_regionkey") <= 1, "Eastern").otherwise("Western").alias("conferenceName"),
        )
    )


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    known = key % 8 != 7
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("Arena "), F.col("n_name")).alias("venue"),
        F.when(known, (key * 5 - 60).cast("double")).alias("venue_lat"),
        F.when(known, (key * 14 - 170).cast("double")).alias("venue_long"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two forecasts per game: one dated on its day, one dated the day before."""
    ahead = games(spark, sf_dir).withColumn("lead", F.explode(F.array(F.lit(0), F.lit(1))))
    return ahead.select(
        F.date_sub("gameDate", F.col("lead")).alias("predDate"),
        "gameId",
        "gameDate",
        "homeTeamName",
        "awayTeamName",
        ((F.col("gameId") + F.col("lead")) % 5).cast("double").alias("homeTeamScore"),
        ((F.col("gameId") * 3) % 4).cast("double").alias("awayTeamScore"),
    )


def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("gameId")
    even = key % 2 == 0
    return (
        games(spark, sf_dir)
        .where(key % 10 != 0)
        .select(
            "gameId",
            "homeTeamName",
            "awayTeamName",
            F.when(even, -110 - key % 90).otherwise(100 + key % 150).cast("double").alias("homeTeamOdds"),
            F.when(even, 100 + key % 120).otherwise(-105 - key % 80).cast("double").alias("awayTeamOdds"),
        )
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario table: seed and rounds won per (iteration, team)."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("teamName"))
    kind = F.col("event_type")
    return (
        events.withColumn("n_nationkey", (F.col("event_id") % 25).cast("int"))
        .join(nation, "n_nationkey")
        .select(
            F.floor(F.col("event_id") / 25).alias("iteration"),
            "teamName",
            F.when(kind == "view", "div_1")
            .when(kind == "signup", "div_2")
            .when(kind == "purchase", "div_3")
            .when(kind == "click", "wc_1")
            .otherwise("missed")
            .alias("playoffSeed"),
            F.when(kind == "error", 0).otherwise(F.floor("value") % 5).alias("roundsWon"),
        )
    )
