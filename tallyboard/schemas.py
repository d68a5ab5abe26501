"""Explicit schemas of the tables the operators read; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


GAME_LOG = _struct(
    ("gameId", LongType()),
    ("seasonName", StringType()),
    ("gameType", IntegerType()),
    ("startTimeUTC", TimestampType()),
    ("venueTimezone", StringType()),
    ("venue", StringType()),
    ("awayTeamName", StringType()),
    ("homeTeamName", StringType()),
    ("awayTeamScore", DoubleType()),
    ("homeTeamScore", DoubleType()),
    ("lastPeriod", StringType()),
)

VENUES = _struct(("venue", StringType()), ("venue_lat", DoubleType()), ("venue_long", DoubleType()))

TEAMS = _struct(
    ("teamName", StringType()), ("conferenceName", StringType()), ("divisionName", StringType())
)

ODDS = _struct(
    ("gameId", LongType()),
    ("homeTeamName", StringType()),
    ("awayTeamName", StringType()),
    ("homeTeamOdds", DoubleType()),
    ("awayTeamOdds", DoubleType()),
)

SNAPSHOT = _struct(
    ("gameId", LongType()),
    ("gameDate", DateType()),
    ("homeTeamName", StringType()),
    ("awayTeamName", StringType()),
    ("homeTeamScore", DoubleType()),
    ("awayTeamScore", DoubleType()),
    ("lastPeriod", StringType()),
)

OUTCOMES = _struct(
    ("iteration", LongType()),
    ("teamName", StringType()),
    ("playoffSeed", StringType()),
    ("roundsWon", LongType()),
)

_LABEL = _struct(("default", StringType()))
_SIDE = _struct(("placeName", _LABEL), ("commonName", _LABEL), ("score", DoubleType()))

RAW_SCHEDULE = _struct(
    (
        "gameWeek",
        ArrayType(
            _struct(
                ("date", StringType()),
                (
                    "games",
                    ArrayType(
                        _struct(
                            ("id", LongType()),
                            ("season", LongType()),
                            ("gameType", IntegerType()),
                            ("startTimeUTC", StringType()),
                            ("venueTimezone", StringType()),
                            ("venue", _LABEL),
                            ("awayTeam", _SIDE),
                            ("homeTeam", _SIDE),
                            ("gameOutcome", _struct(("lastPeriodType", StringType()))),
                        )
                    ),
                ),
            )
        ),
    ),
)

RAW_STANDINGS = _struct(
    (
        "standings",
        ArrayType(
            _struct(
                ("teamName", _LABEL),
                ("conferenceName", StringType()),
                ("divisionName", StringType()),
                ("points", DoubleType()),
                ("wildcardSequence", IntegerType()),
                ("divisionSequence", IntegerType()),
            )
        ),
    ),
)

RAW_TEAMS = _struct(
    ("name", StringType()),
    ("conference", _struct(("name", StringType()))),
    ("division", _struct(("name", StringType()))),
)
