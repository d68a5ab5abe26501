"""Clock and calendar expressions that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampNTZType

# Local clock with daylight saving, and the fixed-offset clock.
LOCAL_ZONE = "US/Eastern"
FIXED_ZONE = "-05:00"


def wall_clock(df: DataFrame, column: str, zone: str) -> Column:
    """Wall-clock time in `zone` of a UTC start time.

    ISO strings and zoned timestamps are instants; a timestamp without a zone is
    read as UTC. The result carries no zone.
    """
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, TimestampNTZType):
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), value)
    if isinstance(kind, StringType):
        value = F.to_timestamp(value)
    return F.convert_timezone(F.current_timezone(), F.lit(zone), value.cast("timestamp_ntz"))


def minute_of_day(clock: Column) -> Column:
    return F.hour(clock) * 60 + F.minute(clock)


def monday_on_or_before(day: Column) -> Column:
    return F.trunc(day, "week")


def next_monday(day: Column) -> Column:
    """The Monday after `day`; a Monday gives the one a week later."""
    return F.date_add(F.trunc(day, "week"), 7)


def season_label(first_year: Column) -> Column:
    """'20252026' from 2025."""
    return F.concat(first_year.cast("string"), (first_year + 1).cast("string"))
