"""Keeping a stored log current, and the dates a run works on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions import dates

# First and last day of a season's calendar, as month and day.
SEASON_START = "09-23"
SEASON_END = "06-30"
REGULAR = 2
RESULT_COLUMNS = ("homeTeamScore", "awayTeamScore", "lastPeriod")


def local_time(games: DataFrame, zone: str = dates.LOCAL_ZONE) -> DataFrame:
    """Local game date and minute of day in place of the UTC start time."""
    clock = dates.wall_clock(games, "startTimeUTC", zone)
    return games.withColumns(
        {"gameDate": F.to_date(clock), "gameTimeEST": dates.minute_of_day(clock)}
    ).drop("startTimeUTC", "startTimeEST")


def fixed_time(games: DataFrame) -> DataFrame:
    """The start time on the fixed-offset clock, which ignores daylight saving."""
    return games.withColumn("startTimeEST", dates.wall_clock(games, "startTimeUTC", dates.FIXED_ZONE))


def mask_as_of(games: DataFrame, as_of: str) -> DataFrame:
    """The log as known on a past date: games from its midnight on lose their result."""
    hidden = dates.wall_clock(games, "startTimeUTC", dates.FIXED_ZONE) >= F.lit(as_of).cast("timestamp_ntz")
    return games.withColumns(
        {c: F.when(F.coalesce(hidden, F.lit(False)), None).otherwise(F.col(c)) for c in RESULT_COLUMNS}
    )


def next_open_date(games: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First day with an unplayed regular game, and the last day with a result."""
    is_open = F.col("lastPeriod").isNull() & (F.col("gameType") == REGULAR)
    return games.groupBy(*by).agg(
        F.min(F.when(is_open, F.col("gameDate"))).alias("nextOpenDate"),
        F.max(F.when(F.col("awayTeamScore").isNotNull(), F.col("gameDate"))).alias("lastPlayedDate"),
    )


def open_dates(games: DataFrame) -> DataFrame:
    """Days that still have games without a score."""
    return games.where(F.col("awayTeamScore").isNull()).select("gameDate").distinct()


def staleness(games: DataFrame, as_of: str, by: Sequence[str] = ()) -> DataFrame:
    """First unplayed day on the fixed-offset clock, and whether it lies before `as_of`."""
    day = F.to_date(dates.wall_clock(games, "startTimeUTC", dates.FIXED_ZONE))
    today = F.lit(as_of).cast("date")
    return (
        games.groupBy(*by)
        .agg(F.min(F.when(F.col("lastPeriod").isNull(), day)).alias("firstUnplayed"))
        .withColumns(
            {
                "stale": F.coalesce(today > F.col("firstUnplayed"), F.lit(False)),
                "daysBehind": F.greatest(F.datediff(today, F.col("firstUnplayed")), F.lit(0)),
            }
        )
    )


def current_season(games: DataFrame) -> DataFrame:
    """Games of the latest season."""
    return games.where(F.col("seasonName") == games.agg(F.max("seasonName")).scalar())


def week_bounds(games: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Monday on or before the first game and the Monday after the last one."""
    return games.groupBy(*by).agg(
        dates.monday_on_or_before(F.min("gameDate")).alias("firstMonday"),
        dates.next_monday(F.max("gameDate")).alias("lastMonday"),
    )


def missing_days(games: DataFrame, first: str = SEASON_START, last: str = SEASON_END) -> DataFrame:
    """Calendar days of each season that the log has no game on.

    A season runs from the month and day `first` in its first year to `last` in
    its second.
    """
    loaded = games.select("seasonName", F.col("gameDate").alias("missingDate")).distinct()

    def day(start: int, month_day: str) -> Column:
        return F.concat(F.substring("seasonName", start, 4), F.lit(f"-{month_day}")).cast("date")

    calendar = (
        games.select("seasonName")
        .distinct()
        .select("seasonName", F.explode(F.sequence(day(1, first), day(5, last))).alias("missingDate"))
    )
    return calendar.join(loaded, ["seasonName", "missingDate"], "left_anti")


def seasons_to_refresh(games: DataFrame, cached: DataFrame) -> DataFrame:
    """Seasons whose features must be rebuilt.

    A season is kept from the cache (`cached` lists their names) only if all of
    its games are played and it is not the latest one.
    """
    latest = games.agg(F.max("seasonName")).scalar()
    kept = cached.select("seasonName").distinct().withColumn("_cached", F.lit(True))
    return (
        games.groupBy("seasonName")
        .agg(F.every(F.col("lastPeriod").isNotNull()).alias("complete"))
        .withColumn("latest", F.col("seasonName") == latest)
        .join(kept, "seasonName", "left")
        .where(~(F.col("complete") & ~F.col("latest") & F.coalesce("_cached", F.lit(False))))
        .drop("_cached")
    )


def season_fingerprints(games: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """rows, total and xored of each season's row hashes, whatever the rows' order; `columns` are all by default.

    A hash takes a null by its place, so a value that moves to another column shows.
    """
    names = sorted(columns or games.columns)
    parts = [part for c in names for part in (F.col(c), F.col(c).isNull())]
    h = F.xxhash64(*parts)
    return games.groupBy("seasonName").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(h).alias("xored")
    )


def changed_seasons(games: DataFrame, cached: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Seasons whose rows aren't those that the `cached` fingerprints were taken of; new seasons are among them."""
    now = season_fingerprints(games, columns)
    old = cached.select(*[F.col(c).alias(f"_{c}") for c in cached.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("seasonName", "rows", "total", "xored")]
    return now.join(old, same, "left_anti").select("seasonName", "rows")


#: What tells games without an id apart, as far as a log has these columns.
WITHOUT_ID = ("gameDate", "startTimeUTC", "homeTeamName", "awayTeamName")


def identity(games: DataFrame, key: str = "gameId") -> list[str]:
    return [c for c in WITHOUT_ID if c in games.columns and c != key]


def _matched(left: DataFrame, right: DataFrame, key: str, how: str, also: Column | None) -> DataFrame:
    """Rows of `left` with, or without, a row of the same game in `right`; games without an id go by `identity`."""
    names = [c for c in identity(left, key) if c in right.columns]

    def keyed(df: DataFrame, side: str) -> DataFrame:
        without = {f"_{c}": F.when(F.col(key).isNull(), F.col(c)) for c in names}
        return df.withColumns(without).alias(side)

    on = [F.col(f"_left.{c}").eqNullSafe(F.col(f"_right.{c}")) for c in (key, *[f"_{c}" for c in names])]
    if also is not None:
        on.append(also)
    return keyed(left, "_left").join(keyed(right, "_right"), on, how).select(*[F.col(f"_left.{c}") for c in left.columns])


def with_matches(games: DataFrame, others: DataFrame, key: str = "gameId") -> DataFrame:
    return _matched(games, others, key, "left_semi", None)


def without_matches(games: DataFrame, others: DataFrame, key: str = "gameId", also: Column | None = None) -> DataFrame:
    """`also` may restrict the matches by columns of `_left` and `_right`."""
    return _matched(games, others, key, "left_anti", also)


def upsert_games(stored: DataFrame, fresh: DataFrame, key: str = "gameId") -> DataFrame:
    """The stored log with refetched games in place of their old rows.

    Games without an id are the same if their day and teams are.
    """
    return without_matches(stored, fresh, key).unionByName(fresh, allowMissingColumns=True)


def replace_tail(stored: DataFrame, fresh: DataFrame, today: str) -> DataFrame:
    """Current season: stored games before yesterday, then the refetched ones."""
    day = F.to_date(dates.wall_clock(stored, "startTimeUTC", dates.FIXED_ZONE))
    kept = current_season(stored).where(day < F.date_sub(F.lit(today).cast("date"), 1))
    return kept.unionByName(fresh, allowMissingColumns=True)


def write_back(
    base: DataFrame, updates: DataFrame, columns: Sequence[str], key: str | Sequence[str] = "gameId"
) -> DataFrame:
    """Overwrite `columns` of `base` where `updates` has a value for the key.

    Keys match null-safely; games without an id need a key that tells them apart,
    such as day and teams. Of several updates of a key the largest value counts,
    so no row of `base` is multiplied.
    """
    keys = [key] if isinstance(key, str) else list(key)
    new = updates.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(
        *[F.max(c).alias(f"_new_{c}") for c in columns]
    )
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    joined = base.join(new, on, "left")
    return joined.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns]
    )
