"""Team-game rows and history windows over them.

A team can appear in any number of games, so no window runs over all game rows of a
team. Games are summed per (season, team, day), and only the last few games of a
day are kept one by one: first of each of `SALTS` parts of the day, then of the
day; all of these steps combine or limit on the map side. What is left per
(season, team) is bounded by the calendar, and windows run over that.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.functions.geo import located

# Parts that the games of one team and day are dealt to before its last ones are picked.
SALTS = 64


def lead(scenario: str | None) -> list[str]:
    return [scenario] if scenario else []


def game_order() -> Column:
    """Order of the games of one day: by id, those without one last, by their teams."""
    return F.struct(F.col("gameId").isNull().alias("noId"), "gameId", "homeTeamName", "awayTeamName")


def team_games(games: DataFrame, scenario: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Two rows per game, one for each side, from one scan of the log."""
    home = F.col("side") == "home"

    def either(if_home: str, if_away: str) -> Column:
        return F.when(home, F.col(if_home)).otherwise(F.col(if_away))

    return games.withColumn("side", F.explode(F.array(F.lit("home"), F.lit("away")))).select(
        *lead(scenario),
        "seasonName",
        "gameType",
        "gameId",
        "gameDate",
        "side",
        either("homeTeamName", "awayTeamName").alias("teamName"),
        either("awayTeamName", "homeTeamName").alias("opponentName"),
        either("homeTeamScore", "awayTeamScore").alias("teamScore"),
        either("awayTeamScore", "homeTeamScore").alias("opponentScore"),
        "homeTeamName",
        "awayTeamName",
        "homeTeamScore",
        "awayTeamScore",
        "lastPeriod",
        *carry,
    )


def prior_days(
    rows: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    spans: Sequence[int] = (),
    places: int | None = None,
    places_from: DataFrame | None = None,
    rest: bool = False,
) -> DataFrame:
    """One row per key and day with totals over strictly earlier days.

    For each measure m: `m_toDate` is the sum over all earlier games and `m_<n>`,
    for n in `spans`, the sum over the last n of them. Games of one day are
    ordered by `game_order`. `places` adds `priorVenues`, the coordinates of the last
    so many venues, looked up in `places_from`. `rest` adds the first game of the
    day and the day before it on which the team played.
    """
    rows = rows.where(F.col("gameDate").isNotNull())
    named = [measures[m].cast("double").alias(m) for m in measures]
    base = rows.select(*keys, "gameDate", game_order().alias("_order"), *(["venue"] if places else []), *named)
    if places:
        # Null, hence not collected, when a coordinate is missing.
        spot = located(F.col("venue_lat"), F.col("venue_long"))
        places_from = places_from.select("venue", spot.alias("_spot"))
    days = base.groupBy(*keys, "gameDate").agg(
        F.count(F.lit(1)).alias("_games"),
        *([F.min("_order").alias("_first")] if rest else []),
        *[F.sum(F.coalesce(F.col(m), F.lit(0.0))).alias(f"_day_{m}") for m in measures],
    )
    depth = max([n + 1 for n in spans] + [places or 0])
    if depth:
        def newest_first(*part: str):
            return Window.partitionBy("gameDate", *keys, *part).orderBy(F.desc("_order"))

        part = F.pmod(F.xxhash64("_order"), F.lit(SALTS)).alias("_part")
        late = base.select("*", part).withColumn("_back", F.row_number().over(newest_first("_part")))
        last = late.where(F.col("_back") <= depth).drop("_part")
        last = last.withColumn("_back", F.row_number().over(newest_first())).where(F.col("_back") <= depth)
        newer = newest_first().rowsBetween(Window.unboundedPreceding, -1)
        if spans:
            last = last.withColumns({f"_newer_{m}": F.sum(F.coalesce(F.col(m), F.lit(0.0))).over(newer) for m in measures})
        last = last.drop(*measures)
        if places:
            last = last.join(places_from, "venue", "left")
        timeline = days.unionByName(last.drop("_order"), allowMissingColumns=True)
    else:
        timeline = days.withColumn("_back", F.lit(None).cast("int"))

    # One exchange serves every window below.
    timeline = timeline.repartition(*keys).withColumn("_day", F.unix_date("gameDate"))
    by_day = Window.partitionBy(*keys).orderBy("_day")
    earlier = by_day.rangeBetween(Window.unboundedPreceding, -1)
    so_far = by_day.rangeBetween(Window.unboundedPreceding, 0)

    def total(column: str, frame) -> Column:
        return F.coalesce(F.sum(column).over(frame), F.lit(0))

    timeline = timeline.withColumns(
        {
            "_before": total("_games", earlier),
            "_through": total("_games", so_far),
            **{f"{m}_toDate": total(f"_day_{m}", earlier) for m in measures},
            **{f"_sofar_{m}": total(f"_day_{m}", so_far) for m in measures},
        }
    )
    if rest:
        day_rows = F.when(F.col("_back").isNull(), F.col("gameDate"))
        timeline = timeline.withColumn("previousDate", F.max(day_rows).over(earlier))
    if depth:
        # A kept game has the rank it has among all games of the team-season; a
        # day row stands where the day's first game would.
        is_day = F.col("_back").isNull()
        timeline = timeline.withColumn(
            "_rank",
            F.when(is_day, F.col("_before") + 1).otherwise(F.col("_through") - F.col("_back") + 1),
        )
        by_rank = Window.partitionBy(*keys).orderBy("_rank")
        if spans:
            # Sum of all games up to and including this one, known only for kept games.
            timeline = timeline.withColumns(
                {
                    f"_upto_{m}": F.when(
                        ~is_day, F.col(f"_sofar_{m}") - F.coalesce(f"_newer_{m}", F.lit(0.0))
                    )
                    for m in measures
                }
            ).withColumns(
                {
                    f"{m}_{n}": F.col(f"{m}_toDate")
                    - F.coalesce(
                        F.max(f"_upto_{m}").over(by_rank.rangeBetween(-n - 1, -n - 1)), F.lit(0.0)
                    )
                    for m in measures
                    for n in spans
                }
            )
        if places:
            timeline = timeline.withColumn(
                "priorVenues", F.collect_list("_spot").over(by_rank.rangeBetween(-places, -1))
            )
        timeline = timeline.where(is_day)
    return timeline.select(
        *keys,
        "gameDate",
        *[f"{m}_toDate" for m in measures],
        *[f"{m}_{n}" for m in measures for n in spans],
        *(["priorVenues"] if places else []),
        *([F.col("_first").alias("firstGame"), "previousDate"] if rest else []),
    )
