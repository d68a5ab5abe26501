"""Features of a game taken from strictly earlier days, for both of its sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.functions import scoring
from tallyboard.functions.geo import EARTH_RADIUS_KM, half_angle, located
from tallyboard.operators.timeline import game_order, lead, prior_days, team_games

SIDES = ("home", "away")
# Fixed value: the number of prior games that stands for "the season so far".
SEASON_GAMES = 110
PLAYOFF = 3


def _results(count_shootout: bool = True) -> dict[str, Column]:
    own, other, period = F.col("teamScore"), F.col("opponentScore"), F.col("lastPeriod")
    return {
        "wins": scoring.won(own, other),
        "losses": scoring.lost_in_regulation(own, other, period),
        "otls": scoring.lost_after_regulation(own, other, period, count_shootout),
    }


def _goals(perspective: str) -> dict[str, Column]:
    if perspective == "fixed_side":
        return {"first": F.col("homeTeamScore"), "second": F.col("awayTeamScore")}
    if perspective == "team":
        return {"first": F.col("teamScore"), "second": F.col("opponentScore")}
    raise ValueError("perspective must be 'fixed_side' or 'team'")


def _goal_columns(side: str, n: int, perspective: str) -> dict[str, Column]:
    """Goals for and against; with fixed sides an away team's "for" is the away score."""
    swap = perspective == "fixed_side" and side == "away"
    scored, conceded = ("second", "first") if swap else ("first", "second")
    return {
        f"{side}TeamPrevGoalsFor_{n}": F.coalesce(F.col(f"{scored}_{n}"), F.lit(0.0)),
        f"{side}TeamPrevGoalsAgainst_{n}": F.coalesce(F.col(f"{conceded}_{n}"), F.lit(0.0)),
    }


def _points_share(suffix: str) -> Column:
    wins, losses, otls = (F.col(f"{m}_{suffix}") for m in ("wins", "losses", "otls"))
    return F.try_divide(2 * wins + otls, 2 * (wins + losses + otls))


def _attach(games: DataFrame, days: DataFrame, side: str, scenario: str | None, new: dict[str, Column]) -> DataFrame:
    """Join the (season, team, day) table to one side of the log and add `new` columns.

    Many games, one day row: a left join that keeps the log in place when the day
    table is small enough to broadcast, and that AQE can split on a hot day
    otherwise.
    """
    keys = [*lead(scenario), "seasonName", "gameDate"]
    kept = games.columns
    joined = games.join(
        days.withColumnRenamed("teamName", f"{side}TeamName"), [*keys, f"{side}TeamName"], "left"
    )
    return joined.select(*kept, *[value.alias(name) for name, value in new.items()])


def _team_keys(scenario: str | None) -> list[str]:
    return [*lead(scenario), "seasonName", "teamName"]


def with_venue(games: DataFrame, venues: DataFrame) -> DataFrame:
    """The log with the coordinates of each game's venue; null where unknown."""
    return games.join(venues.select("venue", "venue_lat", "venue_long"), "venue", "left")


def _with_place(games: DataFrame, venues: DataFrame) -> DataFrame:
    spot = located(F.col("venue_lat"), F.col("venue_long"))
    return games.join(venues.select("venue", spot.alias("_here")), "venue", "left")


def prior_results(
    games: DataFrame,
    n: int | None = SEASON_GAMES,
    scenario: str | None = None,
    count_shootout: bool = True,
) -> DataFrame:
    """Wins, losses and late losses of both sides in their previous n games.

    `n=None` counts the whole season so far. An unplayed game takes a place in
    the window with result 0.
    """
    span = "toDate" if n is None else str(n)
    days = prior_days(
        team_games(games, scenario), _team_keys(scenario), _results(count_shootout), () if n is None else (n,)
    )
    out = games
    for side in SIDES:
        out = _attach(
            out,
            days,
            side,
            scenario,
            {
                f"{side}TeamPrev{label}_{span}": F.coalesce(F.col(f"{m}_{span}"), F.lit(0.0)).cast("long")
                for m, label in (("wins", "Wins"), ("losses", "Losses"), ("otls", "OTLs"))
            },
        )
    return out


def points_pct(
    games: DataFrame,
    spans: Sequence[int] = (SEASON_GAMES, 3, 7),
    scenario: str | None = None,
) -> DataFrame:
    """Share of possible points in the previous n games, one column per n and side."""
    days = prior_days(team_games(games, scenario), _team_keys(scenario), _results(), spans)
    out = games
    for side in SIDES:
        out = _attach(
            out, days, side, scenario, {_share_name(side, n): _points_share(str(n)) for n in spans}
        )
    return out


def _share_name(side: str, n: int) -> str:
    return f"{side}TeamPointsPercentage" if n == SEASON_GAMES else f"{side}TeamPrevPointsPercentage_{n}"


def prior_goals(
    games: DataFrame,
    spans: Sequence[int] = (3, 7),
    perspective: str = "fixed_side",
    scenario: str | None = None,
) -> DataFrame:
    """Goals in the previous n games.

    "fixed_side" adds up the score of the home (or away) side of a team's games,
    whichever side the team was on; "team" adds up the team's own goals.
    """
    days = prior_days(team_games(games, scenario), _team_keys(scenario), _goals(perspective), spans)
    out = games
    for side in SIDES:
        new: dict[str, Column] = {}
        for n in spans:
            new.update(_goal_columns(side, n, perspective))
        out = _attach(out, days, side, scenario, new)
    return out


def _rest(side: str) -> dict[str, Column]:
    # Later games on one day follow a game of that day, hence 0.
    days = F.when(
        game_order().eqNullSafe(F.col("firstGame")), F.datediff("gameDate", "previousDate")
    ).when(F.col("firstGame").isNotNull(), 0)
    return {f"{side}TeamDaysSinceLastGame": days}


def rest_days(games: DataFrame, scenario: str | None = None) -> DataFrame:
    """Days since each side's previous game of the season; null for its first."""
    days = prior_days(team_games(games, scenario), _team_keys(scenario), {}, rest=True)
    out = games
    for side in SIDES:
        out = _attach(out, days, side, scenario, _rest(side))
    return out


def _travel(side: str, n: int) -> dict[str, Column]:
    here = F.col("_here")
    angles = F.aggregate(
        F.col("priorVenues"), F.lit(0.0), lambda so_far, spot: so_far + half_angle(here, spot)
    )
    mean = F.try_divide(2 * EARTH_RADIUS_KM * angles, F.size("priorVenues").cast("double"))
    return {f"{side}TeamTravelDistance{n}Days": F.when(here.isNotNull(), mean)}


def travel_load(
    games: DataFrame, venues: DataFrame, n_games: int = 7, scenario: str | None = None
) -> DataFrame:
    """Mean distance from the game's venue to the venues of the previous n games.

    Venues without coordinates are skipped; null when nothing is left to average.
    """
    days = prior_days(
        team_games(games, scenario, carry=["venue"]), _team_keys(scenario), {}, places=n_games, places_from=venues
    )
    out = _with_place(games, venues)
    for side in SIDES:
        out = _attach(out, days, side, scenario, _travel(side, n_games))
    return out.select(*games.columns, *[c for c in out.columns if "TravelDistance" in c])


def pair_days(games: DataFrame, scenario: str | None = None, latest: bool = False) -> DataFrame:
    """Playoff wins of each pair per day, and before that day.

    A pair is unordered: `teamLow` sorts before `teamHigh`. Games are summed per
    day first, so the running window sees one row per pair and day. `latest`
    adds the day's last played game.
    """
    keys = [*lead(scenario), "seasonName", "teamLow", "teamHigh"]
    home, away = F.col("homeTeamName"), F.col("awayTeamName")
    home_won = scoring.won(F.col("homeTeamScore"), F.col("awayTeamScore"))
    away_won = scoring.won(F.col("awayTeamScore"), F.col("homeTeamScore"))
    home_is_low = home <= away
    low_won = (home_is_low & home_won) | (~home_is_low & away_won)
    high_won = (home_is_low & away_won) | (~home_is_low & home_won)
    sums = [F.sum(low_won.cast("long")).alias("lowWins"), F.sum(high_won.cast("long")).alias("highWins")]
    if latest:
        game = F.struct("gameId", "homeTeamName", "awayTeamName", "homeTeamScore", "awayTeamScore")
        clock = F.when(F.col("lastPeriod").isNotNull(), F.struct("gameTimeEST", "gameId"))
        sums.append(F.max_by(game, clock).alias("lastGame"))
    days = (
        games.where((F.col("gameType") == PLAYOFF) & F.col("gameDate").isNotNull())
        .withColumns({"teamLow": F.least(home, away), "teamHigh": F.greatest(home, away)})
        .groupBy(*keys, "gameDate")
        .agg(*sums)
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(F.unix_date("gameDate"))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    return days.withColumns(
        {
            "lowBefore": F.coalesce(F.sum("lowWins").over(earlier), F.lit(0)),
            "highBefore": F.coalesce(F.sum("highWins").over(earlier), F.lit(0)),
        }
    )


def _attach_series(games: DataFrame, pairs: DataFrame, scenario: str | None) -> DataFrame:
    keys = [*lead(scenario), "seasonName", "gameDate"]
    home, away = F.col("homeTeamName"), F.col("awayTeamName")
    kept = games.columns
    joined = games.withColumns({"teamLow": F.least(home, away), "teamHigh": F.greatest(home, away)}).join(
        pairs.select(*keys, "teamLow", "teamHigh", "lowBefore", "highBefore"),
        [*keys, "teamLow", "teamHigh"],
        "left",
    )
    home_is_low = home <= away
    playoff = F.col("gameType") == PLAYOFF
    low, high = (F.coalesce(F.col(c), F.lit(0)) for c in ("lowBefore", "highBefore"))
    return joined.select(
        *kept,
        F.when(playoff, F.when(home_is_low, low).otherwise(high)).alias("homeTeamSeriesScore"),
        F.when(playoff, F.when(home_is_low, high).otherwise(low)).alias("awayTeamSeriesScore"),
    )


def series_score(games: DataFrame, scenario: str | None = None) -> DataFrame:
    """Wins of both sides in their playoff series before the day of the game.

    Null outside the playoffs.
    """
    return _attach_series(games, pair_days(games, scenario), scenario)


def feature_days(
    games: DataFrame,
    venues: DataFrame,
    perspective: str = "fixed_side",
    scenario: str | None = None,
) -> DataFrame:
    """All per-team history of the feature set at (season, team, day) grain, in one pass."""
    goals = _goals(perspective)
    return prior_days(
        team_games(games, scenario, carry=["venue"]),
        _team_keys(scenario),
        {**_results(), **goals},
        spans=(3, 7, SEASON_GAMES),
        places=7,
        places_from=venues,
        rest=True,
    )


def feature_set(
    games: DataFrame,
    venues: DataFrame,
    perspective: str = "fixed_side",
    scenario: str | None = None,
) -> DataFrame:
    """The log with the history features of both sides.

    Points share over 110, 3 and 7 games, goals over 3 and 7 games, rest days,
    travel over 7 games and the series score.
    """
    spans = (3, 7)
    days = feature_days(games, venues, perspective, scenario)
    shares = {f"share_{n}": _points_share(str(n)) for n in (SEASON_GAMES, *spans)}
    goals = [f"{m}_{n}" for m in ("first", "second") for n in spans]
    days = days.withColumns(shares).select(
        *_team_keys(scenario), "gameDate", *shares, *goals, "priorVenues", "firstGame", "previousDate"
    )
    out = _with_place(games, venues)
    for side in SIDES:
        new = {_share_name(side, n): F.col(f"share_{n}") for n in (SEASON_GAMES, *spans)}
        for n in spans:
            new.update(_goal_columns(side, n, perspective))
        new.update(_rest(side))
        new.update(_travel(side, 7))
        out = _attach(out, days, side, scenario, new)
    added = [c for c in out.columns if c not in games.columns and c != "_here"]
    out = out.select(*games.columns, *added)
    return _attach_series(out, pair_days(games, scenario), scenario)
