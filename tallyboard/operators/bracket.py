"""Playoff pairs, series state and series calendars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.operators.history import PLAYOFF, pair_days
from tallyboard.operators.timeline import lead

# Conferences in slot order, day offsets of a series, the host of
# each of its games, rest days before a round, and ordered pairs per round.
CONFERENCES = ("Eastern", "Western")
SERIES_OFFSETS = (0, 2, 5, 7, 10, 12, 15)
FINAL_OFFSETS = (0, 3, 6, 9, 12, 15, 18)
SERIES_HOSTS = (1, 1, 2, 2, 1, 2, 1)
ROUND_BUFFER_DAYS = 2
ROUND_PAIRS = {16: 1, 24: 2, 28: 3, 30: 4}
FINAL_ROUND = 4


def first_round(
    table: DataFrame, scenario: str | None = None, conferences: Sequence[str] = CONFERENCES
) -> DataFrame:
    """Four pairs per conference from final standings.

    The better division winner meets the second wildcard and the other one the
    first; the second and third of each division meet each other.
    """
    keys = [*lead(scenario), "seasonName", "conferenceName"]
    team = F.struct("teamName", "conferenceSeed")

    def seeded(code: str) -> Column:
        return F.max(F.when(F.col("playoffSeed") == code, team))

    placed = table.where(F.col("playoffSeed") != "missed")
    wild = placed.groupBy(*keys).agg(seeded("wc_1").alias("wc_1"), seeded("wc_2").alias("wc_2"))
    better_first = Window.partitionBy(*keys).orderBy("div_1.conferenceSeed")
    divisions = (
        placed.groupBy(*keys, "divisionName")
        .agg(*[seeded(f"div_{k}").alias(f"div_{k}") for k in (1, 2, 3)])
        .where(F.col("div_1").isNotNull())
        .withColumn("_place", F.row_number().over(better_first) - 1)
    )
    initial = F.substring("divisionName", 1, 1)
    best = F.col("_place") == 0
    pairs = F.array(
        F.struct(
            F.lit(0).alias("k"),
            F.col("div_1").alias("a"),
            F.when(best, F.col("wc_2")).otherwise(F.col("wc_1")).alias("b"),
            F.concat(initial, F.lit("1")).alias("aSeed"),
            F.when(best, "WC2").otherwise("WC1").alias("bSeed"),
        ),
        F.struct(
            F.lit(1).alias("k"),
            F.col("div_2").alias("a"),
            F.col("div_3").alias("b"),
            F.concat(initial, F.lit("2")).alias("aSeed"),
            F.concat(initial, F.lit("3")).alias("bSeed"),
        ),
    )
    order = F.array(*[F.lit(c) for c in conferences])
    offset = (F.array_position(order, F.col("conferenceName")) - 1) * 4
    return (
        divisions.join(wild, keys)
        .withColumn("_pair", F.explode(pairs))
        .select(
            *lead(scenario),
            "seasonName",
            F.lit(1).alias("round"),
            (offset + 2 * F.col("_place") + F.col("_pair.k")).cast("int").alias("slot"),
            "conferenceName",
            "divisionName",
            F.col("_pair.a.teamName").alias("team1"),
            F.col("_pair.b.teamName").alias("team2"),
            F.col("_pair.a.conferenceSeed").alias("team1ConferenceSeed"),
            F.col("_pair.b.conferenceSeed").alias("team2ConferenceSeed"),
            F.col("_pair.aSeed").alias("team1Seed"),
            F.col("_pair.bSeed").alias("team2Seed"),
        )
    )


def next_round(results: DataFrame, round_number: int, scenario: str | None = None) -> DataFrame:
    """Pairs of round 2, 3 or 4 from the winners of the round before.

    Winners meet within their division (2), conference (3) or the league (4), in
    slot order. `results` is a bracket with a `winner` column.
    """
    grouping = {2: ["conferenceName", "divisionName"], 3: ["conferenceName"], 4: []}
    if round_number not in grouping:
        raise ValueError("round_number must be 2, 3 or 4")
    keys = [*lead(scenario), "seasonName"]
    seed = F.when(F.col("winner") == F.col("team1"), F.col("team1ConferenceSeed")).when(
        F.col("winner") == F.col("team2"), F.col("team2ConferenceSeed")
    )
    row = F.struct(
        F.col("winner").alias("team"), seed.alias("seed"), F.col("conferenceName").alias("c"), F.col("divisionName").alias("d")
    )
    met = (
        results.where(F.col("round") == round_number - 1)
        .groupBy(*keys, *grouping[round_number])
        .agg(
            F.min_by(row, "slot").alias("a"),
            F.when(F.count(F.lit(1)) > 1, F.max_by(row, "slot")).alias("b"),
            F.min("slot").alias("_slot"),
        )
    )
    in_order = Window.partitionBy(*keys).orderBy("_slot")
    return met.select(
        *keys,
        F.lit(round_number).alias("round"),
        (F.row_number().over(in_order) - 1).alias("slot"),
        F.col("a.c").alias("conferenceName"),
        F.col("a.d").alias("divisionName"),
        F.col("a.team").alias("team1"),
        F.col("b.team").alias("team2"),
        F.col("a.seed").alias("team1ConferenceSeed"),
        F.col("b.seed").alias("team2ConferenceSeed"),
    )


def latest_series_game(games: DataFrame, scenario: str | None = None) -> DataFrame:
    """The last played playoff game of each pair, with both sides' earlier wins."""
    keys = [*lead(scenario), "seasonName", "teamLow", "teamHigh"]
    day = F.struct("gameDate", "lowBefore", "highBefore", "lastGame")
    played = F.when(F.col("lastGame").isNotNull(), F.col("gameDate"))
    last = (
        pair_days(games, scenario, latest=True)
        .groupBy(*keys)
        .agg(F.max_by(day, played).alias("last"))
        .where(F.col("last").isNotNull())
    )
    home_is_low = F.col("last.lastGame.homeTeamName") == F.col("teamLow")
    low, high = F.col("last.lowBefore"), F.col("last.highBefore")
    return last.select(
        *keys,
        F.col("last.gameDate").alias("gameDate"),
        "last.lastGame.*",
        F.when(home_is_low, low).otherwise(high).alias("homeTeamSeriesScore"),
        F.when(home_is_low, high).otherwise(low).alias("awayTeamSeriesScore"),
    )


def series_state(games: DataFrame, wins_needed: int = 4, scenario: str | None = None) -> DataFrame:
    """State of each pair's series after its latest played game.

    A series is decided when a side that was one win short has won that game.
    """
    home, away = F.col("homeTeamName"), F.col("awayTeamName")
    home_won = F.coalesce(F.col("homeTeamScore") > F.col("awayTeamScore"), F.lit(False))
    away_won = F.coalesce(F.col("awayTeamScore") > F.col("homeTeamScore"), F.lit(False))
    home_wins = F.col("homeTeamSeriesScore") + home_won.cast("int")
    away_wins = F.col("awayTeamSeriesScore") + away_won.cast("int")
    short = wins_needed - 1
    decided = ((F.col("homeTeamSeriesScore") == short) & home_won) | (
        (F.col("awayTeamSeriesScore") == short) & away_won
    )
    home_is_low = home == F.col("teamLow")
    loser_wins = F.when(home_won, away_wins).otherwise(home_wins)
    return latest_series_game(games, scenario).select(
        *lead(scenario),
        "seasonName",
        "teamLow",
        "teamHigh",
        F.col("gameId").alias("lastGameId"),
        F.col("gameDate").alias("lastGameDate"),
        F.when(home_is_low, home_wins).otherwise(away_wins).alias("lowWins"),
        F.when(home_is_low, away_wins).otherwise(home_wins).alias("highWins"),
        decided.alias("decided"),
        F.when(decided, F.when(home_won, home).otherwise(away)).alias("winner"),
        F.when(decided, F.when(home_won, away).otherwise(home)).alias("loser"),
        F.when(decided, loser_wins).alias("loserWins"),
        F.when(decided, F.concat(F.lit(f"{wins_needed}-"), loser_wins.cast("string"))).alias("scoreText"),
    )


def bracket_results(bracket: DataFrame, state: DataFrame, scenario: str | None = None) -> DataFrame:
    """A bracket with the wins of both teams and, where decided, the winner."""
    keys = [*lead(scenario), "seasonName", "teamLow", "teamHigh"]
    joined = bracket.withColumns(
        {"teamLow": F.least("team1", "team2"), "teamHigh": F.greatest("team1", "team2")}
    ).join(state, keys, "left")
    first_is_low = F.col("team1") == F.col("teamLow")
    low, high = (F.coalesce(F.col(c), F.lit(0)) for c in ("lowWins", "highWins"))
    return joined.select(
        *bracket.columns,
        F.when(first_is_low, low).otherwise(high).alias("team1Wins"),
        F.when(first_is_low, high).otherwise(low).alias("team2Wins"),
        F.coalesce("decided", F.lit(False)).alias("decided"),
        "winner",
        "loser",
        "loserWins",
        "scoreText",
    )


def rounds_completed(results: DataFrame, scenario: str | None = None) -> DataFrame:
    """Per round: number of series, decided series, and whether all are decided."""
    return results.groupBy(*lead(scenario), "seasonName", "round").agg(
        F.count(F.lit(1)).alias("series"),
        F.count_if("decided").alias("decidedSeries"),
        F.every("decided").alias("complete"),
    )


def prune_decided(games: DataFrame, state: DataFrame, scenario: str | None = None) -> DataFrame:
    """The log without games of a decided series after the day it was decided."""
    keys = [*lead(scenario), "seasonName", "teamLow", "teamHigh"]
    over = state.where("decided").select(*keys, "lastGameDate")
    home, away = F.col("homeTeamName"), F.col("awayTeamName")
    log = games.withColumns({"teamLow": F.least(home, away), "teamHigh": F.greatest(home, away)})
    same = [log[k] == over[k] for k in keys]
    late = log["gameDate"] > over["lastGameDate"]
    return log.join(over, [*same, late], "left_anti").drop("teamLow", "teamHigh")


def _playoff_pairs(games: DataFrame, scenario: str | None) -> DataFrame:
    """Ordered pairs of each season's playoffs with their first appearance."""
    clock = F.struct("gameDate", "gameTimeEST", "gameId")
    return (
        games.where(F.col("gameType") == PLAYOFF)
        .groupBy(*lead(scenario), "seasonName", "homeTeamName", "awayTeamName")
        .agg(F.min(clock).alias("firstSeen"))
    )


def _full_rounds(pairs: Column, ladder: Mapping[int, int]) -> tuple[Column, Column]:
    """Number of full rounds in so many ordered pairs, and the pairs these take up."""
    rounds, covered = F.lit(0), F.lit(0)
    for size, number in sorted(ladder.items()):
        rounds = F.when(pairs >= size, number).otherwise(rounds)
        covered = F.when(pairs >= size, size).otherwise(covered)
    return rounds, covered


def rounds_scheduled(
    games: DataFrame, scenario: str | None = None, ladder: Mapping[int, int] = ROUND_PAIRS
) -> DataFrame:
    """Number of fully scheduled playoff rounds, and whether another has begun."""
    rounds, covered = _full_rounds(F.col("pairs"), ladder)
    return (
        _playoff_pairs(games, scenario)
        .groupBy(*lead(scenario), "seasonName")
        .agg(F.count(F.lit(1)).alias("pairs"))
        .withColumns({"roundsScheduled": rounds, "partialRound": F.col("pairs") != covered})
    )


def partial_round_games(
    games: DataFrame, scenario: str | None = None, ladder: Mapping[int, int] = ROUND_PAIRS
) -> DataFrame:
    """Playoff games of the pairs that belong to a round not yet fully scheduled.

    These are the pairs seen last, as many as go beyond the full rounds.
    """
    keys = [*lead(scenario), "seasonName"]
    season = Window.partitionBy(*keys)
    _, covered = _full_rounds(F.col("_pairs"), ladder)
    begun = (
        _playoff_pairs(games, scenario)
        .withColumns(
            {
                "_back": F.row_number().over(season.orderBy(F.desc("firstSeen"))),
                "_pairs": F.count(F.lit(1)).over(season),
            }
        )
        .where(F.col("_back") <= F.col("_pairs") - covered)
        .select(*keys, "homeTeamName", "awayTeamName")
    )
    return games.where(F.col("gameType") == PLAYOFF).join(
        begun, [*keys, "homeTeamName", "awayTeamName"], "left_semi"
    )


def usual_start(games: DataFrame, min_count: int = 5) -> DataFrame:
    """Most frequent start minute per season and venue, if it occurs often enough."""
    return (
        games.groupBy("seasonName", "venue", "gameTimeEST")
        .agg(F.count(F.lit(1)).alias("games"))
        .where(F.col("games") > min_count)
        .groupBy("seasonName", "venue")
        .agg(F.max_by("gameTimeEST", F.struct(F.col("games"), -F.col("gameTimeEST"))).alias("usualStart"))
    )


def home_venue(games: DataFrame, min_count: int = 20) -> DataFrame:
    """Most frequent venue per season and home team, if used often enough."""
    place = F.struct("venue", "venueTimezone")
    return (
        games.groupBy("seasonName", "homeTeamName", "venue", "venueTimezone")
        .agg(F.count(F.lit(1)).alias("games"))
        .where(F.col("games") > min_count)
        .groupBy("seasonName", F.col("homeTeamName").alias("teamName"))
        .agg(F.min_by(place, F.struct(-F.col("games"), "venue", "venueTimezone")).alias("_place"))
        .select("seasonName", "teamName", "_place.venue", "_place.venueTimezone")
    )


def series_schedule(
    bracket: DataFrame,
    log: DataFrame,
    homes: DataFrame,
    starts: DataFrame,
    already: DataFrame | None = None,
    home_ice: str = "team1",
    scenario: str | None = None,
    second_day: str = CONFERENCES[1],
    counted: str = "pair",
) -> DataFrame:
    """Games of each pair's series, in the shape of the game log.

    A round begins `ROUND_BUFFER_DAYS` after the last game in `log`; pairs of the
    second conference begin a day later; the final has its own day offsets.
    `already` holds games of these pairs that are scheduled: the series then
    counts from the first of them, and as many games are left out as there are.
    `counted="first_host"` looks at the games at team1's venue only. With `home_ice="by_seed"` the better conference seed
    hosts first, else team1 does.
    """
    if home_ice not in ("team1", "by_seed"):
        raise ValueError("home_ice must be 'team1' or 'by_seed'")
    if counted not in ("pair", "first_host"):
        raise ValueError("counted must be 'pair' or 'first_host'")
    keys = [*lead(scenario), "seasonName"]
    last_day = log.groupBy(*keys).agg(F.max("gameDate").alias("_last"))
    final = F.col("round") == FINAL_ROUND
    delayed = (F.col("conferenceName") == second_day) & ~final
    pairs = bracket.join(last_day, keys).withColumn(
        "_start", F.date_add("_last", F.when(delayed, ROUND_BUFFER_DAYS + 1).otherwise(ROUND_BUFFER_DAYS))
    )
    if already is not None:
        taken = [F.min("gameDate").alias("_begun"), F.count(F.lit(1)).alias("_done")]
        if counted == "first_host":
            begun = already.groupBy(*keys, F.col("homeTeamName").alias("team1")).agg(*taken)
            pairs = pairs.join(begun, [*keys, "team1"], "left")
        else:
            low = F.least("homeTeamName", "awayTeamName").alias("_low")
            high = F.greatest("homeTeamName", "awayTeamName").alias("_high")
            begun = already.groupBy(*keys, low, high).agg(*taken)
            pairs = pairs.withColumns({"_low": F.least("team1", "team2"), "_high": F.greatest("team1", "team2")})
            pairs = pairs.join(begun, [*keys, "_low", "_high"], "left")
    else:
        pairs = pairs.withColumns({"_begun": F.lit(None).cast("date"), "_done": F.lit(0)})
    swap = F.lit(False)
    if home_ice == "by_seed":
        swap = F.coalesce(F.col("team2ConferenceSeed") < F.col("team1ConferenceSeed"), F.lit(False))

    def listed(values: Sequence[int]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    host_is_first = (F.element_at(listed(SERIES_HOSTS), F.col("_pos") + 1) == 1) != swap
    offsets = F.when(final, listed(FINAL_OFFSETS)).otherwise(listed(SERIES_OFFSETS))
    games = (
        pairs.select("*", F.posexplode(offsets).alias("_pos", "_offset"))
        .where(F.col("_pos") >= F.coalesce("_done", F.lit(0)))
        .withColumns(
            {
                "homeTeamName": F.when(host_is_first, F.col("team1")).otherwise(F.col("team2")),
                "awayTeamName": F.when(host_is_first, F.col("team2")).otherwise(F.col("team1")),
                "gameDate": F.date_add(F.coalesce("_begun", "_start"), F.col("_offset")),
            }
        )
        .join(homes.withColumnRenamed("teamName", "homeTeamName"), ["seasonName", "homeTeamName"], "left")
        .join(starts, ["seasonName", "venue"], "left")
    )
    return games.select(
        *lead(scenario),
        F.lit(None).cast("long").alias("gameId"),
        "seasonName",
        F.lit(PLAYOFF).alias("gameType"),
        "venueTimezone",
        "venue",
        "homeTeamName",
        "awayTeamName",
        F.lit(None).cast("double").alias("homeTeamScore"),
        F.lit(None).cast("double").alias("awayTeamScore"),
        F.lit(None).cast("string").alias("lastPeriod"),
        "gameDate",
        F.col("usualStart").alias("gameTimeEST"),
        "round",
        "slot",
        (F.col("_pos") + 1).alias("gameNumber"),
    )
