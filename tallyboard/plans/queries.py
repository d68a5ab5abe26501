"""Registered queries: each operator over the shared test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.functions import dates, scoring
from tallyboard.functions.geo import haversine_km
from tallyboard.operators import bracket, evaluate, forest, history, model, outcomes, refresh, standings, timeline
from tallyboard.plans import daily
from tallyboard.plans import fixtures as fx
from tallyboard.schemas import GAME_LOG, RAW_SCHEDULE, RAW_STANDINGS
from tallyboard.session import shared_dir, stage
from tallyboard.sources import league, models, readers, store, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def text(column: str) -> Column:
    """A date as text, so that every engine prints it alike."""
    return F.col(column).cast("string").alias(column)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def added(out: DataFrame, base: DataFrame) -> DataFrame:
    """The game id and what an operator added to the log."""
    return out.select("gameId", *[c for c in out.columns if c not in base.columns])


# --- rows and standings ---------------------------------------------------


@query("team_games")
def _(spark, sf):
    return timeline.team_games(fx.games(spark, sf)).select(
        "gameId", "side", "seasonName", "gameType", text("gameDate"), "teamName", "opponentName",
        "teamScore", "opponentScore", "lastPeriod",
    )


@query("game_points")
def _(spark, sf):
    return standings.game_points(fx.games(spark, sf)).select("gameId", "homeTeamPoints", "awayTeamPoints")


@query("game_points_reference")
def _(spark, sf):
    return standings.game_points(fx.games(spark, sf), unplayed="reference").select(
        "gameId", "homeTeamPoints", "awayTeamPoints"
    )


@query("home_away_split")
def _(spark, sf):
    labels = ("Games", "Points", "Wins", "Losses", "OTLs", "GoalsFor", "GoalsAgainst")
    return standings.home_away_split(fx.games(spark, sf), fx.teams(spark, sf)).select(
        "seasonName", "teamName", *[f"total{side}{label}" for side in ("Home", "Away") for label in labels]
    )


@query("standings")
def standings_query(spark, sf):
    return rounded(standings.standings(fx.games(spark, sf), fx.teams(spark, sf)), "pointsPercentage")


@query("seeds")
def _(spark, sf):
    return standings.standings(fx.games(spark, sf), fx.teams(spark, sf)).select(
        "seasonName", "teamName", "divisionSeed", "conferenceSeed", "playoffSeed"
    )


@query("wildcard_table")
def _(spark, sf):
    table = standings.standings(fx.games(spark, sf), fx.teams(spark, sf))
    return standings.wildcard_table(table).select(
        "seasonName", "conferenceName", "teamName", "playoffSeed", "totalPoints", "seedGroup", "wildcardSeed", "viewRank"
    )


# --- history features -----------------------------------------------------


@query("with_venue")
def _(spark, sf):
    return history.with_venue(fx.games(spark, sf), fx.venues(spark, sf)).select(
        "gameId", "venue", "venue_lat", "venue_long"
    )


@query("prior_results")
def _(spark, sf):
    games = fx.games(spark, sf)
    return added(history.prior_results(games, 3), games)


@query("prior_results_110")
def _(spark, sf):
    games = fx.games(spark, sf)
    return added(history.prior_results(games), games)


@query("prior_results_season")
def _(spark, sf):
    games = fx.games(spark, sf)
    return added(history.prior_results(games, None), games)


@query("points_pct")
def _(spark, sf):
    games = fx.games(spark, sf)
    out = added(history.points_pct(games), games)
    return rounded(out, *out.columns[1:])


@query("prior_goals")
def _(spark, sf):
    games = fx.games(spark, sf)
    return added(history.prior_goals(games), games)


@query("prior_goals_team")
def _(spark, sf):
    games = fx.games(spark, sf)
    return added(history.prior_goals(games, perspective="team"), games)


@query("rest_days")
def _(spark, sf):
    games = fx.games(spark, sf)
    return added(history.rest_days(games), games)


@query("haversine_km")
def _(spark, sf):
    spots = fx.venues(spark, sf)
    home = spots.select(F.col("venue").alias("homeVenue"), F.col("venue_lat").alias("lat1"), F.col("venue_long").alias("long1"))
    away = spots.select(F.col("venue").alias("awayVenue"), F.col("venue_lat").alias("lat2"), F.col("venue_long").alias("long2"))
    pairs = (
        fx.games(spark, sf)
        .withColumns(
            {
                "homeVenue": F.concat(F.lit("Arena "), F.col("homeTeamName")),
                "awayVenue": F.concat(F.lit("Arena "), F.col("awayTeamName")),
            }
        )
        .join(home, "homeVenue", "left")
        .join(away, "awayVenue", "left")
    )
    km = haversine_km(F.col("lat1"), F.col("long1"), F.col("lat2"), F.col("long2"))
    return pairs.select("gameId", F.round(km, 6).alias("km"))


@query("travel_load")
def travel_load_query(spark, sf):
    games = fx.games(spark, sf)
    out = added(history.travel_load(games, fx.venues(spark, sf)), games)
    return rounded(out, *out.columns[1:])


@query("series_score")
def series_score_query(spark, sf):
    games = fx.games(spark, sf)
    return added(history.series_score(games), games)


@query("feature_set")
def feature_set_query(spark, sf):
    games = fx.games(spark, sf)
    out = added(history.feature_set(games, fx.venues(spark, sf)), games)
    return rounded(out, *[c for c in out.columns if "Percentage" in c or "Travel" in c])


# --- bracket and series ---------------------------------------------------

# Pairs of the test tables meet only a few times a season.
WINS_NEEDED = 2


def _table(spark, sf):
    return standings.standings(fx.games(spark, sf), fx.teams(spark, sf))


def _state(spark, sf):
    return bracket.series_state(fx.games(spark, sf), WINS_NEEDED)


@query("first_round")
def _(spark, sf):
    return bracket.first_round(_table(spark, sf))


@query("latest_series_game")
def _(spark, sf):
    return bracket.latest_series_game(fx.games(spark, sf)).select(
        "seasonName", "teamLow", "teamHigh", text("gameDate"), "gameId", "homeTeamSeriesScore", "awayTeamSeriesScore"
    )


@query("series_state")
def _(spark, sf):
    return _state(spark, sf).withColumn("lastGameDate", text("lastGameDate"))


@query("series_state_best_of_7")
def _(spark, sf):
    state = bracket.series_state(fx.games(spark, sf))
    return state.select("seasonName", "teamLow", "teamHigh", "lowWins", "highWins", "decided", "winner", "loserWins")


@query("bracket_results")
def _(spark, sf):
    results = bracket.bracket_results(bracket.first_round(_table(spark, sf)), _state(spark, sf))
    return results.select(
        "seasonName", "round", "slot", "team1", "team2", "team1Wins", "team2Wins", "decided", "winner", "loser", "scoreText"
    )


def _advanced(spark, sf, round_number):
    """First-round pairs carried on; a series without a decision goes to team1."""
    results = bracket.bracket_results(bracket.first_round(_table(spark, sf)), _state(spark, sf))
    for number in range(2, round_number + 1):
        results = bracket.next_round(results.withColumn("winner", F.coalesce("winner", "team1")), number)
        if number < round_number:
            results = results.withColumn("winner", F.col("team1"))
    return results


@query("next_round")
def _(spark, sf):
    return _advanced(spark, sf, 2)


@query("next_round_final")
def _(spark, sf):
    return _advanced(spark, sf, 4).select(
        "seasonName", "round", "slot", "team1", "team2", "team1ConferenceSeed", "team2ConferenceSeed"
    )


@query("rounds_completed")
def _(spark, sf):
    return bracket.rounds_completed(
        bracket.bracket_results(bracket.first_round(_table(spark, sf)), _state(spark, sf))
    )


def _split_log(spark, sf):
    """The log dealt out to 20 scenarios, so that pair counts differ."""
    return fx.games(spark, sf).withColumn("iteration", F.col("gameId") % 20)


@query("rounds_scheduled")
def _(spark, sf):
    return bracket.rounds_scheduled(_split_log(spark, sf), "iteration")


@query("partial_round_games")
def _(spark, sf):
    return bracket.partial_round_games(_split_log(spark, sf), "iteration").select("iteration", "gameId", "seasonName")


def _coarse_starts(games):
    return games.withColumn("gameTimeEST", (F.floor(F.col("gameTimeEST") / 240) * 240).cast("int"))


@query("usual_start")
def _(spark, sf):
    return bracket.usual_start(_coarse_starts(fx.games(spark, sf)))


@query("home_venue")
def _(spark, sf):
    return bracket.home_venue(fx.timed_games(spark, sf))


def _calendar(spark, sf, pairs, already=None):
    games = _coarse_starts(fx.timed_games(spark, sf))
    return bracket.series_schedule(
        pairs, games, bracket.home_venue(games), bracket.usual_start(games), already, counted="first_host"
    ).select(
        "seasonName", "round", "slot", "gameNumber", text("gameDate"), "homeTeamName", "awayTeamName", "venue",
        "venueTimezone", "gameTimeEST", "gameType",
    )


@query("series_schedule")
def _(spark, sf):
    return _calendar(spark, sf, bracket.first_round(_table(spark, sf)))


@query("series_schedule_final")
def _(spark, sf):
    return _calendar(spark, sf, _advanced(spark, sf, 4))


@query("series_schedule_begun")
def _(spark, sf):
    opening = (F.month("gameDate") == 10) & (F.dayofmonth("gameDate") <= 5)
    already = fx.games(spark, sf).where(opening)
    return _calendar(spark, sf, bracket.first_round(_table(spark, sf)), already)


@query("prune_decided")
def _(spark, sf):
    return bracket.prune_decided(fx.games(spark, sf), _state(spark, sf)).select("gameId", "seasonName")


# --- stored forecasts -----------------------------------------------------


def _kinds(spark, sf):
    playoff = (F.dayofyear("predDate") % 5 == 0) | (F.col("gameId") % 3 == 0)
    kind = F.when(playoff, readers.PLAYOFF).otherwise(readers.REGULAR)
    return fx.snapshots(spark, sf).withColumn("kind", kind)


@query("read_snapshots")
def _(spark, sf):
    return readers.read_snapshots(_kinds(spark, sf), "1996-01-01", "2000-01-01").select(
        text("predDate"), "kind", "gameId"
    )


@query("correct_outcome")
def _(spark, sf):
    joined = fx.games(spark, sf).withColumns(
        {"p1": (F.col("gameId") % 5).cast("double"), "p2": ((F.col("gameId") * 3) % 4).cast("double")}
    )
    hit = scoring.correct_outcome(F.col("homeTeamScore"), F.col("awayTeamScore"), F.col("p1"), F.col("p2"))
    return joined.select("gameId", hit.alias("correctOutcome"))


def _accuracy(spark, sf):
    return evaluate.snapshot_accuracy(fx.snapshots(spark, sf), fx.games(spark, sf))


@query("snapshot_accuracy")
def _(spark, sf):
    return _accuracy(spark, sf).withColumn("gameDate", text("gameDate"))


@query("compare_results")
def _(spark, sf):
    out = evaluate.compare_results(fx.snapshots(spark, sf), fx.games(spark, sf), "1996-01-01", "2001-01-01")
    return out.withColumn("gameDate", text("gameDate"))


@query("daily_accuracy")
def _(spark, sf):
    compared = evaluate.compare_results(fx.snapshots(spark, sf), fx.games(spark, sf))
    days = evaluate.daily_accuracy(compared, overall=True)
    return rounded(days.withColumn("gameDate", text("gameDate")), "accuracy")


def _priced(spark, sf):
    return evaluate.with_odds(_accuracy(spark, sf), fx.odds(spark, sf))


@query("with_odds")
def _(spark, sf):
    return _priced(spark, sf).select("gameId", "correctOutcome", "homeTeamOdds", "awayTeamOdds")


@query("missing_odds")
def _(spark, sf):
    return evaluate.missing_odds(_priced(spark, sf))


@query("unit_return")
def _(spark, sf):
    out = evaluate.game_returns(_priced(spark, sf)).select("gameId", "winnerOdds", "winnings")
    return rounded(out, "winnings")


@query("unit_return_skip")
def _(spark, sf):
    out = evaluate.game_returns(_priced(spark, sf), missing="skip").select("gameId", "winnings")
    return rounded(out, "winnings")


@query("daily_returns")
def daily_returns_query(spark, sf):
    out = evaluate.daily_returns(evaluate.game_returns(_priced(spark, sf)))
    return rounded(out.withColumn("gameDate", text("gameDate")), "winnings", "runningReturn")


@query("regression_metrics")
def _(spark, sf):
    joined = _accuracy(spark, sf).withColumn("seasonOf", F.year("gameDate"))
    return rounded(evaluate.regression_metrics(joined, by=["seasonOf"]), "mse", "r2", "accuracy")


# --- outcomes over scenarios ----------------------------------------------


def _percentages(df: DataFrame) -> DataFrame:
    return rounded(df, *[c for c in df.columns if c.endswith("%")])


@query("seed_probabilities")
def _(spark, sf):
    return _percentages(outcomes.seed_probabilities(fx.outcomes(spark, sf), fx.teams(spark, sf)))


@query("round_probabilities")
def _(spark, sf):
    return _percentages(outcomes.round_probabilities(fx.outcomes(spark, sf), fx.teams(spark, sf)))


@query("outcome_probabilities")
def outcome_probabilities_query(spark, sf):
    return _percentages(outcomes.outcome_probabilities(fx.outcomes(spark, sf)))


def _scenario_logs(spark, sf):
    """The log four times over; in each but the first the sides of other games change scores."""
    games = fx.games(spark, sf).withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(3))))
    swap = (F.col("iteration") > 0) & (F.col("gameId") % 4 == F.col("iteration"))
    home, away = F.col("homeTeamScore"), F.col("awayTeamScore")
    return games.withColumns(
        {"homeTeamScore": F.when(swap, away).otherwise(home), "awayTeamScore": F.when(swap, home).otherwise(away)}
    )


@query("scenario_probabilities")
def _(spark, sf):
    """From the games of four scenarios over all rounds to how often a team gets how far."""
    out, _ = daily.scenario_probabilities(_scenario_logs(spark, sf), fx.teams(spark, sf), WINS_NEEDED)
    shares = {c: F.round(f"{c}_%", 6).alias(f"{c}_share") for c in ("playoff", *outcomes.STAGES.values())}
    return out.select("seasonName", "teamName", *outcomes.SEEDS, *outcomes.STAGES.values(), *shares.values())


@query("scenario_brackets")
def _(spark, sf):
    """The brackets of all rounds of the same scenarios."""
    return daily.scenario_probabilities(_scenario_logs(spark, sf), fx.teams(spark, sf), WINS_NEEDED)[1]


@query("probability_report")
def _(spark, sf):
    table = outcomes.outcome_probabilities(fx.outcomes(spark, sf), fx.teams(spark, sf))
    return _percentages(outcomes.probability_report(table))


@query("ring_shares")
def _(spark, sf):
    out = outcomes.ring_shares(outcomes.outcome_probabilities(fx.outcomes(spark, sf)))
    return rounded(out, "percent", "share").withColumns(
        {c: F.round(c, 4) for c in ("startAngle", "endAngle")}
    )


@query("ring_shares_by_slot")
def _(spark, sf):
    # A stand-in for bracket slots: teams in the reverse order of their keys.
    slots = fx.table(spark, sf, "nation").select(F.col("n_name").alias("teamName"), (-F.col("n_nationkey")).alias("position"))
    out = outcomes.ring_shares(outcomes.outcome_probabilities(fx.outcomes(spark, sf)), slots)
    return out.select("ring", "teamName", *[F.round(c, 4).alias(c) for c in ("startAngle", "endAngle")])


@query("alive_teams")
def _(spark, sf):
    table = outcomes.outcome_probabilities(fx.outcomes(spark, sf))
    return _percentages(outcomes.alive_teams(table, 4).select("teamName", "make_cup_final_%"))


@query("scenario_outcomes")
def _(spark, sf):
    """Each season taken as one scenario: its seeds and the first-round series won."""
    table = _table(spark, sf)
    results = bracket.bracket_results(bracket.first_round(table), _state(spark, sf))
    return outcomes.scenario_outcomes(table, results, scenario=None)


@query("latest_run")
def _(spark, sf):
    runs = fx.table(spark, sf, "events").select(
        "event_id", F.to_date("ts").alias("predDate"), (F.col("event_id") % 3 * 100 + 100).alias("n")
    )
    return readers.latest_run(runs).select("event_id", text("predDate"), "n")


# --- sources, sinks, refresh ----------------------------------------------


def _fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("read_games")
def _(spark, sf):
    """The log written as headed CSV files by season and read back with its schema."""
    path = _fresh_folder(spark, "season-csv")
    log = fx.timed_games(spark, sf).select(*GAME_LOG.fieldNames())
    log.write.partitionBy("seasonName").option("header", True).csv(path)
    games = readers.read_games(spark, path, "csv")
    return games.select(*[text(c) if c == "startTimeUTC" else c for c in GAME_LOG.fieldNames()])


def _schedule_documents(games: DataFrame) -> DataFrame:
    """The log nested like the schedule feed, one day with one game per document."""

    def label(value: Column) -> Column:
        return F.struct(value.alias("default"))

    def club(side: str) -> Column:
        return F.struct(
            label(F.col(f"{side}TeamName")).alias("placeName"),
            label(F.lit("Club")).alias("commonName"),
            F.col(f"{side}TeamScore").alias("score"),
        ).alias(f"{side}Team")

    game = F.struct(
        F.col("gameId").alias("id"),
        F.col("seasonName").cast("long").alias("season"),
        F.when(F.col("gameId") % 17 == 0, 1).otherwise(F.col("gameType")).alias("gameType"),
        F.date_format("startTimeUTC", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startTimeUTC"),
        "venueTimezone",
        label(F.col("venue")).alias("venue"),
        club("away"),
        club("home"),
        F.when(F.col("lastPeriod").isNotNull(), F.struct(F.col("lastPeriod").alias("lastPeriodType"))).alias("gameOutcome"),
    )
    day = F.struct(F.col("gameDate").cast("string").alias("date"), F.array(game).alias("games"))
    return games.select(F.to_json(F.struct(F.array(day).alias("gameWeek"))).alias("doc"))


@query("flatten_schedule")
def _(spark, sf):
    documents = _schedule_documents(fx.timed_games(spark, sf))
    return readers.flatten_schedule(documents.select(F.from_json("doc", RAW_SCHEDULE).alias("d")).select("d.*"))


@query("suspect_venues")
def _(spark, sf):
    """One venue stands on the other side of the globe."""
    venues = fx.venues(spark, sf)
    wrong = F.col("venue") == "Arena FRANCE"
    planted = venues.withColumns({"venue_lat": F.when(wrong, -60.0).otherwise(F.col("venue_lat")), "venue_long": F.when(wrong, 179.0).otherwise(F.col("venue_long"))})
    out = league.suspect_venues(fx.games(spark, sf), planted, factor=3.0)
    return rounded(out, "distance_km")


@query("model_round_trip")
def _(spark, sf):
    """A forest of no depth, saved and loaded."""
    path = _fresh_folder(spark, "models")
    features = _features(spark, sf)
    rows = forest.numbered(features)
    models.save_forest(forest.grow(rows, n_trees=1, max_depth=0, bootstrap=False), features, path, "2001-03-01")
    out = forest.predict(models.load_forest(spark, path, features), rows)
    return rounded(out.select("gameId", "homeTeamScore_predicted", "awayTeamScore_predicted"), "homeTeamScore_predicted", "awayTeamScore_predicted")


@query("read_schedule")
def _(spark, sf):
    """The same documents landed as files, one to a line."""
    path = _fresh_folder(spark, "schedule-json")
    _schedule_documents(fx.timed_games(spark, sf)).write.text(path)
    return readers.read_schedule(spark, path)


@query("load_landed")
def _(spark, sf):
    """Two generations of a landing folder and a broken document; the later fetch of a game counts."""
    landing, path = _fresh_folder(spark, "landing"), _fresh_folder(spark, "store")
    games = fx.timed_games(spark, sf)
    _schedule_documents(games.where("gameDate < '2001-01-01'")).write.text(f"{landing}/first")
    store.load_landed(spark, landing, path)
    later = games.where("gameDate >= '2000-06-01'").withColumn("homeTeamScore", F.col("homeTeamScore") + 1)
    broken = spark.createDataFrame([('{"gameWeek": [{"date"',)], "doc string")
    _schedule_documents(later).union(broken).write.text(f"{landing}/second")
    for _ in range(2):
        store.load_landed(spark, landing, path)
    return store.read(spark, path).drop(*store.FETCHED)


def _standings_documents(spark, sf) -> DataFrame:
    chase = F.when(F.col("playoffSeed") == "missed", 3).otherwise(F.substring("playoffSeed", -1, 1).cast("int"))
    team = F.struct(
        F.struct(F.col("teamName").alias("default")).alias("teamName"),
        "conferenceName",
        "divisionName",
        F.col("totalPoints").alias("points"),
        F.when(F.col("divisionSeed") <= 3, 0).otherwise(chase).alias("wildcardSequence"),
        F.col("divisionSeed").alias("divisionSequence"),
    )
    return _table(spark, sf).select(F.to_json(F.struct(F.array(team).alias("standings"))).alias("doc"))


@query("seed_from_sequences")
def _(spark, sf):
    raw = _standings_documents(spark, sf).select(F.from_json("doc", RAW_STANDINGS).alias("d")).select("d.*")
    return readers.flatten_standings(raw)


@query("read_standings")
def _(spark, sf):
    """The same documents landed as files, one to a line."""
    path = _fresh_folder(spark, "standings-json")
    _standings_documents(spark, sf).write.text(path)
    return readers.read_standings(spark, path)


@query("season_label")
def _(spark, sf):
    """Games by the label of the season that begins in their year, or the year before until June."""
    first_year = F.year("gameDate") - F.when(F.month("gameDate") <= 6, 1).otherwise(0)
    return fx.games(spark, sf).groupBy(dates.season_label(first_year).alias("season")).agg(F.count(F.lit(1)).alias("games"))


@query("team_dim")
def _(spark, sf):
    raw = fx.teams(spark, sf).select(
        F.col("teamName").alias("name"),
        F.struct(F.col("conferenceName").alias("name")).alias("conference"),
        F.struct(F.col("divisionName").alias("name")).alias("division"),
    )
    return league.team_dim(raw)


@query("resolve_venues")
def _(spark, sf):
    nation = fx.table(spark, sf, "nation")
    # Manual coordinates for every other nation's arena.
    manual = nation.where(F.col("n_nationkey") % 2 == 1).select(
        F.concat(F.lit("Arena "), F.col("n_name")).alias("venue"),
        F.col("n_nationkey").cast("double").alias("venue_lat"),
        (-F.col("n_nationkey")).cast("double").alias("venue_long"),
    )
    return league.resolve_venues(fx.games(spark, sf), fx.venues(spark, sf), manual)


@query("upsert_games")
def _(spark, sf):
    games = fx.games(spark, sf)
    # Stored up to a date; refetched from an earlier one, with new scores.
    stored = games.where(F.col("gameDate") < F.lit("2001-01-01").cast("date"))
    fresh = games.where(F.col("gameDate") >= F.lit("2000-06-01").cast("date")).withColumn(
        "homeTeamScore", F.col("homeTeamScore") + 1
    )
    return refresh.upsert_games(stored, fresh).select("gameId", "seasonName", "homeTeamScore")


def _correction(spark, sf):
    """The log, and the log with one more goal in one game of a finished season."""
    games = fx.games(spark, sf)
    one = games.where("seasonName = '19961997' AND homeTeamScore IS NOT NULL").agg(F.min("gameId")).scalar()
    return games, games.withColumn("homeTeamScore", F.when(F.col("gameId") == one, F.col("homeTeamScore") + 1).otherwise(F.col("homeTeamScore")))


@query("changed_seasons")
def _(spark, sf):
    """One corrected score makes its season due, and no other."""
    games, corrected = _correction(spark, sf)
    return refresh.changed_seasons(corrected, refresh.season_fingerprints(games))


@query("upsert_stored")
def _(spark, sf):
    """As `upsert_games`, on storage, twice; games without an id are told apart by day and teams."""
    path = _fresh_folder(spark, "store")
    # The day and the two teams tell one of these games from all others.
    games = fx.games(spark, sf).where("gameId % 3 <> 0")
    alone = Window.partitionBy("gameDate", "homeTeamName", "awayTeamName")
    games = games.withColumn("_same", F.count(F.lit(1)).over(alone)).where("_same = 1").drop("_same")
    games = games.withColumn("gameId", F.when(F.col("gameId") % 5 != 0, F.col("gameId")))
    fresh = games.where(F.col("gameDate") >= F.lit("2000-06-01").cast("date")).withColumn("homeTeamScore", F.col("homeTeamScore") + 1)
    store.upsert(spark, path, games.where(F.col("gameDate") < F.lit("2001-01-01").cast("date")))
    for _ in range(2):
        store.upsert(spark, path, fresh)
    return store.read(spark, path).select("gameId", "seasonName", "homeTeamName", "homeTeamScore")


@query("replace_tail")
def _(spark, sf):
    games = fx.timed_games(spark, sf)
    fresh = games.where(F.col("gameDate") >= F.lit("2001-04-30").cast("date")).withColumn(
        "homeTeamScore", F.col("homeTeamScore") + 1
    )
    return refresh.replace_tail(games, fresh, "2001-05-01").select("gameId", "seasonName", "homeTeamScore")


@query("missing_days")
def _(spark, sf):
    return refresh.missing_days(fx.games(spark, sf)).select("seasonName", text("missingDate"))


@query("seasons_to_refresh")
def _(spark, sf):
    games = fx.games(spark, sf).withColumn(
        "lastPeriod", F.when(F.col("gameDate") < F.lit("1999-01-01").cast("date"), F.lit("REG")).otherwise(F.col("lastPeriod"))
    )
    cached = games.where(F.substring("seasonName", 1, 4).cast("int") % 2 == 0).select("seasonName")
    return refresh.seasons_to_refresh(games, cached)


@query("mask_as_of")
def _(spark, sf):
    return refresh.mask_as_of(fx.timed_games(spark, sf), "1998-03-15").select(
        "gameId", "homeTeamScore", "awayTeamScore", "lastPeriod"
    )


@query("next_open_date")
def _(spark, sf):
    out = refresh.next_open_date(fx.games(spark, sf), ["seasonName"])
    return out.select("seasonName", text("nextOpenDate"), text("lastPlayedDate"))


@query("open_dates")
def _(spark, sf):
    return refresh.open_dates(fx.games(spark, sf)).select(text("gameDate"))


@query("staleness")
def _(spark, sf):
    out = refresh.staleness(fx.timed_games(spark, sf), "1998-06-01", ["seasonName"])
    return out.withColumn("firstUnplayed", text("firstUnplayed"))


@query("current_season")
def _(spark, sf):
    return refresh.current_season(fx.games(spark, sf)).select("gameId", "seasonName")


@query("week_bounds")
def _(spark, sf):
    out = refresh.week_bounds(fx.games(spark, sf), ["seasonName", "homeTeamName"])
    return out.select("seasonName", "homeTeamName", text("firstMonday"), text("lastMonday"))


@query("local_time")
def _(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", F.col("ts").alias("startTimeUTC"))
    return refresh.local_time(events).select("event_id", text("gameDate"), "gameTimeEST")


@query("local_time_games")
def _(spark, sf):
    """Seven years of starts, so both sides of daylight saving; fixed clock next to it."""
    games = fx.timed_games(spark, sf).select("gameId", "startTimeUTC")
    fixed = dates.wall_clock(games, "startTimeUTC", dates.FIXED_ZONE)
    out = refresh.local_time(games.withColumn("fixedMinute", dates.minute_of_day(fixed)))
    return out.select("gameId", text("gameDate"), "gameTimeEST", "fixedMinute")


@query("write_back")
def _(spark, sf):
    games = fx.games(spark, sf)
    # New scores for the unplayed games: the home one before the playoffs, the away one in them.
    regular = F.col("gameType") == 2
    updates = games.where(F.col("lastPeriod").isNull()).select(
        "gameId",
        F.when(regular, F.lit(10.0)).alias("homeTeamScore"),
        F.when(~regular, F.lit(20.0)).alias("awayTeamScore"),
    )
    return refresh.write_back(games, updates, ["homeTeamScore", "awayTeamScore"]).select(
        "gameId", "homeTeamScore", "awayTeamScore"
    )


@query("write_by_season")
def _(spark, sf):
    path = _fresh_folder(spark, "by-season")
    games = fx.games(spark, sf).select("gameId", "seasonName", "homeTeamName", "homeTeamScore")
    writers.write_by_season(games, path)
    return readers.read_table(spark, path, games.schema)


@query("write_snapshot")
def _(spark, sf):
    path = _fresh_folder(spark, "snapshots")
    games = fx.games(spark, sf).select("gameId", "homeTeamScore", "gameType")
    writers.write_snapshot(games, path, "2001-08-01", readers.PLAYOFF)
    writers.write_snapshot(games, path, "2001-08-02", readers.PLAYOFF)
    writers.write_snapshot(games.where("gameType = 2"), path, "2001-08-02", readers.REGULAR)
    stored = spark.read.parquet(path)
    return readers.read_snapshots(stored, "2001-08-01", "2001-08-03").select(
        "gameId", "homeTeamScore", text("predDate"), "kind"
    )


# --- model ----------------------------------------------------------------


@query("encode_columns")
def _(spark, sf):
    columns = ["homeTeamName", "venue", "lastPeriod"]
    out = model.encode_columns(fx.games(spark, sf), columns)
    return out.select("gameId", *[F.col(f"{c}Code").cast("int").alias(f"{c}Code") for c in columns])


@query("call_period")
def _(spark, sf):
    predicted = fx.games(spark, sf).withColumns(
        {
            "homeTeamScore_predicted": (F.col("gameId") % 50) / 10,
            "awayTeamScore_predicted": (F.col("gameId") * 7 % 50) / 10,
        }
    )
    return model.call_result(predicted).select("gameId", "homeTeamScore", "awayTeamScore", "lastPeriod")


def _features(spark, sf):
    # Training reads the features several times, so they are stored once.
    return stage(history.feature_set(fx.games(spark, sf), fx.venues(spark, sf)), "features")


# As many trees as the work this covers fits, grown to the end; all features at every split.
_TREES = {"n_trees": 100}


@query("bootstrap_weights")
def _(spark, sf):
    """How often each game is in the samples of the first trees."""
    trees = fx.games(spark, sf).select("gameId", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("tree"))
    return trees.select("gameId", "tree", forest.bootstrap_weight(F.col("gameId"), F.col("tree"), 42).cast("int").alias("weight"))


@query("train_scores")
def _(spark, sf):
    """Forecasts next to the scores of played games."""
    rows = forest.numbered(_features(spark, sf))
    out = forest.predict(forest.grow(rows, **_TREES), rows.where("_y IS NOT NULL"))
    return out.select("gameId", "homeTeamScore", "awayTeamScore", "homeTeamScore_predicted", "awayTeamScore_predicted")


@query("score_games")
def _(spark, sf):
    out = forest.score_games(_features(spark, sf), **_TREES)
    return out.select("gameId", "homeTeamScore", "awayTeamScore", "lastPeriod")


@query("holdout_metrics")
def _(spark, sf):
    return forest.holdout_metrics(_features(spark, sf), "20002001", **_TREES)


@query("oob_metrics")
def _(spark, sf):
    return forest.oob_metrics(_features(spark, sf), **_TREES)


@query("oob_metrics_mean")
def _(spark, sf):
    """Trees of no depth vote their sample's mean, which SQL can tell."""
    out = forest.oob_metrics(_features(spark, sf), n_trees=20, max_depth=0)
    return rounded(out, "mse", "r2", "accuracy")


@query("feature_importance")
def _(spark, sf):
    features = _features(spark, sf)
    return forest.feature_importance(forest.grow(forest.numbered(features), **_TREES), model.feature_columns(features))


@query("permutation_importance")
def _(spark, sf):
    """Of a day's number, the rest and the home team, one of each kind."""
    features = _features(spark, sf)
    rows = forest.numbered(features)
    columns = ["gameDate", "homeTeamDaysSinceLastGame", "homeTeamName"]
    return forest.permutation_importance(forest.grow(rows, n_trees=20), rows, model.feature_columns(features), columns)


# A forest of no depth predicts the mean, so the whole path has an exact answer.
_MEAN = {"n_trees": 1, "max_depth": 0, "bootstrap": False}


@query("train_scores_mean")
def _(spark, sf):
    features = _features(spark, sf)
    out = model.predict(model.train_scores(features, **_MEAN), features).select(
        "gameId", "homeTeamScore_predicted", "awayTeamScore_predicted"
    )
    return rounded(out, *out.columns[1:])


@query("score_games_mean")
def _(spark, sf):
    features = _features(spark, sf)
    out = model.score_games(features, model.train_scores(features, **_MEAN))
    return rounded(out.select("gameId", "homeTeamScore", "awayTeamScore", "lastPeriod"), "homeTeamScore", "awayTeamScore")


@query("holdout_metrics_mean")
def _(spark, sf):
    """The mean over two runs, which are alike."""
    out = model.holdout_metrics(_features(spark, sf), "20002001", runs=2, **_MEAN)
    return rounded(out, "mse", "r2", "accuracy")


# --- landed files ---------------------------------------------------------


def _landed(df: DataFrame, label: str, *columns: Column) -> str:
    """One JSON document per row, several rows to a file."""
    path = _fresh_folder(df.sparkSession, label)
    df.select(F.to_json(F.struct(*columns)).alias("value")).coalesce(2).write.text(path)
    return path


@query("read_teams")
def _(spark, sf):
    path = _landed(
        fx.teams(spark, sf),
        "teams-json",
        F.col("teamName").alias("name"),
        F.struct(F.col("conferenceName").alias("name")).alias("conference"),
        F.struct(F.col("divisionName").alias("name")).alias("division"),
    )
    return readers.read_teams(spark, path)


@query("read_venues")
def _(spark, sf):
    """A headed file whose columns stand in another order."""
    path = _fresh_folder(spark, "venues-csv")
    fx.venues(spark, sf).select("venue_long", "venue", "venue_lat").write.option("header", True).csv(path)
    return readers.read_venues(spark, path).select("venue", "venue_lat", "venue_long")


@query("read_odds")
def _(spark, sf):
    """The same for odds, some of which are no numbers."""
    path = _fresh_folder(spark, "odds-csv")
    odds = fx.odds(spark, sf)
    bad = F.when(F.col("gameId") % 7 == 0, F.lit("n/a")).otherwise(F.col("homeTeamOdds").cast("string"))
    odds.select("awayTeamOdds", bad.alias("homeTeamOdds"), "awayTeamName", "gameId", "homeTeamName").write.option("header", True).csv(path)
    return readers.read_odds(spark, path).select("gameId", "homeTeamOdds", "awayTeamOdds")
