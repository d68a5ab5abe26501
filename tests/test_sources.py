import json
from datetime import date, datetime

from helpers import game, log
import pytest
from pyspark.sql import functions as F

from tallyboard.functions import dates
from tallyboard.operators import refresh
from tallyboard.schemas import GAME_LOG
from tallyboard.session import shared_dir, stage
from tallyboard.sources import league, readers, writers


def raw_game(gid, kind=2, outcome="REG", start="2025-03-15T23:00:00Z"):
    side = {"placeName": {"default": "North"}, "commonName": {"default": "Stars"}, "score": 2}
    out = {
        "id": gid, "season": 20242025, "gameType": kind, "startTimeUTC": start, "venueTimezone": "US/Eastern",
        "venue": {"default": "Hall"}, "awayTeam": side,
        "homeTeam": {**side, "placeName": {"default": "South"}, "score": 3},
    }
    if outcome:
        out["gameOutcome"] = {"lastPeriodType": outcome}
    return out


def test_landed_schedule(spark, tmp_path):
    week = {"gameWeek": [
        {"date": "2025-03-15", "games": [raw_game(1), raw_game(2, kind=1), raw_game(3, kind=4)]},
        {"date": "2025-03-16", "games": []},
        {"date": "2025-03-17", "games": [raw_game(4, kind=3, outcome=None)]},
    ]}
    (tmp_path / "week.json").write_text(json.dumps(week))
    rows = {r["gameId"]: r for r in readers.read_schedule(spark, str(tmp_path)).collect()}
    assert set(rows) == {1, 4}
    assert (rows[1]["homeTeamName"], rows[1]["awayTeamName"]) == ("South Stars", "North Stars")
    assert (rows[1]["homeTeamScore"], rows[1]["lastPeriod"], rows[1]["seasonName"]) == (3.0, "REG", "20242025")
    assert rows[4]["homeTeamScore"] is None and rows[4]["lastPeriod"] is None


def test_landed_standings_and_teams(spark, tmp_path):
    def team(name, wild, div):
        return {"teamName": {"default": name}, "conferenceName": "Eastern", "divisionName": "North",
                "points": 90, "wildcardSequence": wild, "divisionSequence": div}

    (tmp_path / "s").mkdir()
    table = {"standings": [team("A", 0, 2), team("B", 2, 5), team("C", 3, 6)]}
    (tmp_path / "s" / "standings.json").write_text(json.dumps(table))
    rows = {r["teamName"]: r for r in readers.read_standings(spark, str(tmp_path / "s")).collect()}
    assert [rows[t]["playoffSeed"] for t in "ABC"] == ["div_2", "wc_2", "missed"]
    assert rows["A"]["totalPoints"] == 90.0
    (tmp_path / "t").mkdir()
    teams = [{"name": "A", "conference": {"name": "Eastern"}, "division": {"name": "North"}}]
    (tmp_path / "t" / "teams.json").write_text(json.dumps(teams))
    assert readers.read_teams(spark, str(tmp_path / "t")).first().asDict() == {
        "teamName": "A", "conferenceName": "Eastern", "divisionName": "North"
    }


def test_typed_csv(spark, tmp_path):
    folder = tmp_path / "seasonName=20242025"
    folder.mkdir()
    columns = [c for c in GAME_LOG.fieldNames() if c != "seasonName"]
    first = "1,2,2025-03-15T23:00:00Z,US/Eastern,Hall,B,A,1,3,REG"
    (folder / "games.csv").write_text(",".join(columns) + "\n" + first + "\n2,2,,,,B,A,,bad,\n")
    rows = {r["gameId"]: r for r in readers.read_games(spark, str(tmp_path), "csv").collect()}
    assert rows[1]["seasonName"] == "20242025" and rows[1]["homeTeamScore"] == 3.0
    assert rows[2]["homeTeamScore"] is None and rows[2]["lastPeriod"] is None


def test_odds_columns_are_found_by_name(spark, tmp_path):
    text = "note,awayTeamOdds,homeTeamOdds,awayTeamName,homeTeamName,gameId\nx,-120,110,B,A,7\ny,,oops,B,A,8\n"
    (tmp_path / "odds.csv").write_text(text)
    rows = {r["gameId"]: r for r in readers.read_odds(spark, str(tmp_path / "odds.csv")).collect()}
    assert (rows[7]["homeTeamOdds"], rows[7]["awayTeamOdds"]) == (110.0, -120.0)
    assert rows[8]["homeTeamOdds"] is None


def test_snapshots_fall_back_to_the_playoff_run(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    games = log(spark, game(1, "2025-04-01", "A", "B", 1, 0)).select("gameId", "gameDate")
    for day, kind in (("2025-04-01", "playoff"), ("2025-04-01", "regularseason"), ("2025-04-02", "playoff"), ("2025-04-03", "playoff")):
        writers.write_snapshot(games, path, day, kind)
    writers.write_snapshot(games.withColumn("gameId", F.lit(9).cast("long")), path, "2025-04-02", "playoff")
    rows = readers.read_snapshots(spark.read.parquet(path), "2025-04-01", "2025-04-03").collect()
    assert sorted((r["predDate"].isoformat(), r["kind"], r["gameId"]) for r in rows) == [
        ("2025-04-01", "regularseason", 1), ("2025-04-02", "playoff", 9)
    ]


def test_only_written_seasons_are_replaced(spark, tmp_path):
    path = str(tmp_path / "log")
    old = log(spark, game(1, "2024-01-01", "A", "B", 1, 0, season="20232024"), game(2, "2025-01-01", "A", "B", 1, 0))
    writers.write_by_season(old, path)
    writers.write_by_season(log(spark, game(3, "2025-01-02", "A", "B", 1, 0)), path)
    assert sorted(r["gameId"] for r in spark.read.parquet(path).collect()) == [1, 3]


def test_largest_run_wins(spark):
    runs = spark.createDataFrame([(date(2025, 1, 1), 100, "a"), (date(2025, 1, 1), 500, "b")], "predDate date, n int, t string")
    assert [r["t"] for r in readers.latest_run(runs).collect()] == ["b"]


def test_venue_overrides(spark):
    games = log(spark, *[game(i, "2025-01-01", "A", "B", 1, 0, venue=v) for i, v in enumerate(("Known", "Amalie Arena", "Lost"))])
    known = spark.createDataFrame([("Known", 1.0, 2.0)], "venue string, venue_lat double, venue_long double")
    rows = {r["venue"]: r for r in league.resolve_venues(games, known).collect()}
    assert rows["Known"]["venue_lat"] == 1.0 and rows["Amalie Arena"]["venue_lat"] == 27.9439
    assert rows["Lost"]["venue_lat"] is None


STARTS = [(1, "2026-03-07T23:30:00Z"), (2, "2026-03-08T23:30:00Z"), (3, "2026-07-01T02:30:00Z")]


def test_local_time_over_the_change_of_clocks(spark):
    text = spark.createDataFrame(STARTS, "gameId long, startTimeUTC string")
    kinds = {
        "string": text,
        "zoned": text.withColumn("startTimeUTC", F.to_timestamp("startTimeUTC")),
        "plain": text.withColumn("startTimeUTC", F.substring("startTimeUTC", 1, 19).cast("timestamp_ntz")),
    }
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            for df in kinds.values():
                rows = {r["gameId"]: r for r in refresh.local_time(df).collect()}
                assert [rows[i]["gameTimeEST"] for i in (1, 2, 3)] == [1110, 1170, 1350]
                assert rows[3]["gameDate"] == date(2026, 6, 30)
                fixed = {r["gameId"]: r for r in refresh.fixed_time(df).collect()}
                assert fixed[2]["startTimeEST"] == datetime(2026, 3, 8, 18, 30)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def timed(spark):
    games = log(
        spark,
        game(1, "2025-03-01", "A", "B", 1, 0), game(2, "2025-03-02", "A", "B", 2, 0),
        game(3, "2025-03-03", "A", "B"), game(4, "2025-03-04", "A", "B", kind=3),
    )
    start = F.concat(F.date_add("gameDate", 1).cast("string"), F.lit("T04:59:00Z"))
    return games.withColumn("startTimeUTC", start)


def test_mask_begins_at_fixed_midnight(spark):
    rows = {r["gameId"]: r for r in refresh.mask_as_of(timed(spark), "2025-03-02").collect()}
    assert rows[1]["homeTeamScore"] == 1.0 and rows[2]["homeTeamScore"] is None and rows[2]["lastPeriod"] is None


def test_dates_of_a_run(spark):
    row = refresh.next_open_date(timed(spark)).first()
    assert (row["nextOpenDate"], row["lastPlayedDate"]) == (date(2025, 3, 3), date(2025, 3, 2))
    stale = refresh.staleness(timed(spark), "2025-03-05").first()
    assert (stale["firstUnplayed"], stale["stale"], stale["daysBehind"]) == (date(2025, 3, 3), True, 2)
    assert not refresh.staleness(timed(spark), "2025-03-03").first()["stale"]
    week = refresh.week_bounds(timed(spark)).first()
    assert (week["firstMonday"], week["lastMonday"]) == (date(2025, 2, 24), date(2025, 3, 10))


def test_monday_bounds_of_a_monday(spark):
    row = spark.range(1).select(
        dates.monday_on_or_before(F.lit("2025-03-03").cast("date")).alias("a"),
        dates.next_monday(F.lit("2025-03-03").cast("date")).alias("b"),
        dates.season_label(F.lit(2025)).alias("s"),
    ).first()
    assert (row["a"], row["b"], row["s"]) == (date(2025, 3, 3), date(2025, 3, 10), "20252026")


def test_tail_is_replaced_from_yesterday_on(spark):
    fresh = timed(spark).where("gameId >= 3").withColumn("homeTeamScore", F.lit(5.0))
    out = refresh.replace_tail(timed(spark), fresh, "2025-03-04")
    assert {r["gameId"]: r["homeTeamScore"] for r in out.collect()} == {1: 1.0, 2: 2.0, 3: 5.0, 4: 5.0}


def test_season_cache(spark):
    games = log(
        spark,
        game(1, "2022-01-01", "A", "B", 1, 0, season="20212022"), game(2, "2023-01-01", "A", "B", 1, 0, season="20222023"),
        game(3, "2024-01-01", "A", "B", season="20232024"), game(4, "2025-01-01", "A", "B", 1, 0),
    )
    cached = spark.createDataFrame([("20212022",), ("20232024",), ("20242025",)], "seasonName string")
    out = refresh.seasons_to_refresh(games, cached)
    assert sorted(r["seasonName"] for r in out.collect()) == ["20222023", "20232024", "20242025"]


def test_missing_days(spark):
    out = refresh.missing_days(timed(spark), "12-31", "01-03").collect()
    assert sorted(r["missingDate"].isoformat() for r in out) == ["2024-12-31", "2025-01-01", "2025-01-02", "2025-01-03"]


def test_staged_tables_go_to_the_shared_folder(spark):
    staged = stage(spark.range(5), "probe")
    assert staged.count() == 5
    assert all(shared_dir(spark) in f for f in staged.inputFiles())


def test_every_line_of_landed_files_is_read(spark, tmp_path):
    team = '{"name": "T%d", "conference": {"name": "C"}, "division": {"name": "D"}}'
    (tmp_path / "teams.json").write_text("\n".join(team % i for i in range(5)))
    assert readers.read_teams(spark, str(tmp_path)).count() == 5


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "venues.csv").write_text("venue_lat,venue_long,venue\n10.5,20.5,Hall\nbad,1,Rink\n")
    rows = {r.venue: (r.venue_lat, r.venue_long) for r in readers.read_venues(spark, str(tmp_path)).collect()}
    assert rows == {"Hall": (10.5, 20.5), "Rink": (None, 1.0)}


def test_write_back_of_games_without_id(spark):
    base = spark.createDataFrame([(1, "a", 0.0), (None, "b", None), (None, "c", None)], "gameId int, homeTeamName string, homeTeamScore double")
    updates = spark.createDataFrame([(None, "b", 3.0), (None, "b", 2.0), (1, "a", 1.0)], base.schema)
    out = refresh.write_back(base, updates, ["homeTeamScore"], ["gameId", "homeTeamName"])
    assert {tuple(r) for r in out.collect()} == {(1, "a", 1.0), (None, "b", 3.0), (None, "c", None)} and out.count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        master, applicationId = "spark://host:7077", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Cluster(), {}

    with pytest.raises(RuntimeError):
        shared_dir(Session())
