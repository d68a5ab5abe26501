from helpers import game, log
from pyspark.sql import functions as F

from tallyboard.operators import standings
from tallyboard.plans import fixtures as fx
from tallyboard.sources.league import league_teams

TEAMS = "teamName string, conferenceName string, divisionName string"
SF = "/root/testdata/sf0.001"


def teams(spark, *names):
    return spark.createDataFrame([(n, "Eastern", "North") for n in names], TEAMS)


def by_team(df):
    return {r["teamName"]: r for r in df.collect()}


def test_points_of_each_result(spark):
    games = log(
        spark,
        game(1, "2024-10-01", "A", "B", 3, 1),
        game(2, "2024-10-02", "A", "B", 1, 2, "OT"),
        game(3, "2024-10-03", "A", "B", 1, 2, "SO"),
        game(4, "2024-10-04", "A", "B", 2, 2, "OT"),
        game(5, "2024-10-05", "A", "B", 2, 2),
        game(6, "2024-10-06", "A", "B"),
    )

    def points(mode):
        rows = standings.game_points(games, mode).orderBy("gameId").collect()
        return [(r["homeTeamPoints"], r["awayTeamPoints"]) for r in rows]

    assert points("zero") == [(2, 0), (1, 2), (1, 2), (1, 1), (0, 0), (0, 0)]
    assert points("reference")[-1] == (1, 1)
    table = by_team(standings.standings(games, teams(spark, "A", "B")))
    a = table["A"]
    # A shootout loss is neither a loss nor an OT loss here.
    assert (a["totalGames"], a["totalWins"], a["totalLosses"], a["totalOTLs"], a["totalPoints"]) == (5, 1, 0, 1, 5)
    assert (table["B"]["totalRegWins"], table["B"]["totalRegOTWins"], table["B"]["totalWins"]) == (0, 1, 2)


def test_team_without_games_gets_zeros_and_outsiders_drop_out(spark):
    games = log(spark, game(1, "2024-10-01", "A", "X", 3, 1))
    table = by_team(standings.standings(games, teams(spark, "A", "B")))
    assert set(table) == {"A", "B"}
    assert table["B"]["totalGames"] == 0 and table["B"]["pointsPercentage"] is None
    assert table["A"]["totalGoalsFor"] == 3.0


def test_all_level_goes_by_name(spark):
    names = [f"T{i}" for i in range(9)]
    games = log(spark, game(1, "2024-10-01", "Y", "Z", 3, 1))
    table = by_team(standings.standings(games, teams(spark, *names)))
    assert [table[n]["divisionSeed"] for n in names] == list(range(1, 10))
    assert [table[n]["playoffSeed"] for n in names] == ["div_1", "div_2", "div_3", "wc_1", "wc_2"] + ["missed"] * 4


def test_playoff_games_do_not_count(spark):
    games = log(spark, game(1, "2024-10-01", "A", "B", 3, 1), game(2, "2025-04-01", "A", "B", 3, 1, kind=3))
    assert by_team(standings.standings(games, teams(spark, "A", "B")))["A"]["totalGames"] == 1


def test_results_add_up(spark):
    games, league = fx.games(spark, SF), fx.teams(spark, SF)
    totals = standings.team_totals(games, league, count_shootout=True)
    decided = totals.where("totalGames < totalWins + totalLosses + totalOTLs").count()
    assert decided == 0
    seeded = standings.standings(games, league).where("playoffSeed <> 'missed'")
    assert {r["count"] for r in seeded.groupBy("seasonName", "conferenceName").count().collect()} == {8}


def test_split_adds_up_to_the_total(spark):
    split = standings.home_away_split(fx.games(spark, SF), fx.teams(spark, SF))
    for label in ("Games", "Points", "Wins", "GoalsFor"):
        apart = F.col(f"totalHome{label}") + F.col(f"totalAway{label}")
        assert split.where(apart != F.col(f"total{label}")).count() == 0


def test_scenarios_equal_a_loop(spark):
    games = fx.games(spark, SF).withColumn("iteration", F.col("gameId") % 3)
    league = fx.teams(spark, SF)
    together = standings.standings(games, league, "iteration")
    for i in range(3):
        alone = standings.standings(games.where(F.col("iteration") == i), league)
        assert together.where(F.col("iteration") == i).drop("iteration").exceptAll(alone).count() == 0


def test_wildcard_view_puts_missing_points_last(spark):
    rows = [
        ("s", "Eastern", "North", "A", "missed", None),
        ("s", "Eastern", "North", "B", "missed", 3),
        ("s", "Eastern", "South", "C", "div_1", 1),
        ("s", "Eastern", "North", "D", "div_1", 2),
        ("s", "Eastern", "North", "E", "wc_1", 9),
        ("s", "Eastern", "North", "F", None, 8),
    ]
    table = spark.createDataFrame(
        rows,
        "seasonName string, conferenceName string, divisionName string, teamName string, playoffSeed string, totalPoints int",
    )
    view = by_team(standings.wildcard_table(table))
    assert sorted(view, key=lambda t: view[t]["viewRank"]) == ["D", "C", "E", "F", "B", "A"]


def test_ordered_output(spark):
    table = standings.standings(fx.games(spark, SF), fx.teams(spark, SF))
    rows = [r for r in standings.standings_order(table).collect() if r["seasonName"] == "19951996"]
    points = [r["totalPoints"] for r in rows]
    assert points == sorted(points, reverse=True)


def test_default_league(spark):
    counts = league_teams(spark).groupBy("conferenceName", "divisionName").count().collect()
    assert {r["count"] for r in counts} == {8} and len(counts) == 4
