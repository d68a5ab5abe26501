from datetime import date

import pytest
from helpers import game, log
from pyspark.sql import functions as F

from tallyboard.operators import bracket, outcomes, refresh, standings
from tallyboard.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
PAIR = (
    "seasonName string, round int, slot int, conferenceName string, divisionName string, team1 string, "
    "team2 string, team1ConferenceSeed int, team2ConferenceSeed int"
)
SEASON = "20242025"


def series(*winners, first=1, start=1):
    """Games between A and B, hosts 1,1,2,2,1,2,1, won in turn by `winners`."""
    hosts = "AABBABA"
    rows = []
    for i, winner in enumerate(winners):
        home, away = hosts[i], "B" if hosts[i] == "A" else "A"
        day = f"2025-04-{start + 2 * i:02d}"
        scores = (None, None) if winner is None else ((3, 1) if winner == home else (1, 3))
        rows.append(game(first + i, day, home, away, *scores, kind=3))
    return rows


def state(spark, *winners, wins=4):
    return bracket.series_state(log(spark, *series(*winners)), wins).first()


def test_sweep(spark):
    row = state(spark, "A", "A", "A", "A")
    assert (row["decided"], row["winner"], row["loserWins"], row["scoreText"]) == (True, "A", 0, "4-0")


def test_seven_games(spark):
    row = state(spark, "A", "B", "A", "B", "A", "B", "B")
    assert (row["winner"], row["loser"], row["scoreText"]) == ("B", "A", "4-3")


def test_running_series_and_unplayed_games(spark):
    row = state(spark, "A", "B", "A", None, None)
    assert (row["decided"], row["winner"], row["lowWins"], row["highWins"]) == (False, None, 2, 1)
    assert row["lastGameId"] == 3


def test_later_games_of_a_decided_series_go(spark):
    games = log(spark, *series("A", "A", "A", "A", None, None), game(50, "2025-04-30", "A", "C", kind=3))
    kept = bracket.prune_decided(games, bracket.series_state(games))
    assert sorted(r["gameId"] for r in kept.collect()) == [1, 2, 3, 4, 50]


def pairs(spark, *rows):
    return spark.createDataFrame(
        [(SEASON, rnd, slot, conf, div, a, b, sa, sb) for rnd, slot, conf, div, a, b, sa, sb in rows], PAIR
    )


FIRST = [
    (1, 0, "Eastern", "North", "E1", "E8", 1, 8),
    (1, 1, "Eastern", "North", "E4", "E5", 4, 5),
    (1, 2, "Eastern", "South", "E2", "E7", 2, 7),
    (1, 3, "Eastern", "South", "E3", "E6", 3, 6),
    (1, 4, "Western", "East", "W1", "W8", 1, 8),
    (1, 5, "Western", "East", "W4", "W5", 4, 5),
    (1, 6, "Western", "West", "W2", "W7", 2, 7),
    (1, 7, "Western", "West", "W3", "W6", 3, 6),
]


def test_winners_meet_by_division_then_conference_then_league(spark):
    results = pairs(spark, *FIRST).withColumn("winner", F.col("team2"))
    second = bracket.next_round(results, 2).orderBy("slot")
    assert [(r["slot"], r["team1"], r["team2"], r["team1ConferenceSeed"]) for r in second.collect()] == [
        (0, "E8", "E5", 8), (1, "E7", "E6", 7), (2, "W8", "W5", 8), (3, "W7", "W6", 7)
    ]
    third = bracket.next_round(second.withColumn("winner", F.col("team1")), 3).orderBy("slot")
    assert [(r["team1"], r["team2"], r["conferenceName"]) for r in third.collect()] == [
        ("E8", "E7", "Eastern"), ("W8", "W7", "Western")
    ]
    final = bracket.next_round(third.withColumn("winner", F.col("team2")), 4).collect()
    assert [(r["team1"], r["team2"], r["slot"]) for r in final] == [("E7", "W7", 0)]
    with pytest.raises(ValueError):
        bracket.next_round(results, 5)


def test_first_round_pairs_all_seeds_once(spark):
    table = standings.standings(fx.games(spark, SF), fx.teams(spark, SF))
    first = bracket.first_round(table)
    teams = first.select("seasonName", F.explode(F.array("team1", "team2")).alias("teamName"))
    seeded = table.where("playoffSeed <> 'missed'").select("seasonName", "teamName")
    assert teams.exceptAll(seeded).count() == 0 and seeded.exceptAll(teams).count() == 0
    assert first.where("team1ConferenceSeed > team2ConferenceSeed AND team2Seed LIKE 'WC%'").count() == 0


def calendar(spark, rows, **options):
    games = log(spark, game(1, "2025-04-10", "E1", "W1", 3, 1))
    homes = spark.createDataFrame(
        [(SEASON, t, f"{t} Hall", "Zone") for t in ("E1", "E8", "W1", "W8")],
        "seasonName string, teamName string, venue string, venueTimezone string",
    )
    starts = spark.createDataFrame([(SEASON, "E1 Hall", 1140)], "seasonName string, venue string, usualStart int")
    out = bracket.series_schedule(pairs(spark, *rows), games, homes, starts, **options)
    return out.orderBy("slot", "gameNumber").collect()


def test_calendar_of_a_round(spark):
    rows = calendar(spark, [FIRST[0], FIRST[4]])
    east = [r for r in rows if r["slot"] == 0]
    west = [r for r in rows if r["slot"] == 4]
    assert [r["homeTeamName"] for r in east] == ["E1", "E1", "E8", "E8", "E1", "E8", "E1"]
    assert [(r["gameDate"] - date(2025, 4, 12)).days for r in east] == [0, 2, 5, 7, 10, 12, 15]
    assert west[0]["gameDate"] == date(2025, 4, 13)
    assert east[0]["gameTimeEST"] == 1140 and east[2]["gameTimeEST"] is None
    assert east[0]["venue"] == "E1 Hall" and east[0]["gameId"] is None


def test_final_has_its_own_offsets(spark):
    rows = calendar(spark, [(4, 0, "Western", "East", "W1", "E1", 1, 1)])
    assert [(r["gameDate"] - date(2025, 4, 12)).days for r in rows] == [0, 3, 6, 9, 12, 15, 18]


def test_scheduled_games_are_left_out(spark):
    already = log(spark, game(2, "2025-04-15", "E1", "E8", kind=3), game(3, "2025-04-17", "E1", "E8", kind=3))
    rows = calendar(spark, [FIRST[0]], already=already)
    assert [r["gameNumber"] for r in rows] == [3, 4, 5, 6, 7]
    assert rows[0]["gameDate"] == date(2025, 4, 20)


def test_scheduled_games_at_both_venues_count(spark):
    """Games 3 and 4 are at the other side's; none of the four comes out again."""
    games = [("2025-04-15", "E1", "E8"), ("2025-04-17", "E1", "E8"), ("2025-04-19", "E8", "E1"), ("2025-04-21", "E8", "E1")]
    already = log(spark, *[game(2 + i, *g, kind=3) for i, g in enumerate(games)])
    rows = calendar(spark, [FIRST[0]], already=already)
    assert [r["gameNumber"] for r in rows] == [5, 6, 7]
    assert [r["gameNumber"] for r in calendar(spark, [FIRST[0]], already=already, counted="first_host")][0] == 3


def test_better_seed_can_host_first(spark):
    worse_first = (1, 0, "Eastern", "North", "E8", "E1", 8, 1)
    assert calendar(spark, [worse_first], home_ice="by_seed")[0]["homeTeamName"] == "E1"
    assert calendar(spark, [worse_first])[0]["homeTeamName"] == "E8"


def test_rounds_from_pair_counts(spark):
    def playoffs(n):
        return log(spark, *[game(i, "2025-04-01", f"H{i}", f"A{i}", kind=3, minute=i) for i in range(n)])

    def rounds(n):
        row = bracket.rounds_scheduled(playoffs(n)).first()
        return row["roundsScheduled"], row["partialRound"]

    assert [rounds(n) for n in (5, 16, 18, 24, 28, 30)] == [
        (0, True), (1, False), (1, True), (2, False), (3, False), (4, False)
    ]
    begun = bracket.partial_round_games(playoffs(18))
    assert sorted(r["gameId"] for r in begun.collect()) == [16, 17]


def test_round_is_complete_only_when_all_series_are(spark):
    games = log(spark, *series("A", "A", "A", "A"))
    rows = pairs(spark, (1, 0, "Eastern", "North", "A", "B", 1, 8), (1, 1, "Eastern", "North", "C", "D", 4, 5))
    results = bracket.bracket_results(rows, bracket.series_state(games))
    row = bracket.rounds_completed(results).first()
    assert (row["series"], row["decidedSeries"], row["complete"]) == (2, 1, False)


def test_usual_start_takes_the_earlier_of_equals_and_needs_enough_games(spark):
    rows = [game(i, "2025-01-01", "A", "B", 1, 0, minute=1140 if i % 2 else 1080) for i in range(12)]
    rows += [game(100 + i, "2025-01-01", "C", "B", 1, 0) for i in range(5)]
    out = bracket.usual_start(log(spark, *rows)).collect()
    assert [(r["venue"], r["usualStart"]) for r in out] == [("A Hall", 1080)]


def test_pruned_log_still_upserts(spark):
    games = log(spark, *series("A", "A", "A", "A", None))
    fresh = log(spark, game(5, "2025-04-20", "A", "B", 1, 2, kind=3))
    assert refresh.upsert_games(games, fresh).where("gameId = 5").first()["awayTeamScore"] == 2.0


def test_many_scenarios_in_one_job(spark):
    """Standings, pairs, series and outcomes per scenario equal a loop over scenarios."""
    games = fx.games(spark, SF).withColumn("iteration", F.col("gameId") % 2)
    teams = fx.teams(spark, SF)

    def run(log, scenario):
        table = standings.standings(log, teams, scenario)
        state = bracket.series_state(log, 1, scenario)
        first = bracket.bracket_results(bracket.first_round(table, scenario), state, scenario)
        settled = first.withColumn("winner", F.coalesce("winner", "team1"))
        second = bracket.next_round(settled, 2, scenario)
        return outcomes.scenario_outcomes(table, first, scenario), second

    together = run(games, "iteration")
    for i in (0, 1):
        alone = run(games.where(F.col("iteration") == i), None)
        for many, one in zip(together, alone):
            part = many.where(F.col("iteration") == i).select(one.columns)
            assert part.count() == one.count() > 0 and part.exceptAll(one).count() == 0
