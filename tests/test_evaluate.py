import math
from datetime import date

from helpers import game, log
from pyspark.sql import functions as F

from tallyboard.functions import scoring
from tallyboard.operators import evaluate, outcomes

SNAP = (
    "predDate date, gameId long, gameDate date, homeTeamName string, awayTeamName string, "
    "homeTeamScore double, awayTeamScore double"
)
ODDS = "gameId long, homeTeamName string, awayTeamName string, homeTeamOdds double, awayTeamOdds double"
DAY, NEXT = date(2025, 1, 1), date(2025, 1, 2)


def returns(spark, missing="loss"):
    actual = log(
        spark,
        game(1, "2025-01-01", "A", "B", 3, 1),
        game(2, "2025-01-01", "C", "D", 1, 2),
        game(3, "2025-01-02", "A", "C", 2, 1),
        game(4, "2025-01-02", "B", "D", 2, 1),
        game(5, "2025-01-02", "E", "F"),
    )
    predicted = spark.createDataFrame(
        [
            (DAY, 1, DAY, "A", "B", 2.5, 1.5),
            (DAY, 2, DAY, "C", "D", 1.0, 4.0),
            (DAY, 3, NEXT, "A", "C", 1.0, 4.0),
            (NEXT, 3, NEXT, "A", "C", 4.0, 1.0),
            (NEXT, 4, NEXT, "B", "D", 1.0, 4.0),
            (NEXT, 5, NEXT, "E", "F", 1.0, 4.0),
        ],
        SNAP,
    )
    odds = spark.createDataFrame([(1, "A", "B", 150.0, -170.0), (2, "C", "D", 110.0, -200.0)], ODDS)
    priced = evaluate.with_odds(evaluate.snapshot_accuracy(predicted, actual), odds)
    return priced, evaluate.game_returns(priced, missing)


def test_returns_per_game_and_day(spark):
    priced, games = returns(spark)
    rows = {r["gameId"]: r for r in games.collect()}
    assert [rows[i]["correctOutcome"] for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 0, 0]
    # Right with positive odds, with negative odds, without odds; wrong.
    assert [rows[i]["winnings"] for i in (1, 2, 3, 4)] == [1.5, 0.5, -1.0, -1.0]
    assert evaluate.missing_odds(priced).first()["missingOdds"] == 6
    days = {r["gameDate"]: r for r in evaluate.daily_returns(games).collect()}
    assert (days[DAY]["winnings"], days[DAY]["dayClass"]) == (2.0, "all_right")
    assert (days[NEXT]["runningReturn"], days[NEXT]["dayClass"]) == (-1.0, "mixed")
    skipped = {r["gameId"]: r["winnings"] for r in returns(spark, "skip")[1].collect()}
    assert skipped[3] is None and skipped[4] == -1.0


def test_half_open_period(spark):
    actual = log(spark, game(1, "2025-01-01", "A", "B", 3, 1), game(2, "2025-01-02", "A", "B", 3, 1))
    out = evaluate.compare_results(actual, actual, since="2025-01-01", until="2025-01-02")
    assert [r["gameId"] for r in out.collect()] == [1]


def test_ties_and_missing_scores(spark):
    df = spark.createDataFrame(
        [(2.0, 2.0, 1.0, 1.0), (2.0, 2.0, 1.0, 0.0), (None, 2.0, 0.0, 1.0), (3.0, 1.0, 0.2, 0.1)],
        "a double, b double, c double, d double",
    )
    hit = scoring.correct_outcome(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert [r[0] for r in df.select(hit).collect()] == [1, 0, 0, 1]


def test_metrics(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 1.0, 2.0), (3.0, 0.0, 2.0, 1.0), (2.0, 4.0, 3.0, 3.0), (None, 1.0, 1.0, 1.0)],
        "homeTeamScore_actual double, awayTeamScore_actual double, homeTeamScore_predicted double, awayTeamScore_predicted double",
    )
    row = evaluate.regression_metrics(df).first()
    assert row["games"] == 3 and row["accuracy"] == 2 / 3
    assert math.isclose(row["mse"], (2 / 3 + 2 / 3) / 2)
    assert math.isclose(row["r2"], ((1 - 2 / 2) + (1 - 2 / 8)) / 2)


def test_overall_row(spark):
    df = spark.createDataFrame([(DAY, 1), (DAY, 0), (NEXT, 1)], "gameDate date, correctOutcome int")
    rows = {r["gameDate"]: r for r in evaluate.daily_accuracy(df, overall=True).collect()}
    assert rows[DAY]["accuracy"] == 0.5 and rows[None]["correct"] == 2


def scenarios(spark):
    rows = [(i, t, s, r) for i in range(4) for t, s, r in (("A", "div_1", i), ("B", "wc_2", 0), ("C", "missed", 0))]
    return spark.createDataFrame(rows, "iteration long, teamName string, playoffSeed string, roundsWon long")


def test_outcome_percentages(spark):
    teams = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "teamName string")
    rows = {r["teamName"]: r for r in outcomes.outcome_probabilities(scenarios(spark), teams).collect()}
    a = rows["A"]
    assert (a["div_1"], a["div_1_%"], a["playoff_%"]) == (4, 100.0, 100.0)
    assert (a["make_round_2_%"], a["make_round_3_%"], a["make_cup_final_%"], a["win_cup_%"]) == (75.0, 50.0, 25.0, 0.0)
    assert rows["C"]["missed_%"] == 100.0 and rows["C"]["playoff_%"] == 0.0
    # A team in no scenario at all has never missed the playoffs either.
    assert rows["D"]["div_1"] == 0 and rows["D"]["playoff_%"] == 100.0
    for name in ("A", "B", "C"):
        assert sum(rows[name][f"{s}_%"] for s in outcomes.SEEDS) == 100.0
    report = outcomes.probability_report(outcomes.outcome_probabilities(scenarios(spark))).collect()
    assert [r["teamName"] for r in report] == ["A", "B", "C"]
    alive = outcomes.alive_teams(outcomes.outcome_probabilities(scenarios(spark)), 2).collect()
    assert [r["teamName"] for r in alive] == ["A"]


def test_rings_close(spark):
    rings = outcomes.ring_shares(outcomes.outcome_probabilities(scenarios(spark)))
    full = {r["ring"]: r for r in rings.groupBy("ring").agg(F.sum("share").alias("s"), F.max("endAngle").alias("e")).collect()}
    assert math.isclose(full["playoff_%"]["s"], 1.0) and math.isclose(full["playoff_%"]["e"], 360.0)
    # Nobody won the cup: the ring has no shares.
    assert full["win_cup_%"]["s"] is None
