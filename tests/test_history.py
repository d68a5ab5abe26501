import math
import random
from datetime import date, timedelta

import pytest
from helpers import by_id, game, log
from pyspark.sql import functions as F

from tallyboard.functions.geo import haversine_km
from tallyboard.operators import history, timeline

VENUES = "venue string, venue_lat double, venue_long double"


def random_log(spark, n=400, teams=6, days=40, seed=7, unique_days=False):
    """Crowded days, ties, unplayed games, overtime; or at most one game a day per team."""
    rng = random.Random(seed)
    names = [f"T{i}" for i in range(teams)]
    rows, used = [], set()
    for gid in range(n):
        home, away = rng.sample(names, 2)
        day = date(2024, 10, 1) + timedelta(days=rng.randrange(days))
        if unique_days:
            if (home, day) in used or (away, day) in used:
                continue
            used |= {(home, day), (away, day)}
        scores = (rng.randrange(5), rng.randrange(5)) if rng.random() > 0.1 else (None, None)
        rows.append(
            game(gid, day.isoformat(), home, away, *scores, period=rng.choice(["REG", "REG", "OT", "SO"]),
                 kind=rng.choice([2, 2, 3]), venue=f"V{rng.randrange(5)}")
        )
    return log(spark, *rows), rows


def places(spark):
    known = [(f"V{i}", 10.0 * i, -20.0 * i) for i in range(4)]
    return spark.createDataFrame([*known, ("V4", None, 3.0)], VENUES)


def km(a, b):
    lat1, long1, lat2, long2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((long2 - long1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def earlier_games(rows, row, team):
    """The team's games on earlier days of the season, in order."""
    mine = [r for r in rows if r[1] == row[1] and team in (r[6], r[7]) and r[3] < row[3]]
    return sorted(mine, key=lambda r: (r[3], r[0]))


def brute(rows, coordinates):
    """Features of every game by scanning the log for each one."""
    out = {}
    for row in rows:
        feats = {}
        for side, team in (("home", row[6]), ("away", row[7])):
            past = earlier_games(rows, row, team)

            def result(r):
                own, other = (r[8], r[9]) if r[6] == team else (r[9], r[8])
                if own is None or own == other:
                    return None
                return "W" if own > other else ("L" if r[10] == "REG" else "O")

            for n, label in ((110, "PointsPercentage"), (3, "PrevPointsPercentage_3"), (7, "PrevPointsPercentage_7")):
                res = [result(r) for r in past[-n:]]
                w, l, o = (res.count(x) for x in "WLO")
                feats[f"{side}Team{label}"] = (2 * w + o) / (2 * (w + l + o)) if w + l + o else None
            scored, conceded = (8, 9) if side == "home" else (9, 8)
            for n in (3, 7):
                feats[f"{side}TeamPrevGoalsFor_{n}"] = sum(r[scored] or 0.0 for r in past[-n:])
                feats[f"{side}TeamPrevGoalsAgainst_{n}"] = sum(r[conceded] or 0.0 for r in past[-n:])
            mine = [r for r in rows if r[1] == row[1] and team in (r[6], r[7])]
            mine.sort(key=lambda r: (r[3], r[0]))
            at = mine.index(row)
            feats[f"{side}TeamDaysSinceLastGame"] = (row[3] - mine[at - 1][3]).days if at else None
            here = coordinates.get(row[5])
            legs = [km(here, coordinates[r[5]]) for r in past[-7:] if here and r[5] in coordinates]
            feats[f"{side}TeamTravelDistance7Days"] = sum(legs) / len(legs) if legs else None
            pair = {row[6], row[7]}
            wins = [r for r in rows if r[2] == 3 and r[1] == row[1] and {r[6], r[7]} == pair and r[3] < row[3]
                    and r[8] is not None and r[8] != r[9] and (r[6] if r[8] > r[9] else r[7]) == team]
            feats[f"{side}TeamSeriesScore"] = len(wins) if row[2] == 3 else None
        out[row[0]] = feats
    return out


def same(got, want):
    if want is None or got is None:
        return got is None and want is None
    return math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("unique_days", [False, True])
def test_feature_set_equals_a_scan_per_game(spark, unique_days):
    games, rows = random_log(spark, unique_days=unique_days)
    coordinates = {f"V{i}": (10.0 * i, -20.0 * i) for i in range(4)}
    want = brute(rows, coordinates)
    got = by_id(history.feature_set(games, places(spark)))
    assert len(got) == len(rows)
    for gid, feats in want.items():
        for name, value in feats.items():
            assert same(got[gid][name], value), (gid, name, got[gid][name], value)


def test_one_hot_team_and_day(spark):
    """A single team-day far above the window length: only its last games may count."""
    rows = [game(i, "2024-10-01", "A", f"B{i % 9}", 2, 1) for i in range(500)]
    rows += [game(1000, "2024-10-01", "A", "B0", 0, 4), game(1001, "2024-10-02", "A", "B1", 1, 1)]
    out = by_id(history.prior_results(log(spark, *rows), 3))[1001]
    assert (out["homeTeamPrevWins_3"], out["homeTeamPrevLosses_3"]) == (2, 1)
    season = by_id(history.prior_results(log(spark, *rows), None))[1001]
    assert (season["homeTeamPrevWins_toDate"], season["homeTeamPrevLosses_toDate"]) == (500, 1)
    capped = by_id(history.prior_results(log(spark, *rows)))[1001]
    assert (capped["homeTeamPrevWins_110"], capped["homeTeamPrevLosses_110"]) == (109, 1)


def test_crowded_days_with_scattered_ids(spark):
    """Of crowded days exactly the last games count, however ids lie, games without one after the others."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        # Ids far apart, close together, all at one end, and missing.
        gid = rng.choice([i, 10_000 + 7 * i, 10**12 + i**3])
        day = f"2024-10-{1 + rng.randrange(3):02d}"
        gid = None if i % 50 == 7 else gid * 10_000 + i
        rows.append(game(gid, day, "A", f"B{i:04d}", rng.randrange(4), rng.randrange(4)))
    rows += [game(5, "2024-10-04", "A", "C", 1, 0)]
    past = sorted(rows[:-1], key=lambda r: (r[3], r[0] is None, r[0] or 0, r[7]))
    for n in (7, 20, 110):
        out = by_id(history.prior_results(log(spark, *rows), n).where("gameId = 5"))[5]
        wins = sum(r[8] > r[9] for r in past[-n:])
        assert out[f"homeTeamPrevWins_{n}"] == wins


def test_games_without_id(spark):
    """A day's games without an id come after the others; a missing id alone hides nothing."""
    games = log(
        spark,
        game(1, "2025-04-03", "A", "B", 1, 0),
        game(None, "2025-04-05", "A", "C"),
        game(9, "2025-04-08", "A", "D", 2, 1),
        game(None, "2025-04-08", "E", "A"),
    )
    rows = {(r.gameDate.day, r.homeTeamName): r for r in history.rest_days(games).collect()}
    assert rows[5, "A"].homeTeamDaysSinceLastGame == 2
    assert rows[8, "A"].homeTeamDaysSinceLastGame == 3
    assert rows[8, "E"].awayTeamDaysSinceLastGame == 0


def test_unplayed_game_takes_a_place(spark):
    games = log(
        spark,
        game(1, "2024-10-01", "A", "B", 3, 1),
        game(2, "2024-10-02", "A", "C"),
        game(3, "2024-10-03", "A", "B", 1, 2, "OT"),
    )
    out = by_id(history.prior_results(games, 1))
    assert out[3]["homeTeamPrevWins_1"] == 0
    assert out[2]["homeTeamPrevWins_1"] == 1


def test_no_prior_games_give_null_share_and_zero_goals(spark):
    games = log(spark, game(1, "2024-10-01", "A", "B", 3, 1), game(2, "2024-10-01", "A", "C", 3, 1))
    share = by_id(history.points_pct(games))
    goals = by_id(history.prior_goals(games))
    assert share[2]["homeTeamPointsPercentage"] is None
    assert goals[2]["homeTeamPrevGoalsFor_3"] == 0.0


def test_rest_is_zero_later_on_the_same_day_and_null_at_first(spark):
    games = log(
        spark,
        game(1, "2024-10-01", "A", "B", 3, 1),
        game(2, "2024-10-04", "A", "C", 3, 1),
        game(3, "2024-10-04", "D", "A", 3, 1),
    )
    out = by_id(history.rest_days(games))
    assert out[1]["homeTeamDaysSinceLastGame"] is None
    assert out[2]["homeTeamDaysSinceLastGame"] == 3
    assert out[3]["awayTeamDaysSinceLastGame"] == 0


def test_game_without_a_date_has_no_history_and_gives_none(spark):
    games = log(spark, game(1, None, "A", "B", 3, 1), game(2, "2024-10-04", "A", "B", 3, 1))
    out = by_id(history.prior_results(games, 3))
    assert out[1]["homeTeamPrevWins_3"] == 0 and out[2]["homeTeamPrevWins_3"] == 0


def test_later_games_do_not_change_earlier_features(spark):
    games, _ = random_log(spark)
    cut = date(2024, 10, 20)
    changed = games.withColumn(
        "homeTeamScore", F.when(F.col("gameDate") >= F.lit(cut), F.lit(9.0)).otherwise(F.col("homeTeamScore"))
    )
    kept = F.col("gameDate") <= F.lit(cut)
    added = [c for c in history.feature_set(games, places(spark)).columns if c not in games.columns]
    a = history.feature_set(games, places(spark)).where(kept).select("gameId", *added)
    b = history.feature_set(changed, places(spark)).where(kept).select("gameId", *added)
    assert a.exceptAll(b).count() == 0


def test_scenarios_equal_a_loop(spark):
    games, _ = random_log(spark)
    many = games.withColumn("iteration", F.col("gameId") % 3)
    together = history.prior_results(many, 3, scenario="iteration")
    for i in range(3):
        alone = history.prior_results(many.where(F.col("iteration") == i), 3)
        assert together.where(F.col("iteration") == i).select(alone.columns).exceptAll(alone).count() == 0


def test_partitioning_does_not_matter(spark):
    games, _ = random_log(spark)
    a = history.prior_goals(games.repartition(1))
    b = history.prior_goals(games.repartition(13, "gameId"))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_wrong_perspective_is_refused(spark):
    with pytest.raises(ValueError):
        history.prior_goals(log(spark, game(1, "2024-10-01", "A", "B", 1, 0)), perspective="own")


def test_distance(spark):
    row = spark.range(1).select(
        haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"),
        haversine_km(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("none"),
        haversine_km(F.lit(None).cast("double"), F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("unknown"),
    ).first()
    assert math.isclose(row["half"], math.pi * 6371.0) and row["none"] == 0.0 and row["unknown"] is None


def test_hot_days_are_limited_before_the_shuffle(spark, tmp_path):
    """The plan keeps only the last games of a day on the map side."""
    path = str(tmp_path / "log")
    random_log(spark)[0].write.parquet(path)
    days = timeline.prior_days(
        timeline.team_games(spark.read.parquet(path)),
        ["seasonName", "teamName"],
        {"wins": F.col("teamScore") > F.col("opponentScore")},
        spans=(3,),
    )
    plan = days._jdf.queryExecution().executedPlan().toString()
    # In the parts of a day, then in the day; each before and after its shuffle.
    assert plan.count("WindowGroupLimit") == 4
