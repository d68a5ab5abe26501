import json
import os

import pytest
from helpers import game, log
from pyspark.sql import functions as F

from tallyboard.operators import refresh
from tallyboard.plans import daily
from tallyboard.plans import fixtures as fx
from tallyboard.sources import store

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(((r.gameId, r.seasonName, r.homeTeamName, r.homeTeamScore) for r in df.collect()), key=repr)


def test_upsert_replaces_just_the_touched_seasons(spark, tmp_path):
    path = str(tmp_path / "log")
    assert store.latest(spark, path) is None and store.read(spark, path) is None
    first = store.upsert(spark, path, log(spark, game(1, "2024-01-01", "A", "B", 1, 2), game(2, "2025-01-01", "C", "D", season="20252026"), game(None, None, "X", "Y", season=None)))
    assert first["number"] == 1 and len(first["seasons"]) == 3
    second = store.upsert(spark, path, log(spark, game(2, "2025-01-01", "C", "D", 3, 4, season="20252026"), game(3, "2025-01-02", "D", "C", season="20252026")))
    old, new = ({e["season"]: e["folder"] for e in v["seasons"]} for v in (first, second))
    assert old["20242025"] == new["20242025"] and old[None] == new[None] and old["20252026"] != new["20252026"]
    assert rows(store.read(spark, path)) == sorted(
        [(1, "20242025", "A", 1.0), (2, "20252026", "C", 3.0), (3, "20252026", "D", None), (None, None, "X", None)], key=repr
    )
    # An earlier version can still be read, until its folders are removed.
    assert len(rows(store.read(spark, path, first))) == 3
    assert store.vacuum(spark, path) == [f"data/{old['20252026']}"] or len(set(old.values())) == 1
    assert len(rows(store.read(spark, path))) == 4


def test_a_second_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    fresh = log(spark, game(1, "2024-01-01", "A", "B", 1, 2), game(None, "2024-01-02", "A", "B", 5, 2), game(None, "2024-01-02", "B", "A", 7, 2))
    first = store.upsert(spark, path, fresh)
    assert store.upsert(spark, path, fresh) == first == store.latest(spark, path)
    assert store.upsert(spark, path, fresh.limit(0)) == first
    # Games without an id are replaced, not doubled; others without one stay.
    store.upsert(spark, path, log(spark, game(None, "2024-01-02", "A", "B", 6, 2)))
    assert rows(store.read(spark, path)) == sorted([(1, "20242025", "A", 1.0), (None, "20242025", "A", 6.0), (None, "20242025", "B", 7.0)], key=repr)


def test_interruption_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    store.upsert(spark, path, log(spark, game(1, "2024-01-01", "A", "B", 1, 2)))

    def dies(*_):
        raise RuntimeError("lost driver")

    with monkeypatch.context() as patched:
        patched.setattr(store, "commit", dies)
        with pytest.raises(RuntimeError):
            store.upsert(spark, path, log(spark, game(1, "2024-01-01", "A", "B", 9, 2)))
    assert rows(store.read(spark, path)) == [(1, "20242025", "A", 1.0)]
    assert len(store.vacuum(spark, path)) == 1
    store.upsert(spark, path, log(spark, game(1, "2024-01-01", "A", "B", 9, 2)))
    assert rows(store.read(spark, path)) == [(1, "20242025", "A", 9.0)]


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "log")
    base = store.upsert(spark, path, log(spark, game(1, "2024-01-01", "A", "B", 1, 2)))
    store.upsert(spark, path, log(spark, game(2, "2024-01-01", "C", "D", 1, 2)))
    with pytest.raises(store.Conflict):
        store.commit(spark, path, base, base)
    assert store.latest(spark, path)["number"] == 2 and len(rows(store.read(spark, path))) == 2


def test_moved_games_new_columns_and_types(spark, tmp_path):
    path = str(tmp_path / "log")
    store.upsert(spark, path, log(spark, game(1, "2024-01-01", "A", "B", 1, 2), game(2, "2024-01-03", "A", "B", 1, 2)))
    store.upsert(spark, path, log(spark, game(1, "2025-10-01", "A", "B", 1, 2, season="20252026")).withColumn("crowd", F.lit(5)))
    got = {(r.gameId, r.seasonName, r.crowd) for r in store.read(spark, path).collect()}
    assert got == {(1, "20252026", 5), (2, "20242025", None)}
    store.upsert(spark, path, log(spark, game(2, "2025-10-02", "A", "B", season="20252026")))
    assert {e["season"] for e in store.latest(spark, path)["seasons"]} == {"20252026"}
    with pytest.raises(ValueError):
        store.upsert(spark, path, log(spark, game(3, "2024-01-01", "A", "B")).withColumn("crowd", F.lit("many")))


def test_fingerprints(spark):
    one = log(spark, game(1, "2024-01-01", "A", "B", 1, 2), game(2, "2025-01-01", "C", "D", 0, 3, season="20252026"))
    cached = refresh.season_fingerprints(one.repartition(3).select(*reversed(one.columns)))
    assert refresh.changed_seasons(one, cached).count() == 0
    # A null that moves, a repeated row, a new season, and a season of no name all show.
    swapped = one.withColumns({"homeTeamScore": F.lit(None).cast("double"), "awayTeamScore": F.lit(1.0)})
    other = one.withColumns({"homeTeamScore": F.lit(1.0), "awayTeamScore": F.lit(None).cast("double")})
    assert refresh.changed_seasons(swapped, refresh.season_fingerprints(other)).count() == 2
    assert {r.seasonName for r in refresh.changed_seasons(one.union(one.limit(1)), cached).collect()} == {"20242025"}
    assert refresh.changed_seasons(one, cached.limit(0)).count() == 2
    nameless = log(spark, game(1, "2024-01-01", "A", "B", 1, 2, season=None))
    assert refresh.changed_seasons(nameless, refresh.season_fingerprints(nameless)).count() == 0


def test_features_follow_corrections(spark, tmp_path):
    path = str(tmp_path / "features")
    games, venues = fx.games(spark, SF), fx.venues(spark, SF)
    first = daily.refresh_features_by_content(games, venues, path)
    before = {e["season"]: e["folder"] for e in store.latest(spark, path)["seasons"]}
    assert first.count() == games.count()
    again = store.latest(spark, path)["number"]
    daily.refresh_features_by_content(games, venues, path)
    assert store.latest(spark, path)["number"] == again
    corrected = games.withColumn("homeTeamScore", F.when(F.col("seasonName") == "19961997", F.col("homeTeamScore") + 1).otherwise(F.col("homeTeamScore")))
    rows_now = daily.refresh_features_by_content(corrected, venues, path)
    after = {e["season"]: e["folder"] for e in store.latest(spark, path)["seasons"]}
    assert {s for s in after if after[s] != before[s]} == {"19961997"}
    from tallyboard.operators import history

    want = history.feature_set(corrected, venues)
    assert rows_now.select(want.columns).exceptAll(want).count() == 0
    left = daily.refresh_features_by_content(corrected.where("seasonName > '19961997'"), venues, path)
    assert left.agg(F.min("seasonName")).first()[0] > "19961997"


def document(*games):
    """A schedule with (id, season, minute, home, away, score) games."""
    def one(g):
        i, season, minute, home, away, score = g
        club = lambda n, s: {"placeName": {"default": n}, "commonName": {"default": "Club"}, "score": s}
        out = {"id": i, "season": season, "gameType": 2, "startTimeUTC": f"2024-01-01T00:{minute:02d}:00Z", "venue": {"default": "Hall"}, "homeTeam": club(home, score), "awayTeam": club(away, 0)}
        return {**out, "gameOutcome": {"lastPeriodType": "REG"}} if score is not None else out

    return json.dumps({"gameWeek": [{"date": "2024-01-01", "games": [one(g) for g in games]}]})


def land(path, text, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def test_landing_folder(spark, tmp_path):
    landing, path = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    assert store.load_landed(spark, str(landing), path) is None
    land(landing / "a b" / "one.json", document((1, 20242025, 0, "A", "B", None), (2, 20242025, 0, "C", "D", None)), 1000)
    land(landing / "two.json", document((1, 20242025, 0, "A", "B", 3)) + "\n" + '{"gameWeek": [{"da' + "\n\n", 2000)
    store.load_landed(spark, str(landing), path)
    assert {(r.gameId, r.homeTeamScore) for r in store.read(spark, path).collect()} == {(1, 3.0), (2, None)}
    bad = store.bad_documents(spark, path).collect()
    assert [(b.document, b.file.endswith("/two.json")) for b in bad] == [('{"gameWeek": [{"da', True)]
    assert {(r.file.rsplit("/", 1)[1], r.bad_documents) for r in store.ledger(spark, path).collect()} == {("one.json", 0), ("two.json", 1)}
    # Nothing new: nothing is read or written.
    version = store.latest(spark, path)
    assert store.load_landed(spark, str(landing), path) == version
    # A file that comes late but was fetched earlier changes no later score; a rewritten file is new.
    land(landing / "late.json", document((1, 20242025, 0, "A", "B", 1), (5, 20232024, 0, "E", "F", 2)), 1500)
    land(landing / "a b" / "one.json", document((2, 20242025, 0, "C", "D", 4)), 3000)
    land(landing / "junk.json", "[1, 2]\nnot json\n{}", 3000)
    store.load_landed(spark, str(landing), path)
    assert {(r.gameId, r.seasonName, r.homeTeamScore) for r in store.read(spark, path).collect()} == {(1, "20242025", 3.0), (2, "20242025", 4.0), (5, "20232024", 2.0)}
    assert store.bad_documents(spark, path).count() == 4 and store.ledger(spark, path).count() == 5
    # Only broken files: the rows stay, the ledger knows them.
    land(landing / "worse.json", "{", 4000)
    store.load_landed(spark, str(landing), path)
    assert store.read(spark, path).count() == 3 and store.ledger(spark, path).count() == 6


def test_games_without_an_id_in_upserts(spark):
    stored = log(spark, game(None, "2024-01-01", "A", "B", 1, 2), game(None, "2024-01-02", "A", "B", 1, 2), game(7, "2024-01-01", "A", "B", 1, 2), game(None, None, "A", "B"))
    fresh = log(spark, game(None, "2024-01-01", "A", "B", 5, 2), game(None, None, "A", "B", 6, 2))
    once = refresh.upsert_games(stored, fresh)
    assert sorted(r.homeTeamScore for r in once.collect()) == [1.0, 1.0, 5.0, 6.0]
    twice = refresh.upsert_games(once, fresh)
    assert twice.exceptAll(once).count() == once.exceptAll(twice).count() == 0
