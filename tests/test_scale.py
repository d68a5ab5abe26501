"""What must hold on large and lopsided logs: same answers, and plans without a bottleneck."""

import shutil

import duckdb
import pytest
from check_oracle import TABLES, compare, connect
from pyspark.sql import functions as F

from tallyboard.operators import evaluate, history, standings
from tallyboard.plans import fixtures as fx
from tallyboard.session import stage
from tallyboard.sources import readers, writers

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lopsided(tmp_path_factory):
    """The test tables with a third of all games given to one team on four days of a season."""
    folder = tmp_path_factory.mktemp("lopsided")
    for name in TABLES:
        if name != "orders":
            shutil.copy(f"{SF}/{name}.parquet", folder)
    duckdb.connect().execute(
        f"""COPY (SELECT * REPLACE (
          CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey,
          CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '1997-10-05' + (o_orderkey % 4) * INTERVAL 1 DAY
               ELSE o_orderdate END AS o_orderdate)
        FROM '{SF}/orders.parquet') TO '{folder}/orders.parquet' (FORMAT parquet)"""
    )
    return str(folder)


@pytest.mark.parametrize(
    "name",
    ["standings", "feature_set", "prior_results_110", "prior_results_season", "series_state", "prune_decided",
     "partial_round_games", "daily_returns", "read_snapshots", "upsert_games"],
)
def test_lopsided_log(spark, lopsided, name):
    ok, note = compare(spark, connect(lopsided), lopsided, name)
    assert ok, note


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nothing_runs_before_an_action(spark):
    log, venues, teams = fx.games(spark, SF), fx.venues(spark, SF), fx.teams(spark, SF)
    context = spark.sparkContext
    context.setJobGroup("lazy", "lazy")
    try:
        history.feature_set(log, venues)
        standings.standings(log, teams)
        history.series_score(log)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert not context.statusTracker().getJobIdsForGroup("lazy")


def test_snapshots_are_filtered_in_place(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    games = fx.games(spark, SF).select("gameId", "homeTeamScore")
    writers.write_snapshot(games, path, "2001-08-01")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(readers.read_snapshots(spark.read.parquet(path), "2001-08-01", "2001-08-03"))
        runs = spark.read.parquet(path).withColumn("n", F.col("gameId") % 3)
        latest = plan_of(readers.latest_run(runs))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Exchanges are below subqueries only, of one row per day.
    for text in (plan, latest):
        assert "Join" not in text and "Exchange" not in text.split("Subquery")[0]


def test_large_day_tables_are_not_broadcast(spark):
    log = stage(fx.games(spark, SF), "log")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        out = history.prior_results(log, 3)
        plan = plan_of(out)
        assert "Broadcast" not in plan
        small = out.select("gameId", "homeTeamPrevWins_3").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again = history.prior_results(log, 3).select("gameId", "homeTeamPrevWins_3").collect()
    assert sorted(small) == sorted(again)


def test_no_pairing_of_all_with_all(spark):
    log = fx.games(spark, SF)
    for df in (standings.standings(log, fx.teams(spark, SF)), history.series_score(log)):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scans_prune_folders_and_columns(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    games = fx.games(spark, SF).select("gameId", "homeTeamScore", "awayTeamScore")
    for day in ("2001-08-01", "2001-08-02"):
        writers.write_snapshot(games, path, day)
    chosen = readers.read_snapshots(spark.read.parquet(path), "2001-08-02", "2001-08-03")
    plan = plan_of(chosen.select("gameId"))
    assert "PartitionFilters: [isnotnull(predDate" in plan and "(predDate#" in plan
    assert "ReadSchema: struct<gameId:bigint>" in plan
    seasons = str(tmp_path / "seasons")
    writers.write_by_season(fx.games(spark, SF), seasons)
    late = spark.read.parquet(seasons).where(F.col("seasonName") == "20002001").select("gameId")
    assert "PartitionFilters: [isnotnull(seasonName" in plan_of(late)


def test_a_large_season_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "log")
    one_season = F.regexp_replace("seasonName", ".+", "20002001")
    # Several files, so several map tasks feed the season.
    log = stage(fx.games(spark, SF).withColumn("seasonName", one_season).repartition(8), "one_season")
    options = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.files.openCostInBytes": "1",
        "spark.sql.files.maxPartitionBytes": "100KB",
    }
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        writers.write_by_season(spark.read.parquet(*log.inputFiles()), path)
    finally:
        for key in options:
            spark.conf.unset(key)
    assert len(list((tmp_path / "log" / "seasonName=20002001").glob("*.parquet"))) > 1


def test_odds_join_keeps_the_partitioning(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        games, forecasts, odds = (stage(f(spark, SF), "t") for f in (fx.games, fx.snapshots, fx.odds))
        plan = plan_of(evaluate.with_odds(evaluate.snapshot_accuracy(forecasts, games), odds))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(gameId") == 3 == plan.count("Exchange")
