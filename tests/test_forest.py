import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyboard.operators import forest, model

X = ["a", "b", "c"]


def games(spark, rows):
    """Rows of (gameId, seasonName, a, b, c, home, away)."""
    kind = "gameId long, seasonName string, a double, b long, c string, homeTeamScore double, awayTeamScore double, lastPeriod string"
    return spark.createDataFrame([(*r, "REG" if r[5] is not None else None) for r in rows], kind)


def made(n, seed=1, spread=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.choice([None, 0.5, 1.0, 2.0, 7.5]), rng.randint(0, spread), rng.choice(["x", "y", "z", None])
        home = float((a or 0) > 1) * 3 + rng.randint(0, 1) + (c == "y")
        rows.append((i, "20002001" if i % 3 else "20012002", a, b, c, home, float(b % 3)) if i % 10 else (i, "20012002", a, b, c, None, None))
    return rows


def plain_tree(x, y, w, depth, min_rows=2):
    """Value for a row, by trying every split of every node."""
    total = sum(w)
    value = [sum(wi * yi[t] for wi, yi in zip(w, y)) / total for t in range(len(y[0]))]
    if depth == 0 or len(x) < min_rows or all(yi == y[0] for yi in y):
        return lambda row: value
    best = None
    for f in range(len(x[0])):
        values = sorted({r[f] for r in x})
        for low, high in zip(values, values[1:]):
            sides = [[i for i, r in enumerate(x) if (r[f] <= low) == side] for side in (True, False)]
            gain = 0.0
            for side in sides:
                weight = sum(w[i] for i in side)
                gain += sum(sum(w[i] * y[i][t] for i in side) ** 2 for t in range(len(value))) / weight
            if best is None or gain > best[0]:
                best = (gain, f, (low + high) / 2, sides)
    if best is None:
        return lambda row: value
    _, f, cut, sides = best
    left, right = (plain_tree([x[i] for i in s], [y[i] for i in s], [w[i] for i in s], None if depth is None else depth - 1, min_rows) for s in sides)
    return lambda row: (left if row[f] <= cut else right)(row)


@pytest.mark.parametrize("depth", [None, 0, 1, 3])
def test_subtree_against_all_splits(depth):
    rng = np.random.default_rng(depth or 7)
    for trial in range(60):
        n, width = int(rng.integers(1, 40)), int(rng.integers(1, 4))
        x = rng.integers(0, rng.choice([1, 3, 12]), (n, width)).astype(float)
        y = rng.integers(0, 4, (n, int(rng.integers(1, 4)))).astype(float)
        w = rng.integers(1, 4, n).astype(float)
        min_rows = int(rng.choice([2, 5]))
        grown = forest.grow_rows(x, y, w, depth, min_rows)
        plain = plain_tree(x.tolist(), y.tolist(), w.tolist(), depth, min_rows)
        probe = np.concatenate([x, rng.uniform(-1, 12, (20, width))])
        assert np.allclose(grown["value"][forest.walk(grown, probe)], [plain(r) for r in probe.tolist()], atol=1e-9), trial


def test_weights(spark):
    keys = [0, 1, 5, 10**15, -3, None, 2**62]
    frame = spark.createDataFrame([(k,) for k in keys], "k long").crossJoin(spark.range(7).withColumnRenamed("id", "t"))
    got = {(r.k, r.t): r.w for r in frame.select("k", "t", forest.bootstrap_weight(F.col("k"), F.col("t"), 42).alias("w")).collect()}
    plain = np.array([-1 if k is None else k for k in keys])
    for t in range(7):
        assert [got[k, t] for k in keys] == forest.weights_of(plain, t, 42).tolist()
    many = np.concatenate([forest.weights_of(np.arange(100_000), t, 42) for t in range(5)])
    for k in range(5):
        assert abs((many == k).mean() - math.exp(-1) / math.factorial(k)) < 0.004
    # Trees draw independently of each other.
    a, b = forest.weights_of(np.arange(100_000), 0, 1), forest.weights_of(np.arange(100_000), 1, 1)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.02


def plain_forest(rows, n_trees, seed, depth):
    """(tree functions, weights by tree) over collected rows of `numbered`."""
    known = [r for r in rows if r["_y"] is not None]
    trees = []
    for t in range(n_trees):
        w = forest.weights_of(np.array([r["_key"] for r in known]), t, seed)
        mine = [i for i in range(len(known)) if w[i] > 0]
        trees.append(plain_tree([known[i]["_x"] for i in mine], [known[i]["_y"] for i in mine], [w[i] for i in mine], depth))
    return trees


@pytest.mark.parametrize("depth", [None, 2])
def test_forest_against_plain(spark, depth):
    rows = forest.numbered(games(spark, [*made(120), (None, "20012002", None, 1, None, 1.0, 2.0), (None, "20012002", None, 1, None, 1.0, 2.0)]))
    plain_rows = rows.collect()
    trees = plain_forest(plain_rows, 6, 9, depth)
    nodes = forest.grow(rows, n_trees=6, seed=9, max_depth=depth)
    for sent in (10**6, 0):
        every = {r["_row"]: r for r in forest.predict(nodes, rows, seed=9, sent_nodes=sent).collect()}
        unseen = {r["_row"]: r for r in forest.predict(nodes, rows, out_of_bag=True, seed=9, sent_nodes=sent).collect()}
        assert len(every) == len(plain_rows) == 122
        for r in plain_rows:
            told = [t(r["_x"]) for t in trees]
            got = every[r["_row"]]
            assert got["votes"] == 6
            assert np.allclose([got["homeTeamScore_predicted"], got["awayTeamScore_predicted"]], np.mean(told, axis=0))
            told = [v for i, v in enumerate(told) if forest.weights_of(np.array([r["_key"]]), i, 9)[0] == 0]
            got = unseen[r["_row"]]
            assert got["votes"] == len(told)
            if told:
                assert np.allclose([got["homeTeamScore_predicted"], got["awayTeamScore_predicted"]], np.mean(told, axis=0))
            else:
                assert got["homeTeamScore_predicted"] is None


@pytest.mark.parametrize("depth", [None, 4])
def test_levels_split_as_a_group_does(spark, depth):
    rows = forest.numbered(games(spark, made(400, seed=3, spread=40))).repartition(5)
    whole = forest.grow(rows, n_trees=3, max_depth=depth)
    levels = forest.grow(rows, n_trees=3, max_depth=depth, local_rows=40, bins=1000)
    assert levels.where("part = -1 AND feature >= 0").count() > 9 > whole.where("part = -1 AND feature >= 0").count() == 0
    # Rows that a tree has seen end in equal samples, wherever between two values the cut lies.
    known = rows.where("_y IS NOT NULL")
    for tree in range(3):
        a, b = (
            {r["_row"]: (r["homeTeamScore_predicted"], r["awayTeamScore_predicted"]) for r in forest.predict(n.where(F.col("tree") == tree), known).collect()}
            for n in (whole, levels)
        )
        for r in known.collect():
            if forest.weights_of(np.array([r["_key"]]), tree, 42)[0] > 0:
                assert np.allclose(a[r["_row"]], b[r["_row"]])
    # The same votes when rows are sent to the parts.
    for nodes in (levels, whole):
        a, b = ({r["_row"]: (r["votes"], r["homeTeamScore_predicted"]) for r in forest.predict(nodes, rows, sent_nodes=s).collect()} for s in (10**6, 0))
        assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and math.isclose(a[k][1], b[k][1]) for k in a)


def test_rows_that_nothing_tells_apart_stay_where_they_are(spark):
    rows = forest.numbered(games(spark, [(i, "20012002", 1.0, 1, "x", float(i % 2), 0.0) for i in range(200)]).drop("gameId").withColumn("gameId", F.lit(7)))
    nodes = forest.grow(rows, n_trees=2, bootstrap=False, local_rows=20)
    assert nodes.count() == 2 and nodes.where("feature = -1 AND part = -1 AND value[0] = 0.5").count() == 2
    assert forest.predict(nodes, rows).where("votes = 2 AND homeTeamScore_predicted = 0.5").count() == 200
    assert forest.predict(nodes, rows, sent_nodes=0).where("votes = 2 AND homeTeamScore_predicted = 0.5").count() == 200


def test_quantile_bins_still_grow_to_the_end(spark):
    rows = forest.numbered(games(spark, [(i, "20012002", i * 0.37, i, "x", float(i % 5), 0.0) for i in range(600)]))
    nodes = forest.grow(rows, n_trees=2, bootstrap=False, local_rows=50, bins=8)
    wrong = forest.predict(nodes, rows).where("abs(homeTeamScore_predicted - homeTeamScore) > 1e-9")
    assert wrong.count() == 0


def test_scores_and_metrics(spark):
    log = games(spark, made(150))
    scored = forest.score_games(log, n_trees=4)
    assert scored.columns == log.columns and scored.count() == 150
    assert scored.where("homeTeamScore IS NULL OR lastPeriod IS NULL").count() == 0
    assert log.where("lastPeriod IS NOT NULL").exceptAll(scored).count() == 0
    row = forest.oob_metrics(log, n_trees=5, seed=3).first()
    known = [r for r in forest.numbered(log).collect() if r["_y"] is not None]
    trees = plain_forest(known, 5, 3, None)
    errors, unvoted = [], 0
    for r in known:
        told = [t(r["_x"]) for i, t in enumerate(trees) if forest.weights_of(np.array([r["_key"]]), i, 3)[0] == 0]
        unvoted += not told
        if told:
            errors.append((np.mean(told, axis=0) - r["_y"]) ** 2)
    assert row["games"] == len(errors) and row["unvoted"] == unvoted and math.isclose(row["mse"], np.mean(errors))
    held = forest.holdout_metrics(log, "20002001", n_trees=3).first()
    assert held["games"] == log.where("seasonName = '20002001' AND homeTeamScore IS NOT NULL").count()


def test_empty_and_open_logs(spark):
    log = games(spark, made(30))
    for none in (log.limit(0), log.withColumn("homeTeamScore", F.lit(None).cast("double"))):
        rows = forest.numbered(none)
        nodes = forest.grow(rows, n_trees=2)
        assert nodes.count() == 0
        out = forest.predict(nodes, rows)
        assert out.count() == none.count() and out.where("votes > 0 OR homeTeamScore_predicted IS NOT NULL").count() == 0


def test_importance_by_hand(spark):
    nodes = spark.createDataFrame(
        [
            (0, -1, 0, forest.CARRIED, 0.0, -1, -1, 0.0, None, 0.0),
            (0, 0, 0, 1, 0.5, 1, 2, 4.0, [1.0], 6.0), (0, 0, 1, 0, 0.5, 3, 4, 2.0, [1.0], 2.0),
            *[(0, 0, i, forest.LEAF, 0.0, -1, -1, 1.0, [1.0], 0.0) for i in (2, 3, 4)],
            (1, -1, 0, 0, 0.5, 1, 2, 2.0, [1.0], 5.0), *[(1, -1, i, forest.LEAF, 0.0, -1, -1, 1.0, [1.0], 0.0) for i in (1, 2)],
            (2, -1, 0, forest.LEAF, 0.0, -1, -1, 2.0, [1.0], 0.0),
        ],
        forest.NODES,
    )
    got = {r.feature: r.importance for r in forest.feature_importance(nodes, X).collect()}
    assert got == {"a": (0.25 + 1) / 2, "b": 0.75 / 2, "c": 0.0}


def test_permutation(spark):
    log = games(spark, made(200, seed=5))
    rows = forest.numbered(log)
    names = model.feature_columns(log)
    at = names.index("b")
    before, after = ({r["_row"]: r["_x"] for r in frame.collect()} for frame in (rows, forest.shuffled(rows, at, 1)))
    assert before.keys() == after.keys()
    assert sorted(x[at] for x in before.values()) == sorted(x[at] for x in after.values())
    assert all(before[k][:at] + before[k][at + 1 :] == after[k][:at] + after[k][at + 1 :] for k in before)
    assert sum(before[k][at] != after[k][at] for k in before) > 100
    nodes = forest.grow(rows, n_trees=4)
    trees = plain_forest(rows.collect(), 4, 42, None)
    known = {r["_row"]: r["_y"] for r in rows.collect() if r["_y"] is not None}
    moved = {r["_row"]: r["_x"] for r in forest.shuffled(rows.where("_y IS NOT NULL"), at, 42).collect()}

    def mse(x):
        return np.mean([(np.mean([t(x[k]) for t in trees], axis=0) - known[k]) ** 2 for k in known])

    row = forest.permutation_importance(nodes, rows, names, ["b"]).first()
    assert math.isclose(row.mse, mse(moved)) and math.isclose(row.increase, mse(moved) - mse(before)) and row.increase > 0


def test_a_subtree_sorts_each_feature_once(monkeypatch):
    rng = np.random.default_rng(5)
    n, width = 3000, 6
    x, y = rng.integers(0, 500, (n, width)).astype(float), rng.integers(0, 7, (n, 2)).astype(float)
    sorted_rows, argsort = [], np.argsort

    def counted(a, *args, **kwargs):
        sorted_rows.append(len(a))
        return argsort(a, *args, **kwargs)

    monkeypatch.setattr(np, "argsort", counted)
    grown = forest.grow_rows(x, y, np.ones(n), None)
    # Besides that, the nodes of a level are put in order.
    assert sum(sorted_rows) <= n * width + len(grown["feature"])


def test_rows_come_to_wanted_nodes():
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 9, (300, 3)).astype(float), rng.integers(0, 5, (300, 2)).astype(float)
    nodes = forest.grow_rows(x, y, np.ones(300), 4)
    ends = forest.walk(nodes, x)
    found = dict(forest.reached(nodes, x.T.copy(), np.arange(300), nodes["feature"] < 0))
    assert sorted(found) == np.unique(ends).tolist()
    assert all((ends[rows] == node).all() for node, rows in found.items()) and sum(map(len, found.values())) == 300


def test_targets_that_are_no_whole_numbers(spark):
    log = games(spark, [(*r[:5], None if r[5] is None else r[5] + 0.3, None if r[6] is None else r[6] / 7) for r in made(300, seed=9)])
    rows = forest.numbered(log).repartition(4)
    trees = plain_forest(rows.collect(), 3, 42, None)
    nodes = forest.grow(rows, n_trees=3, local_rows=50, bins=1000)
    known = rows.where("_y IS NOT NULL")
    for sent in (10**6, 0):
        for r in forest.predict(nodes, known, sent_nodes=sent).collect():
            assert math.isclose(r["homeTeamScore_predicted"], np.mean([t(r["_x"]) for t in trees], axis=0)[0]) or any(
                forest.weights_of(np.array([r["_key"]]), t, 42)[0] == 0 for t in range(3)
            )


def test_nodes_at_the_last_depth_need_no_bins(spark, monkeypatch):
    rows = forest.numbered(games(spark, made(200, seed=4)))
    whole = forest.grow(rows, n_trees=3, max_depth=0).select("tree", "feature", "weight", "value").where("feature = -1")

    def none(*args):
        raise AssertionError("bins of a forest without depth")

    monkeypatch.setattr(forest, "bin_edges", none)
    top = forest.grow(rows, n_trees=3, max_depth=0, local_rows=10)
    assert top.count() == 3
    assert sorted(top.select("tree", "feature", "weight", "value").collect()) == sorted(whole.collect())


def test_out_of_bag_votes_are_stored_without_features(spark, monkeypatch):
    stored, stage = {}, forest.stage

    def noted(df, label):
        stored[label] = df.columns
        return stage(df, label)

    monkeypatch.setattr(forest, "stage", noted)
    forest.oob_metrics(games(spark, made(60)), n_trees=3).first()
    assert set(stored["oob"]) == {*model.TARGETS, *[f"{t}_predicted" for t in model.TARGETS], "votes"}


def test_small_nodes_are_grown_together_as_apart(monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(0, 9, (900, 2)), rng.normal(size=(900, 1))], axis=1)
    x[rng.random(900) < 0.1, 0] = np.nan
    y, w = rng.integers(0, 7, (900, 2)).astype(float), rng.integers(1, 4, 900).astype(float)
    whole = forest.grow_rows(x, y, w, None)
    for together, small, at_once in ((60, 20, 100), (200, 200, 10**6)):
        for name, value in (("TOGETHER", together), ("SMALL", small), ("COUNTED_AT_ONCE", at_once)):
            monkeypatch.setattr(forest, name, value)
        parts = forest.grow_rows(x, y, w, None)
        assert len(parts["feature"]) == len(whole["feature"])
        assert sorted(zip(parts["feature"], parts["threshold"], parts["weight"])) == sorted(zip(whole["feature"], whole["threshold"], whole["weight"]))
        assert np.allclose(parts["value"][forest.walk(parts, x)], whole["value"][forest.walk(whole, x)])


def test_features_of_few_values_are_not_gone_through_in_order_at_every_level(monkeypatch):
    rng = np.random.default_rng(11)
    n, width = 4000, 6
    x, y = rng.integers(0, 30, (n, width)).astype(float), rng.integers(0, 7, (n, 2)).astype(float)
    added, cumsum = [], np.cumsum

    def counted(a, *args, **kwargs):
        added.append(len(a))
        return cumsum(a, *args, **kwargs)

    monkeypatch.setattr(np, "cumsum", counted)
    grown = forest.grow_rows(x, y, np.ones(n), None)
    depth = np.zeros(len(grown["feature"]), dtype=int)
    for i in np.flatnonzero(grown["feature"] >= 0):
        depth[grown["left"][i]] = depth[grown["right"][i]] = depth[i] + 1
    open_rows = sum((depth[forest.walk(grown, x)] > d).sum() for d in range(depth.max()))
    assert sum(added) < open_rows * width


def test_rows_are_dealt_in_few_bytes_and_come_back():
    rng = np.random.default_rng(12)
    columns = np.array([
        rng.integers(-128, 128, 500), rng.integers(0, 30_000, 500), rng.integers(0, 10**9, 500), rng.integers(0, 10**12, 500),
        rng.normal(size=500), rng.integers(0, 9, 500) / 4, np.where(rng.random(500) < 0.1, np.nan, 3.0),
        np.where(rng.random(500) < 0.1, np.inf, 3.0), np.zeros(500), np.full(500, 1e300),
    ])
    narrow = forest._narrowed(columns)
    assert [c.itemsize for c in narrow] == [1, 2, 4, 8, 8, 4, 4, 4, 1, 8]
    parts = [np.arange(0, 500, 3), np.arange(0), np.arange(100, 101)]
    blobs = [pa.py_buffer(forest._packed(narrow, rows)) for rows in parts]
    for column, back in zip(columns, forest._unpacked(blobs, len(columns))):
        assert np.array_equal(back, column[np.concatenate(parts)], equal_nan=True)


def test_a_tree_of_many_rows_is_split_between_any_two_values(spark):
    # Before, more than 65,536 rows were split between quantiles, level by level.
    rows = forest.numbered(spark.range(70_000).selectExpr(
        "id AS gameId", "'20002001' AS seasonName", "double(id >= 12345) AS homeTeamScore", "0d AS awayTeamScore", "'REG' AS lastPeriod"
    ))
    nodes = forest.grow(rows, n_trees=1, bootstrap=False)
    assert nodes.where("feature >= 0").select("part", "threshold").collect() == [(0, 12344.5)] and nodes.count() == 4
