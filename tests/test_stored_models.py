import random

import pytest
from helpers import game, log
from pyspark.sql import functions as F
from test_forest import games, made

from tallyboard.operators import forest
from tallyboard.sources import league, models


def test_models_by_day_and_features(spark, tmp_path):
    path = str(tmp_path / "models")
    features = games(spark, made(60))
    rows = forest.numbered(features)
    with pytest.raises(LookupError):
        models.load_forest(spark, path, features)
    old, new = (forest.grow(rows, n_trees=2, max_depth=d) for d in (1, 3))
    models.save_forest(new, features, path, "2024-02-01")
    models.save_forest(old, features, path, "2024-01-01")
    assert models.load_forest(spark, path, features).exceptAll(new).count() == 0
    loaded = models.load_forest(spark, path, features, "2024-01-15")
    assert loaded.exceptAll(old).count() == old.exceptAll(loaded).count() == 0
    with pytest.raises(LookupError):
        models.load_forest(spark, path, features, "2023-12-31")
    # The same day again replaces it; other columns or types are refused by name.
    models.save_forest(old, features, path, "2024-02-01")
    assert models.load_forest(spark, path, features).exceptAll(old).count() == 0
    with pytest.raises(ValueError, match="'a', 'crowd'"):
        models.load_forest(spark, path, features.withColumn("crowd", F.lit(1)).withColumn("a", F.col("a").cast("string")))
    # The order of columns doesn't matter, as features go by name.
    models.load_forest(spark, path, features.select(*reversed(features.columns)))


def test_a_venue_on_another_continent(spark):
    teams, rng = "ABCDEFGHIJKL", random.Random(2)
    rows = [game(20 * i + j, "2024-01-01", h, a) for i, h in enumerate(teams) for j, a in enumerate(teams) if h != a]
    rows += [game(999, "2024-01-02", "A", "B", venue="Nowhere"), game(1000, "2024-01-02", None, "B", venue="F Hall")]
    places = [(f"{t} Hall", rng.uniform(30, 50), rng.uniform(-120, -75)) for t in teams]
    venues = spark.createDataFrame(places + [("Nowhere", None, 3.0), ("Unused", 1.0, 1.0)], "venue string, venue_lat double, venue_long double")
    assert league.suspect_venues(log(spark, *rows), venues).where("suspect").count() == 0
    planted = venues.withColumn("venue_long", F.when(F.col("venue") == "C Hall", 84.0).otherwise(F.col("venue_long")))
    out = {r.venue: r for r in league.suspect_venues(log(spark, *rows), planted).collect()}
    assert {v for v, r in out.items() if r.suspect} == {"C Hall"} and set(out) == {f"{t} Hall" for t in teams}
    assert out["F Hall"].homeTeamName == "F"
    assert league.suspect_venues(log(spark, *rows).limit(0), venues).count() == 0
