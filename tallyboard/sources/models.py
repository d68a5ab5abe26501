"""Forests on shared storage, by the day they are as of, each with the features it knows."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyboard.operators import forest, model
from tallyboard.sources import store


def signature(features: DataFrame) -> list[list[str]]:
    """Name and type of every feature, in the order in which a forest numbers them."""
    kinds = {f.name: f.dataType.simpleString() for f in features.schema.fields}
    return [[name, kinds[name]] for name in model.feature_columns(features)]


def _hash(named: list[list[str]]) -> str:
    return hashlib.sha256(json.dumps(named).encode()).hexdigest()


def save_forest(nodes: DataFrame, features: DataFrame, path: str, as_of: str, seed: int = 42) -> dict:
    """Put the node table of a forest on `features` into the store under `path`; a later one of the same day replaces it."""
    spark = nodes.sparkSession
    base = store.latest(spark, path)
    folder = uuid.uuid4().hex
    nodes.write.parquet(f"{path}/data/{folder}")
    named = signature(features)
    entry = {"as_of": as_of, "folder": folder, "features": named, "hash": _hash(named), "seed": seed}
    others = [m for m in (base or {}).get("models", []) if m["as_of"] != as_of]
    return store.commit(spark, path, base, {"models": sorted([*others, entry], key=lambda m: m["as_of"])})


def load_forest(spark: SparkSession, path: str, features: DataFrame, as_of: str | None = None) -> DataFrame:
    """The node table of the last forest as of a day, by default of any, refused if `features` aren't those it knows."""
    models = (store.latest(spark, path) or {}).get("models", [])
    found = [m for m in models if as_of is None or m["as_of"] <= as_of]
    if not found:
        raise LookupError(f"no model under {path}" + (f" as of {as_of}" if as_of else ""))
    named = signature(features)
    if found[-1]["hash"] != _hash(named):
        old, new = (dict(map(tuple, x)) for x in (found[-1]["features"], named))
        differ = sorted(c for c in old.keys() | new.keys() if old.get(c) != new.get(c))
        raise ValueError(f"the model as of {found[-1]['as_of']} knows other features; these differ: {differ}")
    return spark.read.schema(forest.NODES).parquet(f"{path}/data/{found[-1]['folder']}")
