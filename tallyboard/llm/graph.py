"""Connected components of a link table, by rounds of joins on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyboard.session import stage


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of `links` (columns a, b).

    Every round takes the smallest label among the neighbours and then the label's own label, so a star
    is done in two rounds and a chain in about the logarithm of its length.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, "links")
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("least"))
        hooked = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("comp").alias("old"), F.least("comp", "least").alias("comp")
        )
        own = labels.select(F.col("node").alias("_at"), F.col("comp").alias("_next"))
        jumped = hooked.join(own, hooked["comp"] == own["_at"]).select("node", "old", F.least("comp", "_next").alias("comp"))
        moved = Observation()
        labels = stage(jumped.observe(moved, F.count_if(F.col("old") != F.col("comp")).alias("n")), "labels").select("node", "comp")
        if not moved.get["n"]:
            return labels
