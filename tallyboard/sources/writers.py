"""Partitioned writers; only the partitions present in the data are replaced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_season(df: DataFrame, path: str, season: str = "seasonName", fmt: str = "parquet") -> None:
    """Write a table partitioned by season.

    Rows are rebalanced by season first: AQE merges small seasons' tasks and
    splits a large season over several, so files come out at an even size.
    """
    (
        df.hint("rebalance", season)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(season)
        .format(fmt)
        .save(path)
    )


def write_snapshot(
    df: DataFrame, path: str, pred_date: str, kind: str = "regularseason", fmt: str = "parquet"
) -> None:
    """Write one run's output under its date and kind; a second run of it replaces the first."""
    (
        df.withColumns({"predDate": F.lit(pred_date).cast("date"), "kind": F.lit(kind)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("predDate", "kind")
        .format(fmt)
        .save(path)
    )


def write_feature_names(names: Sequence[str], spark: SparkSession, path: str) -> None:
    """The names of a model's features, one per line."""
    rows = spark.createDataFrame([(name,) for name in names], "value string")
    rows.coalesce(1).write.mode("overwrite").text(path)
