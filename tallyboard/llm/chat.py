"""Chat formatting: logged snapshots of one growing conversation are collapsed to the longest, then rendered.

A snapshot is a conversation whose turns are the first turns of another. Every turn carries a rolling
hash of the turns up to it, so a snapshot's last hash is among the hashes of the longer conversation,
and an anti-join on (number of turns, hash) finds what is not a snapshot. All of it is DataFrame work.

A conversation may have any number of turns. Turns are range-partitioned by conversation and order, so
a long one is spread over tasks; running positions and hashes are made within each task and carried on
from one task to the next by a table of one row per conversation and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.session import stage

#: How a turn is written out.
TURN_FORMAT = "<|%s|>\n%s<|end|>\n"
_MOST = Window.unboundedPreceding


def _carried(turns: DataFrame, value: Column, combine, start) -> DataFrame:
    """`before`: the combination of `value` over the earlier tasks of a conversation."""
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(_MOST, -1)
    return (
        turns.groupBy("conv_id", "task")
        .agg(value.alias("total"))
        .select(
            F.col("conv_id").alias("_conv"), F.col("task").alias("_task"), F.coalesce(combine("total").over(earlier), start).alias("before")
        )
    )


def _resumed(turns: DataFrame, carried: DataFrame) -> DataFrame:
    on = turns["conv_id"].eqNullSafe(carried["_conv"]) & (turns["task"] == carried["_task"])
    return turns.join(carried, on).drop("_conv", "_task")


def prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with `pos`, its place from 1, and `prefix`, a 128-bit hash of the turns up to it."""
    spread = (
        turns.select(
            "conv_id",
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .repartitionByRange("conv_id", "turn", "role", F.xxhash64("text"))
        .withColumn("task", F.spark_partition_id())
    )
    # Written out, so that a turn's task is settled whatever is run again.
    spread = stage(spread, "turns")
    here = Window.partitionBy("conv_id", "task").orderBy("turn", "role", F.xxhash64("text"), "text")
    placed = spread.withColumn("pos", F.row_number().over(here).cast("long"))
    placed = _resumed(placed, _carried(spread, F.count(F.lit(1)), F.sum, F.lit(0).cast("long")))
    placed = placed.withColumn("pos", F.col("pos") + F.col("before")).drop("before")
    hashed = placed.withColumns(
        {"a": F.xxhash64("pos", "role", "text"), "b": F.xxhash64(F.lit("b"), "pos", "role", "text")}
    )
    run = Window.partitionBy("conv_id", "task").orderBy("pos").rowsBetween(_MOST, Window.currentRow)
    for name in ("a", "b"):
        total = _carried(hashed, F.bit_xor(name), F.bit_xor, F.lit(0).cast("long"))
        summed = hashed.withColumn(f"{name}_run", F.bit_xor(name).over(run))
        hashed = _resumed(summed, total).withColumn(f"{name}_run", F.col(f"{name}_run").bitwiseXOR(F.col("before"))).drop("before")
    return hashed.select(
        "conv_id", "role", "text", "pos", F.struct(F.col("a_run").alias("a"), F.col("b_run").alias("b")).alias("prefix")
    )


def collapse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with pos and prefix, kept): kept has conv_id and n_turns of the maximal conversations;
    of equal ones the smallest conv_id stays, a null one being the smallest."""
    turns = stage(prefixes(turns), "prefixes")
    sizes = turns.groupBy("conv_id").agg(
        F.max("pos").alias("n_turns"), F.max_by("prefix", "pos").alias("whole")
    )
    unlike = sizes.groupBy("n_turns", "whole").agg(F.min(F.struct("conv_id")).alias("least"))
    unlike = unlike.select(F.col("least.conv_id").alias("conv_id"), "n_turns", "whole")
    # The last turn's hash is no proper prefix. One row stays of a prefix, however many share it.
    ends = sizes.select(F.col("conv_id").alias("_conv"), F.col("n_turns").alias("_last"))
    inner = turns.join(ends, turns["conv_id"].eqNullSafe(ends["_conv"]) & (turns["pos"] < ends["_last"]))
    inner = inner.select(F.col("pos").alias("_pos"), F.col("prefix").alias("_prefix")).distinct()
    kept = unlike.join(inner, (F.col("n_turns") == F.col("_pos")) & (F.col("whole") == F.col("_prefix")), "left_anti")
    return turns, kept.select("conv_id", "n_turns")


def render(turns: DataFrame, part_turns: int = 1024) -> DataFrame:
    """conv_id, part, n_turns, text: the maximal conversations written out.

    `turns` has conv_id, turn, role and text; other columns are not read. Turns are in order of turn,
    role and text, nulls first; null role and text are empty; rows repeated in a conversation are
    turns each; a null conv_id is a conversation like any other. A conversation of more than
    `part_turns` turns is written in as many parts as it takes, which joined in order are its text.
    """
    turns, kept = collapse(turns)
    kept = kept.withColumnRenamed("conv_id", "_conv")
    line = F.format_string(TURN_FORMAT, "role", "text")
    part = F.floor((F.col("pos") - 1) / part_turns).cast("long")
    return (
        turns.join(kept, turns["conv_id"].eqNullSafe(kept["_conv"]))
        .groupBy("conv_id", part.alias("part"), "n_turns")
        .agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
        .select("conv_id", "part", "n_turns", F.array_join("lines.line", "").alias("text"))
    )
