"""Shaping result lists: first-seen dedupe, interleaving, caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each key in order; rows with a null key all pass."""
    marked = df.withColumn("_k", key)
    once = marked.where("_k is not null").groupBy("_k").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return once.select("_r.*").unionByName(marked.where("_k is null").drop("_k"))


def interleave(df: DataFrame, group: str, order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows when one row of each group is taken per round, groups by their first row; adds ``position``.

    The rows are cut to ``limit`` by a distributed top-k before they are
    numbered in one place.
    """
    rounds = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    first = F.min(F.struct(*order)).over(Window.partitionBy(group))
    ranked = df.withColumn("_round", rounds).withColumn("_first", first).where(F.col("_round") <= limit)
    some = ranked.orderBy("_round", "_first").limit(limit)
    return some.withColumn("position", F.row_number().over(Window.orderBy("_round", "_first"))).drop("_round", "_first")


def capped_with_floor(df: DataFrame, group: str, order: Sequence[str], cap: int, floor: int) -> DataFrame:
    """At most ``cap`` rows: first up to ``floor`` of each group, groups in order, then one of each group per round.

    Adds ``position``.  A list within the cap keeps its order.  Rows beyond
    ``cap`` of a group can never be taken and go before anything is sorted
    globally, so what is ordered in one place is groups times cap rows at most.
    """
    over = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("_n", F.row_number().over(over)).withColumn("_first", F.min(F.struct(*order)).over(Window.partitionBy(group)))
    able = ranked.where(F.col("_n") <= cap)  # no group can give more
    floored = (F.col("_n") > floor).cast("int")
    total = df.groupBy().agg(F.count("*").alias("_total"))
    chosen = able.crossJoin(F.broadcast(total))
    within = F.col("_total") <= cap
    keys = [F.when(within, F.lit(0)).otherwise(floored), F.when(within, F.lit(0)).otherwise(F.when(floored == 1, F.col("_n")).otherwise(0)), F.when(~within, F.col("_first")), F.when(~within, F.col("_n")), *order]
    some = chosen.orderBy(*keys).limit(cap)
    return some.withColumn("position", F.row_number().over(Window.orderBy(*keys))).drop("_n", "_first", "_total")
