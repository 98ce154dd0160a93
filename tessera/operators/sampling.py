"""Seeded samples with exact quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(key: Column, seed: int = 0) -> Column:
    """An order that depends on key and seed alone, whatever the partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def per_group(df: DataFrame, groups: list[str], key: str, quota: int, seed: int = 0) -> DataFrame:
    """``quota`` rows of each group in seeded order."""
    over = Window.partitionBy(*groups).orderBy(seeded(F.col(key), seed), key)
    return df.withColumn("_n", F.row_number().over(over)).where(F.col("_n") <= quota).drop("_n")


def balanced(df: DataFrame, outer: list[str], inner: str, key: str, per_inner: int, cap: int) -> DataFrame:
    """Per ``outer`` group at most ``cap`` rows, ``inner`` values by falling count, at most ``per_inner`` rows of each."""
    counts = df.groupBy(*outer, inner).agg(F.count("*").alias("_c"))
    some = df.withColumn("_n", F.row_number().over(Window.partitionBy(*outer, inner).orderBy(key))).where(F.col("_n") <= per_inner)
    joined = some.join(counts, [*outer, inner])
    place = F.row_number().over(Window.partitionBy(*outer).orderBy(F.desc("_c"), inner, "_n"))
    return joined.withColumn("_p", place).where(F.col("_p") <= cap).drop("_n", "_c", "_p")


def quota_sample(df: DataFrame, group: str, key: str, size: int, seed: int = 0, best: list | None = None) -> DataFrame:
    """``size`` rows: an equal share of each group (at least one), by ``best`` or in seeded order, and the rest in seeded order from what is left.

    What is counted on the driver is a number of groups and of rows taken.
    """
    order = [*(best or [seeded(F.col(key), seed)]), F.col(key)]
    share = max(1, size // max(1, df.select(group).distinct().count()))
    placed = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    taken = placed.where(F.col("_n") <= share).drop("_n")
    missing = max(0, size - taken.count())
    rest = placed.where(F.col("_n") > share).drop("_n").orderBy(seeded(F.col(key), seed), key).limit(missing)
    return taken.unionByName(rest)


def required_first(df: DataFrame, strata: list[Column], key: str, size: int, seed: int = 0) -> DataFrame:
    """One row of each stratum that has any, none twice, then rows in seeded order up to ``size``; adds ``stratum`` (from 1; 0 for the fill).

    Each pick is a distributed top-1 and leaves the table by its key.
    """
    left, out, taken = df, None, 0
    for i, stratum in enumerate(strata, 1):
        pick = left.where(stratum).orderBy(seeded(F.col(key), seed), key).limit(1).collect()
        if pick:
            row = df.sparkSession.createDataFrame(pick, df.schema).withColumn("stratum", F.lit(i))
            out, taken = (row if out is None else out.unionByName(row)), taken + 1
            left = left.where(F.col(key) != pick[0][key])
    fill = left.orderBy(seeded(F.col(key), seed), key).limit(max(0, size - taken)).withColumn("stratum", F.lit(0))
    return fill if out is None else out.unionByName(fill)
