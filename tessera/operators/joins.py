"""Joins for enrichment: fallback keys, nearest earlier row, merged sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in a stated order, as one aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.`{c}`").alias(c) for c in rest))


def fallback_join(left: DataFrame, right: DataFrame, chains: Sequence[Sequence[tuple[str, str]]], values: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left join on the first key chain that has a match.

    Each chain lists (left column, right column) pairs.  The right side is cut
    to one row per key for every chain, so left rows never multiply; null keys
    match nothing.  Adds ``values`` and ``matched_by`` (number of the chain from
    1, null without match).
    """
    out, hits = left, []
    for i, chain in enumerate(chains, 1):
        keys = [r for _, r in chain]
        side = first_per_key(right.select(*dict.fromkeys([*keys, *values, *_names(right, order)])).dropna(subset=keys), keys, order)
        side = side.select(*(F.col(r).alias(f"_k{i}_{r}") for r in keys), F.struct(*values).alias(f"_v{i}"))
        on = [F.col(f"`{a}`") == F.col(f"_k{i}_{b}") for a, b in chain]
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        out = out.join(side, condition, "left").drop(*(f"_k{i}_{r}" for r in keys))
        hits.append(f"_v{i}")
    best = F.coalesce(*hits)
    by = F.coalesce(*(F.when(F.col(h).isNotNull(), F.lit(i)) for i, h in enumerate(hits, 1)))
    return out.withColumn("_best", best).withColumn("matched_by", by).select(*left.columns, *(F.col(f"_best.`{v}`").alias(v) for v in values), "matched_by")


def _names(df: DataFrame, order: Sequence[Column]) -> list[str]:
    return [c for c in df.columns if any(c in str(o) for o in order)]


def merge_sides(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], later_wins: bool = True) -> DataFrame:
    """Full outer join on ``key``; shared columns take the later (or earlier) side's value that is not null."""
    x = a.select(F.col(key), *(F.col(c).alias(f"_a_{c}") for c in columns), F.lit(True).alias("in_a"))
    y = b.select(F.col(key), *(F.col(c).alias(f"_b_{c}") for c in columns), F.lit(True).alias("in_b"))
    both = x.join(y, key, "full_outer")
    pick = (lambda c: F.coalesce(f"_b_{c}", f"_a_{c}")) if later_wins else (lambda c: F.coalesce(f"_a_{c}", f"_b_{c}"))
    return both.select(key, *(pick(c).alias(c) for c in columns), F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def inherit_last(df: DataFrame, sequence: str, order: Sequence[str], position: str, value: str, max_rows: int, max_distance: float) -> DataFrame:
    """As-of inheritance: rows without ``value`` take the last one before them in their sequence, if near enough.

    Adds ``inherited`` and ``inherited_from`` ('own', 'before' or null).  Near
    means at most ``max_rows`` rows and ``max_distance`` of ``position`` back.
    """
    over = Window.partitionBy(sequence).orderBy(*order)
    numbered = df.withColumn("_n", F.row_number().over(over))
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("_n").alias("n"), F.col(position).alias("p")))
    before = numbered.withColumn("_last", F.last(seen, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    near = (F.col("_n") - F.col("_last.n") <= max_rows) & (F.col(position) - F.col("_last.p") <= max_distance)
    return before.withColumn("inherited", F.when(F.col(value).isNotNull(), F.col(value)).when(near, F.col("_last.v"))).withColumn(
        "inherited_from", F.when(F.col(value).isNotNull(), "own").when(near, "before")
    ).drop("_n", "_last")


def range_lookup(df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Rows with the ranges [low, high] their whole ``value`` lies in.

    Ranges are cut into cells of ``width``, so it is an equality join of any
    size; ``width`` should be about that of a range.
    """
    cells = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))).alias("_cell")
    cut = ranges.where(F.col(low) <= F.col(high)).select("*", cells)
    return df.withColumn("_cell", F.floor(F.col(value) / width)).join(cut, "_cell").where(F.col(value).between(F.col(low), F.col(high))).drop("_cell")
