"""Mixing sources to target shares of the tokens by subset-sum budget fitting.

Method.  Documents are counted by source and exact token length.  A source
whose budget holds all its documents k times gives them k times; the remaining
budget is fitted by bounded-knapsack dynamic programming over the length
counts, and so many documents of each length, in seeded order, get one more
copy.  The programme runs over the last ``window`` tokens of the budget; what
lies before is taken in equal parts of every length.

Scale.  What is gathered per source is its length counts.  Which documents of a
length are chosen is decided by ranking within hash buckets, with the buckets'
sizes summed first, so that a length shared by a third of all documents is
never sorted in one task.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def fit_budget(lengths: list[int], counts: list[int], budget: int, max_repeats: int, window: int = 65_536, seed: int = 7) -> tuple[int, list[int]]:
    """(copies every document gets, how many documents of each length get one more)."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    more = [0] * len(lengths)
    if total <= 0 or budget <= 0 or max_repeats <= 0:
        return 0, more
    base = min(max_repeats, budget // total)
    rest = budget - base * total
    if base == max_repeats or rest == 0:
        return base, more
    order = [i for i, n in enumerate(lengths) if n > 0]
    random.Random(seed).shuffle(order)
    if rest > window:
        for i in order:
            more[i] = counts[i] * (rest - window) // total
        rest -= sum(more[i] * lengths[i] for i in order)
        moved = True
        while rest > window and moved:
            moved = False
            for i in order:
                if rest > window and more[i] < counts[i] and lengths[i] <= rest:
                    more[i] += 1
                    rest -= lengths[i]
                    moved = True
    top = rest + max((lengths[i] for i in order if more[i] < counts[i]), default=0)  # the nearest sum may lie above
    mask, reach = (1 << (top + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for i in order:
        left, k = min(counts[i] - more[i], top // lengths[i]), 1
        while left > 0 and not reach >> rest & 1:
            take = min(k, left)
            steps.append((i, take, reach))
            reach |= reach << take * lengths[i] & mask
            left, k = left - take, k * 2
        if reach >> rest & 1:
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    at = below
    if above and (up := rest + 1 + ((above & -above).bit_length() - 1)) - rest < rest - below:
        at = up
    for i, take, before in reversed(steps):
        if not before >> at & 1:
            more[i] += take
            at -= take * lengths[i]
    return base, more


_PLAN = "source string, tokens bigint, base bigint, more bigint"


def mix_sources(sizes: DataFrame, targets: DataFrame, seed: int = 7, window: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, copies of every document in the mix; the report per source).

    ``sizes`` has doc_id, source and tokens, ``targets`` source, target_share
    and max_repeats (a fixed small table; of repeated sources the first by
    values counts, a null share is 0, null repeats are 1).  Shares are of the
    tokens of all documents.  Documents of sources without target, and null
    sources, get no copy; a target without documents ends at share 0.  The
    report has source, target_share, max_repeats, documents, available_tokens,
    target_tokens, mixed_documents, mixed_tokens, off_by (tokens over the target,
    negative if under) and actual_share.
    """
    spark = sizes.sparkSession
    kept = cut_lineage(sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)).alias("tokens")))
    n_docs, total = kept.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    goals = targets.where("source is not null").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("g"))
    goals = goals.select("source", F.coalesce("g.target_share", F.lit(0.0)).alias("target_share"), F.coalesce(F.col("g.max_repeats"), F.lit(1)).cast("bigint").alias("max_repeats"))
    goals = goals.withColumn("target_tokens", F.round(F.col("target_share") * F.lit(total)).cast("bigint"))
    buckets = max(16, -(-n_docs // 1_000_000))
    kept = kept.withColumn("mark", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("mark", F.lit(buckets)))
    by_bucket = cut_lineage(kept.groupBy("source", "tokens", "bucket").agg(F.count("*").alias("n")))
    by_length = by_bucket.where("source is not null").groupBy("source", "tokens").agg(F.sum("n").alias("n")).join(F.broadcast(goals), "source")

    def plan(table: pa.Table) -> pa.Table:
        table = table.sort_by("tokens")
        source, budget, repeats = (table.column(c)[0].as_py() for c in ("source", "target_tokens", "max_repeats"))
        lengths, counts = table.column("tokens").to_pylist(), table.column("n").to_pylist()
        base, more = fit_budget(lengths, counts, budget, repeats, window, seed)
        return pa.table({"source": pa.array([source] * len(lengths), pa.string()), "tokens": pa.array(lengths, pa.int64()), "base": pa.array([base] * len(lengths), pa.int64()), "more": pa.array(more, pa.int64())})

    plans = by_length.groupBy("source").applyInArrow(plan, _PLAN)
    so_far = F.sum("n").over(Window.partitionBy("source", "tokens").orderBy("bucket")) - F.col("n")
    quota = cut_lineage(
        by_bucket.join(plans, ["source", "tokens"])
        .withColumn("take", F.least(F.greatest(F.col("more") - so_far, F.lit(0)), "n"))
        .where("base > 0 or take > 0")
    )
    picked = kept.join(quota.select("source", "tokens", "bucket", "base", "take", "n"), ["source", "tokens", "bucket"])
    whole = picked.where("take = n or take = 0").withColumn("copies", F.col("base") + (F.col("take") > 0).cast("bigint"))
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "bucket").orderBy("mark", "doc_id"))
    part = picked.where("take > 0 and take < n").withColumn("copies", F.col("base") + (rank <= F.col("take")).cast("bigint"))
    out = ["doc_id", "source", "tokens", "copies"]
    mix = whole.select(out).unionByName(part.select(out)).where("copies > 0")

    mixed = quota.groupBy("source").agg(
        F.sum(F.when(F.col("base") > 0, F.col("n")).otherwise(F.col("take"))).alias("mixed_documents"), F.sum(F.col("tokens") * (F.col("base") * F.col("n") + F.col("take"))).alias("mixed_tokens")
    )
    stock = by_bucket.groupBy("source").agg(F.sum("n").alias("documents"), F.sum(F.col("tokens") * F.col("n")).alias("available_tokens"))
    same = F.col("s.source").eqNullSafe(F.col("g.source"))
    report = (
        stock.alias("s").join(goals.alias("g"), same, "full_outer")
        .select(F.coalesce("s.source", "g.source").alias("source"), "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), "target_tokens")
        .join(mixed, "source", "left")
        .na.fill(0, ["mixed_documents", "mixed_tokens"])
        .withColumn("off_by", F.col("mixed_tokens") - F.col("target_tokens"))
        .withColumn("actual_share", F.round(F.try_divide(F.col("mixed_tokens"), F.lit(total)), 6))
    )
    return mix, report
