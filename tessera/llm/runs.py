"""Collapsing runs of near-identical consecutive events by adjacent agglomeration.

Method.  Every event starts as a run of one.  The runs of an entity form a
linked list; a priority queue holds its links, the most similar neighbours
first (equal similarity: the smaller gap, then the earlier place).  The best
link is taken and its two runs become one, until no link meets both limits.
The similarity of two neighbouring runs is one less the edit distance of two
reduced tags over the longer one's length.  Which two tags, the linkage says:
``touching``, those of the two events that touch; ``typical``, the tag most
frequent in each run (equal counts: the earlier), in which case every merge may
change what its neighbours are like, and their links are keyed anew.

Scale.  An entity may hold a third of all events, so entities are not tasks.
Events are hashed by entity and stretch of time, sorted, and agglomerated per
stretch as Arrow batches pass; only the first and the last run of a stretch can
go on elsewhere, and a window over those few rows joins them.  That holds for
``touching``; under ``typical`` a merge may reach as far as gaps allow, so there
a task takes whole stretches between pauses longer than the gap limit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bound on floating error when seconds with few decimals are subtracted.
_SLACK = 1e-6


def edits_within(a: str, b: str, most: int) -> int | None:
    """Edit distance of two strings if it is at most ``most``, else None."""
    if a == b:
        return 0
    if most == 0 or abs(len(a) - len(b)) > most:
        return None
    i, limit = 0, min(len(a), len(b))
    while i < limit and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j, limit = 0, min(len(a), len(b))
    while j < limit and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: len(b) - j]
    if not a or not b:
        return len(a) + len(b) if len(a) + len(b) <= most else None
    row = list(range(len(b) + 1))
    for x, ca in enumerate(a, 1):
        last, row[0] = row[0], x
        for y, cb in enumerate(b, 1):
            last, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, last + (ca != cb))
        if min(row) > most:
            return None
    return row[-1] if row[-1] <= most else None


def agglomerate(tags: list[str], starts: np.ndarray, ends: np.ndarray, max_gap: float, max_edits: int, linkage: str = "touching") -> np.ndarray:
    """First places of the runs of one ordered sequence; an empty tag never joins."""
    n = len(tags)
    gaps = starts[1:] - ends[:-1]
    seen: dict[tuple[str, str], float | None] = {}

    def similarity(a: str, b: str) -> float | None:
        if a == b:
            return 1.0 if a else None
        if not a or not b:
            return None
        if (a, b) not in seen:
            d = edits_within(a, b, max_edits)
            seen[a, b] = None if d is None else 1.0 - d / max(len(a), len(b))
        return seen[a, b]

    near = gaps <= max_gap + _SLACK
    links = [(-s, gaps[i], i, 0) for i in np.flatnonzero(near).tolist() if (s := similarity(tags[i], tags[i + 1])) is not None]
    heapq.heapify(links)
    following = list(range(1, n + 1))  # of each run's head: the head of the next run
    head = list(range(n))  # of each run's last event: the run's head
    typical, counts, current = list(tags), {}, [0] * n  # of each run's head; the number of a link's last key, by its place
    while links:
        _, _, i, key = heapq.heappop(links)
        if key != current[i]:
            continue
        left, right = head[i], i + 1
        after = following[right]
        following[left] = after
        head[after - 1] = left
        current[i] = -1
        if linkage == "touching":
            continue
        held = counts.pop(left, None) or {tags[left]: [1, left]}
        for tag, (c, at) in (counts.pop(right, None) or {tags[right]: [1, right]}).items():
            held.setdefault(tag, [0, at])[0] += c
        counts[left] = held
        typical[left] = min(held, key=lambda t: (-held[t][0], held[t][1]))
        for place, a, b in ((left - 1, head[left - 1] if left else None, left), (after - 1, left, after if after < n else None)):
            if a is None or b is None or not near[place]:
                continue
            current[place] += 1
            if (s := similarity(typical[a], typical[b])) is not None:
                heapq.heappush(links, (-s, gaps[place], place, current[place]))
    places, at = [], 0
    while at < n:
        places.append(at)
        at = following[at]
    return np.array(places, dtype=np.int64)


_PIECE = (
    "entity string, first_item string, last_item string, tag string, n bigint, start double, `end` double, "
    "first_key string, last_key string, opens boolean, closes boolean"
)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches that cut no stretch."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        entity, place = batch.column("entity").to_pylist(), batch.column("place").to_pylist()
        cut = batch.num_rows
        while cut and (entity[cut - 1], place[cut - 1]) == (entity[-1], place[-1]):
            cut -= 1
        if kept and (cut or (kept[-1].column("entity")[-1].as_py(), kept[-1].column("place")[-1].as_py()) != (entity[0], place[0])):
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            kept = [batch.slice(cut)]
        elif cut:
            yield batch.slice(0, cut)
            kept = [batch.slice(cut)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _pieces(max_gap: float, max_edits: int, linkage: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if linkage == "touching" else _whole(batches):
            n = batch.num_rows
            if not n:
                continue
            entity, item, tag, key = (batch.column(batch.schema.get_field_index(c)) for c in ("entity", "item", "tag", "key"))
            start = batch.column("start").to_numpy(zero_copy_only=False)
            end = batch.column("end").to_numpy(zero_copy_only=False)
            place = batch.column("place").to_numpy(zero_copy_only=False)
            keys = key.to_pylist()
            code = entity.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((code[1:] != code[:-1]) | (place[1:] != place[:-1])) + 1
            bounds = [0, *cuts.tolist(), n]
            heads = [agglomerate(keys[a:b], start[a:b], end[a:b], max_gap, max_edits, linkage) + a for a, b in zip(bounds, bounds[1:], strict=False)]
            first = np.concatenate(heads)
            last = np.append(first[1:], n) - 1
            opens, closes = np.isin(first, bounds), np.isin(last + 1, bounds)
            f, t = pa.array(first), pa.array(last)
            yield pa.RecordBatch.from_arrays(
                [entity.take(f), item.take(f), item.take(t), tag.take(f), pa.array(last - first + 1), pa.array(start[first]), pa.array(end[last]), key.take(f), key.take(t), pa.array(opens), pa.array(closes)],
                names=["entity", "first_item", "last_item", "tag", "n", "start", "end", "first_key", "last_key", "opens", "closes"],
            )

    return run


def collapse_runs(
    df: DataFrame, entity: str, item: str, start: str, end: str, tag: str, max_gap: float = 20.0, max_edits: int = 1, stretch: float = 7200.0, linkage: str = "touching"
) -> DataFrame:
    """One row per run: entity, first_item, last_item, tag, n_items, start_sec, end_sec, duration_sec.

    Neighbours in order of ``start`` (then ``item``) may join if both tags are
    present, the tags' letters a-z and digits in lower case are within
    ``max_edits`` edits, and the gap from one's end to the next's start is at
    most ``max_gap``; overlaps are negative gaps.  ``tag`` is the first event's
    spelling.  A null ``end`` counts as ``start``; an event whose start is null
    has no place in the order and is a run of its own, as is one without tag;
    events of a null entity form one sequence.  An empty table gives no rows.
    """
    base = df.select(
        F.col(f"`{entity}`").cast("string").alias("entity"),
        F.col(f"`{item}`").cast("string").alias("item"),
        F.col(f"`{start}`").cast("double").alias("start"),
        F.coalesce(F.col(f"`{end}`").cast("double"), F.col(f"`{start}`").cast("double")).alias("end"),
        F.col(f"`{tag}`").cast("string").alias("tag"),
    ).withColumn("key", F.regexp_replace(F.lower(F.coalesce("tag", F.lit(""))), "[^a-z0-9]", ""))
    if linkage not in ("touching", "typical"):
        raise ValueError(f"unknown linkage {linkage}")
    order = Window.partitionBy("entity").orderBy("start", "item")
    paused = F.coalesce(F.col("start") - F.lag("end").over(order) > max_gap + _SLACK, F.lit(True))
    placed = base.where("start is not null")
    if linkage == "touching":
        placed = placed.withColumn("place", F.floor(F.col("start") / F.lit(stretch)).cast("double"))
    else:
        placed = placed.withColumn("place", F.when(paused, F.lit(1)).otherwise(0)).withColumn("place", F.sum("place").over(order).cast("double"))
    placed = placed.repartition("entity", "place").sortWithinPartitions("entity", "place", "start", "item")
    pieces = placed.mapInArrow(_pieces(max_gap, max_edits, linkage), _PIECE)
    inner = pieces.where("not opens and not closes").select("entity", "first_item", "last_item", "tag", "n", "start", "end")
    order = Window.partitionBy("entity").orderBy("start", "first_item")
    joins = (
        F.col("opens")
        & F.lag("closes").over(order)
        & (F.col("first_key") != "")
        & (F.lag("last_key").over(order) != "")
        & (F.col("start") - F.lag("end").over(order) <= max_gap + _SLACK)
        & (F.levenshtein(F.col("first_key"), F.lag("last_key").over(order)) <= max_edits)
    )
    if linkage == "typical":  # a stretch between pauses has no neighbour to join
        joins = F.lit(False)
    edge = pieces.where("opens or closes").withColumn("breaks", F.when(joins, 0).otherwise(1))
    edge = edge.withColumn("run", F.sum("breaks").over(order)).groupBy("entity", "run").agg(
        F.min_by("first_item", F.struct("start", "first_item")).alias("first_item"),
        F.max_by("last_item", F.struct("start", "first_item")).alias("last_item"),
        F.min_by("tag", F.struct("start", "first_item")).alias("tag"),
        F.sum("n").alias("n"),
        F.min("start").alias("start"),
        F.max_by("end", F.struct("start", "first_item")).alias("end"),
    )
    alone = base.where("start is null").select("entity", F.col("item").alias("first_item"), F.col("item").alias("last_item"), "tag", F.lit(1).cast("bigint").alias("n"), "start", "end")
    return (
        inner.unionByName(edge.drop("run"))
        .unionByName(alone)
        .select("entity", "first_item", "last_item", "tag", F.col("n").alias("n_items"), F.col("start").alias("start_sec"), F.col("end").alias("end_sec"), F.round(F.col("end") - F.col("start"), 6).alias("duration_sec"))
    )
