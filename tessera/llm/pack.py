"""Filling fixed-capacity containers by the sum-of-squares rule.

Method.  N(g) counts the open containers with gap g.  Each document goes to the
container, open or new, after which the sum of N(g) squared is smallest; equal
sums go to the fullest container.  Documents come in order of falling size,
which measured half the waste of random order.  A document larger than the
capacity fills containers of its own and only its remainder is placed.

Scale.  Documents are hashed into shards of about ``shard_docs``, packed
independently and each by a task of its own, so no task grows with the corpus.
The containers in which a shard leaves more than 1 / ``slack`` of the room are
opened again, and their contents packed in a second pass, in shards of the same
size drawn from all of the first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, written_table

_FAR = 1 << 40


def sum_of_squares(sizes: Sequence[int], capacity: int) -> list[int]:
    """The container of each size, all between 1 and ``capacity``, in the order given."""
    open_at = np.zeros(capacity + 1, np.int64)  # by fill: the gap counts, mirrored
    stacks: dict[int, list[int]] = {}
    where, made = [], 0
    for s in sizes:
        fill, best = 0, (2 * int(open_at[s]) + 1 if s < capacity else 0)
        if s < capacity:
            levels = open_at[1 : capacity - s]
            if levels.size:
                change = np.where(levels > 0, open_at[1 + s : capacity] - levels, _FAR)[::-1]
                j = int(change.argmin())
                if change[j] < _FAR and 2 * int(change[j]) + 2 <= best:
                    fill, best = capacity - s - 1 - j, 2 * int(change[j]) + 2
            if open_at[capacity - s] and 1 - 2 * int(open_at[capacity - s]) <= best:
                fill = capacity - s
        if fill:
            box = stacks[fill].pop()
            open_at[fill] -= 1
        else:
            box, made = made, made + 1
        where.append(box)
        if fill + s < capacity:
            open_at[fill + s] += 1
            stacks.setdefault(fill + s, []).append(box)
    return where


def pack_documents(sizes: Sequence[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document index, piece, first token, tokens, container) for every piece of every document."""
    out, items, made = [], [], 0
    for i, n in enumerate(sizes):
        for k in range(n // capacity):
            out.append((i, k, k * capacity, capacity, made))
            made += 1
        if n % capacity:
            items.append((i, n // capacity, n - n % capacity, n % capacity))
    items.sort(key=lambda x: -x[3])
    boxes = sum_of_squares([x[3] for x in items], capacity)
    out += [(*x, made + b) for x, b in zip(items, boxes, strict=True)]
    return out + [(i, 0, 0, 0, 0) for i, n in enumerate(sizes) if not n]


_OUT = "capacity_id int, container bigint, place int, doc_id bigint, piece int, first_token bigint, tokens bigint"


def _placed(rows: np.ndarray, capacity: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of :func:`pack_documents` by container, their place in it, and whether it is to be opened again."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0], rows[:, 4]))]
    box = rows[:, 4]
    first = np.flatnonzero(np.append(True, box[1:] != box[:-1])) if len(box) else box
    sizes = np.diff(np.append(first, len(box)))
    fill = np.add.reduceat(rows[:, 3], first) if len(box) else box
    return rows, np.arange(len(box)) - np.repeat(first, sizes) + 1, np.repeat((capacity - fill) * slack >= capacity, sizes)


def _table(cid: int | None, box: np.ndarray, place: np.ndarray, ids: pa.Array, piece: np.ndarray, first: np.ndarray, tokens: np.ndarray, again: np.ndarray | None = None) -> pa.Table:
    columns = {
        "capacity_id": pa.array(np.full(len(box), cid, np.int32)) if cid is not None else pa.nulls(len(box), pa.int32()),
        "container": pa.array(box),
        "place": pa.array(place.astype(np.int32)),
        "doc_id": ids,
        "piece": pa.array(piece.astype(np.int32)),
        "first_token": pa.array(first),
        "tokens": pa.array(tokens),
    }
    return pa.table(columns if again is None else {**columns, "again": pa.array(again)})


def pack_containers(sizes: DataFrame, capacities: DataFrame, shard_docs: int = 10_000, slack: int = 32) -> DataFrame:
    """capacity_id, container, place (from 1), doc_id, piece (from 0), first_token, tokens.

    ``sizes`` has doc_id and tokens, ``capacities`` capacity_id and
    capacity_tokens (a fixed small table).  Every row of ``sizes`` is placed for
    every capacity.  Without tokens (or with null) it takes no room and lies in
    its shard's first container.  Null or non-positive capacities are left out.
    """
    rooms = [(r[0], r[1]) for r in capacities.select("capacity_id", "capacity_tokens").distinct().orderBy(F.col("capacity_id").asc_nulls_last()).collect() if r[1] and r[1] > 0]
    kept = cut_lineage(sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.greatest(F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)), F.lit(0)).alias("tokens")))
    if not rooms:
        return kept.sparkSession.createDataFrame([], _OUT)
    shards = max(1, -(-kept.count() // shard_docs))
    kept = kept.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tokens", "descending"), ("doc_id", "ascending")])
        ids, tokens, shard = table.column("doc_id").combine_chunks(), table.column("tokens").to_pylist(), table.column("shard")[0].as_py()
        parts = []
        for cid, room in rooms:
            rows, place, again = _placed(np.array(pack_documents(tokens, room), np.int64).reshape(-1, 5), room, slack)
            parts.append(_table(cid, rows[:, 4] + (shard << 32), place, ids.take(pa.array(rows[:, 0])), rows[:, 1], rows[:, 2], rows[:, 3], again))
        return pa.concat_tables(parts)

    once = written_table(kept.groupBy("shard").applyInArrow(run, _OUT + ", again boolean"))
    opened = {r[0]: -(-r[1] // shard_docs) for r in once.where("again").groupBy("capacity_id").count().collect()}
    before, bases = 0, {}
    for cid, _ in rooms:
        bases[cid] = before
        before += opened.get(cid, 0)
    if not before:
        return once.drop("again")
    turn = F.lit(None).cast("int")
    for cid, n in opened.items():
        turn = F.when(F.col("capacity_id").eqNullSafe(F.lit(cid)), F.pmod(F.xxhash64("doc_id", "piece", F.lit(7)), F.lit(n)).cast("int") + bases[cid]).otherwise(turn)
    rest = once.where("again").select("capacity_id", "doc_id", "piece", "first_token", "tokens", turn.alias("shard")).repartitionById(before, F.col("shard"))

    def rerun(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        cid, shard = table.column("capacity_id")[0].as_py(), table.column("shard")[0].as_py()
        room = dict(rooms)[cid]
        rows, place, _ = _placed(np.array(pack_documents(table.column("tokens").to_pylist(), room), np.int64).reshape(-1, 5), room, slack)
        pick = pa.array(rows[:, 0])
        piece, first = (table.column(c).combine_chunks().take(pick).to_numpy(zero_copy_only=False) for c in ("piece", "first_token"))
        return _table(cid, rows[:, 4] + ((shards + shard) << 32), place, table.column("doc_id").combine_chunks().take(pick), piece, first, rows[:, 3])

    return once.where("not again").drop("again").unionByName(rest.groupBy("shard").applyInArrow(rerun, _OUT))


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, room left and its share."""
    made = packed.groupBy("capacity_id", "container").agg(F.sum("tokens").alias("tokens")).groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    room = F.col("containers") * F.col("capacity_tokens")
    return made.join(F.broadcast(capacities.select("capacity_id", "capacity_tokens").distinct()), "capacity_id").select(
        "capacity_id", "capacity_tokens", "containers", "tokens", (room - F.col("tokens")).alias("room_left"), F.round(1 - F.col("tokens") / room, 6).alias("room_left_share")
    )
