"""Exact vector similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, least: float = 1e-12) -> Column:
    """The vector at length one."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(least))
    return F.transform(v, lambda x: x.cast("double") / norm)


def nearest(df: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The ``k`` rows of greatest inner product with one query, ties by key; a distributed top-k without a full sort."""
    wanted = F.array(*(F.lit(float(x)) for x in query))
    return df.select(key, F.round(dot(F.col(vector), wanted), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def nearest_many(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 2_048) -> DataFrame:
    """The ``k`` rows of greatest inner product of every query (key, vector): query, key, score, rank; ties by key.

    Queries go to the tasks in blocks of ``block``, each a broadcast of that many
    vectors; every task keeps the best ``k`` of its rows per query, and what is
    shuffled is those.  Rows without a vector take no part.
    """
    spark, parts, held = df.sparkSession, [], []
    kind, arrow = df.schema[key].dataType.simpleString(), to_arrow_type(df.schema[key].dataType)

    def search(share) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, wanted = share.value
            best_s, best_k = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), object)
            for batch in batches:
                rows = batch.column(1)
                if not len(rows):
                    continue
                v = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
                keys = np.array(batch.column(0).to_pylist(), object)
                s = np.concatenate([best_s, np.round(wanted @ v.T, 6)], axis=1)
                names = np.concatenate([best_k, np.broadcast_to(keys, (len(ids), len(keys)))], axis=1)
                if s.shape[1] > k:  # all that tie with the last place stay
                    floor = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                    width = int((s >= floor[:, None]).sum(axis=1).max())
                    order = np.argsort(-s, axis=1, kind="stable")[:, :width]
                    s, names = np.take_along_axis(s, order, 1), np.take_along_axis(names, order, 1)
                best_s, best_k = s, names
            at = np.repeat(np.arange(len(ids)), best_s.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], arrow), pa.array(best_k.ravel().tolist(), arrow), pa.array(best_s.ravel(), pa.float64())], names=["query", key, "score"])

        return df.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"query {kind}, `{key}` {kind}, score double")

    def flush() -> None:
        share = spark.sparkContext.broadcast(([h[0] for h in held], np.array([h[1] for h in held], np.float64)))
        parts.append(search(share))
        held.clear()

    for row in queries.where(F.col(vector).isNotNull()).select(key, vector).toLocalIterator():
        held.append((row[0], list(row[1])))
        if len(held) == block:
            flush()
    if held:
        flush()
    if not parts:
        return spark.createDataFrame([], f"query {kind}, `{key}` {kind}, score double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def closest_entries(df: DataFrame, key: str, vector: str, entries: DataFrame, label: str, k: int, block: int = 2_048) -> DataFrame:
    """The ``k`` entries (label, vector) of greatest inner product of every row: key, label, score, rank; ties by label.

    Entries go to the tasks in blocks of ``block``, each a broadcast of that many
    vectors.  Up to one block nothing is shuffled; of several, a row's best of
    each meet.  Rows and entries without a vector take no part.
    """
    spark, parts, held = df.sparkSession, [], []
    kinds = [(d.schema[c].dataType.simpleString(), to_arrow_type(d.schema[c].dataType)) for d, c in ((df, key), (entries, label))]

    def search(share) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, known = share.value
            for batch in batches:
                rows = batch.column(1)
                if not len(rows):
                    continue
                v = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
                s = np.round(v @ known.T, 6)
                order = np.argsort(-s, axis=1, kind="stable")[:, :k]  # entries come by label
                n = order.shape[1]
                at = pa.array(np.repeat(np.arange(len(rows)), n))
                rank = np.tile(np.arange(1, n + 1, dtype=np.int32), len(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([names[j] for j in order.ravel()], kinds[1][1]), pa.array(np.take_along_axis(s, order, 1).ravel()), pa.array(rank)], names=[key, label, "score", "rank"])

        return df.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"`{key}` {kinds[0][0]}, `{label}` {kinds[1][0]}, score double, rank int")

    def flush() -> None:
        parts.append(search(spark.sparkContext.broadcast(([h[0] for h in held], np.array([h[1] for h in held], np.float64)))))
        held.clear()

    for row in entries.where(F.col(vector).isNotNull()).select(label, vector).orderBy(label).toLocalIterator():
        held.append((row[0], list(row[1])))
        if len(held) == block:
            flush()
    if held:
        flush()
    if not parts:
        return spark.createDataFrame([], f"`{key}` {kinds[0][0]}, `{label}` {kinds[1][0]}, score double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if len(parts) == 1:
        return found
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), label))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
