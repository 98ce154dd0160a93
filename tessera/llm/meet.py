"""Bringing together the documents that share a mark, without a square of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _meet(most: int):
    """From rows sorted by mark: pairs of the documents of a mark, or those of a mark with more than ``most`` one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, m):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.int64())], names=["a", "b", "mark"])

        hot, mark, doc = None, np.empty(0, np.int64), np.empty(0, np.int64)

        def flush(mark: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.append(True, (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1]))
            mark, doc = mark[new], doc[new]
            first = np.flatnonzero(np.append(True, mark[1:] != mark[:-1]))
            size = np.diff(np.append(first, len(mark)))
            two = first[size == 2]
            if len(two):
                yield out(doc[two], doc[two + 1], mark[two])
            for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                if n <= most:
                    x, y = np.triu_indices(n, 1)
                    yield out(doc[i + x], doc[i + y], np.full(len(x), mark[i]))
                else:
                    yield out(doc[i : i + n], [None] * n, mark[i : i + n])

        for batch in batches:
            mark = np.concatenate([mark, batch.column(0).to_numpy(zero_copy_only=False)])
            doc = np.concatenate([doc, batch.column(1).to_numpy(zero_copy_only=False)])
            if hot is not None:  # a mark known to be hot goes on
                n = int(np.searchsorted(mark, hot, "right"))
                if n:
                    yield out(doc[:n], [None] * n, mark[:n])
                mark, doc = mark[n:], doc[n:]
            if not len(mark):
                continue
            tail = int(np.searchsorted(mark, mark[-1], "left"))
            if tail:
                yield from flush(mark[:tail], doc[:tail])
            mark, doc, hot = mark[tail:], doc[tail:], None
            new = np.append(True, doc[1:] != doc[:-1])  # repeated rows once, however many there are
            mark, doc = mark[new], doc[new]
            if len(doc) > most:
                hot = mark[0]
                yield out(doc, [None] * len(doc), mark)
                mark, doc = mark[:0], doc[:0]
        if len(mark):
            yield from flush(mark, doc)

    return run


def meet(marks: DataFrame, most: int) -> DataFrame:
    """``marks`` (mark bigint, doc_id bigint) -> a, b, mark.

    A mark of up to ``most`` documents gives its pairs a < b; a larger one gives
    each of its documents once as ``a`` with a null ``b``, for the caller to
    resolve in another way.  Pairs that share several marks come several times.
    Rows pass as a sorted stream: a mark of any size needs the memory of ``most``.
    """
    ordered = marks.select("mark", "doc_id").repartition("mark").sortWithinPartitions("mark", "doc_id")
    return ordered.mapInArrow(_meet(most), "a bigint, b bigint, mark bigint")


def with_sides(pairs: DataFrame, rows: DataFrame, payload: str) -> DataFrame:
    """``pairs`` (a, b) with the ``payload`` of ``rows`` (id, ...) of both sides: a, b, <payload>_a, <payload>_b.

    ``rows`` moves once, one exchange serving both joins; of a pair's two
    payloads only the first moves with it.  Pairs lacking a side are left out.
    """
    one = rows.select("id", payload)
    first = pairs.select("a", "b").join(one, F.col("a") == F.col("id")).select("a", "b", F.col(payload).alias(f"{payload}_a"))
    return first.join(one, F.col("b") == F.col("id")).select("a", "b", f"{payload}_a", F.col(payload).alias(f"{payload}_b"))
