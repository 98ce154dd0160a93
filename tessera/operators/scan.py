"""Ordered passes with state, for rules where each row's result depends on the results before it.

Rows are hashed by entity and sorted; a partition passes as a stream, so an
entity of any size needs the memory of its state alone.  These rules are
sequential within an entity by nature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_scan(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], start: Callable[[], object], schema: str) -> DataFrame:
    """Run a state machine over each entity's rows in order.

    ``start()`` gives an object with ``row(values) -> list of output rows`` and
    ``end() -> list of output rows``, for one entity; ``values`` are ``columns``
    in order.  Output rows are tuples after ``schema``; the entity comes first.
    """
    picked = df.select(F.col(entity).alias("_e"), *columns, *(c for c in order if c not in columns))
    ordered = picked.repartition("_e").sortWithinPartitions("_e", *order)
    out_type = T._parse_datatype_string(schema)
    kinds = [T_arrow(f.dataType) for f in out_type.fields]
    names = [f.name for f in out_type.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        machine, current = None, None
        for batch in batches:
            out = []
            for e, *values in zip(*(batch.column(i).to_pylist() for i in range(1 + len(columns))), strict=True):
                if machine is None or e != current:
                    if machine is not None:
                        out += [(current, *r) for r in machine.end()]
                    machine, current = start(), e
                out += [(e, *r) for r in machine.row(values)]
            if out:
                yield emit(out)
        if machine is not None and (last := [(current, *r) for r in machine.end()]):
            yield emit(last)

    return ordered.mapInArrow(run, schema)


def T_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class Consolidation:
    """Chunks of rows of one tag within budgets; short chunks join the one before them.

    First pass: a chunk takes rows until the tag changes, a gap exceeds
    ``gap``, or span or characters would exceed their budgets.  Second pass: a
    chunk shorter than ``same`` seconds joins the one before it if the tags are
    equal, one shorter than ``any_tag`` whatever the tags, if the two stay within ``slack`` times the budgets.
    """

    def __init__(self, gap=25.0, span=140.0, chars=2600, same=55.0, any_tag=25.0, slack=1.35):
        self.gap, self.span, self.chars, self.same, self.any_tag, self.slack = gap, span, chars, same, any_tag, slack
        self.open = self.kept = None  # (start, end, n, chars, tag)

    def row(self, values):
        start, end, chars, tag = values
        end = start if end is None else end
        c = self.open
        if c and tag == c[4] and start - c[1] <= self.gap and end - c[0] <= self.span and c[3] + 1 + chars <= self.chars:
            self.open = (c[0], max(c[1], end), c[2] + 1, c[3] + 1 + chars, tag)
            return []
        out = self._close()
        self.open = (start, end, 1, chars, tag)
        return out

    def _close(self):
        c, k = self.open, self.kept
        if c is None:
            return []
        if k is not None:
            length = c[1] - c[0]
            small = (length < self.same and c[4] == k[4]) or length < self.any_tag
            if small and c[1] - k[0] <= self.span * self.slack and k[3] + 1 + c[3] <= self.chars * self.slack:
                self.kept = (k[0], max(k[1], c[1]), k[2] + c[2], k[3] + 1 + c[3], k[4])
                return []
        self.kept = c
        return [k] if k is not None else []

    def end(self):
        out = self._close()
        return [*out, self.kept] if self.kept is not None else out


def consolidate(df: DataFrame, entity: str, start: str, end: str, text: str, tag: str, **budgets) -> DataFrame:
    """entity, start_sec, end_sec, n_rows, n_chars, tag; rows without start are left out, a null tag is a tag of its own."""
    rows = df.where(F.col(start).isNotNull()).select(entity, F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("t"), F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("bigint").alias("c"), F.col(tag).alias("g"))
    return ordered_scan(rows, entity, ["s", "t", "g"], ["s", "t", "c", "g"], lambda: Consolidation(**budgets), f"{entity} string, start_sec double, end_sec double, n_rows bigint, n_chars bigint, tag string")


class Hold:
    """Keeps the last choice while its score stays within ``within`` of the best and at least ``least``; resets on flagged rows."""

    def __init__(self, within=0.025, least=0.48):
        self.within, self.least, self.held = within, least, None

    def row(self, values):
        ident, scores, reset = values
        if reset:
            self.held = None
            return [(ident, None, "reset")]
        scored = {s["tag"]: s["score"] for s in scores or []}
        best = min(scored, key=lambda t: (-scored[t], t), default=None)
        if best is None:
            return [(ident, self.held, "carried" if self.held else "none")]
        held = self.held
        if held in scored and held != best and scored[held] >= scored[best] - self.within and scored[held] >= self.least:
            return [(ident, held, "held")]
        self.held = best
        return [(ident, best, "best")]

    def end(self):
        return []


def sticky_hold(df: DataFrame, entity: str, order: Sequence[str], ident: str, scores: str, reset: str, **limits) -> DataFrame:
    """entity, row id, tag and basis ('best', 'held', 'carried', 'reset', 'none'); ``scores`` is an array of (tag, score)."""
    return ordered_scan(df, entity, list(order), [ident, scores, reset], lambda: Hold(**limits), f"{entity} string, {ident} string, tag string, basis string")
