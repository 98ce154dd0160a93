"""Cutting oversized texts into balanced, overlapping pieces at natural boundaries.

Method.  The least number of pieces follows from the length and the limit;
their ends are placed at equal distances; each end snaps to the strongest
boundary near its target (paragraph, line, sentence, clause, word; equal
strength: the nearest), and one more piece is planned whenever a piece would
exceed the limit.  A piece after the first begins up to ``overlap`` characters
before the end of the one before it, at the earliest boundary there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries, strongest first; a cut falls at the end of the match.
_BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*",
        r"(?:\r\n|\n|\r)\s*",
        r"[.!?…][\"'”»)\]]*\s+",
        r"[;:,]\s+",
        r"\s+",
    )
)


def _snap(text: str, target: int, low: int, high: int) -> int:
    """The strongest cut in (low, high], the nearest to ``target``; ``target`` itself if there is none."""
    for pattern in _BOUNDARIES:
        best = None
        for m in pattern.finditer(text, low, min(len(text), high + 1)):
            if low < m.end() <= high and (best is None or abs(m.end() - target) < abs(best - target)):
                best = m.end()
        if best is not None:
            return best
    # no boundary: cut at the target, yet not between a base character and what combines with it, nor within CR LF
    cut = min(max(target, low + 1), high)
    while low + 1 < cut < len(text) and (0x300 <= ord(text[cut]) <= 0x36F or text[cut - 1 : cut + 1] == "\r\n"):
        cut -= 1
    return cut


def _start_after(text: str, end: int, before: int, overlap: int) -> int:
    """Where the next piece begins: the first word, or better boundary, in the last ``overlap`` characters."""
    start = max(end - overlap, before + 1)
    for pattern in _BOUNDARIES:
        if m := next((m for m in pattern.finditer(text, start, end) if m.end() < end), None):
            return m.end()
    return start


def _balanced(text: str, count: int, limit: int, overlap: int) -> list[tuple[int, int]] | None:
    """``count`` pieces near equal targets, or None if one would exceed the limit."""
    n, start, end, pieces = len(text), 0, 0, []
    reach = max(1, min(n // count // 3, limit // 4))
    for k in range(1, count):
        target = round(k * n / count)
        high, low = min(target + reach, start + limit, n - 1), max(end, target - reach)
        if low >= high:
            return None
        end = _snap(text, min(target, high), low, high)
        pieces.append((start, end))
        start = _start_after(text, end, start, overlap)
    return [*pieces, (start, n)] if n - start <= limit else None


def cut_text(text: str, limit: int = 1200, overlap: int = 120) -> list[tuple[int, int]]:
    """Pieces of ``text`` as (start, end) offsets in characters.

    Each is at most ``limit`` long, together they cover the text, and two
    consecutive ones share at most ``overlap`` characters.  Pieces are added
    until a plan holds.  Only where the overlap is so near the limit that none
    does, whatever the count, are pieces filled from the front.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    least = 1 + math.ceil((n - limit) / (limit - overlap))
    for count in range(least, n + 1):
        if plan := _balanced(text, count, limit, overlap):
            return plan
    pieces, start, end = [], 0, 0
    while start + limit < n:
        end = _snap(text, start + limit, max(end, start + limit // 2), start + limit)
        pieces.append((start, end))
        start = _start_after(text, end, start, overlap)
    return [*pieces, (start, n)]


_OUT = "tbl string, record_key string, piece bigint, n_pieces bigint, start bigint, `end` bigint, overlap bigint, text string"


def split_oversized(df: DataFrame, key: str, text: str, label: str, limit: int = 1200, overlap: int = 120) -> DataFrame:
    """Pieces of every text of more than ``limit`` characters.

    Columns: tbl (= ``label``), record_key, piece (from 0), n_pieces, start and
    end (offsets in characters), overlap (characters shared with the piece
    before) and text.  Joining each piece's text without its first ``overlap``
    characters gives the text again.  Null and shorter texts give no rows;
    repeated rows are each cut.  The filter runs in the JVM, so only oversized
    texts reach Python, and no row moves.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces, before = cut_text(t, limit, overlap), 0
                for i, (a, b) in enumerate(pieces):
                    rows.append((label, k, i, len(pieces), a, b, max(0, before - a), t[a:b]))
                    before = b
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), *[pa.int64()] * 5, pa.string()), strict=True)],
                    names=["tbl", "record_key", "piece", "n_pieces", "start", "end", "overlap", "text"],
                )

    long = df.where(F.char_length(F.col(f"`{text}`")) > limit)
    return long.select(F.col(f"`{key}`").cast("string").alias("record_key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, _OUT)
