"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies; a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pre-token pattern published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A plain space beside other white space: there a pre-token may cross it.
_TOUCHING = re.compile(r" \s|\s ")


class _Sizes(dict):
    """Token counts of ' ' + word, kept for short words; emptied when it holds ``most``."""

    def __init__(self, encode, most: int = 1_000_000):
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> int:
        n = len(self.encode(" " + word))
        if len(word) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


class TokenCounter:
    """Exact token counts.

    A pre-token holds a space only at its front or within a run of white space,
    so a text may be cut before every space that stands between two other
    characters, and the counts of the parts add up.  Words recur, so nearly all
    parts are looked up.
    """

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sizes = _Sizes(self.encode)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if _TOUCHING.search(text):
            return len(self.encode(text))
        first, *rest = text.split(" ")
        return len(self.encode(first)) + sum(map(self.sizes.__getitem__, rest))


_COUNTERS: dict[int, TokenCounter] = {}


def counter_of(vocabulary: bytes) -> TokenCounter:
    """The counter of a vocabulary, built once per Python worker."""
    key = hash(vocabulary)
    if key not in _COUNTERS:
        _COUNTERS[key] = TokenCounter(vocabulary)
    return _COUNTERS[key]


def count_tokens(df: DataFrame, text: str, keep: dict[str, str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` (column -> Spark type) and ``tokens`` (bigint), row by row; a null text has no tokens.

    The vocabulary (under 1 MB) travels with the tasks, so only the driver needs the file.
    """
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(shared.value)
        for batch in batches:
            tokens = pa.array([count(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], tokens], names=[*keep, "tokens"])

    picked = df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in keep.items()), F.col(f"`{text}`").cast("string").alias("_text"))
    return picked.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in keep.items()), "tokens bigint"]))
