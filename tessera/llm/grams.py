"""Rolling hashes of character grams and the marks that any long shared stretch has in common."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, np.uint64(b), np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all ``k``-grams of an array of code points."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=sums[1:])
    return _mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def marks_of(texts: list[str | None], least: int, chunk: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, mark) without repeats within a text, in chunks of about ``chunk`` characters.

    A text's marks are the least gram hashes of its stretches of ``least``
    characters, the grams being half as long.  Two texts that share such a
    stretch share its mark.
    """
    k = least // 2
    width = least - k + 1
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop] or "") <= chunk):
            size += len(texts[stop] or "")
            stop += 1
        kept = [i for i in range(start, stop) if texts[i] is not None and len(texts[i]) >= least]
        start = stop
        if not kept:
            continue
        codes = codes_of("".join(texts[i] for i in kept))
        lows = sliding_min(gram_hashes(codes, k), width)
        sizes = np.array([len(texts[i]) for i in kept])
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(kept)), sizes - least + 1)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes - least + 1) - (sizes - least + 1), sizes - least + 1) + first[owner]
        lows = lows[at]
        new = np.append(True, (lows[1:] != lows[:-1]) | (owner[1:] != owner[:-1]))
        lows, owner = lows[new], owner[new]
        order = np.lexsort((lows, owner))
        lows, owner = lows[order], owner[order]
        new = np.append(True, (lows[1:] != lows[:-1]) | (owner[1:] != owner[:-1]))
        yield np.array(kept)[owner[new]], lows[new].view(np.int64)
