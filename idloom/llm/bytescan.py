"""Text columns as flat bytes: words, folded letters and hashes of whole batches in numpy.

A word is a maximal run of letters, digits and bytes from 0x80 up (``alnum``), or of anything but the six ASCII
blanks (``blank``). Nothing here loops over words in Python, and a text is never cut: a batch holds whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 1 << 21
_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_code = np.arange(256)
BLANK = np.isin(_code, [9, 10, 11, 12, 13, 32])
UPPER = (_code >= 65) & (_code <= 90)
LOWER = (_code >= 97) & (_code <= 122)
DIGIT = (_code >= 48) & (_code <= 57)
HIGH = _code >= 128
ALNUM = UPPER | LOWER | DIGIT | HIGH
_FOLD = np.where(UPPER, _code + 32, _code).astype(np.uint8)


def batches(text: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows that hold about ``most`` bytes; a null is an empty text."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    buffers = text.buffers()
    off = np.frombuffer(buffers[1], np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8."""
    out = _FOLD[data]
    if len(out) > 1:
        after = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][after] += 32
    return out


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of true bytes; a run ends where its text does."""
    if not len(mask):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(mask)]
    first[edge] |= mask[edge]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    cut = edge[edge > 0] - 1
    last[cut] |= mask[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _powers(base: np.uint64, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    p = kept.get(int(base))
    if p is None or len(p) < n:
        p = np.full(max(n, BATCH_BYTES + 1), base, np.uint64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if len(p) <= 4 * BATCH_BYTES:
            kept[int(base)] = p
    return p[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one prefix polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_B, n), out=h[1:])
    return mix((h[ends] - h[starts]) * _powers(_BI, n + 1)[starts])


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, for each place where k words follow."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(_B, n), out=p[1:])
    return mix((p[k:] - p[:-k]) * _powers(_BI, n + 1)[: n - k + 1], 7)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over values[bounds[i]:bounds[i + 1]], zero for an empty range."""
    c = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=c[1:], dtype=c.dtype)
    return c[bounds[1:]] - c[bounds[:-1]]
