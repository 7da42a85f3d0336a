"""Vectorised word kernels over the byte buffers of Arrow string columns.

Used inside ``mapInArrow`` tasks: Spark partitions the rows, these functions
only turn one batch of texts into word boundaries and 64-bit word hashes.
Work is done in cache-sized blocks cut at white space; what is kept per text
is a few integers per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, BLOCK + 4096)
        _POW[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_P, _INV)]
    return _POW[0][:n], _POW[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the n + 1 offsets (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that end between words or texts."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + BLOCK)
        if b < n:
            k = int(offsets[np.searchsorted(offsets, b, "right") - 1])  # the last text start
            if k > a:
                b = k
            else:
                gap = np.flatnonzero(_SPACE[data[a:b]])
                while not len(gap) and b < n:  # one word longer than a block
                    b = min(n, b + BLOCK)
                    end = int(offsets[np.searchsorted(offsets, a, "right")])
                    b = min(b, end)
                    gap = np.flatnonzero(_SPACE[data[a:b]])
                    if b == end:
                        break
                if len(gap):
                    b = a + int(gap[-1]) + 1
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and the n + 1 word offsets of the texts."""
    starts, ends, hashes = [], [], []
    for a, b in _blocks(data, offsets):
        part = data[a:b]
        solid = ~_SPACE[part]
        first = np.zeros(b - a + 1, bool)  # where a text starts
        lo, hi = np.searchsorted(offsets, [a, b])
        inner = offsets[lo:hi] - a
        first[inner[inner <= b - a]] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | first[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | first[1:-1]
        s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
        up, down = _powers(b - a)
        byte = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte * up, dtype=np.uint64)])
        h = (total[e] - total[s]) * down[s]
        hashes.append(mix(h ^ ((e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
        starts.append(s + a)
        ends.append(e + a)
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64)
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(s, offsets)


_K = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def grams(h: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text (word offsets ``at``) the hashes of its k-word windows, in order.

    A text of fewer words has one window, the whole of it; one without words none.
    """
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        out += h[i : i + len(out)] * _K[i]
    out = mix(out + np.uint64(k))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield out[a : b - k + 1]
        elif b > a:
            yield mix(np.array([(h[a:b] * _K[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield h[:0]
