"""Whole batches of texts as flat numpy arrays: words, word hashes, shingles and rolling hashes without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base of the rolling hash and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (_BASE, _BACK)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and where each row starts; null counts as empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of lower-cased (A-Z) texts."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lower: bool = True):
        self.data, self.starts = (_LOWER[data] if lower else data), starts
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.begin, starts)  # words begin[at[d]:at[d + 1]] are document d's
        self.count = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(starts) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.begin):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.data) + 1)
        run = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[self.data] * up[:-1])))
        return mix((run[self.end] - run[self.begin]) * down[self.begin] + (self.end - self.begin).astype(np.uint64))

    def prefix_hashes(self, sizes: tuple[int, ...]) -> list[np.ndarray]:
        """Hashes of each word's first so many bytes, or of all it has, one array a size."""
        if not len(self.begin):
            return [np.zeros(0, np.uint64) for _ in sizes]
        up, down = powers(len(self.data) + 1)
        run = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[self.data] * up[:-1])))
        return [mix((run[np.minimum(self.begin + k, self.end)] - run[self.begin]) * down[self.begin] + np.uint64(k << 32)) for k in sizes]

    def suffix_hashes(self, size: int) -> np.ndarray:
        """The hash of each word's last ``size`` bytes, or of all it has."""
        if not len(self.begin):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.data) + 1)
        run = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[self.data] * up[:-1])))
        first = np.maximum(self.end - size, self.begin)
        return mix((run[self.end] - run[first]) * down[first])


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document the sorted distinct hashes of its shingles of ``k`` words, end to end, and their bounds.

    A document of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    h, n = words.hashes(), len(words.begin)
    acc = np.zeros(n, np.uint64)
    sizes = np.where(words.count >= k, words.count - k + 1, np.minimum(words.count, 1))
    for j in range(k):
        acc[: n - j] = mix(acc[: n - j] * np.uint64(0xD6E8FEB86659FD93) + h[j:] + np.uint64(j + 1)) if n > j else acc[: n - j]
    for d in np.flatnonzero((words.count < k) & (words.count > 0)):
        one = np.zeros(1, np.uint64)
        for j, x in enumerate(h[words.at[d] : words.at[d + 1]]):
            one = mix(one * np.uint64(0xD6E8FEB86659FD93) + x + np.uint64(j + 1))
        acc[words.at[d]] = mix(one + np.uint64(words.count[d]))[0]
    parts, bounds = [], np.zeros(len(sizes) + 1, np.int64)
    for d, (a, m) in enumerate(zip(words.at, sizes, strict=False)):
        if m:
            own = acc[a : a + m]
            own.sort()
            if m > 1:
                keep = np.empty(m, bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
            parts.append(own)
            bounds[d + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(bounds)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` bytes that start at each place, over the texts as they lie end to end."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    run = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * up[:-1])))
    return mix((run[k:] - run[:-k]) * down[:n])


def arrays(flat: np.ndarray, bounds: np.ndarray, kind=None) -> pa.Array:
    """Arrow lists from end-to-end values and bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat) if kind is None else pa.array(flat, kind))
