"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

White space here is ASCII's, x20 and x09 to x0D, whose bytes never occur inside
another character, so all texts of a batch are cut in one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _UNBASE)):
            grown = np.full(max(n + 1, 1 << 16), base, np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each begins and ends; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def runs(kind: np.ndarray, bounds: np.ndarray, single: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal kinds but 0, cut at bounds; those of kind single have one byte each."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.empty(len(kind) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    if single >= 0:
        cut[1:-1] |= kind[1:] == single
    cut[bounds] = True
    cut[0] = cut[-1] = True
    full = kind != 0
    return np.flatnonzero(cut[:-1] & full), np.flatnonzero(cut[1:] & full) + 1


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs((~SPACE[data]).view(np.uint8), bounds)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, by differences of one running polynomial."""
    power, unpower = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * unpower[starts] + (ends - starts).astype(np.uint64))


def shingles(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words, and where each text's begin and end.

    A text of fewer words, but one at least, has all its words as its only shingle.
    """
    starts, ends = words(data, bounds)
    h, n = hashes(data, starts, ends), len(starts)
    first = np.searchsorted(starts, bounds)
    count = np.diff(first)
    if n < size:
        h = np.concatenate([h, np.zeros(size - n, np.uint64)])
    m = len(h) - size + 1
    out, q = np.zeros(m, np.uint64), np.uint64(0x100000001B3)
    for k in range(size):
        out = out * q + h[k : k + m]
    out = mixed(out)
    each = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(each)])
    at = np.repeat(first[:-1] - to[:-1], each) + np.arange(to[-1])
    out = out[np.minimum(at, m - 1)]
    for i in np.flatnonzero((count > 0) & (count < size)):
        v = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in h[first[i] : first[i + 1]]:
                v = v * q + x
        out[to[i]] = mixed(np.array([v + np.uint64(count[i])]))[0]
    return out, to


def shares(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, wide: int) -> np.ndarray:
    """Of each text the square roots of its shares of hashed pairs of bytes, and of hashed words; wide of either."""
    n, size = len(bounds) - 1, np.diff(bounds)
    bits = np.uint32(32 - (wide.bit_length() - 1))
    out = np.zeros((n, 2 * wide), np.float32)
    if len(data) > 1:
        pair = ((data[:-1].astype(np.uint32) << np.uint32(8) | data[1:]) * np.uint32(2654435761)) >> bits
        text = np.repeat(np.arange(n), size)
        whole = text[1:] == text[:-1]
        out[:, :wide] = np.bincount((text[:-1] * wide + pair)[whole], minlength=n * wide).reshape(n, wide) / np.maximum(size - 1, 1)[:, None]
    if len(starts):
        first = np.searchsorted(starts, bounds)
        text = np.repeat(np.arange(n), np.diff(first))
        word = (hashes(data, starts, ends) % np.uint64(wide)).astype(np.int64)
        out[:, wide:] = np.bincount(text * wide + word, minlength=n * wide).reshape(n, wide) / np.maximum(np.diff(first), 1)[:, None]
    return np.sqrt(out)
