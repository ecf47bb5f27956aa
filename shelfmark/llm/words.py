"""Words of UTF-8 texts as 64-bit hashes, a whole Arrow batch at a time in numpy.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D, as in
``[^\\x20\\x09-\\x0D]+``. Equal words have equal hashes wherever they stand; the hash is a
polynomial over the ring of 64-bit integers of randomised byte codes, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes hashed at a time: arrays of eight times this size stay near the caches.
WINDOW = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_R = 0x9E6C63D0676A9A99
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> list[np.ndarray]:
    """r**i and r**-i modulo 2**64 for i below n."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, r in enumerate((_R, pow(_R, -1, 1 << 64))):
                steps = np.full(n, r, _U)
                steps[0] = 1
                _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


class Words:
    """hashes: of all words; first: index of each text's first word, then their number.

    begin, end: each word's bytes in data, if asked for.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, spans: bool = False, hashed: bool = True):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        raw = raw[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.data = raw
        space = _SPACE[raw]
        begins = ~space
        begins[1:] &= space[:-1]
        cut = offsets[:-1][np.diff(offsets) > 0]
        begins[cut] = ~space[cut]
        ends = ~space
        ends[:-1] &= space[1:]
        ends[cut[1:] - 1] |= ~space[cut[1:] - 1]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(begin, offsets)
        if spans:
            self.begin, self.end = begin, end
        del begins, ends, space
        if not hashed:
            return
        out = np.empty(len(begin), _U)
        k = 0
        with np.errstate(over="ignore"):
            while k < len(begin):
                last = max(k + 1, int(np.searchsorted(end, begin[k] + WINDOW, "right")))
                s, e = begin[k:last] - begin[k], end[k:last] - begin[k]
                part = raw[begin[k] : end[last - 1]]
                up, down = _powers(max(len(part), WINDOW))
                sums = np.empty(len(part) + 1, _U)
                sums[0] = 0
                np.cumsum(_CODES[_LOWER[part] if lower else part] * up[: len(part)], out=sums[1:])
                out[k:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U))
                k = last
        self.hashes = out

    def __len__(self) -> int:
        return len(self.first) - 1


def pair(x: np.ndarray, y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Ordered combination of two hashes."""
    return mix(x * _U(0x9FB21C651E98DF25 + 2 * seed) + (y ^ _U(0xD6E8FEB86659FD93 + seed)) * _U(0xC2B2AE3D27D4EB4F))


def rolling(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every k consecutive entries (len(h) - k + 1 of them) by doubling."""
    if len(h) < k:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        n, out, width, level, size = len(h) - k + 1, None, 0, h, 1
        while k:
            if k & 1:
                part = level[width : width + n]
                out = part if out is None else pair(out, part, seed)
                width += size
            k >>= 1
            if k:
                level, size = pair(level[:-size], level[size:], seed), size * 2
    return out


def slices(batches, limit: int = 4 << 20, column: str = "text"):
    """Splits incoming Arrow batches so that none holds much more than ``limit`` text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        size = np.frombuffer(text.cast(pa.large_string()).buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        cut = np.unique(np.searchsorted(size, np.arange(size[0], size[-1] + limit, limit)))
        cut = [0, *[int(x) for x in cut if 0 < x < len(text)], len(text)]
        for a, b in zip(cut, cut[1:]):
            if b > a:
                yield batch.slice(a, b - a)
