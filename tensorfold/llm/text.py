"""Vectorised work on UTF-8 texts that lie one after another in a buffer: words, hashes of runs of bytes, shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: The bytes that part words: space and 9 to 13.
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and each row's bounds (n + 1 of them, from 0); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def chunks(bounds: np.ndarray, most: int | None = None):
    """Ranges of rows with at most so many bytes; a longer row makes a range of its own."""
    most = most or CHUNK_BYTES
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all (splitmix64's finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Powers of the base up to a tile, and of the tile's power, so that any power is a product of two.
TILE = 1 << 16
_powers: dict[int, np.ndarray] = {}


def _accumulated(base: int, n: int) -> np.ndarray:
    key = (base, n)
    if key not in _powers:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        _powers[key] = np.multiply.accumulate(x)
    return _powers[key]


def _down(at: np.ndarray) -> np.ndarray:
    """The base's inverse to each power."""
    low = _accumulated(int(INVERSE), TILE)
    if not len(at) or int(at.max()) < TILE:
        return low[at]
    high = _accumulated(pow(int(INVERSE), TILE, 1 << 64), 1 << (int(at.max()) // TILE).bit_length())
    return low[at & (TILE - 1)] * high[at >> 16]


class Runs:
    """Hashes of any runs of a buffer's bytes (or of other symbols that have codes), from one pass over it. Equal runs have equal hashes, wherever they lie.

    Eight bytes a symbol are held, besides tiles.
    """

    def __init__(self, data: np.ndarray, codes: np.ndarray = BYTE_CODE):
        n = len(data)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        up, scale = _accumulated(int(BASE), TILE), 1
        for i in range(0, n, TILE):
            part = codes[data[i : i + TILE]] * up[: min(TILE, n - i)]
            if i:
                part *= U(scale)
            np.cumsum(part, out=self.sums[i + 1 : i + 1 + len(part)])
            if i:
                self.sums[i + 1 : i + 1 + len(part)] += self.sums[i]
            scale = scale * pow(int(BASE), TILE, 1 << 64) % (1 << 64)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _down(start)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64))

    def fixed(self, k: int) -> np.ndarray:
        """Of every run of k bytes."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        out, down, scale = self.sums[k:] - self.sums[:n], _accumulated(int(INVERSE), TILE), 1
        for i in range(0, n, TILE):
            part = out[i : i + TILE]
            part *= down[: len(part)]
            if i:
                part *= U(scale)
            part[:] = mix(part)
            scale = scale * pow(int(INVERSE), TILE, 1 << 64) % (1 << 64)
        return out


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each row's words begin among them (n + 1 bounds)."""
    space = IS_SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:], after[:-1] = space[:-1], space[1:]
        filled = bounds[:-1] < bounds[1:]
        before[bounds[:-1][filled]] = True
        after[bounds[1:][filled] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of runs of bytes that follow one another, some at a time: a hash of bytes takes eight times their room."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, "right")))
        low = starts[at]
        part = data[low : ends[to - 1]]
        out[at:to] = Runs(LOWER[part] if lower else part).of(starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and where each row's words begin among them."""
    starts, ends, first = words(data, bounds)
    return hashes_of(data, starts, ends, lower), first


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of ``width`` words of a row, or of the whole row if it has fewer; and each row's bounds among them."""
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out_first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], count)
    left = np.repeat(np.minimum(n, width), count)
    out, padded = np.zeros(len(at), np.uint64), np.concatenate([hashes, np.zeros(width, np.uint64)])
    whole = bool((n >= width).all())
    for k in range(width):
        part = padded[at + k]
        out = out * BASE + (part if whole else np.where(k < left, part, U(k + 1)))
    return mix(out), out_first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted, each once, and the rows' new bounds."""
    parts = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return np.concatenate(parts) if parts else values[:0], np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
