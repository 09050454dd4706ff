"""Vectorised word and n-gram hashing over Arrow string batches.

Hashes are polynomials modulo 2**64 over randomised byte values, mixed at the
end, computed for a whole batch with prefix sums: no Python step per word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19  # bytes hashed at once; tables of powers stay in memory, 16 bytes each
SPACES = (9, 10, 11, 12, 13, 32)

_rng = np.random.default_rng(20260117)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
        up[0] = down[0] = 1
        up[1:], down[1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        _powers[base] = have = up, down
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the public splitmix64 step)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    large = pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32) if n else np.zeros(1, np.int32)
    offsets = raw[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2] if n else None
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    buf, offsets = buf[offsets[0] : offsets[-1]], offsets - offsets[0]
    return buf, offsets


class Words:
    """The white-space separated words of a batch of texts.

    ``start``/``end`` are byte positions, ``bound`` has n + 1 word positions: the
    words of text i are ``bound[i]:bound[i + 1]``; ``hash`` (and ``hash2``, an
    independent one, if asked for) are 64-bit word hashes.
    """

    def __init__(self, column: pa.Array, lower: bool = False, second: bool = False):
        self.buf, self.offsets = text_buffer(column)
        starts, ends, one, two = [], [], [], []
        at, n = 0, len(self.buf)
        while at < n:
            stop = self._stop(at, min(n, at + SEGMENT))
            s, e = self._spans(at, stop)
            if len(s):
                starts.append(s), ends.append(e)
                one.append(self._hash(at, stop, s, e, _BYTE, _BASE, lower))
                if second:
                    two.append(self._hash(at, stop, s, e, _BYTE_2, _STEP, lower))
            at = stop
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.start, self.end = join(starts, np.int64), join(ends, np.int64)
        self.hash = join(one, np.uint64)
        self.hash2 = join(two, np.uint64) if second else None
        self.bound = np.searchsorted(self.start, self.offsets)

    def _stop(self, at: int, stop: int) -> int:
        """A place at or after ``stop`` where no word of one text is cut."""
        n = len(self.buf)
        step = 1 << 16
        while stop < n:
            ahead = np.flatnonzero(_IS_SPACE[self.buf[stop : stop + step]])
            if len(ahead):
                return stop + int(ahead[0])
            stop += step
        return n

    def _spans(self, at: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        word = ~_IS_SPACE[self.buf[at:stop]]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cut = self.offsets[np.searchsorted(self.offsets, at, "right") : np.searchsorted(self.offsets, stop)] - at
        cut = cut[(cut > 0) & (cut < stop - at)]
        first[cut] |= word[cut]
        last[cut - 1] |= word[cut - 1]
        return np.flatnonzero(first) + at, np.flatnonzero(last) + at + 1

    def _hash(self, at, stop, s, e, table, base, lower) -> np.ndarray:
        part = self.buf[at:stop]
        if lower:
            table = table[_LOWER]
        up, down = powers(base, stop - at + 1)
        total = np.empty(stop - at + 1, np.uint64)
        total[0] = 0
        values = table[part]
        values *= up[: stop - at]
        np.cumsum(values, out=total[1:])
        out = total[e - at]
        out -= total[s - at]
        out *= down[s - at]
        out ^= (e - s).astype(np.uint64)
        return mix(out)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.bound)

    def text(self, i: int) -> slice:
        return slice(int(self.bound[i]), int(self.bound[i + 1]))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the bytes start:end of each span of ``buf``; starts and
    ends ascend."""
    out = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        at = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, at + SEGMENT, "right")))
        s, e = start[i:j] - at, end[i:j] - at
        part = buf[at : at + int(e[-1])]
        for h, table, base in zip(out, (_BYTE, _BYTE_2), (_BASE, _STEP)):
            up, down = powers(base, len(part) + 1)
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            values = table[part]
            values *= up[: len(part)]
            np.cumsum(values, out=total[1:])
            x = total[e]
            x -= total[s]
            x *= down[s]
            x ^= (e - s).astype(np.uint64)
            h[i:j] = mix(x)
        i = j
    return out


def windows(hashes: np.ndarray, k: int, base: int = _STEP) -> np.ndarray:
    """Hashes of all runs of k consecutive items; too short: none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= np.uint64(base)
            out += hashes[j : j + n]
        return mix(out)
    up, down = powers(base, len(hashes) + 1)
    total = np.empty(len(hashes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    out = total[k:] - total[:-k]
    out *= down[:n]
    return mix(out)


def release() -> None:
    """Gives memory back to the system: workers outlive their tasks, and so would their heaps and tables."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it has its own ways
        pass


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch whose texts have about ``most`` bytes together."""
    col = batch.column(column)
    _, offsets = text_buffer(col)
    at, n = 0, batch.num_rows
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        stop = min(stop, n)
        yield batch.slice(at, stop - at)
        at = stop
