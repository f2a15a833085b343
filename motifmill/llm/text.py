"""Bytes of Arrow text columns as numpy arrays, and rolling hashes over them.

Everything works on slices of bounded size: a prefix sum takes about 40 bytes per byte of text, so
callers go through a batch in steps of ``STEP`` bytes, whatever the length of its texts.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
import time

import numpy as np
import pyarrow as pa

STEP = 1 << 18
#: Bytes that one polynomial hashes.
BLOCK = 128
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
# Random odd codes of the byte values.
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _CODES.copy()
_FOLDED[65:91] = _CODES[97:123]
#: The bytes that end a word: space, tab, line ends, vertical tab and form feed.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _give_back() -> None:
    """Return to the system what earlier batches of this worker have freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_C, "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


_C = ctypes.CDLL(None)
#: Seconds between two times that a worker gives memory back after a piece of work.
_PAUSE = 0.25
_last = [0.0]


def tidied(work):
    """``work`` on a group or on batches; what it has freed goes back to the system when it is done.

    A worker outlives its task and waits for others beside new ones, so what it holds by then counts.
    """
    def done():
        if time.monotonic() - _last[0] > _PAUSE:
            _give_back()
            _last[0] = time.monotonic()

    def batches(found):
        yield from found
        del found
        _give_back()

    @functools.wraps(work)
    def run(*args, **more):
        found = work(*args, **more)
        if inspect.isgenerator(found):
            return batches(found)
        done()
        return found
    return run


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; nulls are empty."""
    _give_back()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of ``base`` modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, STEP + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have)
    return have[:n]


class Rolling:
    """Hashes of arbitrary stretches of one slice of bytes."""

    def __init__(self, data: np.ndarray, fold_case: bool = False):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        codes = (_FOLDED if fold_case else _CODES)[data]
        codes *= _power(_BASE, n)
        np.cumsum(codes, out=self.sums[1:])
        self.back = _power(_INVERSE, n + 1)

    def _short(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.sums[ends] - self.sums[starts]
        out *= self.back[starts]
        return mix(out)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes of each stretch.

        Polynomials modulo 2**64 take some texts of 1,024 bytes and more for one another whatever the base, so a long
        stretch is hashed in blocks, too short for that, one after the other.
        """
        out = self._short(starts, np.minimum(ends, starts + BLOCK))
        more = np.flatnonzero(ends - starts > BLOCK)
        at, stop = starts[more] + BLOCK, ends[more]
        while len(more):
            upto = np.minimum(at + BLOCK, stop)
            out[more] = mix(out[more] * np.uint64(_BASE) + self._short(at, upto))
            left = upto < stop
            more, at, stop = more[left], upto[left], stop[left]
        return out

    def grams(self, width: int) -> np.ndarray:
        """The hash of every ``width`` bytes, one after the other."""
        out = self.sums[width:] - self.sums[:-width]
        out *= self.back[: len(out)]
        return mix(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold_case: bool = True):
    """Hashes of the words of all rows, and the index of each row's first word (one more at the end).

    A word is a longest run of bytes other than ``BLANK``; words never cross rows.
    """
    solid = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + STEP, "right")))
        low = starts[k]
        rolling = Rolling(data[low: ends[stop - 1]], fold_case)
        hashes[k:stop] = rolling.of(starts[k:stop] - low, ends[k:stop] - low)
        k = stop
    return hashes, np.searchsorted(starts, offsets)


def shingles_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` consecutive words; with fewer words, of all of them."""
    if not len(hashes):
        return hashes
    if len(hashes) < width:
        seed = len(hashes)
        for h in hashes.tolist():
            seed = int(mix(np.array([(seed * 3 + h) & _MASK], np.uint64))[0])
        return np.array([seed], np.uint64)
    n = len(hashes) - width + 1
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += hashes[j: j + n] * np.uint64((2 * j + 3) * _BASE & _MASK | 1)
    return np.unique(mix(total))


def ranges_of(offsets: np.ndarray, limit: int = STEP):
    """Runs of rows with at most ``limit`` bytes; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j
