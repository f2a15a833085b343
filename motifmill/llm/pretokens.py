"""Splitting of texts into the words of a byte-level BPE, and a table of what is known of words.

The split is that of the usual pattern of byte-level tokenizers, applied to whole slices of bytes at once:
contractions; an optional space and letters, numbers or other characters; white space up to the last
character before something else; white space.  Special tokens stand by themselves.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from motifmill.llm.text import STEP, Rolling

SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        out[c] = kind.get(unicodedata.category(chr(c))[0], OTHER)
    for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = SPACE
    return out


def _classify(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    table = _classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | data[np.minimum(lead[more] + k, len(data) - 1)] & 0x3F
        kind = table[np.minimum(code, 0x10FFFF)]
        for k in range(4):
            more = size > k
            out[np.minimum(lead[more] + k, len(data) - 1)] = kind[more]
    return out


def split(data: np.ndarray, bounds: np.ndarray, special: tuple[bytes, ...] = ()) -> np.ndarray:
    """Starts of the words of adjoining texts that begin at ``bounds`` (its last entry is the end)."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = _classify(data)
    hard = np.zeros(len(data) + 1, bool)
    hard[bounds] = True
    for token in special:
        raw, at = data.tobytes(), -1
        while (at := raw.find(token, at + 1)) >= 0:
            if not hard[at + 1: at + len(token)].any():
                kind[at: at + len(token)] = SPECIAL
                hard[at] = hard[at + len(token)] = True
    begin = hard[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    begin[0] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    # White space before something else gives up its last character.
    k = np.flatnonzero((kind[starts] == SPACE) & ~hard[ends])
    last = ends[k] - 1
    while (inside := data[last] & 0xC0 == 0x80).any():
        last = last - inside
    begin[last] = True
    begin[ends[k][data[last] == 0x20]] = False
    # An apostrophe that begins a word takes the ending of a contraction.
    quote = np.flatnonzero((data[:-1] == 0x27) & begin[:-1] & (kind[1:] == LETTER) & ~hard[1:-1])
    if len(quote):
        one = data[np.minimum(quote + 1, len(data) - 1)]
        two = np.where(hard[np.minimum(quote + 2, len(data))], 0, data[np.minimum(quote + 2, len(data) - 1)])
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for found, size in ((quote[short], 2), (quote[long], 3)):
            begin[found + 1] = False
            after = found + size
            after = after[after < len(data)]
            begin[after[~hard[after] & (kind[after] == LETTER)]] = True
    return np.flatnonzero(begin)


class WordTable:
    """Values of distinct words: ids in one pool, found by the words' hashes.

    ``encode`` gets a list of words (bytes) and returns a list of id arrays.  The table is emptied when it has
    more than ``limit`` words, so its memory is bounded.
    """

    def __init__(self, encode, kind=np.uint32, limit: int = 1 << 20):
        self.encode, self.kind, self.limit = encode, kind, limit
        self._clear()

    def _clear(self):
        self.hashes = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(ids of all words in a row, number of ids of each word)."""
        if not len(starts):
            return self.pool[:0], np.zeros(0, np.int64)
        hashes = np.empty(len(starts), np.uint64)
        k = 0
        while k < len(starts):
            stop = max(k + 1, int(np.searchsorted(ends, starts[k] + STEP, "right")))
            low = starts[k]
            hashes[k:stop] = Rolling(data[low: ends[stop - 1]]).of(starts[k:stop] - low, ends[k:stop] - low)
            k = stop
        seen, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > self.limit:
            self._clear()
        at = np.searchsorted(self.hashes, seen)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == seen[known]
        if not known.all():
            new = np.flatnonzero(~known)
            words = [data[s:e].tobytes() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            ids = self.encode(words)
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            place = len(self.pool) + np.cumsum(count) - count
            self.pool = np.concatenate([self.pool, *ids]) if len(ids) < 64 else np.concatenate(
                [self.pool, np.concatenate(ids)])
            self.hashes = np.insert(self.hashes, at[new], seen[new])
            self.place = np.insert(self.place, at[new], place)
            self.count = np.insert(self.count, at[new], count)
            at = np.searchsorted(self.hashes, seen)
        at = at[back]
        count, place = self.count[at], self.place[at]
        stop = np.cumsum(count)
        take = np.arange(int(stop[-1])) + np.repeat(place - (stop - count), count)
        return self.pool[take], count
