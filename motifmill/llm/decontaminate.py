"""Search for benchmark items in documents, by edit distance.

An item of L bytes may have k = floor(max_share * L) edits.  It is cut into k // 2 + 1 groups, so one group at least has at most
one edit, and one of that group's halves has none.  Each half is therefore looked up at every byte of a document, and
what is found is followed into the other half with at most one edit.  No item within the limit is missed.

* Texts are reduced to lower-case letters and digits with one space between words; Unicode white space, punctuation and
  symbols separate words as well.  Letters of scripts without spaces need none: halves are looked up at every byte.
* Halves that are found are aligned with the whole item exactly, and count if at most k of its bytes have to be edited.
* Items with fewer than ``SHORT`` bytes are too short to be told from chance if edited: they are looked for as they are, as
  whole words.
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from motifmill.llm.tables import prepare
from motifmill.llm.text import STEP, ranges_of, texts_of, tidied

#: Bytes of benchmark text that are sent to the executors at once; more is searched in turns.
SLICE = 8 << 20
#: Items with fewer bytes are looked for without edits.
SHORT = 16
#: Bytes of a half that are looked up, and those of the other half that are compared.
KEY, NEAR = 8, 16
FILTER_BITS = 22
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Characters of two to four bytes that separate words.
_PARTS = np.array([unicodedata.category(chr(c))[0] in "ZPS" or 0x80 <= c < 0xA0 or c == 0x200B for c in range(0x20000)])
_PARTS[:0x80] = False


def _separators(data: np.ndarray) -> np.ndarray:
    """The bytes of characters beyond ASCII that separate words."""
    out = []
    for low, high, n in ((0xC2, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0xF8, 4)):
        at = np.flatnonzero((data >= low) & (data < high))
        at = at[at + n <= len(data)]
        code = (data[at] & (0x7F >> n)).astype(np.int64)
        for k in range(1, n):
            code = code << 6 | data[at + k] & 0x3F
        at = at[(code < len(_PARTS)) & _PARTS[np.minimum(code, len(_PARTS) - 1)]]
        out += [at + k for k in range(n)]
    return np.concatenate(out)


def plain(column) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case words with a space after each, and the offsets of the rows.

    What is found out about each byte takes some twenty times the text, so it is done for pieces of about ``STEP`` bytes.
    """
    data, offsets = texts_of(pc.utf8_lower(column.cast(pa.large_string())))
    parts, places = [data[:0]], np.zeros(len(offsets), np.int64)
    size, before, a = 0, False, 0
    while a < len(data):
        b = min(a + STEP, len(data))
        while b < len(data) and data[b] & 0xC0 == 0x80:  # a character stays in one piece
            b += 1
        own = data[a:b]
        keep = _WORD[own]
        keep[_separators(own)] = False
        ends = np.empty(len(own), bool)  # places that close a word: the first other byte, or the end of a row
        ends[0], ends[1:] = before and not keep[0], keep[:-1] & ~keep[1:]
        # A word at the end of a row has no byte after it, so the row's last word stays without a space.
        i, j = np.searchsorted(offsets, [a, b])
        ends[offsets[i:j] - a] = False
        taken = keep | ends
        count = np.cumsum(taken)
        places[i:j] = size + count[offsets[i:j] - a] - taken[offsets[i:j] - a]
        parts.append(np.where(keep, own, np.uint8(32))[taken])
        size, before, a = size + int(count[-1]), keep[-1], b
    places[np.searchsorted(offsets, len(data)):] = size
    return np.concatenate(parts), places


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def _slot(keys):
    return ((keys * _MIX) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _within_one(x: np.ndarray, size: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the first ``size`` bytes of each row of ``x`` are a beginning of that row of ``y``, one longer, with one edit at most."""
    past = np.arange(x.shape[1]) >= size[:, None]

    def last(same):
        wrong = ~same
        return np.where(wrong.any(axis=1), x.shape[1] - 1 - wrong[:, ::-1].argmax(axis=1), -1)

    same = (x == y[:, :-1]) | past
    first = np.where(same.all(axis=1), x.shape[1], same.argmin(axis=1))
    lost = np.ones_like(same)  # the document lacks a byte
    lost[:, 1:] = (x[:, 1:] == y[:, :-2]) | past[:, 1:]
    more = (x == y[:, 1:]) | past
    return (last(same) <= first) | (last(lost) <= first) | (last(more) < first)


class Items:
    """Halves of the items of one slice of a benchmark, by their first bytes."""

    def __init__(self, ids: list, texts: pa.Array, max_share: float = 0.1):
        data, offsets = plain(texts)
        self.ids = ids
        self.texts = [data[a:b].tobytes().rstrip() for a, b in zip(offsets[:-1], offsets[1:])]
        self.most = [math.floor(max_share * len(t)) if len(t) >= SHORT else 0 for t in self.texts]
        # By the bytes of the key: (key, item, start, bytes on which way, other half).
        seeds: dict[tuple[int, bool], list] = {}
        for item, text in enumerate(self.texts):
            if not text:
                continue
            if len(text) < SHORT:
                seeds.setdefault((min(KEY, len(text)), True), []).append((text[:KEY], item, 0, 0, 0, b""))
                continue
            groups = max(1, min(self.most[item] // 2 + 1, len(text) // 2))
            cuts = [len(text) * g // (2 * groups) for g in range(2 * groups + 1)]
            for h in range(2 * groups):
                a, b = cuts[h], cuts[h + 1]
                if h % 2:
                    other, step, edge = text[cuts[h - 1]: a][::-1][:NEAR], -1, -1
                else:
                    other, step, edge = text[b: cuts[h + 2]][:NEAR], 1, b - a
                n = min(KEY, b - a)
                seeds.setdefault((n, False), []).append((text[a: a + n], item, a, edge, step, other))
        self.tables = []
        for (n, whole), own in sorted(seeds.items()):
            keys = np.array([int.from_bytes(x[0], "little") for x in own], np.uint64)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            own = [own[k] for k in order]
            hit = np.zeros(1 << FILTER_BITS, bool)
            hit[_slot(keys)] = True
            near = np.frombuffer(b"".join(x[5].ljust(NEAR, b"\0") for x in own), np.uint8).reshape(-1, NEAR)
            item, start, edge, step, size = (np.array(v, np.int64) for v in zip(*((*x[1:5], len(x[5])) for x in own)))
            self.tables.append((n, whole, hit, keys, item, start, edge, step, size, near))

    def candidates(self, data: np.ndarray, bounds: np.ndarray):
        """(place in ``data``, item, place in the item) of halves that are in ``data`` with at most one edit in the other half."""
        room = NEAR + 1
        pad = room + max([int(t[6].max()) for t in self.tables], default=0) + KEY
        padded = np.concatenate([np.zeros(pad, np.uint8), data, np.zeros(pad, np.uint8)])
        for low in range(0, len(data), 1 << 17):
            size = min(1 << 17, len(data) - low)
            bytes_ = padded[pad + low: pad + low + size + KEY]
            words = np.zeros(size, np.uint64)
            for k in range(KEY):
                words |= bytes_[k: k + size].astype(np.uint64) << np.uint64(8 * k)
            for n, whole, filter_, keys, item, start, edge, step, other, near in self.tables:
                found = words & _mask(n)
                at = np.flatnonzero(filter_[_slot(found)])
                left, right = np.searchsorted(keys, found[at], "left"), np.searchsorted(keys, found[at], "right")
                at, left, count = at[right > left], left[right > left], (right - left)[right > left]
                ends = np.cumsum(count)
                # A key that many items have is worked through in rounds of bounded size.
                k = 0
                while k < len(at):
                    j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + (1 << 17), "right")))
                    m = count[k:j]
                    which = np.arange(m.sum()) + np.repeat(left[k:j] - (np.cumsum(m) - m), m)
                    place = np.repeat(at[k:j], m) + low
                    k = j
                    if not whole:
                        for part in range(0, len(which), 1 << 14):
                            w, p = which[part: part + (1 << 14)], place[part: part + (1 << 14)]
                            y = padded[(p + pad + edge[w])[:, None] + step[w][:, None] * np.arange(room)]
                            ok = _within_one(near[w], other[w], y)
                            if ok.any():
                                yield p[ok], item[w[ok]], start[w[ok]]
                    elif len(which):
                        yield self._whole(data, bounds, place, item[which])

    def _whole(self, data, bounds, place, item):
        """Of places and short items those where the item stands as whole words."""
        keep = np.zeros(len(place), bool)
        for k, (p, t) in enumerate(zip(place.tolist(), item.tolist())):
            text = self.texts[t]
            row = np.searchsorted(bounds, p, "right") - 1
            a, b, end = int(bounds[row]), int(bounds[row + 1]), p + len(text)
            if end > b or data[p:end].tobytes() != text:
                continue
            # Letters of scripts without spaces stand next to each other whatever the word.
            keep[k] = ((p == a or data[p - 1] == 32 or _spaceless(data, p, text[:1]))
                       and (end == b or data[end] == 32 or _spaceless(data, end, text[-1:])))
        return place[keep], item[keep], np.zeros(int(keep.sum()), np.int64)


def _spaceless(data, at, byte):
    """Whether a word may end between two characters at ``at``: both have three bytes or more, or the item's own has."""
    near = data[max(0, at - 3): at + 3].tobytes()
    own = byte[0]
    if own < 128:
        return False
    before = near[: min(3, at)].decode("utf-8", "ignore")[-1:]
    after = near[min(3, at):].decode("utf-8", "ignore")[:1]
    return any(c >= "\u0e00" for c in before) and any(c >= "\u0e00" for c in after)


def distance_within(item: bytes, region: bytes, most: int) -> int:
    """The least edit distance of ``item`` to any part of ``region``, or most + 1 if it is larger."""
    if item in region:
        return 0
    # Of twice as many pieces as edits are allowed, each edit spoils one at most.
    size = len(item) // (2 * most) if most else 0
    if size:
        lost = 0
        for k in range(0, size * 2 * most, size):
            lost += item[k: k + size] not in region
            if lost > most:
                return most + 1
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8)
    if not len(b):
        return min(len(a), most + 1)
    # Rows are bytes of the item; a part may begin anywhere.
    steps = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    for c in a:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != c))
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return most + 1
    return int(min(row.min(), most + 1))


def _found(batch, items: Items):
    """(row, item, distance, word) of the items that are in a batch's texts."""
    data, offsets = plain(batch.column("text"))
    for i, j in ranges_of(offsets, 1 << 20):
        low = int(offsets[i])
        own, bounds = data[low: int(offsets[j])], offsets[i: j + 1] - low
        tried = set()
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for place, item, start in items.candidates(own, bounds):
            if not len(place):
                continue
            row = np.searchsorted(bounds, place, "right") - 1
            for r, p, t, s in zip(row.tolist(), place.tolist(), item.tolist(), start.tolist()):
                text = items.texts[t]
                most = items.most[t]
                spot = (r, t, (p - s) // max(1, most))
                if spot in tried or best.get((r, t), (1,))[0] == 0:
                    continue
                tried.add(spot)
                a, b = max(int(bounds[r]), p - s - 2 * most), min(int(bounds[r + 1]), p - s + len(text) + 2 * most)
                d = distance_within(text, own[a:b].tobytes(), most)
                if d <= most and d < best.get((r, t), (most + 1,))[0]:
                    words = int((own[bounds[r]: max(int(bounds[r]), p - s)] == 32).sum())
                    best[r, t] = d, words
        for (r, t), (d, words) in sorted(best.items()):
            yield i + r, t, d, words


@tidied
def _search(batches, items):
    held = items.value
    for batch in batches:
        found = list(_found(batch, held))
        rows = pa.array([x[0] for x in found], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), pa.array([held.ids[x[1]] for x in found], pa.int64()),
             pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64()),
             pa.array([len(held.texts[x[1]].decode("utf-8", "replace")) for x in found], pa.int64())],
            names=["doc_id", "item_id", "distance", "word", "item_chars"])


def _slices(benchmark: DataFrame, max_share: float):
    """The benchmark's items, broadcast in slices of bounded size."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(
        "text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // SLICE)
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        table = part.orderBy("item_id", "text").toArrow()
        yield sc.broadcast(Items(table["item_id"].to_pylist(), table["text"].combine_chunks(), max_share))


def find_items(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.1) -> DataFrame:
    """(doc_id, item_id, distance, word, item_chars): the items of ``benchmark`` (item_id, text) that are in ``docs`` (doc_id, text).

    An item is in a document if some part of the document's text is at an edit distance of at most ``max_share`` of the
    item's length; both are taken as lower-case words.  ``distance`` is the smallest found and ``word`` the
    number of words before it.  One row per row of ``docs`` and item, repeated rows included.  Null and empty texts and items
    match nothing; items with fewer than ``SHORT`` bytes of words are in a document only as they are, as whole words.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance long, word long, item_chars long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _slices(benchmark, max_share):
        out = out.union(docs.mapInArrow(lambda b, x=items: _search(b, x), schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.1) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    prepare(docs.sparkSession)

    @tidied
    def clean(batches, items):
        for batch in batches:
            texts = batch.select(["text"])
            dirty = {x[0] for x in _found(texts, items.value)}
            yield batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)], pa.bool_()))

    for items in _slices(benchmark, max_share):
        docs = docs.mapInArrow(lambda b, x=items: clean(b, x), docs.schema)
    return docs
