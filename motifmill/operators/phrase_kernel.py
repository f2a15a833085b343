"""Numpy helpers that work on whole phrases, or on blocks of very long ones, inside tasks.

A phrase is one row with its notes as lists and the hashes of the reduced pairs that its notes make with their
neighbours.  A merge surveys only the phrases that have one of its pairs: it says what their pairs were before
and what they are after, so counts are kept up to date by differences.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from motifmill.operators.merge_kernel import ShapeBounds, ranges, reach
from motifmill.params import Limits

NOTE = ["k", "shape_id", "onset", "pitch", "stretch", "velocity"]
K, SHAPE, ONSET, PITCH, STRETCH, VELOCITY = range(6)
NAME = ["piece_id", "track_number", "phrase", "chunk"]
PAIR = ["l", "r", "lr", "rr", "d", "dp"]
#: Notes that a task looks at in one go, unless a single phrase has more.
SLICE = 1 << 16
#: Notes of one boundary up to which every entry state of a block is tried.
STATES = 8


@dataclass(frozen=True)
class Rules:
    """What makes notes neighbours, and pairs count."""

    bounds: ShapeBounds
    adjacency: str
    gap: int
    limits: Limits


def pair_hash(keys: np.ndarray) -> np.ndarray:
    """Reduced pairs as 64 bits; equal pairs have equal hashes."""
    out = np.zeros(len(keys), np.uint64)
    for column in keys.T:
        out = (out ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


@dataclass
class Survey:
    """The neighbours of equal velocity among some notes: their reduced pairs, the hashes of these, the common unit,
    whether they count; and the totals of ``merge_kernel.count_pairs``."""

    left: np.ndarray
    right: np.ndarray
    keys: np.ndarray
    hashes: np.ndarray
    unit: np.ndarray
    counts: np.ndarray
    last: np.ndarray
    totals: list[int]


def survey(notes: np.ndarray, phrase: np.ndarray, rules: Rules, own: slice | None = None) -> Survey:
    """All neighbours of ``notes`` (or of those in ``own`` only), which lie phrase by phrase in order.

    Neighbours are counted by their ranges; only those of equal velocity, which stand next to each other when notes are
    ordered by phrase and velocity, are formed as pairs.
    """
    shape, onset, stretch, velocity = notes[SHAPE], notes[ONSET], notes[STRETCH], notes[VELOCITY]
    bounds, limits = rules.bounds, rules.limits
    stop, cut = reach(onset, onset + bounds.span[shape] * stretch, phrase, rules.gap, limits.neighbours)
    n = notes.shape[1]
    number = np.arange(n)
    few = slice(0, n) if own is None else own
    if own is not None:
        cut = cut[(cut >= own.start) & (cut < own.stop)]
    n_neighbours = int((stop[few] - number[few] - 1).sum())
    low = velocity.min(initial=0)
    by = np.argsort(phrase * (velocity.max(initial=0) - low + 1) + velocity - low, kind="stable")
    group = np.zeros(n, np.int64)
    group[by[1:]] = np.cumsum((phrase[by[1:]] != phrase[by[:-1]]) | (velocity[by[1:]] != velocity[by[:-1]]))
    rank = np.empty(n, np.int64)
    rank[by] = number
    until = np.searchsorted(group[by] * (n + 1) + by, group[few] * (n + 1) + stop[few])
    left, right = ranges(rank[few] + 1, until)
    left, right = left + few.start, by[right]
    last = right == stop[left] - 1
    n = few.stop - few.start
    distance = onset[right] - onset[left]
    unit = np.gcd(np.gcd(distance, stretch[left]), stretch[right])
    keys = np.stack([shape[left], shape[right], stretch[left] // unit, stretch[right] // unit, distance // unit,
                     notes[PITCH][right] - notes[PITCH][left]], axis=1)
    l, r, lr, rr, d, _ = keys.T
    counts = ((bounds.onset[r] * rr + d <= limits.onset) & (bounds.onset[l] * lr <= limits.onset)
              & (bounds.duration[l] * lr <= limits.duration) & (bounds.duration[r] * rr <= limits.duration))
    adjacent = np.ones(len(left), bool)
    if rules.adjacency == "mulpi":
        adjacent = (distance == 0) & (stretch[left] == stretch[right])
    oversized = int((adjacent & ~counts).sum())
    return Survey(left, right, keys, pair_hash(keys), unit, counts & adjacent, last, [n_neighbours, n, len(cut), oversized])


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their ``times``, without those that sum to nothing.

    Keys are brought together by their hashes; should two have the same, a key may come twice, which whoever sums up later evens out.
    """
    if not len(keys):
        return keys, times
    order = np.argsort(pair_hash(keys))
    keys, times = keys[order], times[order]
    at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    keys, times = keys[at], np.add.reduceat(times, at)
    return keys[times != 0], times[times != 0]


def change(after: Survey | None, before: Survey | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Reduced pairs and by how much their counts change; totals as shapes below 0."""
    keys, times = [np.zeros((0, 6), np.int64)], [np.zeros(0, np.int64)]
    for one, sign in ((after, 1), (before, -1)):
        if one is not None:
            keys += [one.keys[one.counts], np.array([[-1 - k, -1 - k, 0, 0, 0, 0] for k in range(4)])]
            times += [np.full(int(one.counts.sum()), sign), sign * np.array(one.totals)]
    return summed(np.concatenate(keys), np.concatenate(times))


def _total(changes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several results of ``change`` as one."""
    keys, times = zip(*changes)
    return summed(np.concatenate(keys), np.concatenate(times))


def matching(found: Survey, targets: np.ndarray, include_last: bool) -> np.ndarray:
    """The pairs of a survey that make up the new shape, by number."""
    hashes = pair_hash(targets)
    at = np.flatnonzero(np.isin(found.hashes, hashes))
    hit = np.zeros(len(at), bool)
    for t in targets:
        hit |= (found.keys[at] == t).all(axis=1)
    at = at[hit]
    return at if include_last else at[~found.last[at]]


def greedy(left: list, right: list, gone: set) -> list[int]:
    """Which pairs merge, from left to right: a note takes the first neighbour that is still there.

    ``gone`` has the notes that aren't there to begin with; those that are taken are added.
    """
    took, merged = [], set()
    for i, (a, b) in enumerate(zip(left, right)):
        if a not in gone and b not in gone and a not in merged:
            gone.add(b)
            merged.add(a)
            took.append(i)
    return took


def merge(notes: np.ndarray, found: Survey, targets: np.ndarray, new_id: int, include_last: bool,
          gone: set | None = None) -> tuple[np.ndarray, set]:
    """``notes`` with the pairs that make up the new shape merged (the notes taken still in place), and the notes taken."""
    at = matching(found, targets, include_last)
    gone = set() if gone is None else gone
    took = at[greedy(found.left[at].tolist(), found.right[at].tolist(), gone)]
    notes = notes.copy()
    notes[SHAPE, found.left[took]] = new_id
    notes[STRETCH, found.left[took]] = found.unit[took]
    return notes, gone


# ---- rows ---------------------------------------------------------------------------------

def notes_of(batch: pa.RecordBatch, fields=NOTE) -> tuple[np.ndarray, np.ndarray]:
    """The notes of all rows of a batch, side by side, and where each row's notes begin."""
    offsets, out = np.zeros(1, np.int64), []
    for f in fields:
        column = batch.column(f)
        offsets = np.asarray(column.offsets).astype(np.int64)
        out.append(np.asarray(column.values)[offsets[0]: offsets[-1]].astype(np.int64) if len(column) else np.zeros(0, np.int64))
    return np.stack(out), offsets - offsets[0]


def _lists(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _pair_lists(found: Survey, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row's pairs."""
    order = np.argsort(found.hashes)
    owner = row[found.left[order]]
    order = order[np.argsort(owner.astype(np.min_scalar_type(n)), kind="stable")]
    owner, hashes = row[found.left[order]], found.hashes[order]
    first = np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))[: len(owner)]
    return hashes[first], np.append(0, np.cumsum(np.bincount(owner[first], minlength=n)))


CHANGE = pa.struct([*((c, pa.int32()) for c in PAIR), ("n", pa.int64())])


def _changes(keys: np.ndarray, times: np.ndarray) -> pa.Array:
    values = pa.StructArray.from_arrays(
        [*(pa.array(keys[:, i], pa.int32()) for i in range(6)), pa.array(times, pa.int64())], fields=list(CHANGE))
    return pa.ListArray.from_arrays(pa.array([0, len(times)], pa.int32()), values)


def _rows(names: pa.RecordBatch, notes, offsets, found: Survey, row) -> pa.RecordBatch:
    hashes, cuts = _pair_lists(found, row, len(offsets) - 1)
    return pa.RecordBatch.from_arrays(
        [*(names.column(c) for c in NAME), *(_lists(notes[i], offsets, pa.int32()) for i in range(6)),
         _lists(hashes, cuts, pa.int64()), pa.nulls(len(offsets) - 1, pa.list_(CHANGE))],
        names=[*NAME, *NOTE, "pairs", "changes"])


def _change_row(like: pa.RecordBatch, keys, times) -> pa.RecordBatch:
    """A row without a phrase that carries changed counts."""
    columns = [pa.nulls(1, like.schema.field(c).type) for c in [*NAME, *NOTE, "pairs"]]
    return pa.RecordBatch.from_arrays([*columns, _changes(keys, times)], names=[*NAME, *NOTE, "pairs", "changes"])


def sliced(batch: pa.RecordBatch):
    """``batch`` in parts of at most ``SLICE`` notes, or of one phrase: what pairs take grows with these, not with a batch."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("k")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        begun = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, begun + SLICE, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def first_survey(batches, rules: Rules):
    """Phrases with the hashes of their pairs, and the counts of all pairs."""
    for batch in batches:
        changes = []
        for part in sliced(batch):
            notes, offsets = notes_of(part)
            row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            found = survey(notes, row, rules)
            rows = _rows(part, notes, offsets, found, row)
            changes.append(change(found))
            yield rows
        if changes:
            yield _change_row(rows, *_total(changes))


def merge_round(batches, new_id: int, targets: np.ndarray, rules: Rules, include_last: bool):
    """One shape merged in the phrases that are ``touched``; the others pass as they are."""
    for batch in batches:
        touched = batch.column("touched")
        batch = batch.select([*NAME, *NOTE, "pairs", "changes"])
        calm = batch.filter(pc.invert(touched))
        if calm.num_rows:
            yield calm
        changes = []
        for some in sliced(batch.filter(touched)):
            notes, offsets = notes_of(some)
            row = np.repeat(np.arange(some.num_rows), np.diff(offsets))
            before = survey(notes, row, rules)
            notes, gone = merge(notes, before, targets, new_id, include_last)
            stays = np.ones(len(row), bool)
            stays[list(gone)] = False
            notes, row = notes[:, stays], row[stays]
            after = survey(notes, row, rules)
            rows = _rows(some, notes, np.append(0, np.cumsum(np.bincount(row, minlength=some.num_rows))), after, row)
            changes.append(change(after, before))
            yield rows
        if changes:
            yield _change_row(rows, *_total(changes))


def merge_all(batches, plan: list[tuple[int, np.ndarray]], rules: Rules, include_last: bool):
    """All shapes in order.  Phrases are found by the pairs they have, so a shape costs what it touches."""
    hashes = [pair_hash(targets).tolist() for _, targets in plan]
    planned = np.array([h for wanted in hashes for h in wanted], np.int64)
    for batch in (part for whole in batches for part in sliced(whole)):
        notes, offsets = notes_of(batch)
        n = batch.num_rows
        row = np.repeat(np.arange(n), np.diff(offsets))
        phrases = [notes[:, a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        having: dict[int, set[int]] = defaultdict(set)  # pair of the plan to phrases that have, or once had it

        def index(found, row, number):
            at = np.flatnonzero(np.isin(found.hashes, planned))
            for h, p in zip(found.hashes[at].tolist(), number[row[found.left[at]]].tolist()):
                having[h].add(p)

        index(survey(notes, row, rules), row, np.arange(n))
        for (new_id, targets), wanted in zip(plan, hashes):
            touched = sorted(set().union(*(having[h] for h in wanted if h in having)))
            if not touched:
                continue
            some = np.concatenate([phrases[p] for p in touched], axis=1)
            row = np.repeat(np.arange(len(touched)), [phrases[p].shape[1] for p in touched])
            some, gone = merge(some, survey(some, row, rules), targets, new_id, include_last)
            for h in wanted:  # none is left that could merge
                having.pop(h, None)
            if not gone:
                continue
            changed = np.zeros(len(touched), bool)
            changed[row[list(gone)]] = True
            stays = np.ones(len(row), bool)
            stays[list(gone)] = False
            stays &= changed[row]
            some, row = some[:, stays], (np.cumsum(changed) - 1)[row[stays]]
            number = np.array(touched)[changed]
            cuts = np.append(0, np.cumsum(np.bincount(row, minlength=len(number))))
            for p, a, b in zip(number.tolist(), cuts[:-1], cuts[1:]):
                phrases[p] = some[:, a:b]
            index(survey(some, row, rules), row, number)
        notes = np.concatenate([np.zeros((6, 0), np.int64), *phrases], axis=1)
        offsets = np.append(0, np.cumsum([p.shape[1] for p in phrases]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in NAME), *(_lists(notes[i], offsets, pa.int32()) for i in range(6))], names=[*NAME, *NOTE])


# ---- blocks of one phrase ------------------------------------------------------------------

def _with_edges(batch: pa.RecordBatch):
    """Per row: its notes between the last ones of the block before and the first ones of the block after."""
    parts = [notes_of(batch, [f"{side}{f}" for f in NOTE]) for side in ("before_", "", "after_")]
    for i in range(batch.num_rows):
        cut = [notes[:, at[i]: at[i + 1]] for notes, at in parts]
        sizes = [x.shape[1] for x in cut]
        yield np.concatenate(cut, axis=1), slice(sizes[0], sizes[0] + sizes[1])


def count_blocks(batches, rules: Rules):
    """The counts of blocks' pairs."""
    for batch in batches:
        keys, times = [np.zeros((0, 6), np.int64)], [np.zeros(0, np.int64)]
        for notes, own in _with_edges(batch):
            one = change(survey(notes, np.zeros(notes.shape[1], np.int64), rules, own))
            keys.append(one[0])
            times.append(one[1])
        keys, times = summed(np.concatenate(keys), np.concatenate(times))
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, i], pa.int32()) for i in range(6)), pa.array(times, pa.int64())],
                                         names=[*PAIR, "n"])


def _components(left: list, right: list) -> list[list[int]]:
    """Pairs that share notes, directly or by others, as lists of their numbers in order."""
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(left, right):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    out = defaultdict(list)
    for i, a in enumerate(left):
        out[top(a)].append(i)
    return list(out.values())


def block_transitions(batches, targets: np.ndarray, rules: Rules, include_last: bool):
    """How each block's first notes, taken or not by the block before, decide which notes of the next it takes.

    Notes go by their numbers ``k``.  Groups of pairs that share no note are independent.  A group that reaches into
    the next block gives a table: for every set of its notes that may be gone at the block's beginning, the next block's notes
    that are gone at its end.  If more than ``STATES`` notes may be gone, the group's pairs themselves go along.
    """
    out = {c: [] for c in [*NAME, "open", "sets", "left", "right", "beyond"]}
    for batch in batches:
        names = [batch.column(c).to_pylist() for c in NAME]
        for i, (notes, own) in enumerate(_with_edges(batch)):
            found = survey(notes, np.zeros(notes.shape[1], np.int64), rules)
            at = matching(found, targets, include_last)
            left, right = found.left[at], found.right[at]
            into = set(right[(left < own.start) & (right >= own.start)].tolist())
            mine = (left >= own.start) & (left < own.stop)
            left, right = left[mine].tolist(), right[mine].tolist()
            k = notes[K].tolist()
            for group in _components(left, right):
                a, b = [left[x] for x in group], [right[x] for x in group]
                beyond = [x for x in b if x >= own.stop]
                if not beyond:
                    continue
                open_ = sorted(into.intersection(a + b))
                sets, pairs = [], ([], [])
                if len(open_) <= STATES:
                    for state in range(1 << len(open_)):
                        gone = {x for bit, x in enumerate(open_) if state >> bit & 1}
                        greedy(a, b, gone)
                        sets.append([k[x] for x in set(beyond) & gone])
                else:
                    pairs = [k[x] for x in a], [k[x] for x in b]
                for c, value in zip(out, (*(x[i] for x in names), [k[x] for x in open_], sets, *pairs, sorted({k[x] for x in beyond}))):
                    out[c].append(value)
    yield pa.RecordBatch.from_arrays(
        [pa.array(out["piece_id"], pa.int64()), *(pa.array(out[c], pa.int32()) for c in NAME[1:]), pa.array(out["open"], pa.list_(pa.int32())),
         pa.array(out["sets"], pa.list_(pa.list_(pa.int32()))), *(pa.array(out[c], pa.list_(pa.int32())) for c in ("left", "right", "beyond"))],
        names=list(out))


def entry_states(groups: pd.DataFrame) -> pd.DataFrame:
    """One phrase: the notes that are gone at the beginning of each block, from its blocks' transitions in order."""
    groups = groups.sort_values("chunk", kind="stable")
    out, gone, previous = [], set(), None
    for chunk, own in groups.groupby("chunk", sort=True):
        entry = gone if previous == chunk - 1 else set()
        gone, previous = set(), chunk
        for open_, sets, left, right, beyond in zip(*(own[c] for c in ("open", "sets", "left", "right", "beyond"))):
            if len(sets):
                gone.update(sets[sum(1 << bit for bit, x in enumerate(open_) if x in entry)])
            else:
                taken = entry.intersection(open_)
                greedy(list(left), list(right), taken)
                gone.update(taken.intersection(beyond))
        if gone:
            out.append((chunk + 1, sorted(int(x) for x in gone)))
    first = groups.iloc[0]
    return pd.DataFrame({"piece_id": [first["piece_id"]] * len(out), "track_number": [first["track_number"]] * len(out),
                         "phrase": [first["phrase"]] * len(out), "chunk": [c for c, _ in out],
                         "gone": pd.Series([g for _, g in out], dtype=object)})


def merge_blocks(batches, new_id: int, targets: np.ndarray, rules: Rules, include_last: bool):
    """One shape merged in blocks whose notes ``gone`` were taken by the block before."""
    for batch in batches:
        gone_before = batch.column("gone").to_pylist()
        out, sizes = [np.zeros((6, 0), np.int64)], []
        for (notes, own), taken in zip(_with_edges(batch), gone_before):
            found = survey(notes, np.zeros(notes.shape[1], np.int64), rules, own)
            gone = set(np.flatnonzero(np.isin(notes[K], taken or [])).tolist())
            notes, gone = merge(notes, found, targets, new_id, include_last, gone)
            stays = np.zeros(notes.shape[1], bool)
            stays[own] = True
            stays[list(gone)] = False
            out.append(notes[:, stays])
            sizes.append(out[-1].shape[1])
        notes, offsets = np.concatenate(out, axis=1), np.append(0, np.cumsum(sizes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in NAME), *(_lists(notes[i], offsets, pa.int32()) for i in range(6))], names=[*NAME, *NOTE])
