"""Numpy helpers that run inside tasks: neighbours and greedy merges along sorted rows.

Rows arrive sorted by (phrase, rank) in Arrow batches.  A note looks ahead as far as the gap
allows, and at most ``Limits.neighbours`` rows, so a task keeps only the rows within that reach
between batches, however long a phrase is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from motifmill.params import LIMITS, Limits

PHRASE = ["piece_id", "track_number", "phrase"]


@dataclass(frozen=True)
class ShapeBounds:
    """Per shape id: span, largest relative onset, largest relative duration."""

    span: np.ndarray
    onset: np.ndarray
    duration: np.ndarray

    @classmethod
    def of(cls, shapes: list[tuple]) -> "ShapeBounds":
        return cls(
            np.array([max(o + d for o, _, d, _ in s) for s in shapes], dtype=np.int64),
            np.array([max(m[0] for m in s) for s in shapes], dtype=np.int64),
            np.array([max(m[2] for m in s) for s in shapes], dtype=np.int64))


def phrase_numbers(rows: pd.DataFrame) -> np.ndarray:
    keys = [rows[c].to_numpy() for c in PHRASE]
    change = np.zeros(len(rows), dtype=bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.cumsum(change)


def reach(onset, end, phrase, gap: int, limit: int | None = LIMITS.neighbours):
    """JON6 as ranges: the neighbours of note ``i`` are the notes from ``i + 1`` to before ``stop[i]``.

    Notes lie in order of their onsets, phrase by phrase.  A neighbour starts before the left note ends, or is one of the
    notes at the first onset after it, if that comes within ``gap``; so neighbours stand next to each other, and two searches
    per note find the last one.  The second array holds the notes that have more neighbours than ``limit``.
    """
    n = len(onset)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, own = onset.min(), np.arange(n)
    width = max(int(onset.max()), int(end.max())) - low + 2
    place = phrase.astype(np.int64) * width + (onset - low)
    follow = np.maximum(np.searchsorted(place, phrase * width + np.maximum(end - low, 0)), own + 1)
    at = np.minimum(follow, n - 1)
    near = (follow < n) & (phrase[at] == phrase) & (onset[at] - end <= gap)
    stop = np.where(near, np.searchsorted(place, place[at], "right"), follow)
    if limit is None:
        return stop, own[:0]
    return np.minimum(stop, own + 1 + limit), own[stop - own - 1 > limit]


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the numbers of all ranges one after another."""
    sizes = stop - start
    owner = np.repeat(np.arange(len(start)), sizes)
    return owner, np.arange(len(owner)) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)


def neighbours(onset, end, phrase, gap: int, limit: int | None = LIMITS.neighbours):
    """JON6 as row numbers ``(left, right)``, ordered by left, then right; and the notes cut short (see ``reach``)."""
    stop, cut = reach(onset, end, phrase, gap, limit)
    left, right = ranges(np.arange(1, len(stop) + 1), stop)
    return left, right, cut


def pair_keys(rows: pd.DataFrame, left, right) -> tuple[np.ndarray, np.ndarray]:
    """For each pair ``(shape, shape, stretch, stretch, distance, interval)``, times reduced."""
    col = lambda c: rows[c].to_numpy(dtype=np.int64)
    onset, pitch, stretch, shape = col("onset"), col("pitch"), col("stretch"), col("shape_id")
    distance = onset[right] - onset[left]
    unit = np.gcd(np.gcd(distance, stretch[left]), stretch[right])
    keys = np.stack([shape[left], shape[right], stretch[left] // unit, stretch[right] // unit,
                     distance // unit, pitch[right] - pitch[left]], axis=1)
    return keys, unit


def _settled(onset, end, phrase, gap: int, limit: int | None, last_batch: bool) -> int:
    """How many leading rows already see all rows they may look at."""
    n = len(onset)
    if last_batch or not n:
        return n
    # Rows that are still to come start at the last onset or later.
    open_ = (phrase == phrase[-1]) & (end + gap >= onset[-1])
    done = int(open_.argmax()) if open_.any() else n
    return done if limit is None else max(done, n - limit - 1)


def _with_carry(batches, step):
    """Feed each batch, preceded by the rows kept from before, to ``step``."""
    kept = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if kept is None or not len(kept) else pd.concat([kept, batch], ignore_index=True)
        out, kept = step(rows.reset_index(drop=True), False)
        if out is not None and len(out):
            yield out
    if kept is not None and len(kept):
        out, _ = step(kept.reset_index(drop=True), True)
        if out is not None and len(out):
            yield out


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of whole numbers, and how often each occurs."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    keys = keys[np.lexsort(keys.T[::-1])]
    at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[at], np.diff(np.append(at, len(keys)))


def count_pairs(batches, bounds: ShapeBounds, adjacency: str, gap: int, limits: Limits = LIMITS):
    """BPE2, local part: counts of reduced pairs.

    Totals come as shapes below 0: neighbours (-1), notes (-2), notes with more neighbours than
    the limit (-3), pairs whose shape would be too large (-4).
    """
    columns = ["l", "r", "lr", "rr", "d", "dp"]

    def step(rows, last_batch):
        phrase = phrase_numbers(rows)
        col = lambda c: rows[c].to_numpy(dtype=np.int64)
        onset, shape, stretch, velocity = col("onset"), col("shape_id"), col("stretch"), col("velocity")
        end = onset + bounds.span[shape] * stretch
        done = _settled(onset, end, phrase, gap, limits.neighbours, last_batch)
        left, right, cut = neighbours(onset, end, phrase, gap, limits.neighbours)
        ready = left < done
        left, right = left[ready], right[ready]
        n_neighbours = len(left)
        match = velocity[left] == velocity[right]
        if adjacency == "mulpi":
            match &= (onset[left] == onset[right]) & (stretch[left] == stretch[right])
        keys, _ = pair_keys(rows, left[match], right[match])
        l, r, lr, rr, d, _ = keys.T
        fits = ((bounds.onset[r] * rr + d <= limits.onset)
                & (bounds.onset[l] * lr <= limits.onset)
                & (bounds.duration[l] * lr <= limits.duration)
                & (bounds.duration[r] * rr <= limits.duration))
        found, counts = _counted(keys[fits])
        out = pd.DataFrame(found, columns=columns).assign(n=counts)
        totals = [n_neighbours, done, int((cut < done).sum()), int((~fits).sum())]
        total = pd.DataFrame([[-1 - k, -1 - k, 0, 0, 0, 0, n] for k, n in enumerate(totals)],
                             columns=[*columns, "n"])
        return pd.concat([out, total], ignore_index=True), rows.iloc[done:]

    for out in _with_carry(batches, step):
        yield out.astype({**{c: "int32" for c in columns}, "n": "int64"})


def merge_pass(batches, new_id: int, targets: np.ndarray, bounds: ShapeBounds, gap: int,
               include_last: bool = True, limits: Limits = LIMITS):
    """WIN16, BPE3: absorb the first free matching neighbour, left to right.

    ``targets`` lists the reduced pairs that make up the new shape.  The left note takes the
    new shape and the common time unit as its stretch (K4); the right one goes.
    """
    def step(rows, last_batch):
        phrase = phrase_numbers(rows)
        col = lambda c: rows[c].to_numpy(dtype=np.int64)
        onset, shape, stretch, velocity = col("onset"), col("shape_id"), col("stretch"), col("velocity")
        end = onset + bounds.span[shape] * stretch
        done = _settled(onset, end, phrase, gap, limits.neighbours, last_batch)
        left, right, _ = neighbours(onset, end, phrase, gap, limits.neighbours)
        if not include_last and len(left):
            final = np.append(left[1:] != left[:-1], True)
            left, right = left[~final], right[~final]
        pick = (left < done) & (velocity[left] == velocity[right])
        left, right = left[pick], right[pick]
        keys, unit = pair_keys(rows, left, right)
        match = np.zeros(len(left), dtype=bool)
        for t in targets:
            match |= (keys == t).all(axis=1)
        gone = rows["gone"].to_numpy().copy()
        merged_at, merged_unit, merged = [], [], set()
        for a, b, u in zip(left[match].tolist(), right[match].tolist(), unit[match].tolist()):
            if not gone[a] and not gone[b] and a not in merged:
                gone[b] = True
                merged.add(a)
                merged_at.append(a)
                merged_unit.append(u)
        shape[merged_at] = new_id
        stretch[merged_at] = merged_unit
        rows["shape_id"], rows["stretch"], rows["gone"] = shape.astype("int32"), stretch.astype("int32"), gone
        out = rows.iloc[:done]
        return out[~out["gone"]].drop(columns="gone"), rows.iloc[done:]

    yield from _with_carry((b.assign(gone=False) for b in batches), step)


def merge_all(batches, plan: list[tuple[int, np.ndarray]], bounds: ShapeBounds, gap: int,
              include_last: bool = True, limits: Limits = LIMITS):
    """BPE5: every shape in order, as a chain of passes over one stream of rows."""
    stream = batches
    for new_id, targets in plan:
        stream = merge_pass(stream, new_id, targets, bounds, gap, include_last, limits)
    return stream
