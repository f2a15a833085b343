"""Numpy helpers that rejoin the chunks of long notes, block by block along a voice, inside tasks.

A chunk that continues waits at its end; a chunk that begins there takes the one that began to wait last.  What
happens at a tick of a voice depends on the chunks that end or begin there only, so a voice is cut into blocks
of ticks: a chunk is in the block where it begins and, if it waits in another one, in that too.  A block reduces to its whole notes
and to *fragments*: runs of chunks that come from or go on to other blocks, by the chunk that reaches over,
and those that a chunk earlier in the text may still take.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa

VOICE = ["piece_id", "track_number", "pitch", "velocity"]
CHUNK = ["seq", "member", "onset", "end", "is_cont"]
#: How a run of chunks ends: for good, still waiting, or in another block.
CLOSED, WAITING, ELSEWHERE = range(3)
FRAGMENT = ["whole", "start", "end", "state", "early", "late", "from_seq", "from_member", "to_seq", "to_member"]


def _links(group, tick, seq, member, row, pushes, n):
    """(next chunk of each that waits, which chunks took one) by stacks per group and tick, in the order of the text.

    A chunk that waits right before one that takes is taken by it; without such pairs, the next ones meet.
    """
    order = np.lexsort((pushes, member, seq, tick, group))
    group, tick, row, pushes = group[order], tick[order], row[order], pushes[order]
    following, taken = np.full(n, -1, np.int64), np.zeros(n, bool)
    while len(row) > 1:
        hit = np.flatnonzero(pushes[:-1] & ~pushes[1:] & (group[:-1] == group[1:]) & (tick[:-1] == tick[1:]))
        if not len(hit):
            break
        following[row[hit]] = row[hit + 1]
        taken[row[hit + 1]] = True
        left = np.ones(len(row), bool)
        left[hit] = left[hit + 1] = False
        group, tick, row, pushes = group[left], tick[left], row[left], pushes[left]
    # What is left at a tick: chunks that found nobody waiting, then chunks that nobody took.
    start = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (tick[1:] != tick[:-1]))) if len(row) else np.zeros(0, np.int64)
    spot = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(row))))
    both = (np.bincount(spot, pushes, len(start)) > 0) & (np.bincount(spot, ~pushes, len(start)) > 0)
    odd = np.zeros((2, n), bool)  # takers, waiters
    odd[pushes[both[spot]].astype(int), row[both[spot]]] = True
    return following, taken, odd[0], odd[1]


def stitch(rows: dict[str, np.ndarray], group: np.ndarray, ticks: int) -> dict[str, np.ndarray]:
    """The runs of chunks of whole blocks: the row of each run's first chunk (``head``), and the columns of ``FRAGMENT``."""
    n = len(group)
    onset, end, cont = rows["onset"], rows["end"], rows["is_cont"] == 1
    begins, waits = onset // ticks == rows["blk"], cont & (end // ticks == rows["blk"])
    b, w = np.flatnonzero(begins), np.flatnonzero(waits)
    row = np.concatenate([b, w])
    following, taken, early, late = _links(
        group[row], np.concatenate([onset[b], end[w]]), rows["seq"][row], rows["member"][row], row,
        np.repeat([False, True], [len(b), len(w)]), n)
    # Each run's last chunk, by doubling steps.
    last = np.where(following >= 0, following, np.arange(n))
    while ((after := last[last]) != last).any():
        last = after
    head = np.flatnonzero(~taken)
    tail = last[head]
    state = np.where(~cont[tail], CLOSED, np.where(waits[tail], WAITING, ELSEWHERE))
    own = begins[head]
    early, late = early[head], late[tail]
    return {
        "head": head, "whole": own & ~early & ~late & (state != ELSEWHERE), "start": np.where(own, onset[head], -1), "end": end[tail],
        "state": state, "early": early, "late": late, "from_seq": np.where(own, -1, rows["seq"][head]),
        "from_member": np.where(own, -1, rows["member"][head]), "to_seq": rows["seq"][tail], "to_member": rows["member"][tail]}


def stitch_batches(batches, ticks: int):
    """Runs of chunks of rows that come block by block; the rows of a block that may go on are kept for the next batch."""
    names = [*VOICE, "blk", *CHUNK]

    def run(table: dict[str, np.ndarray]):
        n = len(table["blk"])
        new = np.zeros(n, bool)
        for c in [*VOICE, "blk"]:
            new[1:] |= table[c][1:] != table[c][:-1]
        found = stitch(table, np.cumsum(new), ticks)
        head = found.pop("head")
        types = {"piece_id": pa.int64(), "whole": pa.bool_(), "early": pa.bool_(), "late": pa.bool_()}
        columns = {c: table[c][head] for c in VOICE} | found
        return pa.RecordBatch.from_arrays([pa.array(v).cast(types.get(c, pa.int32())) for c, v in columns.items()], names=list(columns))

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = {c: np.asarray(batch.column(c)).astype(np.int64) for c in names}
        if held is not None:
            table = {c: np.concatenate([held[c], table[c]]) for c in names}
        n = len(table["blk"])
        same = np.ones(n, bool)
        for c in [*VOICE, "blk"]:
            same &= table[c] == table[c][-1]
        cut = int(same.argmax())  # the last block's first row
        held = {c: v[cut:] for c, v in table.items()}
        if cut:
            yield run({c: v[:cut] for c, v in table.items()})
    if held is not None:
        yield run(held)


def join_fragments(rows: pd.DataFrame) -> pd.DataFrame:
    """One voice: its fragments put together, and chunks that come too late in the text taken by those that wait.

    Notes that are whole are tried in the order in which they ended; each is taken by the one that began to wait last
    at its start, and is tried again with its new start.
    """
    records = rows[FRAGMENT].to_dict("records")
    coming = {(r["from_seq"], r["from_member"]): r for r in records if r["from_seq"] >= 0}
    done, wait = [], []
    for r in records:
        if r["from_seq"] >= 0:
            continue
        tail = r
        while tail["state"] == ELSEWHERE:
            tail = coming[tail["to_seq"], tail["to_member"]]
        (wait if tail["state"] == WAITING else done).append(((tail["to_seq"], tail["to_member"]), r["start"], tail["end"]))
    waiting = defaultdict(list)
    for _, start, end in sorted(wait):
        waiting[end].append(start)
    queue = [(start, end) for _, start, end in sorted(done)]
    out, moved = [], True
    while moved:
        moved, rest = False, []
        for k, (start, end) in enumerate(queue):
            if waiting.get(start):
                queue = rest + queue[k + 1:] + [(waiting[start].pop(), end)]
                moved = True
                break
            rest.append((start, end))
    out = queue + [(start, end) for end, starts in waiting.items() for start in starts]
    first = rows.iloc[0]
    return pd.DataFrame({"piece_id": first["piece_id"], "track_number": first["track_number"], "start": [s for s, _ in out],
                         "end": [e for _, e in out], "pitch": first["pitch"], "velocity": first["velocity"]})
