"""Long notes put together from chunks, next to a walk along the text."""

import random
from collections import defaultdict

import pytest
from conftest import rows

from motifmill.operators import decode as D

SCHEMA = "piece_id bigint, seq int, member int, track_number int, velocity int, onset int, pitch int, duration int, is_cont int"


def walk(chunks):
    """Notes by one walk through a voice's text; then chunks that came too late, one at a time."""
    waiting, done = defaultdict(list), []
    for _, _, onset, duration, cont in sorted(chunks):
        start = waiting[onset].pop() if waiting[onset] else onset
        if cont:
            waiting[onset + duration].append(start)
        else:
            done.append((start, onset + duration))
    while True:
        k = next((k for k, (start, _) in enumerate(done) if waiting[start]), None)
        if k is None:
            return sorted(done + [(s, t) for t, starts in waiting.items() for s in starts])
        start, end = done.pop(k)
        done.append((waiting[start].pop(), end))


def stitched(spark, voices, block):
    """``voices``: per (piece, track, pitch, velocity) its chunks (seq, member, onset, duration, is_cont)."""
    members = [(p, s, m, t, v, o, h, d, c) for (p, t, h, v), chunks in voices.items() for s, m, o, d, c in chunks]
    found = defaultdict(list)
    for r in D.stitch_continuations(spark.createDataFrame(members, SCHEMA).repartition(3), block).collect():
        found[r.piece_id, r.track_number, r.pitch, r.velocity].append((r.start, r.end))
    return {k: sorted(v) for k, v in found.items()}


def tangled(rng, n, ticks, durations):
    """Chunks in no order of time, many at the same ticks."""
    return [(s, rng.randrange(3), rng.randrange(ticks), rng.choice(durations), int(rng.random() < 0.6)) for s in range(n)]


def chained(rng, notes, chunk):
    """Long notes as chains of chunks, in the order of time, with some twins."""
    out = []
    for _ in range(notes):
        start, length = rng.randrange(3000), rng.randrange(1, 40 * chunk)
        for _ in range(1 + (rng.random() < 0.2)):
            out += [(start + k, min(chunk, length - k), int(k + chunk < length)) for k in range(0, length, chunk)]
    return [(s, 0, *c) for s, c in enumerate(sorted(out))]


@pytest.mark.parametrize("block", [7, 48, 1 << 13])
def test_notes_equal_a_walk_along_the_text(spark, block):
    rng = random.Random(block)
    voices = {(0, t, 60, 64): tangled(rng, rng.randrange(1, 60), rng.choice([5, 20, 80]), rng.choice([[1], [3, 5], [4, 8, 40]])) for t in range(150)}
    voices |= {(1, t, 60, 64): chained(rng, rng.randrange(1, 30), rng.choice([6, 48])) for t in range(40)}
    assert stitched(spark, voices, block) == {k: walk(v) for k, v in voices.items()}


def test_one_voice_over_many_blocks(spark):
    """One note of 20,000 chunks, and its twin an octave up that is never closed."""
    chunks = [(k, 0, 4 * k, 4, int(k < 19_999)) for k in range(20_000)]
    open_ = [(30_000 + k, 0, 4 * k, 4, 1) for k in range(20_000)]
    found = stitched(spark, {(0, 0, 60, 64): chunks, (0, 0, 72, 64): open_}, 100)
    assert found == {(0, 0, 60, 64): [(0, 80_000)], (0, 0, 72, 64): [(0, 80_000)]}


def test_blocks_that_reach_over_batches(spark):
    rng = random.Random(2)
    voices = {(0, t, 60, 64): tangled(rng, 40, 60, [3, 6, 30]) for t in range(30)}
    want = {k: walk(v) for k, v in voices.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        assert stitched(spark, voices, 25) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_chunks(spark):
    assert D.stitch_continuations(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_text_order_decides_over_time(spark):
    """A chunk before the one that continues it, in the text."""
    found = stitched(spark, {(0, 0, 60, 64): [(0, 1, 12, 2, 0), (1, 0, 6, 6, 1)], (0, 0, 61, 64): [(0, 1, 12, 2, 1), (1, 0, 6, 6, 1)]}, 8)
    assert found == {(0, 0, 60, 64): [(6, 14)], (0, 0, 61, 64): [(6, 12), (12, 14)]}
    assert rows(D.stitch_continuations(spark.createDataFrame([(0, 0, 0, 0, 64, 5, 60, 0, 0)], SCHEMA)), "start", "end") == [(5, 5)]


def test_members_of_tokens(spark):
    """Single notes and shapes, pitches out of range and notes without a length; single notes need no lists."""
    kinds = [("N", None, 60, 4, 0), ("N", None, 61, 9, 1), ("U", "0,0,1;2,5,1~;", 62, 3, 0), ("U", "0,0,1;1,99,2;", 63, 2, 0),
             ("U", None, 64, 5, 1), ("N", None, 128, 4, 0), ("N", None, -1, 4, 0), ("N", None, 65, None, 1), ("P", None, 66, 4, 0)]
    timed = spark.createDataFrame([(1, k, 2, 80, 10 * k, *row) for k, row in enumerate(kinds)],
                                  "piece_id bigint, seq int, track_number int, velocity int, onset int, type string, shape string, "
                                  "pitch int, duration int, is_cont int")
    found = D.token_members(timed)
    assert [tuple(r) for r in found.orderBy("seq", "member").select("seq", "member", "onset", "pitch", "duration", "is_cont").collect()] == [
        (0, 0, 0, 60, 4, 0), (1, 0, 10, 61, 9, 1), (2, 0, 20, 62, 3, 0), (2, 1, 26, 67, 3, 1), (3, 0, 30, 63, 2, 0),
        (4, 0, 40, 64, 5, 1), (7, 0, None, 65, None, 1)]
    plan = timed.sparkSession._jvm.PythonSQLUtils.explainString(D.token_members(timed)._jdf.queryExecution(), "simple")
    assert "Union" in plan and plan.count("Generate") == 1
