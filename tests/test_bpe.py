"""Merging against a plain re-implementation on small tracks, and laws of the whole loop."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from motifmill.operators import bpe as B, merge_kernel as M, phrase_kernel as H, tokens as K
from motifmill.params import CORPUS, BpeParams, Limits
from math import gcd

GAP = 12


def shape_of(l, r, shapes):
    unit = gcd(gcd(r["on"] - l["on"], l["st"]), r["st"])
    ls, rs, d, dp = l["st"] // unit, r["st"] // unit, (r["on"] - l["on"]) // unit, r["pi"] - l["pi"]
    members = [(o * ls, p, t * ls, c) for o, p, t, c in shapes[l["sh"]]]
    members += [(o * rs + d, p + dp, t * rs, c) for o, p, t, c in shapes[r["sh"]]]
    if max(m[0] for m in members) > 127:
        return None, unit
    return B.canonical(members), unit


def neighbours(track, k, shapes):
    end = track[k]["on"] + max(o + d for o, _, d, _ in shapes[track[k]["sh"]]) * track[k]["st"]
    found, follow = [], None
    for n in range(k + 1, min(len(track), k + 127)):
        on = track[n]["on"]
        if on >= end:
            if follow is None:
                if on - end > GAP:
                    break
                follow = on
            elif on != follow:
                break
        found.append(n)
    return found


def brute_counts(tracks, shapes):
    counts = {}
    for track in tracks:
        for k, l in enumerate(track):
            for n in neighbours(track, k, shapes):
                if l["ve"] == track[n]["ve"]:
                    s, _ = shape_of(l, track[n], shapes)
                    if s:
                        counts[s] = counts.get(s, 0) + 1
    return counts


def brute_merge(tracks, shapes, new):
    merged = []
    for track in tracks:
        near = [neighbours(track, k, shapes) for k in range(len(track))]
        gone, changed = set(), {}
        for k, l in enumerate(track):
            for n in near[k]:
                if k in gone or n in gone or l["ve"] != track[n]["ve"]:
                    continue
                s, unit = shape_of(l, track[n], shapes)
                if s == new:
                    gone.add(n)
                    changed[k] = unit
                    break
        merged.append([{**t, **({"st": changed[k], "sh": len(shapes)} if k in changed else {})}
                       for k, t in enumerate(track) if k not in gone])
    return merged


def random_tracks(seed, n=6, size=300):
    rng = random.Random(seed)
    tracks = []
    for _ in range(n):
        track = sorted({(rng.randrange(0, 700), rng.randrange(60, 66), rng.choice([3, 6, 6, 12, 48]),
                         rng.choice([0, 0, 0, 1]), rng.choice([40, 80])) for _ in range(size)})
        tracks.append([{"on": o, "pi": p, "st": d, "sh": c, "ve": v} for o, p, d, c, v in track])
    return tracks


def as_frame(spark, tracks):
    notes = [(i, 0, "N", t["on"], t["pi"], t["st"], t["ve"], t["sh"]) for i, track in enumerate(tracks) for t in track]
    df = spark.createDataFrame(notes, "piece_id bigint, track_number int, type string, onset int, pitch int, "
                                      "duration int, velocity int, is_cont int")
    return B.to_multi_notes(df, GAP)


def plain(df):
    return rows(df, "piece_id", "onset", "pitch", "stretch", "shape_id", "velocity")


def brute_rows(tracks):
    return sorted(((i, t["on"], t["pi"], t["st"], t["sh"], t["ve"]) for i, tr in enumerate(tracks) for t in tr), key=str)


@pytest.mark.parametrize("seed,batch", [(1, 10000), (2, 200), (3, 137)])
def test_learning_matches_brute_force(spark, seed, batch):
    tracks, shapes = random_tracks(seed), list(B.DEFAULT_SHAPES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        notes = as_frame(spark, tracks)
        got = B.learn(notes, GAP, BpeParams(iterations=5, checkpoint_every=2))
        for learned in got.shapes:
            counts = brute_counts(tracks, shapes)
            best = min(counts, key=lambda s: (-counts[s], [(o, p % 256, d, c) for o, p, d, c in s]))
            assert learned == best
            tracks = brute_merge(tracks, shapes, best)
            shapes.append(best)
        assert len(got.shapes) == 5
        assert plain(got.multi_notes) == brute_rows(tracks)
        assert plain(B.apply_shapes(notes, got.shapes, GAP)) == brute_rows(tracks)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("adjacency,rate", [("ours", 1.0), ("mulpi", 1.0), ("ours", 0.6)])
@pytest.mark.parametrize("chunk", [B.CHUNK, 300])
def test_kept_counts_equal_full_recounting(spark, adjacency, rate, chunk):
    """Every round's log next to a count of all pairs of the notes as they are then, whole phrases and blocks alike."""
    notes = as_frame(spark, random_tracks(8, n=9, size=500))
    b = BpeParams(iterations=4, adjacency=adjacency, sampling_rate=rate, seed=4, checkpoint_every=3)
    got = B.learn(notes, GAP, b, chunk)
    assert len(got.shapes) == 4
    state, shapes = B.lay_out(notes), list(B.DEFAULT_SHAPES)
    for i, (shape, line) in enumerate(zip(got.shapes, got.log)):
        keys = B.score_shapes(B.keep_sampled_pieces(state, rate, 4, i), shapes, adjacency, GAP).collect()
        totals = {r.l: r.n for r in keys if r.l < 0}
        named = B.named_counts(spark.createDataFrame([r for r in keys if r.l >= 0]), B.shapes_frame(spark, shapes).select("shape_id", "shape"))
        best = B.best_shape(named).first()
        assert (line[3], line[4]) == tuple(best) and line[2] == named.count()
        assert (line[1], line[5:8]) == (totals[-1] / totals[-2], (totals[-2], totals[-3], totals[-4]))
        state = B.merge_shape(state, shapes, shape, GAP)
        shapes.append(shape)
    assert plain(got.multi_notes) == plain(state)
    start, end = got.run_log().first()[:2], got.run_log().first()[2:]
    assert start == (notes.count(), B.avg_mulpi_size(notes).first()[0]) and end == (state.count(), B.avg_mulpi_size(state).first()[0])


def ostinato(n, chord=1):
    """One endless phrase: the same chord again and again, with some notes of other velocities and gaps within."""
    rng = random.Random(n)
    return [{"on": 3 * t, "pi": 60 + 4 * c, "st": 3, "sh": 0, "ve": 40 if rng.random() < 0.97 else 80} for t in range(n) for c in range(chord)]


@pytest.mark.parametrize("track", [ostinato(4000), ostinato(900, 4), random_tracks(4, 1, 5000)[0]], ids=["chain", "chords", "random"])
@pytest.mark.parametrize("shape", ["0,0,1;1,0,1;", "0,0,1;0,4,1;", "0,0,1;1,4,1;"])
def test_blocks_of_one_phrase_equal_one_task(spark, track, shape):
    notes, shape = as_frame(spark, [track]), B.shape_tuple(shape)
    again = B.canonical([*shape, *((o + 2, p, d, c) for o, p, d, c in shape)])
    serial = B.lay_out(notes)
    for k, new in enumerate((shape, again)):
        serial = B.merge_shape(serial, [*B.DEFAULT_SHAPES, shape][: 2 + k], new, GAP)
    for chunk in (130, 257):
        assert B.pack(notes, chunk).count() > 3
        assert plain(B.apply_shapes(notes, [shape, again], GAP, chunk=chunk)) == plain(serial)


@pytest.mark.parametrize("limit", [3, None])
def test_blocks_with_other_limits(spark, limit):
    notes, limits = as_frame(spark, [ostinato(500, 3)]), Limits(neighbours=limit)
    shape = B.shape_tuple("0,0,1;1,0,1;")
    serial = B.merge_shape(B.lay_out(notes), B.DEFAULT_SHAPES, shape, GAP, limits=limits)
    assert plain(B.apply_shapes(notes, [shape], GAP, limits=limits, chunk=140)) == plain(serial)
    b = BpeParams(iterations=3, limits=limits)
    assert plain(B.learn(notes, GAP, b, 140).multi_notes) == plain(B.learn(notes, GAP, b).multi_notes)


def test_more_open_notes_than_states(spark, monkeypatch):
    """Blocks whose groups have many open notes send their pairs along."""
    track = ostinato(400, 4)
    rules = H.Rules(M.ShapeBounds.of(B.DEFAULT_SHAPES + [B.shape_tuple("0,0,1;1,4,1;")]), "ours", GAP, Limits())
    targets = B.splits_of(B.shape_tuple("0,0,1;1,4,1;"), {s: i for i, s in enumerate(B.DEFAULT_SHAPES)})
    edged = B.Blocks(B.pack(as_frame(spark, [track]), 140)).edged(126).toArrow().combine_chunks().to_batches()
    found = {}
    for states in (8, 0):
        monkeypatch.setattr(H, "STATES", states)
        moves = pd.concat(b.to_pandas() for b in H.block_transitions(iter(edged), targets, rules, True))
        assert all((len(s) > 0) == (states > 0 or len(o) == 0) for s, o in zip(moves["sets"], moves["open"]))
        found[states] = H.entry_states(moves)[["chunk", "gone"]].to_dict("list")
    assert found[8] == found[0] and len(found[8]["chunk"]) > 3


def test_many_shapes_cost_what_they_touch(spark):
    """Shapes without a pair in the notes are never looked for note by note."""
    notes = as_frame(spark, random_tracks(2))
    learned = B.learn(notes, GAP, BpeParams(iterations=4)).shapes
    rare = [B.shape_tuple(f"0,0,1;{k},9,1;") for k in "123456789abcdefghij"]
    looked_at = []
    rules = H.Rules(M.ShapeBounds.of([*B.DEFAULT_SHAPES, *learned, *rare]), "ours", GAP, Limits())
    known = {s: i for i, s in enumerate([*B.DEFAULT_SHAPES, *learned])}
    plan = [(i, B.splits_of(s, {t: j for t, j in known.items() if j < i})) for s, i in known.items() if i > 1]
    plan += [(len(known) + k, B.splits_of(s, known)) for k, s in enumerate(rare)]
    batches = B.pack(notes).toArrow().combine_chunks().to_batches()
    survey = H.survey
    try:
        H.survey = lambda notes, *args: looked_at.append(notes.shape[1]) or survey(notes, *args)
        list(H.merge_all(iter(batches), plan, rules, True))
    finally:
        H.survey = survey
    assert all(len(t) for _, t in plan) and len(looked_at) <= 2 * len(learned) + len(batches)


def crowd(n, ticks, seed=5):
    """Notes of one phrase as the kernels have them, many of them at each tick."""
    rng = np.random.default_rng(seed)
    notes = np.stack([np.arange(1, n + 1), rng.integers(0, 2, n), np.sort(rng.integers(0, ticks, n)), rng.integers(30, 90, n),
                      rng.integers(1, 49, n), rng.integers(0, 32, n)])
    return notes, np.zeros(n, np.int64)


@pytest.mark.parametrize("limit", [2, 126, None])
def test_neighbours_of_a_crowd_are_those_of_a_walk(limit):
    """Ranges of neighbours next to a walk from each note to the right; phrases of one note and of none too."""
    (notes, _), phrase = crowd(300, 400), np.repeat([0, 1, 2, 3], [1, 149, 30, 120])
    onset, end = notes[H.ONSET].copy(), notes[H.ONSET] + notes[H.STRETCH]
    pairs, cut = [], []
    for i in range(len(onset)):
        found, follow = [], None
        for j in range(i + 1, len(onset)):
            if phrase[j] != phrase[i]:
                break
            if onset[j] >= end[i]:
                follow = onset[j] if follow is None else follow
                if onset[j] != follow or onset[j] > end[i] + GAP:
                    break
            found.append((i, j))
        pairs += found[:limit]
        cut += [i] if limit is not None and len(found) > limit else []
    left, right, short = M.neighbours(onset, end, phrase, GAP, limit)
    assert list(zip(left.tolist(), right.tolist())) == pairs and short.tolist() == cut
    assert [x.size for x in M.neighbours(onset[:0], end[:0], phrase[:0], GAP, limit)] == [0, 0, 0]
    rules = H.Rules(M.ShapeBounds.of(B.DEFAULT_SHAPES), "ours", GAP, Limits(neighbours=limit))
    surveyed = H.survey(notes, phrase, rules)
    final = {a: b for a, b in pairs}
    same = [(a, b) for a, b in pairs if notes[H.VELOCITY][a] == notes[H.VELOCITY][b]]
    assert list(zip(surveyed.left.tolist(), surveyed.right.tolist())) == same
    assert surveyed.last.tolist() == [final[a] == b for a, b in same] and surveyed.totals[:3] == [len(pairs), 300, len(cut)]


def test_a_survey_takes_what_notes_and_pairs_of_equal_velocity_take():
    """Neighbours of other velocities, most of a dense phrase's, are counted and not formed."""
    notes, phrase = crowd(6000, 400)
    rules = H.Rules(M.ShapeBounds.of(B.DEFAULT_SHAPES), "ours", GAP, Limits())
    tracemalloc.start()
    try:
        found = H.survey(notes, phrase, rules)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.totals[0] > 100 * 6000 and len(found.left) < 6000 * 6
    assert peak < 8 * (40 * 6000 + 30 * len(found.left))


def test_batches_are_looked_at_in_slices(spark, monkeypatch):
    """However many phrases a batch has, a survey is of so many notes; the counts stay those of the batch."""
    notes = as_frame(spark, random_tracks(8))
    rules = H.Rules(M.ShapeBounds.of(B.DEFAULT_SHAPES), "ours", GAP, Limits())
    batch = B.pack(notes).toArrow().combine_chunks().to_batches()[0]
    sizes, survey = [], H.survey
    monkeypatch.setattr(H, "survey", lambda notes, *args: sizes.append(notes.shape[1]) or survey(notes, *args))

    def counts():
        out = [b.to_pylist() for b in H.first_survey(iter([batch]), rules)]
        change = [r["changes"] for rows in out for r in rows if r["changes"] is not None]
        return len(change), sorted(tuple(x.values()) for x in change[0]), sum(len(rows) for rows in out)
    whole, longest = counts(), max(len(r) for r in batch.column("k").to_pylist())
    assert sizes == [notes.count()]
    sizes.clear()
    monkeypatch.setattr(H, "SLICE", longest)
    assert counts() == whole and whole[0] == 1 and len(sizes) > 1 and max(sizes) <= longest


def test_strict_apply_misses_the_last_neighbour(spark):
    tracks = [[{"on": 0, "pi": 60, "st": 6, "sh": 0, "ve": 40}, {"on": 6, "pi": 60, "st": 6, "sh": 0, "ve": 40}]]
    shape = B.shape_tuple("0,0,1;1,0,1;")
    notes = as_frame(spark, tracks)
    assert B.apply_shapes(notes, [shape], GAP).count() == 1
    assert B.apply_shapes(notes, [shape], GAP, include_last=False).count() == 2


def test_neighbour_counts_of_four_cases(spark):
    note = lambda on, st, pi=60: {"on": on, "pi": pi, "st": st, "sh": 0, "ve": 40}
    tracks = [[note(0, 6), note(3, 50)], [note(0, 6), note(18, 6)], [note(0, 6), note(19, 6)],
              [note(0, 6), note(8, 6, 60), note(8, 6, 64)]]
    single = B.shapes_frame(spark, B.DEFAULT_SHAPES)
    pairs = B.neighbour_pairs(as_frame(spark, tracks), single, GAP)
    first = pairs.filter("a.onset = 0").groupBy("piece_id").count()
    assert rows(first, "piece_id", "count") == [(0, 1), (1, 1), (3, 2)]


def test_shared_onset_and_pitch_keep_their_durations(spark):
    tracks = [[{"on": 0, "pi": 60, "st": 2, "sh": 0, "ve": 40}, {"on": 0, "pi": 60, "st": 4, "sh": 0, "ve": 40}]]
    got = B.apply_shapes(as_frame(spark, tracks), [B.shape_tuple("0,0,1;0,0,2;")], GAP).first()
    assert (got.shape_id, got.stretch) == (2, 2)


def test_canonical_order_takes_pitch_as_a_byte():
    assert B.canonical([(1, -1, 1, 0), (0, 0, 1, 0), (1, 5, 1, 0)]) == ((0, 0, 1, 0), (1, 5, 1, 0), (1, -1, 1, 0))


def test_ties_take_the_smallest_shape(spark):
    counts = spark.createDataFrame(
        [("0,0,1;1,-1,1;", 3), ("0,0,1;1,5,1;", 3), ("0,0,9;", 1)], "text string, n bigint")
    from motifmill.functions import scalars as S
    assert B.best_shape(counts.withColumn("shape", S.parse_shape("text"))).first().text == "0,0,1;1,5,1;"


def test_splits_of_finds_both_sides():
    base = list(B.DEFAULT_SHAPES)
    pair = B.shape_tuple("0,0,1;1,0,1;")
    triple = B.shape_tuple("0,0,1;1,0,1;2,0,1;")
    known = {s: i for i, s in enumerate([*base, pair])}
    assert {(0, 2), (2, 0)} <= {tuple(r[:2]) for r in B.splits_of(triple, known).tolist()}


def test_sampling_takes_whole_pieces(spark):
    notes = as_frame(spark, random_tracks(5, n=40, size=5))
    kept = B.keep_sampled_pieces(notes, 0.5, 1, 0)
    per = kept.groupBy("piece_id").count().join(notes.groupBy("piece_id").agg(F.count("*").alias("all")), "piece_id")
    assert per.filter("count != all").isEmpty() and 5 < per.count() < 35


def test_phrases_and_rows_take_one_exchange(spark):
    plan = B.pack(as_frame(spark, random_tracks(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("Exchange hashpartitioning(piece_id") == 1


def test_phrases_end_at_rests(spark):
    note = lambda on, st: {"on": on, "pi": 60, "st": st, "sh": 0, "ve": 40}
    got = as_frame(spark, [[note(0, 30), note(5, 5), note(42, 3), note(58, 3)]])
    assert rows(got, "onset", "phrase", "k") == [(0, 0, 1), (42, 0, 3), (5, 0, 2), (58, 58, 1)]


def test_no_limit_on_neighbours(spark):
    """200 notes at one onset: all pairs without a limit, and what a limit leaves out is counted."""
    notes = B.to_multi_notes(
        spark.createDataFrame([(0, 0, "N", 0, 0, k % 100, 1 + k // 100, 4) for k in range(200)],
                              "piece_id bigint, track_number int, type string, is_cont int, onset int, pitch int, duration int, velocity int"), GAP)
    single = B.shapes_frame(spark, B.DEFAULT_SHAPES)
    every = B.neighbour_pairs(notes, single, GAP, limit=None).count()
    assert every == 200 * 199 // 2
    totals = {}
    for limit in (None, 126):
        keys = B.score_shapes(B.lay_out(notes), B.DEFAULT_SHAPES, "ours", GAP, Limits(neighbours=limit))
        totals[limit] = {r.l: r.n for r in keys.filter("l < 0").collect()}
    assert (totals[None][-1], totals[None][-2], totals[None][-3]) == (every, 200, 0)
    assert totals[126][-1] == B.neighbour_pairs(notes, single, GAP).count()
    assert totals[126][-3] == 200 - 127


def test_carry_without_a_limit(spark, monkeypatch):
    """Batches of a few rows give the same pairs as one batch."""
    notes = B.lay_out(as_frame(spark, random_tracks(3)))
    count = lambda: sorted(tuple(r) for r in B.score_shapes(notes, B.DEFAULT_SHAPES, "ours", GAP, Limits(neighbours=None)).collect())
    whole = count()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert count() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_too_many_shapes():
    with pytest.raises(ValueError):
        BpeParams(iterations=2**16)
    with pytest.raises(ValueError):
        Limits(neighbours=0)


def test_workers_import_the_package_from_anywhere(tmp_path):
    """A merge in a fresh session that was started in another folder, without PYTHONPATH."""
    import os
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from motifmill.operators import bpe as B
from motifmill.session import local_session
spark = local_session(2, 2)
rows = [(0, 0, "N", 0, t, 60, 1, 4) for t in range(6)]
notes = B.to_multi_notes(spark.createDataFrame(rows, "piece_id bigint, track_number int, type string, is_cont int, onset int, pitch int, duration int, velocity int"), 12)
print("merged", B.apply_shapes(notes, [B.shape_tuple("0,0,1;1,0,1;")], 12).count())
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_ENV_LOADED", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "merged 3" in done.stdout, done.stderr[-2000:]
