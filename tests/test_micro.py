"""Small hand-written pieces for every decision that the projected tables do not reach."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from motifmill.functions import scalars as S
from motifmill.operators import (
    cleaning as C, decode as D, examples as E, features as X, splits as P, stats as T, timing as W,
    tokens as K, verify as Y, vocab as V,
)
from motifmill.params import CORPUS, ExampleParams
from motifmill.plans import jobs as J
from motifmill.sources import raw as R, tables as Z

LONG = CORPUS.with_(deny_long_empty_measures=False)


def text_of(build):
    return {r.piece_id: r.text for r in build.corpus.collect()}


def tokens_from(spark, *lines):
    corpus = spark.createDataFrame(list(enumerate(lines)), "piece_id bigint, text string")
    return K.parse_tokens(K.explode_text(corpus))


def reasons(build):
    return {r.piece_id: r.reason for r in build.rejects.collect()}


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_ticks_round_half_up_exactly(spark):
    assert value(spark, S.quantize_tick(F.lit(55), F.lit(480), 48)) == 6
    assert value(spark, S.quantize_tick(F.lit(20), F.lit(480), 12)) == 1
    assert value(spark, S.quantize_tick(F.lit(19), F.lit(480), 12)) == 0


def test_tempo_and_velocity_clamp(spark):
    tempo = lambda x: value(spark, S.quantize_tempo(F.lit(x), CORPUS))
    assert [tempo(x) for x in (1.0, 120.5, 124.0, 123.9, 999.0)] == [8, 120, 128, 120, 240]
    velocity = lambda x: value(spark, S.quantize_velocity(F.lit(x), 4))
    assert [velocity(x) for x in (1, 5, 6, 127)] == [4, 4, 8, 124]


@pytest.mark.parametrize("x,text", [(0, "0"), (35, "Z"), (36, "10"), (-36, "-10"), (-1, "-1"),
                                    (1295, "ZZ"), (1296, "100"), (131071, "2T4V")])
def test_base36(spark, x, text):
    assert value(spark, S.itob36(F.lit(x))) == text
    assert value(spark, S.b36toi(F.lit(text))) == x


@pytest.mark.parametrize("a,b", [(0, 5), (12, 18), (48, 48), (7, 5), (96, 36), (5, 0), (100000, 48)])
def test_gcd(spark, a, b):
    assert value(spark, S.gcd_upto(F.lit(a), F.lit(b), 48)) == math.gcd(a, b)


@pytest.mark.parametrize("values", [(100, 150), (0, 0), (0, 7), (2**40, 6 * 2**30, 0), (987, 610), (13,), (48, 36, 60)])
def test_gcd_of(spark, values):
    assert value(spark, S.gcd_of(F.array(*(F.lit(v) for v in values)))) == math.gcd(*values)


@pytest.mark.parametrize("values", [(1000, 48, 96), (48, 1000), (127, 127), (2**40, 0, 127), (0, 5, 0)])
def test_gcd_of_small_values_takes_no_divisions(spark, monkeypatch, values):
    monkeypatch.setattr(S.F, "sequence", lambda *_: F.array(F.raise_error(F.lit("divided")).cast("int")))
    assert value(spark, S.gcd_of(F.array(*(F.lit(v) for v in values)))) == math.gcd(*values)


def test_forty_two_time_signatures(spark):
    s = S.supported_time_signatures(spark)
    assert s.count() == 42 and s.agg(F.max("length")).first()[0] == 144
    assert S.instruments(spark).count() == 129


def test_long_notes_split_or_cut(make_raw):
    raw = make_raw([(0, 0, 0, 100, 60, 64), (1, 0, 0, 96, 60, 64)], time_sigs=[(0, 0, 4, 4), (1, 0, 4, 4)])
    build = J.build_corpus(raw, CORPUS)
    assert rows(build.notes, "piece_id", "onset", "duration", "is_cont") == [
        (0, 0, 48, 1), (0, 48, 48, 1), (0, 96, 4, 0), (1, 0, 48, 1), (1, 48, 48, 0)]
    cut = J.build_corpus(raw, CORPUS.with_(use_cont_note=False))
    assert rows(cut.notes, "piece_id", "onset", "duration", "is_cont") == [(0, 0, 48, 0), (1, 0, 48, 0)]


def test_misaligned_time_signature(make_raw):
    raw = make_raw([(0, 0, 0, 12, 60, 64), (0, 0, 90, 99, 60, 64)], time_sigs=[(0, 0, 4, 4), (0, 50, 3, 4)])
    assert reasons(J.build_corpus(raw, CORPUS)) == {0: "misaligned time signature"}


@pytest.mark.parametrize("empty,rejected", [(18, False), (19, True)])
def test_long_empty_stretch(make_raw, empty, rejected):
    at = 48 * (empty + 1)
    raw = make_raw([(0, 0, 0, 12, 60, 64), (0, 0, at, at + 12, 60, 64)])
    assert bool(reasons(J.build_corpus(raw, CORPUS))) is rejected
    assert not reasons(J.build_corpus(raw, LONG))


def test_other_rejections(make_raw, spark):
    raw = make_raw(
        [(0, 0, 0, 12, 60, 64), (1, 0, 0, 12, 60, 64), (2, 0, 300000, 300010, 60, 64),
         (3, 0, 0, 20000, 60, 64), (4, 0, 140000, 140010, 60, 64), (5, 0, 0, 12, 60, 64),
         (6, 0, 0, 12, 60, 64), (7, 0, 5, 5, 60, 64)],
        time_sigs=[(p, 0, 4, 4) for p in (0, 2, 3, 4, 6, 7, 8)] + [(1, 500, 4, 4)],
        tempos=[(p, 0, 120.0) for p in range(5)] + [(6, 500, 90.0)])
    assert reasons(J.build_corpus(raw, CORPUS)) == {
        1: "no time signature", 2: "note time too large", 3: "note duration too large",
        4: "no notes", 5: "no time signature", 6: "no tempo", 7: "no notes", 8: "no tracks"}


def test_a_late_end_alone_is_not_corrupt(make_raw):
    raw = make_raw([(0, 0, 262140, 262150, 60, 64), (0, 0, 0, 12, 60, 64)])
    assert reasons(J.build_corpus(raw, LONG)) == {}


def test_drums_outside_the_map_go(make_raw):
    raw = make_raw([(0, 0, 0, 12, 34, 64), (0, 0, 0, 12, 35, 64), (0, 0, 0, 12, 81, 64), (0, 0, 0, 12, 82, 64)],
                   tracks=[(0, 0, 3, True)])
    build = J.build_corpus(raw, CORPUS)
    assert rows(build.notes, "pitch") == [(35,), (81,)]
    assert "R3K:0" in text_of(build)[0]


def test_first_time_signature_at_tick_one(make_raw):
    raw = make_raw([(0, 0, 2, 12, 60, 64), (0, 0, 60, 70, 60, 64)], time_sigs=[(0, 1, 4, 4), (0, 48, 3, 4)])
    assert rows(J.build_corpus(raw, CORPUS).measures, "onset", "numer") == [(0, 4), (48, 3)]


def test_late_first_time_signature_gets_four_four(make_raw):
    raw = make_raw([(0, 0, 0, 12, 60, 64), (0, 0, 100, 110, 60, 64)], time_sigs=[(0, 96, 3, 4)])
    assert rows(J.build_corpus(raw, CORPUS).measures, "onset", "numer") == [(0, 4), (48, 4), (96, 3)]


def test_leading_measures_without_notes_are_left_out(make_raw):
    raw = make_raw([(0, 0, 100, 110, 60, 64)], tempos=[(0, 0, 90.0)])
    build = J.build_corpus(raw, CORPUS)
    assert rows(build.measures, "onset") == [(96,)]
    assert rows(build.tempos, "onset", "bpm") == [(96, 88)]


@pytest.mark.parametrize("changes,expected", [
    ([(0, 96.0), (48, 96.0), (48, 64.0)], [(0, 96), (48, 64)]),
    ([], [(0, 120)]),
    ([(12, 96.0)], [(0, 120), (12, 96)]),
    ([(1, 96.0)], [(0, 96)]),
    ([(0, 96.0), (24, 97.0), (36, 64.0)], [(0, 96), (36, 64)]),
])
def test_tempos(make_raw, changes, expected):
    raw = make_raw([(0, 0, 0, 12, 60, 64), (0, 0, 90, 99, 60, 64)],
                   tempos=[(0, *c) for c in changes] or [(9, 0, 100.0)])
    got = rows(J.build_corpus(raw, CORPUS).tempos.filter("piece_id = 0"), "onset", "bpm")
    assert sorted(got) == expected


def test_last_end_is_that_of_the_last_note(make_raw, spark):
    raw = make_raw([(0, 0, 0, 400, 60, 64), (0, 0, 12, 20, 60, 64)])
    cut = CORPUS.with_(max_duration=255, deny_long_empty_measures=False)
    assert J.build_corpus(raw, cut).extent.first().last_end == 400  # the second chunk starts last
    short = make_raw([(0, 0, 0, 200, 60, 64), (0, 0, 12, 20, 60, 64)])
    build = J.build_corpus(short, cut)
    assert build.extent.first().last_end == 20
    assert C.piece_extent(build.notes).first().last_end == 20
    assert build.measures.count() == 1


def test_excess_tracks_merge_or_reject(make_raw):
    notes = [(p, t, 12 * i, 12 * i + 6, 60 + t, 64) for p in (0, 1) for t in range(3) for i in range(4 - t)]
    tracks = [(0, 0, 5, False), (0, 1, 7, False), (0, 2, 7, False),
              (1, 0, 5, False), (1, 1, 7, False), (1, 2, 9, False)]
    raw = make_raw(notes, time_sigs=[(0, 0, 4, 4), (1, 0, 4, 4)], tracks=tracks)
    two = CORPUS.with_(max_track_number=2)
    build = J.build_corpus(raw, two)
    assert reasons(build) == {1: "too many tracks after merge"}
    assert rows(build.track_map.filter("piece_id = 0"), "track_idx", "track_number") == [(0, 0), (1, 1), (2, 1)]
    strict = J.build_corpus(raw, two.with_(strict_track_limit=True))
    assert set(reasons(strict)) == {0, 1}


def test_empty_tracks_do_not_count(make_raw):
    raw = make_raw([(0, 2, 0, 12, 60, 64)], tracks=[(0, 0, 1, False), (0, 2, 3, False)])
    assert text_of(J.build_corpus(raw, CORPUS))[0] == "BOS R3:0 SEP M4/4 P0 T3C N:1O:C:1S:0 EOS"


def test_duplicate_notes_are_written_once(make_raw):
    raw = make_raw([(0, 0, 0, 12, 60, 64), (0, 0, 0, 12, 60, 65), (0, 0, 0, 12, 60, 64)])
    assert text_of(J.build_corpus(raw, CORPUS))[0].count("N:") == 1


def test_mps_numbers(spark):
    t = tokens_from(spark, "BOS R0:0 R1:1 SEP M4/4 P0 T3C N:1O:C:1S:0 EOS",
                    "BOS R0:0 SEP M4/4 P0 N:1O:C:1S:0 N:1P:C:1S:0 P1 N:1O:C:1S:0 EOS")
    got = [r.mps for r in V.mps_numbers(t).orderBy("piece_id", "seq").collect()]
    assert got == [1, 2, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]


def decoded(spark, line):
    return D.decode_tokens(tokens_from(spark, line), 12)


def test_ambiguous_chunks_pair_last_in_first_out(spark):
    d = decoded(spark, "BOS R0:0 SEP M4/4 P0 T3C N~:1O:C:1S:0 N~:1O:C:1S:0 P4 N~:1O:8:1S:0 "
                       "PC N:1O:2:1S:0 N:1O:3:1S:0 N:1O:4:1S:0 EOS")
    # The one that began to wait last goes first: onset 4, then 0 twice.
    assert rows(d.notes, "start", "end") == [(0, 15), (0, 16), (4, 14)]


def test_chunks_that_come_late_or_stay_open(spark):
    late = decoded(spark, "BOS R0:0 SEP M4/4 P0 T3C U0,0,1;C,0,2;:1O:1:1S:0 P6 N~:1O:6:1S:0 EOS")
    assert rows(late.notes, "start", "end") == [(0, 1), (6, 14)]
    unclosed = decoded(spark, "BOS R0:0 SEP M4/4 P0 T3C N~:1O:6:1S:0 EOS")
    assert rows(unclosed.notes, "start", "end") == [(0, 6)]


def test_members_outside_the_pitch_range_are_skipped(spark):
    d = decoded(spark, "BOS R0:0 SEP M4/4 P0 T3C U0,0,1;0,5,1;:3H:C:1S:0 EOS")
    assert rows(d.notes, "pitch") == [(125,)]


def test_decoding_starts_at_tick_zero(make_raw, spark):
    raw = make_raw([(0, 0, 100, 110, 60, 64)])
    corpus = J.build_corpus(raw, CORPUS).corpus
    assert rows(J.decode_corpus(corpus, 12).notes, "start", "end") == [(4, 14)]


def test_bars_and_similarity_of_one_measure(spark):
    d = decoded(spark, "BOS R0:0 SEP M4/4 P0 T3C N:1O:C:1S:0 EOS")
    assert X.bar_counts(d.notes, d.measures).first().n_bars == 2
    assert X.bar_counts(d.notes, d.measures, True).first().n_bars == 1
    f = X.scalar_features(d).first()
    assert f.instrumentation_self_similarity == 0.0
    assert f.grooving_self_similarity == pytest.approx(1 - 1 / 48)
    later = decoded(spark, "BOS R0:0 SEP M4/4 P0 T3C N:1O:C:1S:0 P1 N:1O:C:1S:0 EOS")
    assert X.bar_counts(later.notes, later.measures).first().n_bars == 3


def test_similarity_equals_all_pairs(spark, folder):
    from motifmill.plans.catalog import Workspace

    w = Workspace.of(spark, folder)
    d = w.decoded
    bars = {r.piece_id: r.n_bars for r in X.bar_counts(d.notes, d.measures).collect()}
    program = {(r.piece_id, r.track_number): r.instrument for r in d.tracks.collect()}
    hit = {}
    for r in X.note_bars(d.notes, d.measures).collect():
        hit.setdefault(r.piece_id, {}).setdefault(r.bar, set()).add(program[r.piece_id, r.track_number])
    width = {p: len({i for (q, _), i in program.items() if q == p}) for p in hit}
    for r in w.features.collect():
        sets = list(hit[r.piece_id].values())
        sets += [set()] * (bars[r.piece_id] - len(sets))
        pairs = [(a, b) for i, a in enumerate(sets) for b in sets[i + 1:]]
        mean = sum(1 - len(a ^ b) / width[r.piece_id] for a, b in pairs) / len(pairs)
        assert r.instrumentation_self_similarity == pytest.approx(mean)


def hist(spark, **bins):
    return spark.createDataFrame([("f", k, v) for k, v in bins.items()], "feature string, bin string, n bigint")


def test_distances(spark):
    a = spark.createDataFrame([("f", "1", 1), ("f", "2", 1)], "feature string, bin string, n bigint")
    b = spark.createDataFrame([("f", "1", 1), ("f", "2", 1), ("f", "3", 2)], "feature string, bin string, n bigint")
    al = X.align_histograms(a, b)
    assert X.kl_divergence(al, True).first().kld == pytest.approx(0.0)
    assert X.kl_divergence(al, False).first().kld == math.inf
    assert X.kl_divergence(X.align_histograms(b, a)).first().kld == pytest.approx(math.log(2))
    assert X.kl_divergence(X.align_histograms(b, a), base=2).first().kld == pytest.approx(1.0)
    assert X.histogram_intersection(al).first().hi == pytest.approx(0.5)
    one = spark.createDataFrame([("f", "3/4", 5)], "feature string, bin string, n bigint")
    assert math.isnan(X.normal_overlap(one, b).first().oa)
    assert X.normal_overlap(b, b).first().oa == pytest.approx(1.0)
    none = X.align_histograms(a, b.filter("bin = '3'"))
    assert math.isnan(X.kl_divergence(none).first().kld)


def test_empty_bins_vanish_when_summed(spark):
    h = spark.createDataFrame([(0, "f", "1", 0), (1, "f", "2", 3)], "piece_id bigint, feature string, bin string, n bigint")
    assert rows(X.aggregate_histograms(h), "bin", "n") == [("2", 3)]


def test_describe_matches_pandas(spark):
    import numpy as np
    import pandas as pd

    values = [1.0, 2.5, 2.5, 7.0, -3.0, 11.0, float("nan")]
    df = spark.createDataFrame([("a", v) for v in values], "name string, value double")
    got, want = T.describe(df).first(), pd.Series(values).dropna().describe()
    for k in ("count", "mean", "std", "min", "25%", "50%", "75%", "max"):
        assert np.isclose(got[k], want[k]), k


def test_splits_prefer_test_and_align_to_components(spark):
    pieces = spark.createDataFrame([(0, "d/x/a.mid"), (1, "d/x/ba.mid"), (2, "d/y/c.mid")], "piece_id bigint, path string")
    lists = spark.createDataFrame([("a.mid", "valid"), ("x/a.mid", "test"), ("", "test"), ("c.mid", "valid")],
                                  "path_suffix string, split string")
    assert rows(P.apply_splits(pieces, lists), "piece_id", "split") == [(0, "test"), (1, "train"), (2, "valid")]


def test_index_expressions():
    assert Z.index_ranges("1, 3:5, :2, -2:, -1", 10) == [(1, 2), (3, 5), (0, 2), (8, 10), (9, 10)]
    with pytest.raises(ValueError):
        Z.index_ranges(":", 3)


def test_files_and_lists(spark, tmp_path):
    for sub, name in (("a", "1.mid"), ("a/b", "2.MID"), ("c", "3.midi"), ("c", "4.txt")):
        (tmp_path / sub).mkdir(parents=True, exist_ok=True)
        (tmp_path / sub / name).write_bytes(b"x")
    found = R.list_files(spark, [str(tmp_path / "a"), str(tmp_path / "c")])
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["1.mid", "2.MID", "3.midi"]
    assert [r.piece_id for r in R.number_paths(found).orderBy("path").collect()] == [0, 1, 2]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        R.list_files(spark, [str(tmp_path / "empty")])
    (tmp_path / "test.txt").write_text("a/1.mid\n\n b/2.MID \n")
    (tmp_path / "valid.txt").write_text("c/3.midi\n")
    assert rows(R.read_splits(spark, str(tmp_path / "test.txt"), str(tmp_path / "valid.txt")), "path_suffix", "split") == [
        ("a/1.mid", "test"), ("b/2.MID", "test"), ("c/3.midi", "valid")]


def test_shape_files_round_trip(spark, tmp_path):
    from motifmill.operators import bpe as B

    shapes = [*B.DEFAULT_SHAPES, B.shape_tuple("0,0,1;1,-2,A~;"), B.shape_tuple("0,0,2;0,3,2;")]
    Z.write_shapes(B.shapes_frame(spark, shapes), str(tmp_path / "shapes"))
    back = Z.read_shapes(spark, str(tmp_path / "shapes"))
    assert rows(back, "shape_id", "text") == [(0, "0,0,1;"), (1, "0,0,1~;"), (2, "0,0,1;1,-2,A~;"), (3, "0,0,2;0,3,2;")]
    member = back.filter("shape_id = 2").first().shape[1]
    assert tuple(member) == (1, -2, 10, 1)


def test_first_tokens_and_primers(spark):
    t = tokens_from(spark, "BOS R0:0 SEP M4/4 P0 T3C N:1O:C:1S:0 EOS")
    text = lambda df: " ".join(r.text for r in df.orderBy("seq").collect())
    assert text(K.first_k_tokens(t, 5)) == "BOS R0:0 SEP M4/4 P0 EOS"
    assert text(K.first_k_tokens(t, 8)) == text(t)
    assert text(K.first_k_measures(t, 0)) == "BOS R0:0 SEP"
    assert text(K.first_k_measures(t, 9)) == "BOS R0:0 SEP M4/4 P0 T3C N:1O:C:1S:0"
    assert text(K.after_k_measures(t, 1)) == "BOS R0:0 SEP EOS"
    assert text(J.primer_tokens(t, 99, "token", CORPUS)) == ""


def test_audits_find_each_fault(spark):
    good = "BOS R0:0 SEP M4/4 P0 T3C N:1O:C:1S:0 EOS"
    bad = {
        "R0:0 SEP M4/4 P0 N:1O:C:1S:0 EOS": "no BOS at start",
        "BOS R0:0 SEP M4/4 P0 N:1O:C:1S:0": "no EOS at end",
        "BOS R0:0 R1:0 SEP M4/4 EOS": "repeated track number",
        "BOS R0:0 SEP M4/4 N:1O:C:1S:0 EOS": "no position before note",
        "BOS R0:0 SEP M4/4 P0 M4/4 T3C EOS": "no position before tempo",
        "BOS R0:0 SEP M4/4 P0 N:1O:C:1S:1 EOS": "note in undeclared track",
        "BOS SEP M4/4 EOS": "no track in head",
        "BOS R0:0 SEP X EOS": "unknown type",
    }
    t = tokens_from(spark, good, *bad)
    found = {}
    for r in Y.audit_grammar(t).collect():
        found.setdefault(r.piece_id, set()).add(r.violation)
    assert 0 not in found
    for i, reason in enumerate(bad.values(), 1):
        assert reason in found[i]
    order = Y.audit_order(tokens_from(spark, good, "BOS R0:0 SEP M4/4 P5 N:1O:C:1S:0 P5 T3C N:1O:C:1S:0 T3C EOS"))
    assert rows(order, "piece_id", "violation") == [
        (1, "position does not increase"), (1, "second tempo at position"), (1, "tempo after note")]


def test_head_longer_than_an_example(spark):
    t = tokens_from(spark, "BOS R0:0 R1:1 R2:2 SEP M4/4 P0 T3C N:1O:C:1S:0 EOS")
    build = J.ExampleBuild(t, CORPUS, ExampleParams(max_len=4))
    # The first measure lies past the step boundary, so it opens an example of its own.
    assert rows(build.examples, "vp_idx", "pos", "is_body") == [(v, i, False) for v in (0, 1) for i in range(4)]


def test_virtual_pieces_by_hand(spark):
    body = " ".join("M4/4 P0 N:1O:C:1S:0" for _ in range(10))
    t = tokens_from(spark, f"BOS R0:0 SEP {body} EOS")  # measures at 3, 6, ..., 30; 34 rows
    build = J.ExampleBuild(t, CORPUS, ExampleParams(max_len=10, step_ratio=0.5))
    # Step 5: 6 opens (5, 10], then 12 in (10, 15], 18, 21, 27; 27 > 34 - 10 ends it.
    assert rows(build.starts, "vp_idx", "start") == [(0, 3), (1, 6), (2, 12), (3, 18), (4, 21), (5, 27)]


def test_permutations_keep_contents(spark, folder):
    from motifmill.plans.catalog import EXAMPLES, Workspace

    ex = Workspace.of(spark, folder).examples
    key = ["piece_id", "vp_idx", "pitch_shift"]
    bag = lambda df: df.select(*key, "evt", "pit", "dur", "vel", "mps")
    mixed = E.permute_mps(ex, EXAMPLES)
    assert bag(mixed).exceptAll(bag(ex)).isEmpty() and bag(ex).exceptAll(bag(mixed)).isEmpty()
    falls = mixed.select(*key, "pos", "mps").orderBy(*key, "pos").limit(3000).collect()
    for a, b in zip(falls, falls[1:]):
        assert a[:3] != b[:3] or a.mps <= b.mps
    tracks = E.permute_tracks(ex, 40, EXAMPLES)
    pairs = tracks.withColumnRenamed("trn", "new").join(ex.select(*key, "pos", "trn"), [*key, "pos"])
    per = pairs.groupBy(*key, "trn").agg(F.countDistinct("new").alias("n"), F.min("new").alias("lo"))
    assert per.filter("n != 1 or (trn = 0) != (lo = 0)").isEmpty()


def test_text_sinks(spark, tmp_path):
    corpus = spark.createDataFrame([(2, "BOS c"), (0, "BOS a"), (1, "BOS b")], "piece_id bigint, text string")
    Z.write_corpus_lines(corpus, str(tmp_path))
    assert [r.value for r in spark.read.text(f"{tmp_path}/corpus_lines").orderBy("value").collect()] == [
        "BOS a", "BOS b", "BOS c"]
    Z.write_corpus(corpus.union(spark.createDataFrame([(3, "junk")], corpus.schema)), str(tmp_path))
    assert Z.read_corpus(spark, str(tmp_path)).count() == 3
    with pytest.raises(IndexError):
        Z.get_piece(corpus, 9)
    assert rows(Z.extract(corpus, "-1"), "text") == [("BOS c",)]
    assert rows(Z.get_line(corpus, -1), "text") == [("BOS c",)]
    pieces = spark.createDataFrame([(1, "b.mid"), (0, "a.mid")], "piece_id bigint, path string")
    Z.write_pathlist(pieces, str(tmp_path))
    assert rows(R.read_pathlist(spark, f"{tmp_path}/pathlist"), "path") == [("a.mid",), ("b.mid",)]
    assert Z.corpus_len(pieces) == 2
    stats = T.describe(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "name string, value double"))
    Z.write_stats(stats, f"{tmp_path}/stats")
    assert spark.read.json(f"{tmp_path}/stats").first()["50%"] == 2.0


def test_checkpoint_folder_of_the_session_is_used(spark):
    from motifmill.session import ensure_checkpoint_dir, stage

    staged = stage(spark.range(3), "three")
    assert all(ensure_checkpoint_dir(spark).split(":")[-1] in f for f in staged.inputFiles())


def test_evaluating_a_collection_against_itself(spark):
    h = spark.createDataFrame(
        [(p, f, str(b), b + p) for p in (1, 2) for f in ("pitch_histogram", "velocity_histogram") for b in (3, 4, 5)],
        "piece_id bigint, feature string, bin string, n bigint")
    for r in J.evaluate(h, h).collect():
        assert (r.kld, r.hi) == (pytest.approx(0.0), pytest.approx(1.0)) and r.oa == pytest.approx(1.0)


def test_describe_with_an_outlier(spark):
    """One value far away leaves the others spread over the ranges, and the quartiles exact."""
    import statistics
    from motifmill.operators import stats as T
    values = [float(v) for v in range(2000)] + [1e12]
    got = T.describe(spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "name string, value double")).collect()
    a = next(r for r in got if r["name"] == "a")
    assert [a["25%"], a["50%"], a["75%"]] == pytest.approx(statistics.quantiles(values, n=4, method="inclusive"))


def test_dropped_notes(spark):
    notes = spark.createDataFrame([(1, 0, 0, 5, 60), (1, 0, 300, 310, 60), (1, 128, 0, 5, 20), (2, 0, 5, 5, 60)],
                                  "piece_id bigint, instrument int, start int, end int, pitch int")
    p = CORPUS.with_(event_time_limit=200)
    assert rows(C.dropped_notes(notes, p), "piece_id", "reason", "n") == [(1, "no drum", 1), (1, "too late", 1), (2, "no length", 1)]
    assert C.keep_playable_notes(notes, p).count() == 1


def test_staged_tables_of_a_job_are_dropped(spark):
    import os
    from motifmill import session
    with session.job(spark):
        kept = session.stage(spark.range(3))
        path = kept.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
