"""Results do not depend on partitions, block sizes or where a huge piece is cut."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from motifmill.functions import scan
from motifmill.operators import cleaning as C, decode as D, features as X, tokens as K, verify as Y, vocab as V
from motifmill.params import CORPUS
from motifmill.plans import jobs as J
from motifmill.session import setting, stage
from motifmill.sources.projections import raw_tables
from motifmill.sources.raw import RawTables


@pytest.fixture(scope="module")
def one_big_piece(spark, folder):
    """Two thirds of the pieces put one after the other into a single long piece."""
    raw = raw_tables(spark, folder)
    big = F.col("piece_id") < 7
    late = F.when(big, F.col("piece_id") * 61440).otherwise(0)
    into = F.when(big, 0).otherwise(F.col("piece_id"))
    move = lambda df, *times: df.select(*[
        (into.alias(c) if c == "piece_id" else (F.col(c) + late).alias(c) if c in times else F.col(c))
        for c in df.columns])
    four = raw.time_sigs.filter("change_idx = 0")
    parts = [raw.pieces.filter("piece_id not between 1 and 6"),
             raw.tracks.filter("piece_id not between 1 and 6"), move(raw.notes, "start_tick", "end_tick"),
             four.filter("piece_id not between 1 and 6"), move(raw.tempos, "time_tick")]
    return RawTables(*[stage(p, "big") for p in parts])


def corpus(raw, p):
    return rows(J.build_corpus(raw, p).corpus, "piece_id", "text")


def test_blocks_do_not_show(one_big_piece):
    want = corpus(one_big_piece, CORPUS.with_(block_ticks=2**17))
    assert len(want) == 4
    for ticks in (24, 384):
        assert corpus(one_big_piece, CORPUS.with_(block_ticks=ticks)) == want


def test_numbered_tokens_spell_the_corpus(one_big_piece):
    build = J.build_corpus(one_big_piece, CORPUS.with_(block_ticks=96))
    tokens = stage(build.tokens)
    assert rows(K.join_text(tokens), "piece_id", "text") == rows(build.corpus, "piece_id", "text")
    ends = tokens.groupBy("piece_id").agg(F.count("*").alias("n"), F.max("seq").alias("top"),
                                          F.countDistinct("seq").alias("d"))
    assert ends.filter("n != top + 1 or n != d").isEmpty()


def test_stored_blocks_and_times_hold_no_text(one_big_piece):
    build = J.build_corpus(one_big_piece, CORPUS)
    tokens = stage(build.tokens)
    assert "text" not in build.blocks.columns and "text" in tokens.columns
    timed = J.timed_tokens(tokens, CORPUS.tpq)
    assert "Exchange" in (plan := timed._jdf.queryExecution().executedPlan().toString()) and "text" not in plan
    both = K.running_time(tokens, CORPUS.tpq).drop("text")
    assert timed.columns == both.columns and timed.exceptAll(both).isEmpty() and both.exceptAll(timed).isEmpty()


def test_small_sides_leave_notes_and_blocks_in_place(spark, one_big_piece):
    build = J.build_corpus(one_big_piece, CORPUS)
    blocks, tracks, track_map = stage(build.blocks), stage(build.tracks), stage(build.track_map)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        for column, frame in (("blk#", K.number_tokens(blocks, tracks)), ("track_idx#", C.quantised_notes(one_big_piece, track_map, CORPUS))):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            joins = [line for line in plan.split("\n") if "Join [piece_id#" in line and column in line]
            assert joins and all("BroadcastHashJoin" in line for line in joins), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scans_do_not_depend_on_their_block(one_big_piece, monkeypatch):
    tokens = stage(J.build_corpus(one_big_piece, CORPUS).tokens)

    def results():
        timed = stage(K.running_time(tokens, 12))
        return (rows(timed, "piece_id", "seq", "onset", "measure_no", "at"),
                rows(V.mps_numbers(tokens), "piece_id", "seq", "mps"),
                rows(K.first_k_ticks(tokens, 12, 500), "piece_id", "seq"),
                rows(Y.audit_order(tokens.filter("seq % 31 != 5")), "piece_id", "seq", "violation"))

    want = results()
    monkeypatch.setattr(scan, "TOKEN_BLOCK", 7)
    assert results() == want


def test_partitions_do_not_show(spark, one_big_piece):
    tokens = J.build_corpus(one_big_piece, CORPUS).tokens
    shuffled = stage(tokens.orderBy(F.xxhash64("seq", "piece_id")))

    def features(n):
        d = D.decode_tokens(K.running_time(shuffled.repartition(n), 12), 12)
        return rows(X.scalar_features(d).select("piece_id", *[F.round(c, 9).alias(c) for c in X.SCALARS]), "*")

    assert features(1) == features(8)


def test_plans_read_few_columns_and_use_no_cross_join(spark, folder, one_big_piece):
    build = J.build_corpus(one_big_piece, CORPUS)
    plan = build.blocks._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert plan.count("hashpartitioning(piece_id") == 1
    narrow = build.quantised.groupBy("piece_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<piece_id:bigint>" in narrow


def test_side_tables_are_as_large_as_their_rows(spark):
    """Tables with a row per piece, track or measure are no smaller on disk than their numbers, so Catalyst doesn't take millions of rows for a few kB."""
    ids = spark.range(400).select(F.col("id").alias("piece_id"))
    of = lambda df, spec: df.selectExpr(*spec.split("; "))
    raw = RawTables(*(stage(p.repartition(1), "raw", plain=True) for p in (
        of(ids, "piece_id; concat('a/', piece_id, '.mid') path; 12 ticks_per_beat"),
        of(ids, "piece_id; explode(sequence(0, 5)) track_idx; 0 program; false is_drum"),
        of(ids, "piece_id; explode(sequence(0, 5)) track_idx; 0 start_tick; 460 end_tick; 60 pitch; 64 velocity"),
        of(ids, "piece_id; 0 change_idx; 0 time_tick; 4 numer; 4 denom"),
        of(ids, "piece_id; 0 change_idx; 0 time_tick; 120.0D bpm"))))
    build = J.build_corpus(raw, CORPUS)
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tables = {"track_map": build.track_map, "stats": build.stats, "time_sigs": build.time_sigs, "segments": build.segments,
              "all_measures": build.all_measures, "tempos": build.tempos}
    for name, table in tables.items():
        full = [c for c, kind in table.dtypes if kind in ("int", "bigint") and table.filter(F.col(c).isNull()).isEmpty()]
        assert size(table) >= table.count() * 4 * len(full), name
    # A side of 2400 rows is above a limit of 30 kB: notes are not joined to a broadcast of it.
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "30k"):
        plan = C.quantised_notes(raw, build.track_map, CORPUS)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
