"""Files by ranges of pieces, shards of training examples, digests of corpora."""

import os
import shutil
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from motifmill.operators import examples as E, verify as Y
from motifmill.operators.decode import Decoded
from motifmill.params import ExampleParams
from motifmill.sources import tables as Z

KEYS = E.EXAMPLE + ["length", *E.ATTRS]


def files_read(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles()}


# ---- ranges -----------------------------------------------------------------------------

@pytest.fixture
def stored(spark, tmp_path):
    """Token rows of 40 pieces, a third of all rows in one of them, in about 12 files."""
    ids = spark.range(40).select(F.col("id").alias("piece_id"), F.when(F.col("id") == 7, 900).otherwise(45).alias("n"))
    table = ids.select("piece_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seq")).select(
        "piece_id", F.col("seq").cast("int").alias("seq"), *(F.lit(k).cast("int").alias(a) for k, a in enumerate(E.ATTRS)))
    Z.write_token_rows(table, str(tmp_path), parts=12)
    return table, str(tmp_path)


def test_only_files_with_wanted_pieces_are_read(spark, stored):
    table, folder = stored
    whole = Z.read_token_rows(spark, folder)
    assert rows(whole, "piece_id", "seq") == rows(table, "piece_id", "seq") and len(files_read(whole)) > 8
    for wanted in ([3], [0, 39], [7], [12, 13, 14]):
        some = Z.read_token_rows(spark, folder, spark.createDataFrame([(i,) for i in wanted], "piece_id bigint"))
        assert rows(some, "piece_id", "seq") == rows(table.filter(F.col("piece_id").isin(wanted)), "piece_id", "seq")
        having = whole.filter(F.col("piece_id").isin(wanted)).select("_metadata.file_name").distinct().collect()
        assert files_read(some) >= {r[0] for r in having}
        # No more than those with the pieces, and at most one beside each edge.
        assert len(files_read(some)) <= len(having) + 2 * len(wanted)
    # The long piece takes several files.
    assert whole.filter("piece_id = 7").select("_metadata.file_name").distinct().count() > 2


def test_no_file_for_unknown_pieces(spark, stored):
    nothing = spark.createDataFrame([(1000,), (None,), (-1,)], "piece_id bigint")
    assert Z.read_token_rows(spark, stored[1], nothing).count() == 0
    assert Z.read_token_rows(spark, stored[1], nothing.limit(0)).count() == 0


def test_one_piece_from_one_file(spark, tmp_path):
    corpus = spark.range(300).select(F.col("id").alias("piece_id"), F.concat(F.lit("BOS "), "id").alias("text"))
    Z.write_ranged(corpus, f"{tmp_path}/corpus", ["piece_id"], parts=10)
    assert rows(Z.read_corpus(spark, str(tmp_path)), "piece_id") == rows(corpus, "piece_id")
    for i in (0, 150, 299):
        piece = Z.stored_piece(spark, str(tmp_path), i)
        assert piece.first() == (i, f"BOS {i}") and len(files_read(piece)) == 1
    with pytest.raises(IndexError):
        Z.stored_piece(spark, str(tmp_path), 300)


# ---- shards -----------------------------------------------------------------------------

P = ExampleParams(max_len=64, seed=3)


@pytest.fixture
def arrays(spark):
    """500 examples of all lengths; two thirds are short."""
    n = F.when(F.col("id") % 3 > 0, 1 + F.col("id") % 9).otherwise(1 + F.col("id") % 64)
    return spark.range(500).select(
        F.floor(F.col("id") / 5).alias("piece_id"), (F.col("id") % 5).cast("int").alias("vp_idx"), F.lit(0).alias("pitch_shift"),
        n.cast("int").alias("length"),
        *(F.transform(F.sequence(F.lit(1), n), lambda x, k=k: (x * k + F.col("id")).cast("int")).alias(a) for k, a in enumerate(E.ATTRS)))


def bare(shards):
    return rows(shards.select(*E.EXAMPLE, "length", *(F.slice(a, F.lit(1), F.col("length")).alias(a) for a in E.ATTRS)), *KEYS)


def test_shards_hold_every_example_once(spark, arrays, tmp_path):
    manifest = E.export_examples(arrays, str(tmp_path), P, shard_bytes=6000, bucket_width=16)
    shards = E.read_shards(spark, str(tmp_path))
    assert bare(shards) == rows(arrays, *KEYS)
    assert manifest.agg(F.sum("n_examples")).first()[0] == 500
    assert shards.filter(" or ".join(f"size({a}) <> bucket" for a in E.ATTRS)).isEmpty()
    assert shards.filter("bucket % 16 <> 0 or length > bucket or length <= bucket - 16").isEmpty()
    # Bytes are bounded, all but the last shard of a bucket are full, and each is one file.
    assert manifest.filter("n_bytes > 6000").isEmpty() and manifest.filter("bucket = 16").count() > 10
    sizes = {(r.bucket, r.shard): r.n_examples for r in manifest.collect()}
    assert all(sizes[b, s] == 6000 // (24 * b) for b, s in sizes if (b, s + 1) in sizes)
    folders = [[f for f in names if f.endswith(".parquet")] for _, _, names in os.walk(tmp_path / "shards")]
    assert sum(map(bool, folders)) == len(sizes) == sum(map(len, folders))
    assert E.damaged_shards(spark, str(tmp_path)).isEmpty()


def test_an_export_goes_on_where_it_was_broken_off(spark, arrays, tmp_path):
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    listed = lambda m: sorted(map(tuple, m.collect()))
    want = listed(E.export_examples(arrays, whole, P, 6000, 16))
    first = listed(E.export_examples(arrays.repartition(3), broken, P, 6000, 16, wave=4, waves=2))
    assert len(first) == 8 and set(first) < set(want)
    # A wave that was written, but not listed, is written again.
    lost = E.place_in_shards(arrays, P, 6000, 16).filter("bucket = 64")
    lost.repartition(*E.SHARD).write.mode("append").partitionBy(*E.SHARD).parquet(f"{broken}/shards")
    assert listed(E.export_examples(arrays.repartition(7), broken, P, 6000, 16, wave=5)) == want
    assert bare(E.read_shards(spark, broken)) == bare(E.read_shards(spark, whole)) == rows(arrays, *KEYS)
    # Nothing is left to do; what is damaged is found.
    assert listed(E.export_examples(arrays, broken, P, 6000, 16, waves=1)) == want
    E.read_shards(spark, whole).filter("bucket = 32 and shard = 0").limit(1).write.mode("append").partitionBy(*E.SHARD).parquet(f"{whole}/shards")
    assert rows(E.damaged_shards(spark, whole), *E.SHARD) == [(32, 0)]


def test_a_wave_reads_its_own_examples(spark, arrays, tmp_path, monkeypatch):
    """Waves don't read what other waves write; the examples are placed once, and come out whole."""
    seen, table = [], E.stage

    def staged(df, name="stage", **more):
        out = table(df, name, **more)
        seen.append((name, out))
        return out

    monkeypatch.setattr(E, "stage", staged)
    manifest = E.export_examples(arrays, str(tmp_path), P, 6000, 16, wave=4)
    assert bare(E.read_shards(spark, str(tmp_path))) == rows(arrays, *KEYS)
    assert [name for name, _ in seen].count("placed") == 1 and "wave" not in dict(seen)
    waves, n = dict(seen)["waves"], manifest.count()
    own = waves.filter(F.col("_wave") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "(_wave" in own.split("PartitionFilters: [")[1].split("]")[0]
    assert waves.count() == 500 and waves.select(*E.SHARD, "_wave").distinct().count() == n
    assert rows(waves.groupBy("_wave").agg(F.countDistinct(*E.SHARD).alias("n")), "n")[-1] == (4,)


def test_shards_are_read_some_at_a_time(spark, arrays, tmp_path, monkeypatch):
    """The driver lists the files of no more than ``listed`` shards at once, whatever their number."""
    folder, seen, staged = str(tmp_path), [], E.stage_each

    def stage_each(parts, name):
        def watched():
            for part in parts:
                seen.append(len(part.inputFiles()))
                yield part
        return staged(watched(), name)

    monkeypatch.setattr(E, "stage_each", stage_each)
    n = E.export_examples(arrays, folder, P, 6000, 16).count()
    # What the manifest doesn't have is left out, also of shards read so.
    E.read_shards(spark, folder).filter("bucket = 16 and shard = 0").withColumn("shard", F.lit(1000)).write.mode("append").partitionBy(*E.SHARD).parquet(f"{folder}/shards")
    key, before = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    few = E.read_shards(spark, folder, listed=7)
    assert sum(seen) == n > 7 and max(seen) == 7 and spark.conf.get(key) == before
    assert len(few.inputFiles()) <= len(seen) * spark.sparkContext.defaultParallelism
    whole = E.read_shards(spark, folder)
    assert few.schema == whole.schema and rows(few, *whole.columns) == rows(whole, *whole.columns) and bare(few) == rows(arrays, *KEYS)
    # A shard that is lost is left out, as in a read of all.
    shutil.rmtree(tmp_path / "shards" / "bucket=32" / "shard=0")
    few, whole = E.read_shards(spark, folder, listed=7), E.read_shards(spark, folder)
    assert rows(few, *whole.columns) == rows(whole, *whole.columns) and few.count() < 500


def test_export_of_nothing(spark, arrays, tmp_path):
    assert E.export_examples(arrays.limit(0), str(tmp_path), P).isEmpty()


# ---- digests ----------------------------------------------------------------------------

@pytest.fixture
def corpus(spark):
    notes = spark.range(3000).select(
        (F.col("id") % 6).alias("piece_id"), (F.col("id") % 3).cast("int").alias("track_number"), (F.col("id") * 7).cast("int").alias("start"),
        (F.col("id") * 7 + 5).cast("int").alias("end"), (F.col("id") % 128).cast("int").alias("pitch"), F.lit(64).alias("velocity"))
    per_piece = lambda **c: spark.range(6).select(F.col("id").alias("piece_id"), *(F.lit(v).alias(k) for k, v in c.items()))
    return Decoded(notes, per_piece(onset=0, bpm=120), per_piece(onset=0, numer=4, denom=4), per_piece(track_number=0, instrument=1), None)


def test_equal_corpora_differ_nowhere(spark, corpus):
    other = replace(corpus, notes=corpus.notes.repartition(5))
    assert Y.differing_stretches(Y.items(corpus), Y.items(other)).isEmpty()
    assert Y.corpora_equal(corpus, other)


def test_only_differing_stretches_are_compared(spark, corpus):
    moved = F.when((F.col("piece_id") == 2) & (F.col("start") == 7 * 1202), F.col("end") + 1).otherwise(F.col("end"))
    other = replace(corpus, notes=corpus.notes.withColumn("end", moved.cast("int")))
    stretches = Y.differing_stretches(Y.items(corpus), Y.items(other))
    assert rows(stretches, "piece_id", "stretch") == [(2, 7 * 1202 // Y.DIGEST_TICKS)]
    assert rows(Y.compare_corpora(corpus, other), "piece_id", "reason") == [(2, "notes")]


def test_repeated_notes_are_no_difference(spark, corpus):
    other = replace(corpus, notes=corpus.notes.union(corpus.notes.filter("piece_id = 1")))
    assert Y.differing_stretches(Y.items(corpus), Y.items(other)).select("piece_id").distinct().count() == 1
    assert Y.corpora_equal(corpus, other)


def test_every_kind_of_difference(spark, corpus):
    change = lambda df, c: df.withColumn(c, (F.col(c) + 1).cast(df.schema[c].dataType))
    for table, column, reason in (("tracks", "instrument", "tracks"), ("tempos", "bpm", "tempos"), ("time_sigs", "numer", "time signatures"),
                                  ("notes", "pitch", "notes"), ("notes", "end", "notes")):
        other = replace(corpus, **{table: change(getattr(corpus, table), column)})
        assert rows(Y.compare_corpora(corpus, other), "piece_id", "reason") == [(i, reason) for i in range(6)]
    missing = replace(corpus, tempos=corpus.tempos.filter("piece_id <> 3"))
    assert rows(Y.compare_corpora(missing, corpus), "piece_id", "reason") == [(3, "tempos")]
    assert rows(Y.compare_corpora(corpus, replace(corpus, notes=corpus.notes.filter("piece_id <> 5"))), "piece_id") == [(5,)]
