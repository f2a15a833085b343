"""Training examples cut from token rows (WIN17, EXM2-10, ARR5-6)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from motifmill.functions import scalars as S
from motifmill.functions.scan import ranked, running
from motifmill.params import ExampleParams
from motifmill.session import exists, setting, stage, stage_each

EXAMPLE = ["piece_id", "vp_idx", "pitch_shift"]
ATTRS = ["evt", "pit", "dur", "vel", "trn", "mps"]
HEAD_SALTS = 16


def piece_layout(token_rows: DataFrame, sep_id: int) -> DataFrame:
    """Length of each piece and where its body starts."""
    return token_rows.groupBy("piece_id").agg(
        F.count("*").alias("n_rows"),
        (F.min(F.when(F.col("evt") == sep_id, F.col("seq"))) + 1).alias("body_start"))


def virtual_pieces(token_rows: DataFrame, layout: DataFrame, measure_ids: list[int],
                   e: ExampleParams) -> DataFrame:
    """WIN17: where examples start.

    The body start; and in pieces longer than ``max_len`` the first measure after each step
    boundary, until what remains fits into one example (K23).
    """
    body = layout.select("piece_id", "n_rows", "body_start", F.col("body_start").alias("start"))
    if e.step_ratio <= 0:
        starts = body
    else:
        step = max(1, int(e.max_len * e.step_ratio))
        measures = token_rows.filter(F.col("evt").isin(measure_ids)).select("piece_id", "seq")
        bucket = F.ceil(F.col("seq") / step)
        firsts = (measures.filter(F.col("seq") > step).groupBy("piece_id", bucket.alias("bucket"))
                  .agg(F.min("seq").alias("start")).join(layout, "piece_id")
                  .filter(F.col("n_rows") > e.max_len))
        rest = F.when(F.col("start") > F.col("n_rows") - e.max_len, F.col("start"))
        last = firsts.groupBy("piece_id").agg(F.min(rest).alias("last"))
        more = firsts.join(last, "piece_id").filter("last is null or start <= last")
        starts = body.unionByName(more.select("piece_id", "n_rows", "body_start", "start"))
    w = Window.partitionBy("piece_id").orderBy("start", "body")
    # The body start comes first even if a measure starts at the same row.
    marked = starts.withColumn("body", (F.col("start") != F.col("body_start")).cast("int"))
    return marked.select("piece_id", (F.row_number().over(w) - 1).alias("vp_idx"), "start",
                         "n_rows", "body_start")


def rotate(starts: DataFrame, epoch: int) -> DataFrame:
    """EXM7: one start per piece, another one each epoch."""
    n = F.count("*").over(Window.partitionBy("piece_id"))
    return starts.withColumn("_n", n).filter(F.col("vp_idx") == F.pmod(F.lit(epoch), F.col("_n"))).drop("_n")


def cut_examples(token_rows: DataFrame, starts: DataFrame, e: ExampleParams) -> DataFrame:
    """EXM2: head and body slice of each example, at most ``max_len`` rows.

    Rows meet their examples per (piece, row block), so a piece with many examples is spread
    out; the head, needed by every example of a piece, is spread by a salt.
    """
    fits = F.col("body_start") < e.max_len
    ends = starts.withColumns({
        "head_len": F.least("body_start", F.lit(e.max_len)),
        "stop": F.when(fits, F.col("start") + e.max_len - F.col("body_start")).otherwise(F.col("start"))})
    width = e.max_len
    blocks = F.sequence(S.idiv("start", F.lit(width)), S.idiv(F.col("stop") - 1, F.lit(width)))
    wanted = ends.filter("stop > start").withColumn("_blk", F.explode(blocks))
    body = (token_rows.withColumn("_blk", S.idiv("seq", F.lit(width)))
            .join(wanted, ["piece_id", "_blk"])
            .filter((F.col("seq") >= F.col("start")) & (F.col("seq") < F.col("stop")))
            .withColumn("pos", F.col("seq") - F.col("start") + F.col("body_start")))
    # Heads are a few rows per piece; how many says its layout.
    sizes = ends.groupBy("piece_id").agg(F.max("head_len").alias("_head"))
    heads = (token_rows.filter(F.col("seq") < e.max_len).join(sizes, "piece_id")
             .filter(F.col("seq") < F.col("_head")).drop("_head")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(HEAD_SALTS - 1)))))
    head = (heads.join(ends.withColumn("_salt", F.pmod("vp_idx", F.lit(HEAD_SALTS))), ["piece_id", "_salt"])
            .filter(F.col("seq") < F.col("head_len")).withColumn("pos", F.col("seq")))
    columns = ["piece_id", "vp_idx", "body_start", "head_len", "pos", *ATTRS]
    return head.select(*columns).unionByName(body.select(*columns)).withColumns({
        "pos": F.col("pos").cast("int"), "is_body": F.col("pos") >= F.col("head_len")})


def rebase_mps(examples: DataFrame) -> DataFrame:
    """EXM3: body mps numbers start at 4."""
    w = Window.partitionBy("piece_id", "vp_idx")
    low = F.min(F.when(F.col("is_body"), F.col("mps"))).over(w)
    return examples.withColumn("_low", low).withColumn(
        "mps", F.when(F.col("is_body"), F.when(
            F.col("_low") < 4, F.raise_error(F.lit("mps number in body is less than 4"))
        ).otherwise(F.col("mps") - F.col("_low") + 4)).otherwise(F.col("mps")).cast("int")).drop("_low")


def augment_pitch(examples: DataFrame, drum_event: int, e: ExampleParams) -> DataFrame:
    """EXM4: a copy per shift; body pitches of non-drum tracks move, clipped to the range."""
    p = e.pitch_range
    shifts = F.explode(F.sequence(F.lit(-p), F.lit(p)))
    if p == 0:
        return examples.withColumn("pitch_shift", shifts)
    cut = ["piece_id", "vp_idx"]
    heads = examples.filter((F.col("evt") == drum_event) & (F.col("pos") < F.col("body_start"))).select(
        *cut, "trn").distinct().withColumn("_drum", F.lit(True))
    moves = F.col("is_body") & (F.col("pit") != 0) & F.col("_drum").isNull()
    pitch, w = F.when(F.col("_moves"), F.col("pit")), Window.partitionBy(*cut)
    # Everything that an example's copies share is found before they are made.
    marked = examples.join(heads, [*cut, "trn"], "left").withColumn("_moves", moves).withColumns(
        {"_low": F.min(pitch).over(w), "_high": F.max(pitch).over(w)})
    shift = F.least(F.greatest(F.col("pitch_shift"), 1 - F.col("_low")), 128 - F.col("_high"))
    return marked.withColumn("pitch_shift", shifts).withColumn(
        "pit", F.when(F.col("_moves"), F.col("pit") + shift).otherwise(F.col("pit"))
    ).select(*examples.columns, "pitch_shift")


def permute_tracks(examples: DataFrame, n_tracks: int, e: ExampleParams) -> DataFrame:
    """EXM5: track ids 1..n relabelled at random per example, by hash; 0 stays."""
    ids = F.sequence(F.lit(1), F.lit(n_tracks))
    drawn = F.array_sort(F.transform(ids, lambda t: F.struct(
        S.shared_hash(F.lit(e.seed), *EXAMPLE, t).alias("h"), t.alias("t"))))
    order = F.transform(drawn, lambda s: s["t"])
    relabelled = F.when(F.col("trn") == 0, 0).otherwise(F.array_position("_order", F.col("trn")))
    labels = examples.select(*EXAMPLE).distinct().withColumn("_order", order)
    return (examples.join(labels, EXAMPLE)
            .withColumn("trn", relabelled.cast("int")).drop("_order"))


def permute_mps(examples: DataFrame, e: ExampleParams) -> DataFrame:
    """EXM6: shuffle the tokens of each run, tracks of the head too, by hash."""
    h = S.shared_hash(F.lit(e.seed), *EXAMPLE, "pos")
    by = Window.partitionBy(*EXAMPLE).orderBy("is_body", "mps", h)
    return examples.withColumn("pos", (F.row_number().over(by) - 1).cast("int"))


def example_count(starts: DataFrame, e: ExampleParams) -> DataFrame:
    """EXM8."""
    n = F.count("*") if e.flatten else F.countDistinct("piece_id")
    return starts.agg((n * (2 * e.pitch_range + 1)).alias("n_examples"))


def to_arrays(examples: DataFrame) -> DataFrame:
    """EXM9: a row per example with one array per attribute; at most ``max_len`` long."""
    rows = F.array_sort(F.collect_list(F.struct("pos", *ATTRS)))
    grouped = examples.groupBy(*EXAMPLE).agg(rows.alias("_rows"))
    return grouped.select(*EXAMPLE, F.size("_rows").alias("length"),
                          *[F.col(f"_rows.{a}").alias(a) for a in ATTRS])


def pad_batch(arrays: DataFrame, max_len: int, side: str = "right") -> DataFrame:
    """ARR5: zeros up to ``max_len`` on the given side."""
    def padded(a):
        zeros = F.array_repeat(F.lit(0), F.lit(max_len) - F.size(a))
        return (F.concat(a, zeros) if side == "right" else F.concat(zeros, a)).alias(a)

    return arrays.select(*EXAMPLE, "length", *[padded(a) for a in ATTRS])


# ---- export -----------------------------------------------------------------------------

SHARD = ["bucket", "shard"]


def _digest(*columns) -> Column:
    """A number for each example; sums of them, over any order, tell shards apart."""
    return F.xxhash64(*columns).bitwiseAND(0xFFFFFFFF)


def place_in_shards(arrays: DataFrame, e: ExampleParams, shard_bytes: int, bucket_width: int) -> DataFrame:
    """``arrays`` padded to the upper end of their length bucket, with ``bucket``, ``shard`` and a place in it.

    Within a bucket, examples are in the order of their hashes (so shards are shuffled, and the same each time), and a
    shard is as many of them as fit into ``shard_bytes``.  Places are running counts over blocks of hashes.
    """
    length = F.ceil(F.greatest("length", F.lit(1)) / bucket_width) * bucket_width
    keyed = arrays.withColumns({"bucket": length.cast("int"), "_h": F.xxhash64(F.lit(e.seed), *EXAMPLE)})
    numbered = running(keyed.select(*EXAMPLE, "bucket", "_h"), ["bucket"], ["_h", *EXAMPLE], F.shiftright("_h", 48), sums={"_n": F.lit(1)})
    fit = F.greatest(S.idiv(F.lit(shard_bytes), F.col("bucket") * (4 * len(ATTRS))), F.lit(1))
    placed = numbered.select(*EXAMPLE, S.idiv(F.col("_n") - 1, fit).cast("int").alias("shard"),
                             ((F.col("_n") - 1) % fit).cast("int").alias("place"))
    padded = [F.concat(a, F.array_repeat(F.lit(0), F.col("bucket") - F.size(a))).alias(a) for a in ATTRS]
    return keyed.join(placed, EXAMPLE).select(*SHARD, "place", *EXAMPLE, "length", *padded)


def export_examples(arrays: DataFrame, folder: str, e: ExampleParams, shard_bytes: int = 64 << 20, bucket_width: int = 64,
                    wave: int = 1024, waves: int | None = None) -> DataFrame:
    """EXM9: training examples as shards of bounded bytes; returns the manifest, a row per shard that is written.

    ``folder/shards`` has a file per ``(bucket, shard)``, each a table of arrays of the bucket's length; ``folder/manifest``
    the shards' examples, bytes and digests.  Shards are written ``wave`` by ``wave``, and a wave is in the manifest
    once it is whole: an export that was broken off goes on where it was when it is called again, and a
    shard that is written twice is the same both times.  ``waves`` ends an export early.

    ``arrays`` is read three times and should be a stored table.  Examples are dealt out by wave once, so a wave reads its own.
    """
    spark = arrays.sparkSession
    placed = stage(place_in_shards(arrays, e, shard_bytes, bucket_width), "placed")
    schema = "bucket int, shard int, n_examples bigint, n_bytes bigint, digest bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    manifest = lambda: spark.read.schema(schema).parquet(f"{folder}/manifest")
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/manifest")
    planned = placed.groupBy(*SHARD).agg(
        F.count("*").alias("n_examples"), (F.count("*") * F.col("bucket") * (4 * len(ATTRS))).alias("n_bytes"),
        F.sum(_digest("place", *EXAMPLE, "length", *ATTRS)).alias("digest"))
    todo = planned.join(manifest(), [*SHARD, "digest"], "left_anti").select(F.struct(*names).alias("_s"))
    todo = stage(ranked(todo, "_s", "_n").select("_s.*", S.idiv("_n", F.lit(wave)).cast("int").alias("_wave")), "todo", plain=True)
    last = todo.agg(F.max("_wave")).first()[0]
    count = 0 if last is None else last + 1 if waves is None else min(last + 1, waves)
    if not count:
        return manifest()
    dealt = stage(placed.join(todo.filter(F.col("_wave") < count).select(*SHARD, "_wave"), SHARD)
                  .repartitionByRange("_wave", *SHARD).sortWithinPartitions("_wave"), "waves", by=["_wave"])
    for k in range(count):
        rows = dealt.filter(F.col("_wave") == k).drop("_wave")
        # Tasks may move their files themselves: nobody reads a shard before its wave is in the manifest.
        (rows.repartition(*SHARD).sortWithinPartitions(*SHARD, "place").write.partitionBy(*SHARD)
         .option("partitionOverwriteMode", "dynamic").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .mode("overwrite").parquet(f"{folder}/shards"))
        todo.filter(F.col("_wave") == k).select(*names).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return manifest()


#: Shards whose files the driver lists at once; it holds some kB for each.
LISTED = 1 << 13


def read_shards(spark: SparkSession, folder: str, listed: int = LISTED) -> DataFrame:
    """The examples of an export, padded; shards that the manifest doesn't have are left out.

    Of more than ``listed`` shards so many at a time are put together in a stored table of fewer files.
    """
    arrays = ", ".join(f"{a} array<int>" for a in ATTRS)
    schema = f"place int, piece_id bigint, vp_idx int, pitch_shift int, length int, {arrays}, bucket int, shard int"
    reader = spark.read.schema(schema).option("basePath", f"{folder}/shards")
    whole = spark.read.schema("bucket int, shard int").parquet(f"{folder}/manifest").distinct()
    count = whole.count()
    if count <= listed:
        return reader.parquet(f"{folder}/shards").join(whole, SHARD, "left_semi")
    numbered = stage(ranked(whole.select(F.struct(*SHARD).alias("_s")), "_s", "_n").select("_s.*", "_n"), "listed", plain=True)
    cores = spark.sparkContext.defaultParallelism

    def parts() -> Iterator[DataFrame]:
        for first in range(0, count, listed):
            some = numbered.filter(F.col("_n").between(first, first + listed - 1)).select(*SHARD).collect()
            paths = [f"{folder}/shards/bucket={b}/shard={s}" for b, s in some]
            try:
                rows = reader.parquet(*paths)
            except AnalysisException:  # some are lost, which ``damaged_shards`` tells
                paths = [p for p in paths if exists(spark, p)]
                rows = reader.parquet(*paths) if paths else spark.createDataFrame([], schema)
            yield rows.select(*SHARD, *(c for c in rows.columns if c not in SHARD)).coalesce(cores)

    # By default there is a task for each folder, of which the driver keeps a record, and it keeps what it has listed.
    with (setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * cores)),
          setting(spark, "spark.sql.hive.filesourcePartitionFileCacheSize", "0")):
        return stage_each(parts(), "shards")


def damaged_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``(bucket, shard)`` of the manifest whose examples aren't what was written."""
    found = read_shards(spark, folder).groupBy(*SHARD).agg(F.sum(_digest("place", *EXAMPLE, "length", *ATTRS)).alias("found"))
    wanted = spark.read.schema("bucket int, shard int, digest bigint").parquet(f"{folder}/manifest")
    return wanted.join(found, SHARD, "left").filter("found is null or found <> digest").select(*SHARD)


def shift_targets(examples: DataFrame, drop_mps: bool = True) -> DataFrame:
    """ARR6: every row but the last, with the next row as its target."""
    w = Window.partitionBy(*EXAMPLE).orderBy("pos")
    targets = ATTRS[:-1] if drop_mps else ATTRS
    shifted = examples.withColumns({
        "_more": F.lead("pos").over(w), **{f"target_{a}": F.lead(a).over(w) for a in targets}})
    return shifted.filter("_more is not null").drop("_more")
