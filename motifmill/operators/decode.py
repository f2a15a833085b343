"""Tokens back to notes, tempos, time signatures and tracks (JON4-5, FLT16)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from motifmill.functions import scalars as S
from motifmill.operators import voice_kernel as H
from motifmill.operators.tokens import running_time, token_measures
from motifmill.operators.voice_kernel import VOICE
from motifmill.session import ship_package, stage

NOTE_COLUMNS = ["piece_id", "track_number", "start", "end", "pitch", "velocity"]


@dataclass(frozen=True)
class Decoded:
    notes: DataFrame
    tempos: DataFrame
    time_sigs: DataFrame
    tracks: DataFrame
    measures: DataFrame


def drop_out_of_range_notes(members: DataFrame) -> DataFrame:
    """FLT16."""
    return members.filter(F.col("pitch").between(0, 127))


def _members(df: DataFrame, shape, carried: list[str]) -> DataFrame:
    rel = df.select(*carried, "onset", "pitch", "stretch", F.posexplode(shape).alias("member", "m"))
    return drop_out_of_range_notes(rel.select(
        *carried, "member",
        (F.col("onset") + F.col("m.rel_onset") * F.col("stretch")).alias("onset"),
        (F.col("pitch") + F.col("m.rel_pitch")).alias("pitch"),
        (F.col("m.rel_dur") * F.col("stretch")).alias("duration"),
        F.col("m.is_cont").alias("is_cont")))


def expand_multi_notes(multi_notes: DataFrame, shapes: DataFrame) -> DataFrame:
    """JON4: members of every multi-note.

    The shape table has at most 2**16 rows by its id type, so it is broadcast.
    """
    carried = [c for c in multi_notes.columns if c not in ("onset", "pitch", "stretch")]
    joined = multi_notes.join(F.broadcast(shapes.select("shape_id", "shape")), "shape_id")
    return _members(joined, F.col("shape"), carried)


def token_members(timed: DataFrame) -> DataFrame:
    """JON4 on tokens, whose text holds the shape itself."""
    carried = ["piece_id", "seq", "track_number", "velocity"]
    notes = timed.filter(F.col("type").isin("N", "U"))
    # Most tokens are single notes: their only member is read off the row, without lists.
    single = drop_out_of_range_notes(notes.filter("shape is null").select(
        *carried, F.lit(0).alias("member"), F.when(F.col("duration").isNotNull(), F.col("onset")).alias("onset"), "pitch", "duration", "is_cont"))
    multi = notes.filter("shape is not null").withColumnRenamed("duration", "stretch")
    return single.unionByName(_members(multi, S.parse_shape("shape").cast(S.SHAPE_TYPE), carried))


#: Ticks of a block of a voice.
VOICE_BLOCK = 1 << 13


def stitch_continuations(members: DataFrame, block_ticks: int = VOICE_BLOCK) -> DataFrame:
    """JON5: rejoin the chunks of long notes.

    Within a voice (piece, track, pitch, velocity) a chunk that continues waits at its end, and a chunk that begins there
    takes the one that began to wait last.  Voices are dealt out in blocks of ticks; a block gives its whole notes, and
    summaries of the runs of chunks that reach into other blocks, which are put together per voice.
    """
    ship_package(members.sparkSession)
    end = F.col("onset") + F.col("duration")
    blk = lambda tick: F.floor(tick / F.lit(block_ticks)).cast("int")
    begins, waits = blk(F.col("onset")), F.when(F.col("is_cont") == 1, blk(F.col("end")))
    # A chunk is in the block where it begins, and in another one if it waits there.
    blocks = F.when(begins.isNull(), F.array_compact(F.array(waits))).when(waits != begins, F.array(begins, waits)).otherwise(F.array(begins))
    chunks = members.withColumn("end", end).withColumn("blk", F.explode(blocks))
    columns = [F.col(c).cast("bigint" if c == "piece_id" else "int").alias(c) for c in [*VOICE, "blk", *H.CHUNK]]
    dealt = chunks.select(*columns).repartition(*VOICE, "blk").sortWithinPartitions(*VOICE, "blk")
    schema = ("piece_id bigint, track_number int, pitch int, velocity int, whole boolean, start int, end int, state int, early boolean, "
              "late boolean, from_seq int, from_member int, to_seq int, to_member int")
    runs = stage(dealt.mapInArrow(lambda it: H.stitch_batches(it, block_ticks), schema), "runs")
    joined = runs.filter("not whole").groupBy(*VOICE).applyInPandas(
        H.join_fragments, "piece_id bigint, track_number int, start int, end int, pitch int, velocity int")
    return runs.filter("whole").select(*NOTE_COLUMNS).union(joined.select(*NOTE_COLUMNS))


def decode_tokens(tokens: DataFrame, tpq: int) -> Decoded:
    """JOB2: the tables behind a token sequence, in ticks from its first measure."""
    timed = tokens if "measure_no" in tokens.columns else running_time(tokens, tpq)
    measures = token_measures(timed, tpq)
    nd = F.struct("numer", "denom")
    before = F.lag(nd).over(Window.partitionBy("piece_id").orderBy("measure_idx"))
    time_sigs = (measures.withColumn("before", before)
                 .filter(F.col("before").isNull() | (F.col("before") != nd))
                 .select("piece_id", "onset", "numer", "denom"))
    return Decoded(
        notes=stitch_continuations(token_members(timed)),
        tempos=timed.filter("type = 'T'").select("piece_id", "onset", "bpm"),
        time_sigs=time_sigs,
        tracks=timed.filter("type = 'R'").select("piece_id", "track_number", "instrument"),
        measures=measures,
    )


def piano_roll(decoded: Decoded) -> DataFrame:
    """JON13: what a piano roll draws - notes, measure lines and bpm labels."""
    notes = decoded.notes.join(decoded.tracks, ["piece_id", "track_number"]).select(
        "piece_id", F.lit("note").alias("mark"), F.col("start").cast("double").alias("x0"),
        (F.col("end") - 0.25).cast("double").alias("x1"), "pitch",
        (F.col("instrument") == 128).alias("is_drum"), "track_number",
        F.lit(None).cast("int").alias("bpm"))
    lines = decoded.measures.select("piece_id", F.lit("measure").alias("mark"),
                                    F.col("onset").cast("double").alias("x0"))
    labels = decoded.tempos.select("piece_id", F.lit("bpm").alias("mark"),
                                   (F.col("onset") + 0.05).alias("x0"), "bpm")
    return notes.unionByName(lines, True).unionByName(labels, True)


def within_shape_links(multi_notes: DataFrame, shapes: DataFrame, tpq: int) -> DataFrame:
    """JON12: member pairs of a multi-note that overlap or follow within four quarters.

    Pairs stay inside one shape, which has a bounded number of members.
    """
    joined = multi_notes.join(F.broadcast(shapes.select("shape_id", "shape")), "shape_id")
    left = joined.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("shape") - 1)))
    pair = (left.withColumn("a", F.get("shape", F.col("i")))
            .withColumn("later", F.expr("slice(shape, i + 2, size(shape))"))
            .select("*", F.posexplode("later").alias("_j", "b"))
            .withColumn("j", F.col("i") + 1 + F.col("_j")))
    start = lambda m: F.col("onset") + F.col(f"{m}.rel_onset") * F.col("stretch")
    a_end = F.col("onset") + (F.col("a.rel_onset") + F.col("a.rel_dur")) * F.col("stretch")
    linked = pair.withColumns({"a_onset": start("a"), "a_end": a_end, "b_onset": start("b")})
    kind = F.when(F.col("b_onset") < F.col("a_end"), "overlap").otherwise("following")
    return linked.filter(F.col("b_onset") - F.col("a_end") <= 4 * tpq).select(
        "piece_id", "track_number", "k", "i", "j", kind.alias("link"),
        F.when(kind == "overlap", F.col("a_onset")).otherwise(F.col("a_end")).alias("from_tick"),
        F.col("b_onset").alias("to_tick"))
