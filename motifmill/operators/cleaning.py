"""Cleaning raw notes and tracks, and rejecting pieces (FLT1-11, JON1, SCL2-3, SCL6, AGG1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from motifmill.functions import scalars as S
from motifmill.params import (
    CORPUS, DRUM_PITCHES, NOTE_DURATION_CORRUPTION_LIMIT,
    NOTE_TIME_CORRUPTION_LIMIT, CorpusParams,
)
from motifmill.session import stage

NOTE_KEY = ["piece_id", "onset", "track_number", "pitch", "duration", "is_cont", "velocity"]

# Rejection reasons in the order in which they are tested; the first one counts.
REASONS = {
    1: "no tracks",
    2: "too many tracks after merge",
    3: "note time too large",
    4: "note duration too large",
    5: "no notes",
    6: "no time signature",
    7: "unsupported time signature",
    8: "misaligned time signature",
    9: "last note does not end in last measure",
    10: "first measure is after first note",
    11: "no tempo",
    12: "long empty measures",
}


def drop_invalid_notes(notes: DataFrame) -> DataFrame:
    """FLT2."""
    return notes.filter("end_tick > start_tick")


def drop_empty_tracks(tracks: DataFrame, notes: DataFrame) -> DataFrame:
    """FLT1."""
    return tracks.join(notes.select("piece_id", "track_idx").distinct(), ["piece_id", "track_idx"],
                       "left_semi")


def requantize_notes(notes: DataFrame, p: CorpusParams, ticks_per_beat="ticks_per_beat") -> DataFrame:
    """SCL2: quantise both ends; a note that vanishes keeps one tick."""
    return notes.withColumns({
        "start": S.quantize_tick("start_tick", ticks_per_beat, p.tpq),
        "end": S.quantize_tick("end_tick", ticks_per_beat, p.tpq),
    }).withColumn("end", F.when(F.col("end") == F.col("start"), F.col("start") + 1)
                  .otherwise(F.col("end")))


def requantize_changes(changes: DataFrame, pieces: DataFrame, p: CorpusParams) -> DataFrame:
    """SCL3: quantise the time of tempo or time-signature changes."""
    return (changes.join(pieces.select("piece_id", "ticks_per_beat"), "piece_id")
            .withColumn("time", S.quantize_tick("time_tick", "ticks_per_beat", p.tpq)))


def merge_tracks(tracks: DataFrame, notes: DataFrame, p: CorpusParams) -> DataFrame:
    """JON1, TOP3, WIN6: ``(piece_id, track_idx) -> (track_number, instrument)``.

    The ``max_track_number`` tracks with the most notes stay.  Each further track, largest
    first, joins the track of its program that is smallest at that moment.  A piece with a
    further track whose program is not among those that stay gets ``track_number = null``
    (rejected by FLT6); with ``strict_track_limit`` so does every piece above the limit (K6).
    """
    counts = notes.groupBy("piece_id", "track_idx").agg(F.count("*").alias("n"))
    live = tracks.join(counts, ["piece_id", "track_idx"]).select(
        "piece_id", "track_idx", "n", S.program_of("program", "is_drum").alias("instrument"))
    piece = Window.partitionBy("piece_id")
    by_size = piece.orderBy(F.desc("n"), "track_idx")
    ranked = live.withColumns({"n_tracks": F.count("*").over(piece),
                               "rank": F.row_number().over(by_size)})
    limit = p.max_track_number
    number = F.row_number().over(piece.orderBy("track_idx")) - 1
    within = ranked.filter(F.col("n_tracks") <= limit).select(
        "piece_id", "track_idx", "instrument", number.alias("track_number"))
    over = ranked.filter(F.col("n_tracks") > limit)
    if p.strict_track_limit:
        return within.unionByName(over.select(
            "piece_id", "track_idx", "instrument", F.lit(None).cast("int").alias("track_number")))

    entry = F.struct("rank", "n", "track_idx")
    by_program = over.groupBy("piece_id", "instrument").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank") <= limit, entry))).alias("kept"),
        F.array_sort(F.collect_list(F.when(F.col("rank") > limit, entry))).alias("extra"))

    def absorb(state, extra):
        last = F.element_at(state["kept"], -1)
        grown = F.struct(last["rank"].alias("rank"), (last["n"] + extra["n"]).alias("n"),
                         last["track_idx"].alias("track_idx"))
        rest = F.slice(state["kept"], F.lit(1), F.size(state["kept"]) - 1)
        return F.struct(
            F.concat(F.filter(rest, lambda t: t["n"] >= grown["n"]), F.array(grown),
                     F.filter(rest, lambda t: t["n"] < grown["n"])).alias("kept"),
            F.concat(state["moves"], F.array(F.struct(
                extra["track_idx"].alias("track_idx"), last["track_idx"].alias("into")))
            ).alias("moves"))

    start = F.struct(
        F.col("kept"), F.expr("cast(array() as array<struct<track_idx:int,into:int>>)").alias("moves"))
    folded = by_program.withColumn("lost", (F.size("kept") == 0).cast("int")).withColumn(
        "state", F.when(F.size("kept") > 0, F.aggregate("extra", start, absorb)))
    program_rank = F.element_at("kept", 1)["rank"]
    kept = (folded.filter("lost = 0")
            .select("piece_id", "instrument", program_rank.alias("program_rank"),
                    F.posexplode("state.kept").alias("pos", "t"))
            .select("piece_id", "instrument", F.col("t.track_idx").alias("track_idx"),
                    (F.row_number().over(piece.orderBy("program_rank", "pos")) - 1)
                    .alias("track_number")))
    moved = (folded.filter("lost = 0").select("piece_id", F.inline("state.moves"))
             .join(kept.withColumnRenamed("track_idx", "into"), ["piece_id", "into"])
             .select("piece_id", "track_idx", "instrument", "track_number"))
    lost = (folded.filter("lost = 1").select("piece_id", "instrument", F.explode("extra").alias("t"))
            .select("piece_id", F.col("t.track_idx").alias("track_idx"), "instrument",
                    F.lit(None).cast("int").alias("track_number")))
    merged = kept.unionByName(moved).unionByName(lost)
    return within.unionByName(merged)


def quantised_notes(raw, track_map: DataFrame, p: CorpusParams) -> DataFrame:
    """Valid notes with their final track, quantised; still with corrupt and unplayable ones."""
    # The small side carries everything a note needs, so that notes are joined only once.  It is stored, so that
    # Catalyst knows its size: as long as it is small, notes stay where they are.
    side = stage(track_map.filter("track_number is not null").join(
        raw.pieces.select("piece_id", "ticks_per_beat"), "piece_id"), "sides", plain=True)
    joined = drop_invalid_notes(raw.notes).join(side, ["piece_id", "track_idx"])
    return requantize_notes(joined, p).select(
        "piece_id", "track_number", "instrument", "start", "end", "pitch", "velocity")


def _unplayable(p: CorpusParams) -> Column:
    """Why a note is left out of the corpus; null if it is not."""
    lo, hi = DRUM_PITCHES
    return (F.when((F.col("start") >= F.col("end")) | (F.col("start") < 0), "no length")
            .when((F.col("start") > p.event_time_limit) | (F.col("end") > p.event_time_limit), "too late")
            .when((F.col("instrument") == 128) & ~F.col("pitch").between(lo, hi), "no drum"))


def keep_playable_notes(notes: DataFrame, p: CorpusParams = CORPUS) -> DataFrame:
    """FLT3."""
    return notes.filter(_unplayable(p).isNull())


def dropped_notes(notes: DataFrame, p: CorpusParams = CORPUS) -> DataFrame:
    """FLT3, the other way round: notes that are left out, per piece and reason."""
    return (notes.withColumn("reason", _unplayable(p)).filter("reason is not null")
            .groupBy("piece_id", "reason").agg(F.count("*").alias("n")))


def split_long_notes(notes: DataFrame, p: CorpusParams) -> DataFrame:
    """SCL6: over-long notes become continuing chunks and a remainder, or are cut short."""
    m = p.max_duration
    if not p.use_cont_note:
        return notes.withColumns({"duration": F.least("duration", F.lit(m)), "is_cont": F.lit(0)})
    chunks = S.idiv(F.col("duration") - 1, F.lit(m)).cast("int")
    return (notes.withColumn("_last", chunks)
            .withColumn("_chunk", F.explode(F.sequence(F.lit(0), "_last")))
            .withColumns({
                "onset": F.col("onset") + F.col("_chunk") * m,
                "is_cont": (F.col("_chunk") < F.col("_last")).cast("int"),
                "duration": F.least(F.lit(m), F.col("duration") - F.col("_chunk") * m)})
            .drop("_last", "_chunk"))


def note_chunks(quantised: DataFrame, p: CorpusParams) -> DataFrame:
    """Playable notes as corpus notes, duplicates still in."""
    notes = keep_playable_notes(quantised, p).select(
        "piece_id", "track_number", F.col("start").alias("onset"), "pitch",
        (F.col("end") - F.col("start")).alias("duration"),
        S.quantize_velocity("velocity", p.velocity_step).alias("velocity"))
    return split_long_notes(notes, p).select(*NOTE_KEY)


def dedup_notes(notes: DataFrame) -> DataFrame:
    """SET1: the key holds the onset, so no piece sits on one task."""
    return notes.dropDuplicates(NOTE_KEY)


def piece_extent(notes: DataFrame) -> DataFrame:
    """AGG31: first onset, end of the last note in sort order (K18), latest onset."""
    last = F.max_by(
        F.col("onset") + F.col("duration"),
        F.struct("onset", "track_number", "pitch", "duration", "is_cont", "velocity"))
    return notes.groupBy("piece_id").agg(
        F.min("onset").alias("first_onset"), last.alias("last_end"),
        F.max("onset").alias("max_onset"))


def piece_stats(quantised: DataFrame, p: CorpusParams) -> DataFrame:
    """AGG31 and FLT4 in one pass over unsplit notes: extents and the rank of corruption.

    The last corpus note in sort order is always the last chunk of some note, so long notes
    need not be split to find it.  Extents are null where no note is playable.
    """
    playable = _unplayable(p).isNull()
    length = F.col("end") - F.col("start")
    if p.use_cont_note:
        onset = F.col("start") + S.idiv(length - 1, F.lit(p.max_duration)).cast("int") * p.max_duration
        duration = F.col("end") - onset
    else:
        onset, duration = F.col("start"), F.least(length, F.lit(p.max_duration))
    place = F.struct(
        onset.alias("onset"), "track_number", "pitch", duration.alias("duration"),
        S.quantize_velocity("velocity", p.velocity_step).alias("velocity"))
    ok = lambda c: F.when(playable, c)
    return quantised.groupBy("piece_id").agg(
        F.min(ok(F.col("start"))).alias("first_onset"),
        F.max_by(onset + duration, ok(place)).alias("last_end"),
        F.max(ok(onset)).alias("max_onset"),
        F.min(corruption()).alias("corruption"))


def _rejected(df: DataFrame, rank: int) -> DataFrame:
    return df.select("piece_id", F.lit(rank).alias("rank"))


def reject_no_tracks(raw) -> DataFrame:
    """FLT5."""
    return _rejected(raw.pieces.join(raw.tracks, "piece_id", "left_anti"), 1)


def reject_track_limit(track_map: DataFrame) -> DataFrame:
    """FLT6."""
    return _rejected(track_map.filter("track_number is null").select("piece_id").distinct(), 2)


def corruption(start="start", end="end") -> Column:
    """FLT4: rank of the rule a note breaks - both ends beyond the limit (K5), or too long."""
    late = ((F.col(start) > NOTE_TIME_CORRUPTION_LIMIT) & (F.col(end) > NOTE_TIME_CORRUPTION_LIMIT))
    long = F.col(end) - F.col(start) > NOTE_DURATION_CORRUPTION_LIMIT
    return F.when(late, 3).when(long, 4)


def reject_corrupt(quantised: DataFrame) -> DataFrame:
    """FLT4."""
    return (quantised.withColumn("rank", corruption()).filter("rank is not null")
            .groupBy("piece_id").agg(F.min("rank").alias("rank")))


def reject_no_notes(raw, extent: DataFrame) -> DataFrame:
    """FLT5."""
    return _rejected(raw.pieces.join(extent, "piece_id", "left_anti"), 5)


def reject_no_time_signature(extent: DataFrame, segments: DataFrame) -> DataFrame:
    """FLT7."""
    return _rejected(extent.join(segments, "piece_id", "left_anti"), 6)


def reject_unsupported(changes: DataFrame) -> DataFrame:
    """FLT8, on changes up to the last note end."""
    ok = S.is_supported_time_signature("numer", "denom")
    return _rejected(changes.filter(~ok).select("piece_id").distinct(), 7)


def reject_misaligned(segments: DataFrame) -> DataFrame:
    """FLT9, on segments that are not wholly before the first note."""
    off = (F.col("next_time") - F.col("time")) % F.col("length") != 0
    return _rejected(segments.filter((F.col("next_time") > F.col("first_onset")) & off)
                     .select("piece_id").distinct(), 8)


def reject_uncovered(extent: DataFrame, measures: DataFrame) -> DataFrame:
    """FLT10."""
    span = measures.groupBy("piece_id").agg(
        F.min("onset").alias("m_first"), F.max("onset").alias("m_last"),
        F.max(F.col("onset") + F.col("length")).alias("m_end"))
    covered = (F.col("m_last") <= F.col("last_end")) & (F.col("last_end") < F.col("m_end"))
    rank = (F.when(~F.coalesce(covered, F.lit(False)), 9)
            .when(F.col("m_first") > F.col("first_onset"), 10))
    return extent.join(span, "piece_id", "left").select("piece_id", rank.alias("rank")).filter(
        "rank is not null")


def empty_measure_runs(note_measures: DataFrame, measures: DataFrame) -> DataFrame:
    """WIN10: longest run of measure tokens without a note token between them, per piece.

    ``note_measures`` holds the distinct ``(piece_id, measure_idx)`` in which notes start.
    """
    totals = measures.groupBy("piece_id").agg(F.count("*").alias("n_measures"))
    w = Window.partitionBy("piece_id").orderBy("measure_idx")
    runs = note_measures.withColumn(
        "run", F.col("measure_idx") - F.coalesce(F.lag("measure_idx").over(w), F.lit(-1)))
    longest = runs.groupBy("piece_id").agg(F.max("run").alias("run"),
                                           F.max("measure_idx").alias("last_idx"))
    return totals.join(longest, "piece_id", "left").select(
        "piece_id",
        F.greatest(F.coalesce("run", F.lit(0)),
                   F.col("n_measures") - 1 - F.coalesce("last_idx", F.lit(-1)))
        .cast("int").alias("longest_run"))


def reject_long_empty(runs: DataFrame, p: CorpusParams = CORPUS) -> DataFrame:
    """FLT11."""
    return _rejected(runs.filter(F.col("longest_run") >= p.empty_measure_limit), 12)


def first_reasons(rules: list[DataFrame]) -> DataFrame:
    """One row per rejected piece: the first rule it breaks."""
    reasons = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    broken = reduce(DataFrame.unionByName, rules).groupBy("piece_id").agg(F.min("rank").alias("rank"))
    return broken.select("piece_id", "rank", reasons[F.col("rank")].alias("reason"))


def rejection_counts(rejects: DataFrame) -> DataFrame:
    """AGG1."""
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))
