"""Measures, tempos and the measure of an onset (WIN1-4, JON2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from motifmill.functions import scalars as S
from motifmill.params import CorpusParams

# Rows per piece below are bounded: one per tick up to the event time limit.
def _piece():
    return Window.partitionBy("piece_id")


def time_sig_changes(changes: DataFrame, extent: DataFrame) -> DataFrame:
    """Quantised changes up to the last note end, with the piece's extent."""
    return (changes.join(extent.select("piece_id", "first_onset", "last_end"), "piece_id")
            .filter("time <= last_end"))


def dedup_time_sigs(changes: DataFrame) -> DataFrame:
    """WIN1: drop repeated signatures.

    Changes are first folded to one row per tick (partial aggregation); a tick stays if it
    starts with another signature than the one before it, or changes within itself.
    """
    nd = F.struct("numer", "denom")
    ticks = changes.groupBy("piece_id", "time", "first_onset", "last_end").agg(
        F.min_by(nd, "change_idx").alias("opening"), F.max_by(nd, "change_idx").alias("closing"),
        (F.min(nd) != F.max(nd)).alias("mixed"))
    before = F.lag("closing").over(_piece().orderBy("time"))
    return (ticks.withColumn("before", before)
            .filter(F.col("before").isNull() | (F.col("opening") != F.col("before")) | F.col("mixed"))
            .select("piece_id", "time", "first_onset", "last_end", "mixed",
                    F.col("closing.numer").alias("numer"), F.col("closing.denom").alias("denom")))


def fix_first_time_sig(changes: DataFrame, p: CorpusParams) -> DataFrame:
    """WIN2: a first change at tick 1 may mean 0; 4/4 fills in before a late first change."""
    by_time = _piece().orderBy("time")
    length = S.measure_ticks("numer", "denom", p.tpq)
    following = F.lead("time").over(by_time)
    shifted = ((F.row_number().over(by_time) == 1) & (F.col("time") == 1) & ~F.col("mixed")
               & F.coalesce(following % length == 0, F.lit(True)))
    fixed = changes.withColumn("time", F.when(shifted, 0).otherwise(F.col("time")))
    first = fixed.groupBy("piece_id", "first_onset", "last_end").agg(F.min("time").alias("t0"))
    fill = first.filter("t0 > first_onset").select(
        "piece_id", F.lit(0).alias("time"), "first_onset", "last_end",
        F.lit(4).alias("numer"), F.lit(4).alias("denom"))
    return fixed.drop("mixed").unionByName(fill)


def time_sig_segments(changes: DataFrame, p: CorpusParams) -> DataFrame:
    """Each signature with the time at which the next one takes over."""
    kept = fix_first_time_sig(dedup_time_sigs(changes), p).withColumn(
        "length", S.measure_ticks("numer", "denom", p.tpq))
    tail = F.col("time") + (S.idiv(F.col("last_end") - F.col("time"), F.col("length")) + 1) * F.col("length")
    following = F.lead("time").over(_piece().orderBy("time"))
    return kept.filter("length > 0").withColumn("next_time", F.coalesce(following, tail).cast("int"))


def build_measures(segments: DataFrame) -> DataFrame:
    """WIN3: measures from the one holding the first note to the one holding the last end."""
    used = segments.filter("next_time > first_onset")
    skip = F.greatest(S.idiv(F.col("first_onset") - F.col("time"), F.col("length")), F.lit(0))
    start = (F.col("time") + skip * F.col("length")).cast("int")
    stop = F.least(F.col("next_time") - 1, F.col("last_end"))
    onsets = F.when(start <= stop, F.sequence(start, stop, F.col("length")))
    return (used.select("piece_id", F.explode(onsets).alias("onset"), "numer", "denom", "length")
            .withColumn("measure_idx", F.row_number().over(_piece().orderBy("onset")) - 1))


def clean_tempos(changes: DataFrame, extent: DataFrame, measures: DataFrame, p: CorpusParams) -> DataFrame:
    """WIN4: one bpm per tick, the last one wins; repeats dropped; 120 where none is set."""
    start = measures.groupBy("piece_id").agg(F.min("onset").alias("m0"))
    bounds = start.join(extent.select("piece_id", "last_end"), "piece_id")
    inside = changes.join(bounds, "piece_id").filter("time <= last_end")
    ticks = (inside
             .withColumns({"onset": F.greatest("time", "m0"), "bpm": S.quantize_tempo("bpm", p)})
             .groupBy("piece_id", "m0", "onset")
             .agg(F.max_by("bpm", F.struct("time", "change_idx")).alias("bpm")))
    by_onset = _piece().orderBy("onset")
    fresh = ticks.withColumn("before", F.lag("bpm").over(by_onset)).filter(
        "before is null or bpm != before")
    first = (F.row_number().over(by_onset) == 1) & (F.col("onset") == 1) & (F.col("m0") == 0)
    fixed = fresh.withColumn("onset", F.when(first, 0).otherwise(F.col("onset")))
    # Pieces without any change, or whose first change comes late, start at 120.
    opening = start.join(fixed.groupBy("piece_id").agg(F.min("onset").alias("t0")), "piece_id", "left")
    fill = opening.filter("t0 is null or t0 > m0").select(
        "piece_id", F.col("m0").alias("onset"), F.lit(120).alias("bpm"))
    return fixed.select("piece_id", "onset", "bpm").unionByName(fill)


def reject_no_tempo(changes: DataFrame, extent: DataFrame) -> DataFrame:
    """Pieces that have tempo changes, all of them after the last note."""
    first = changes.groupBy("piece_id").agg(F.min("time").alias("t0"))
    return first.join(extent, "piece_id").filter("t0 > last_end").select(
        "piece_id", F.lit(11).alias("rank"))


def measure_blocks(measures: DataFrame, block_ticks: int) -> DataFrame:
    """Every measure once per block it reaches into; ``copy`` marks all but the first."""
    first = S.idiv("onset", F.lit(block_ticks)).cast("int")
    last = S.idiv(F.col("onset") + F.col("length") - 1, F.lit(block_ticks)).cast("int")
    return (measures.withColumn("blk", F.explode(F.sequence(first, last)))
            .withColumn("copy", F.col("blk") != first))


def assign_measure(events: DataFrame, measures: DataFrame, block_ticks: int) -> DataFrame:
    """JON2: add the measure an ``onset`` falls into.

    An as-of join by equi-join on ``(piece, block)``: a block holds a few measures at most,
    and a huge piece is spread over its blocks.
    """
    m = measure_blocks(measures, block_ticks).select(
        "piece_id", "blk", "measure_idx", "numer", "denom", "length",
        F.col("onset").alias("measure_onset"))
    e = events.withColumn("blk", S.idiv("onset", F.lit(block_ticks)).cast("int"))
    inside = ((e["onset"] >= m["measure_onset"])
              & (e["onset"] < m["measure_onset"] + m["length"]))
    return (e.join(m, (e["piece_id"] == m["piece_id"]) & (e["blk"] == m["blk"]) & inside)
            .drop(m["piece_id"], m["blk"]).drop("blk"))
