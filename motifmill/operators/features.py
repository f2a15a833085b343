"""Evaluation features of pieces and of collections (AGG9-19, AGG25-26, AGG29, JON10)."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

from motifmill.functions import scalars as S
from motifmill.operators.decode import Decoded
from motifmill.operators.stats import describe, unpivot
from motifmill.session import stage

SCALARS = ["pitch_class_entropy", "instrumentation_self_similarity", "grooving_self_similarity"]


# ---- histograms -------------------------------------------------------------------------

def histogram(notes: DataFrame, value, name: str) -> DataFrame:
    """``(piece_id, feature, bin, n)`` of one note attribute."""
    return (notes.groupBy("piece_id", value.cast("string").alias("bin"))
            .agg(F.count("*").alias("n"))
            .select("piece_id", F.lit(name).alias("feature"), "bin", "n"))


def zero_filled(hist: DataFrame, pieces: DataFrame, size: int = 128) -> DataFrame:
    """Every bin 0..size-1 of every piece."""
    spine = pieces.select("piece_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("bin"))
    spine = spine.withColumn("bin", F.col("bin").cast("string"))
    counts = hist.select("piece_id", "bin", "n")
    return (spine.join(counts, ["piece_id", "bin"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0))))


def pitch_histogram(notes: DataFrame) -> DataFrame:
    """AGG9."""
    return histogram(notes, F.col("pitch"), "pitch_histogram")


def duration_distribution(notes: DataFrame, tpq: int) -> DataFrame:
    """AGG11: by reduced fraction of a quarter; fractions are made per distinct duration."""
    counts = notes.groupBy("piece_id", (F.col("end") - F.col("start")).alias("ticks")).agg(
        F.count("*").alias("n"))
    return counts.select("piece_id", F.lit("duration_distribution").alias("feature"),
                         S.duration_fraction("ticks", tpq).alias("bin"), "n")


def velocity_histogram(notes: DataFrame) -> DataFrame:
    """AGG12."""
    return histogram(notes, F.col("velocity"), "velocity_histogram")


def histograms(notes: DataFrame, tpq: int) -> DataFrame:
    """All three, from one count per (piece, pitch, velocity, duration)-like attribute."""
    ticks = F.col("end") - F.col("start")
    long = notes.select("piece_id", F.explode(F.array(
        F.struct(F.lit("pitch_histogram").alias("feature"), F.col("pitch").alias("v")),
        F.struct(F.lit("velocity_histogram").alias("feature"), F.col("velocity").alias("v")),
        F.struct(F.lit("duration_distribution").alias("feature"), ticks.alias("v")),
    )).alias("h")).groupBy("piece_id", "h.feature", "h.v").agg(F.count("*").alias("n"))
    bin_ = F.when(F.col("feature") == "duration_distribution", S.duration_fraction("v", tpq)
                  ).otherwise(F.col("v").cast("string"))
    return long.select("piece_id", "feature", bin_.alias("bin"), "n")


# ---- scalar features --------------------------------------------------------------------

def pitch_class_entropy(notes: DataFrame, base: float | None = None) -> DataFrame:
    """AGG10: entropy of the pitch classes, in nats unless ``base`` is given."""
    counts = notes.groupBy("piece_id", S.pitch_class("pitch").alias("pc")).agg(F.count("*").alias("n"))
    scale = log(base) if base else 1.0
    entropy = (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")) / F.lit(scale)
    return counts.groupBy("piece_id").agg(entropy.alias("pitch_class_entropy"))


def _last_measure(measures: DataFrame) -> DataFrame:
    return measures.groupBy("piece_id").agg(
        F.count("*").alias("n_measures"), F.max("onset").alias("last_start"),
        F.max_by("length", "onset").alias("last_length"), F.max("length").alias("longest"))


def bar_counts(notes: DataFrame, measures: DataFrame, real_bars_only: bool = False) -> DataFrame:
    """Number of bars of the similarity features.

    By default one bar more than there are measures, plus those a note starting after the
    last measure's start asks for; with ``real_bars_only`` just the measures.
    """
    latest = notes.groupBy("piece_id").agg(F.max("start").alias("latest"))
    past = F.ceil((F.col("latest") - F.col("last_start")) / F.col("last_length"))
    bars = (F.col("n_measures") if real_bars_only
            else 1 + F.col("n_measures") + F.greatest(past, F.lit(0)))
    return _last_measure(measures).join(latest, "piece_id").select(
        "piece_id", bars.cast("bigint").alias("n_bars"), "longest", "last_start", "last_length")


def note_bars(notes: DataFrame, measures: DataFrame, block_ticks: int = 1536) -> DataFrame:
    """JON2 for features: the bar each distinct (track, start) falls into.

    Starts past the last measure go into bars of its length.
    """
    starts = notes.select("piece_id", "track_number", F.col("start").alias("onset")).distinct()
    last = _last_measure(measures).select("piece_id", "last_start", "last_length")
    m = measures.select("piece_id", "onset", "length")
    first, until = S.idiv("onset", F.lit(block_ticks)), F.col("onset") + F.col("length") - 1
    blocks = m.withColumn("blk", F.explode(F.sequence(first, S.idiv(until, F.lit(block_ticks)))))
    blocks = blocks.withColumnRenamed("onset", "bar")
    located = starts.withColumn("blk", S.idiv("onset", F.lit(block_ticks)))
    inside = ((located["onset"] >= blocks["bar"])
              & (located["onset"] < blocks["bar"] + blocks["length"]))
    hit = located.join(
        blocks, (located["piece_id"] == blocks["piece_id"]) & (located["blk"] == blocks["blk"]) & inside,
        "left").select(located["piece_id"], "track_number", "onset", "bar")
    tail = S.idiv(F.col("onset") - F.col("last_start"), F.col("last_length")) * F.col("last_length")
    bar = F.coalesce(F.col("bar"), F.col("last_start") + tail)
    return hit.join(last, "piece_id").select("piece_id", "track_number", "onset", bar.alias("bar"))


def _similarity(bar_columns: DataFrame, bars: DataFrame, width: DataFrame, name: str) -> DataFrame:
    """Mean over all pairs of N bars of 1 - hamming / W, without forming a pair.

    A column set in ``o`` bars differs in ``o * (N - o)`` pairs, so the mean is
    ``1 - sum(o * (N - o)) / (W * N * (N - 1) / 2)``.
    """
    set_in = bar_columns.groupBy("piece_id", "column").agg(F.count("*").alias("o"))
    n, o = F.col("n_bars"), F.col("o")
    mean = 1 - F.sum(o * (n - o)) / (F.max("width") * F.max(n) * (F.max(n) - 1) / 2)
    return (set_in.join(bars.select("piece_id", "n_bars"), "piece_id").join(width, "piece_id")
            .groupBy("piece_id").agg(mean.alias(name)))


def instrumentation_self_similarity(placed: DataFrame, tracks: DataFrame, bars: DataFrame) -> DataFrame:
    """AGG13: bars by instrument; ``placed`` comes from ``note_bars``."""
    columns = (placed.join(tracks, ["piece_id", "track_number"])
               .select("piece_id", "bar", F.col("instrument").alias("column")).distinct())
    width = programs_present(tracks).withColumnRenamed("n_programs", "width")
    return _similarity(columns, bars, width, "instrumentation_self_similarity")


def grooving_self_similarity(placed: DataFrame, bars: DataFrame) -> DataFrame:
    """AGG14: bars by onset position; the width is the longest measure."""
    columns = placed.select("piece_id", "bar", (F.col("onset") - F.col("bar")).alias("column")).distinct()
    width = bars.select("piece_id", F.col("longest").alias("width"))
    return _similarity(columns, bars, width, "grooving_self_similarity")


def programs_present(tracks: DataFrame) -> DataFrame:
    """AGG29: distinct instruments per piece."""
    return tracks.groupBy("piece_id").agg(F.countDistinct("instrument").alias("n_programs"))


def scalar_features(d: Decoded) -> DataFrame:
    """One row per piece that has notes."""
    bars = stage(bar_counts(d.notes, d.measures), "bars", plain=True)
    placed = stage(note_bars(d.notes, d.measures), "placed")
    return (pitch_class_entropy(d.notes)
            .join(instrumentation_self_similarity(placed, d.tracks, bars), "piece_id", "left")
            .join(grooving_self_similarity(placed, bars), "piece_id", "left"))


def notes_per_piece(notes: DataFrame) -> DataFrame:
    """AGG25."""
    return notes.groupBy("piece_id").agg(F.count("*").alias("n_notes"))


def note_totals(notes: DataFrame) -> DataFrame:
    """AGG25."""
    return notes_per_piece(notes).agg(F.sum("n_notes").alias("n_notes"),
                                      F.avg("n_notes").alias("avg_notes"))


def playback_seconds(notes: DataFrame, tempos: DataFrame, tpq: int) -> DataFrame:
    """AGG26: length of each piece by its tempo map; 120 bpm before the first tempo."""
    end = notes.groupBy("piece_id").agg(F.max("end").alias("piece_end"))
    opening = end.select("piece_id", F.lit(-1).alias("onset"), F.lit(120).alias("bpm"))
    steps = tempos.select("piece_id", "onset", "bpm").unionByName(opening).join(end, "piece_id")
    until = F.lead("onset").over(Window.partitionBy("piece_id").orderBy("onset"))
    span = F.least(F.coalesce(until, F.col("piece_end")), F.col("piece_end")) - F.greatest("onset", F.lit(0))
    return (steps.withColumn("ticks", F.greatest(span, F.lit(0)))
            .groupBy("piece_id")
            .agg(F.sum(F.col("ticks") * 60 / (F.col("bpm") * tpq)).alias("seconds")))


# ---- aggregation and comparison ---------------------------------------------------------

def aggregate_scalars(features: DataFrame) -> DataFrame:
    """AGG15: the description of each scalar feature."""
    return describe(unpivot(features, SCALARS))


def aggregate_histograms(hists: DataFrame) -> DataFrame:
    """AGG15: histograms summed over pieces, empty bins absent."""
    return hists.groupBy("feature", "bin").agg(F.sum("n").alias("n")).filter("n > 0")


def align_histograms(pred: DataFrame, true: DataFrame) -> DataFrame:
    """JON10: counts side by side over the union of bins; null where a side lacks the bin."""
    return pred.withColumnRenamed("n", "pred").join(
        true.withColumnRenamed("n", "true"), ["feature", "bin"], "full_outer")


def kl_divergence(aligned: DataFrame, ignore_pred_zero: bool = True, base: float | None = None) -> DataFrame:
    """AGG16: KL(true || pred) per feature."""
    rows = aligned.filter("pred is not null") if ignore_pred_zero else aligned
    totals = rows.groupBy("feature").agg(F.sum("pred").alias("sp"), F.sum("true").alias("st"))
    p, t = F.col("pred") / F.col("sp"), F.col("true") / F.col("st")
    term = (F.when(F.coalesce("true", F.lit(0)) == 0, 0.0)
            .when(F.col("pred").isNull(), F.lit(float("inf")))
            .otherwise(t * F.log(t / p)))
    scale = log(base) if base else 1.0
    # One row per feature on the right.
    value = F.when(F.max("st").isNull(), F.lit(float("nan"))).otherwise(F.sum(term) / scale)
    return rows.join(F.broadcast(totals), "feature").groupBy("feature").agg(value.alias("kld"))


def normal_moments(hist: DataFrame) -> DataFrame:
    """AGG17: mean and population deviation of each histogram's bin values."""
    x, n = S.fraction_to_double("bin"), F.col("n")
    sums = hist.groupBy("feature").agg(
        F.sum("n").alias("total"), F.sum(x * n).alias("s1"), F.sum(x * x * n).alias("s2"))
    mean = F.col("s1") / F.col("total")
    return sums.select("feature", mean.alias("mean"), F.sqrt(F.greatest(
        F.col("s2") / F.col("total") - mean * mean, F.lit(0.0))).alias("std"))


def erf(x: Column) -> Column:
    """The error function: 2/sqrt(pi) exp(-x^2) times the sum of 2^n x^(2n+1) / (1 3 5 ... (2n+1)).

    All terms are positive; 120 of them are exact to double precision up to 6, where it is 1.
    """
    size = F.least(F.abs(x), F.lit(6.0))
    pair = lambda term, total: F.struct(term.alias("term"), total.alias("total"))

    def add(s, n):
        term = s["term"] * 2 * size * size / (2 * n + 1)
        return pair(term, s["total"] + term)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), pair(size, size), add, lambda s: s["total"])
    return F.signum(x) * F.least(F.lit(1.0), 2 / F.sqrt(F.pi()) * F.exp(-size * size) * series)


def _overlap(m1: Column, s1: Column, m2: Column, s2: Column) -> Column:
    """Area below both of two normal densities; undefined if one has no spread."""
    below = lambda x, m, s: (1 + erf((x - m) / (s * F.sqrt(F.lit(2.0))))) / 2
    gap, v1, v2 = m2 - m1, s1 * s1, s2 * s2
    same = 1 - erf(F.abs(gap) / (2 * s1 * F.sqrt(F.lit(2.0))))
    # The densities cross at two places.
    centre = (m1 * v2 - m2 * v1) / (v2 - v1)
    reach = s1 * s2 * F.sqrt(gap * gap + (v2 - v1) * F.ln(v2 / v1)) / (v2 - v1)
    part = lambda x: F.abs(below(x, m1, s1) - below(x, m2, s2))
    other = 1 - part(centre + reach) - part(centre - reach)
    return F.when((s1 > 0) & (s2 > 0), F.when(v1 == v2, same).otherwise(other)).otherwise(F.lit(float("nan")))


def normal_overlap(pred: DataFrame, true: DataFrame) -> DataFrame:
    """AGG17: overlapping area of the two fitted normals; on one row per feature."""
    a = normal_moments(pred)
    b = normal_moments(true).toDF("feature", "mean2", "std2")
    area = _overlap(*(F.col(c) for c in ("mean", "std", "mean2", "std2")))
    return a.join(b, "feature").select("feature", area.alias("oa"))


def histogram_intersection(aligned: DataFrame) -> DataFrame:
    """AGG18: summed smaller share."""
    totals = aligned.groupBy("feature").agg(F.sum("pred").alias("sp"), F.sum("true").alias("st"))
    smaller = F.least(F.coalesce("pred", F.lit(0)) / F.col("sp"), F.coalesce("true", F.lit(0)) / F.col("st"))
    return aligned.join(F.broadcast(totals), "feature").groupBy("feature").agg(F.sum(smaller).alias("hi"))


def compare_with_ref(pred: DataFrame, true: DataFrame) -> DataFrame:
    """AGG19: the three distances of every distribution; inputs are summed histograms."""
    aligned = align_histograms(pred, true)
    return (kl_divergence(aligned).join(normal_overlap(pred, true), "feature")
            .join(histogram_intersection(aligned), "feature"))


def hist_to_map(hist: DataFrame) -> DataFrame:
    """ARR4: one map per feature; for summed histograms, whose bins are bounded."""
    return hist.groupBy("feature").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", "n")))).alias("bins"))


def map_to_hist(maps: DataFrame) -> DataFrame:
    """ARR4, ARR7: back to rows, keys as strings."""
    return maps.select("feature", F.explode("bins").alias("bin", "n")).withColumn(
        "bin", F.col("bin").cast("string"))
