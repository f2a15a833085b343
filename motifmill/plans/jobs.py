"""Whole jobs, composed from operators (JOB1-7)."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from motifmill.operators import (
    bpe as B, cleaning as C, examples as E, features as X, timing as W, tokens as K, vocab as V,
)
from motifmill.operators.decode import Decoded, decode_tokens
from motifmill.params import EVALUATION, CorpusParams, ExampleParams
from motifmill.session import stage
from motifmill.sources.raw import RawTables


@dataclass
class CorpusBuild:
    """JOB1: raw tables to tokens and rejects.

    Frames with several consumers are written once to the shared folder (``stage``): the
    quantised notes, and the small per-piece tables.  Notes cross the network twice: for the
    join with their tracks, and for ordering by (piece, time block).
    """

    raw: RawTables
    p: CorpusParams

    @cached_property
    def track_map(self) -> DataFrame:
        return stage(C.merge_tracks(self.raw.tracks, C.drop_invalid_notes(self.raw.notes), self.p),
                     "track_map", plain=True)

    @cached_property
    def quantised(self) -> DataFrame:
        return stage(C.quantised_notes(self.raw, self.track_map, self.p), "quantised")

    @cached_property
    def chunks(self) -> DataFrame:
        """Notes of the corpus before duplicates and rejected pieces are removed."""
        return C.note_chunks(self.quantised, self.p)

    @cached_property
    def stats(self) -> DataFrame:
        return stage(C.piece_stats(self.quantised, self.p), "stats", plain=True)

    @cached_property
    def extent(self) -> DataFrame:
        return self.stats.filter("first_onset is not null").drop("corruption")

    @cached_property
    def time_sigs(self) -> DataFrame:
        return stage(W.time_sig_changes(
            C.requantize_changes(self.raw.time_sigs, self.raw.pieces, self.p), self.extent), "time_sigs", plain=True)

    @cached_property
    def tempo_changes(self) -> DataFrame:
        return C.requantize_changes(self.raw.tempos, self.raw.pieces, self.p)

    @cached_property
    def segments(self) -> DataFrame:
        return stage(W.time_sig_segments(self.time_sigs, self.p), "segments", plain=True)

    @cached_property
    def all_measures(self) -> DataFrame:
        return stage(W.build_measures(self.segments), "all_measures", plain=True)

    @cached_property
    def note_measures(self) -> DataFrame:
        onsets = self.chunks.select("piece_id", "onset").distinct()
        return (W.assign_measure(onsets, self.all_measures, self.p.block_ticks)
                .select("piece_id", "measure_idx").distinct())

    @cached_property
    def rejects(self) -> DataFrame:
        rules = [
            C.reject_no_tracks(self.raw),
            C.reject_track_limit(self.track_map),
            self.stats.filter("corruption is not null").selectExpr("piece_id", "corruption as rank"),
            C.reject_no_notes(self.raw, self.extent),
            C.reject_no_time_signature(self.extent, self.time_sigs),
            C.reject_unsupported(self.time_sigs),
            C.reject_misaligned(self.segments),
            C.reject_uncovered(self.extent, self.all_measures),
            W.reject_no_tempo(self.tempo_changes, self.extent),
        ]
        if self.p.deny_long_empty_measures:
            rules.append(C.reject_long_empty(
                C.empty_measure_runs(self.note_measures, self.all_measures), self.p))
        return stage(C.first_reasons(rules), "rejects", plain=True)

    @cached_property
    def measures(self) -> DataFrame:
        return self.all_measures.join(self.rejects, "piece_id", "left_anti")

    @cached_property
    def tempos(self) -> DataFrame:
        return stage(W.clean_tempos(self.tempo_changes, self.extent, self.measures, self.p), "tempos", plain=True)

    @cached_property
    def tracks(self) -> DataFrame:
        """Tracks of accepted pieces."""
        kept = self.track_map.filter("track_number is not null")
        return K.head_tokens(kept).join(self.rejects, "piece_id", "left_anti")

    @cached_property
    def accepted(self) -> DataFrame:
        """SNK2: accepted pieces with their paths."""
        return self.raw.pieces.join(self.rejects, "piece_id", "left_anti")

    @cached_property
    def notes(self) -> DataFrame:
        return C.dedup_notes(self.chunks).join(self.rejects, "piece_id", "left_anti")

    @cached_property
    def blocks(self) -> DataFrame:
        # Rejected pieces lose their notes because they bring no measures.
        return K.order_blocks(self.chunks, self.measures, self.tempos, self.p)

    @cached_property
    def tokens(self) -> DataFrame:
        self.blocks = stage(self.blocks, "blocks")
        return K.number_tokens(self.blocks, self.tracks)

    @cached_property
    def corpus(self) -> DataFrame:
        return K.join_blocks(self.blocks, self.tracks)


def build_corpus(raw: RawTables, p: CorpusParams) -> CorpusBuild:
    return CorpusBuild(raw, p)


def timed_tokens(tokens: DataFrame, tpq: int) -> DataFrame:
    """WIN8 for decoding and merging, which read typed columns: the text stays behind."""
    return K.running_time(tokens.drop("text"), tpq)


def decode_corpus(corpus: DataFrame, tpq: int) -> Decoded:
    """JOB2: text lines to note, tempo, time-signature and track tables."""
    timed = stage(timed_tokens(K.parse_tokens(K.explode_text(corpus)), tpq), "timed")
    return staged(decode_tokens(timed, tpq))


def staged(d: Decoded) -> Decoded:
    """A decoded corpus whose notes and measures are written once."""
    return replace(d, notes=stage(d.notes, "notes"), measures=stage(d.measures, "measures", plain=True))


def piece_features(tokens: DataFrame, tpq: int, skip_measures: int = 0,
                   max_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """JOB3: scalar features and histograms of every piece.

    ``max_tokens`` cuts long pieces only when asked to; by default the whole piece counts.
    """
    if skip_measures:
        tokens = stage(K.renumber(K.after_k_measures(tokens, skip_measures)), "skipped")
    if max_tokens:
        tokens = K.first_k_tokens(tokens, max_tokens)
    d = staged(decode_tokens(stage(timed_tokens(tokens, tpq), "timed"), tpq))
    return X.scalar_features(d), X.histograms(d.notes, tpq)


def raw_features(raw: RawTables, p: CorpusParams = EVALUATION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JOB4: features straight from raw tables, on a fine grid; and the rejected pieces (K7)."""
    build = build_corpus(raw, p)
    features, hists = piece_features(stage(build.tokens, "tokens"), p.tpq)
    return features, hists, build.rejects


def corpus_features(tokens: DataFrame, tpq: int) -> tuple[DataFrame, DataFrame]:
    """JOB5: described scalars and summed histograms of a corpus."""
    features, hists = piece_features(tokens, tpq)
    return X.aggregate_scalars(features), X.aggregate_histograms(hists)


def evaluate(pred: DataFrame, true: DataFrame) -> DataFrame:
    """JOB6: distances between the histograms of two collections of pieces."""
    return X.compare_with_ref(stage(X.aggregate_histograms(pred), "pred"),
                              stage(X.aggregate_histograms(true), "true"))


def filter_failed(pieces: DataFrame, rejects: DataFrame) -> DataFrame:
    """FLT15: pieces that have features."""
    return pieces.join(rejects, "piece_id", "left_anti")


def multi_notes_of(tokens: DataFrame, tpq: int) -> DataFrame:
    """BPE1 on tokens."""
    return B.to_multi_notes(K.running_time(tokens, tpq).filter("type = 'N'"), tpq)


def merged_tokens(multi_notes: DataFrame, shapes: DataFrame, timed: DataFrame, p: CorpusParams) -> DataFrame:
    """BPE7: the token sequences of merged notes; time structure and tracks from ``timed``."""
    measures = stage(K.token_measures(timed, p.tpq), "measures", plain=True)
    tempos = timed.filter("type = 'T'").select("piece_id", "onset", "bpm")
    tracks = timed.filter("type = 'R'").select("piece_id", "track_number", "instrument")
    notes = B.as_note_rows(multi_notes, shapes)
    blocks = stage(K.order_blocks(notes, measures, tempos, p, K.MULTI_NOTE_ORDER), "blocks")
    return K.number_tokens(blocks, tracks)


def primer_tokens(tokens: DataFrame, length: int, unit: str, p: CorpusParams,
                  learned: list[tuple] = ()) -> DataFrame:
    """EXM10: the beginning of each piece, merged with the learned shapes, without EOS."""
    cut = {"measure": lambda: K.first_k_measures(tokens, length),
           "tick": lambda: K.first_k_ticks(tokens, p.tpq, length),
           "token": lambda: tokens}[unit]()
    out = stage(cut.filter("type != 'EOS'"), "primer")
    if learned:
        timed = stage(timed_tokens(out, p.tpq), "timed")
        notes = B.to_multi_notes(timed, p.tpq)
        shapes = B.shapes_frame(tokens.sparkSession, [*B.DEFAULT_SHAPES, *learned])
        merged = B.apply_shapes(notes, list(learned), p.tpq)
        out = merged_tokens(merged, shapes, timed, p).filter("type != 'EOS'")
    if unit == "token":
        sizes = out.groupBy("piece_id").agg(F.count("*").alias("n")).filter(F.col("n") >= length)
        out = out.filter(F.col("seq") < length).join(sizes, "piece_id", "left_semi")
    return out


@dataclass
class ExampleBuild:
    """EXM1-EXM9 over one corpus."""

    tokens: DataFrame
    p: CorpusParams
    e: ExampleParams
    shapes: DataFrame | None = None

    @cached_property
    def vocab(self) -> DataFrame:
        return stage(V.build_vocab(self.tokens, self.p, self.shapes), "vocab")

    @cached_property
    def token_rows(self) -> DataFrame:
        rows = stage(V.encode_tokens(self.tokens, self.vocab), "token_rows")
        return V.known_rows(rows, self.tokens)

    def event_ids(self, condition: str) -> list[int]:
        """Ids of a few events, from the bounded vocabulary."""
        return [r["id"] for r in self.vocab.filter("attr = 'events'").filter(condition).collect()]

    @cached_property
    def starts(self) -> DataFrame:
        layout = stage(E.piece_layout(self.token_rows, self.event_ids("text = 'SEP'")[0]), "layout", plain=True)
        return stage(E.virtual_pieces(self.token_rows, layout,
                                      self.event_ids("text like 'M%'"), self.e), "starts", plain=True)

    @cached_property
    def examples(self) -> DataFrame:
        """Cut, rebased and augmented rows."""
        cut = E.rebase_mps(E.cut_examples(self.token_rows, self.starts, self.e))
        return E.augment_pitch(cut, self.event_ids("text = 'R3K'")[0], self.e)
