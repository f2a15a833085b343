"""Vocabularies and integer token rows (EXM1, JON7-8, WIN9, FLT14, FLT17, AGG27, AGG32)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from motifmill.functions import scalars as S
from motifmill.functions.scan import token_block
from motifmill.operators.stats import supported_used
from motifmill.params import CorpusParams

ROW_COLUMNS = ["piece_id", "seq", "evt", "pit", "dur", "vel", "trn", "mps"]
ATTRIBUTES = {"evt": "events", "pit": "pitchs", "dur": "durations", "vel": "velocities",
              "trn": "track_numbers"}


def _numbers(spark, first: int, stop: int, prefix: str = "", step: int = 1) -> DataFrame:
    return spark.range(first, stop, step).select(
        F.col("id").alias("ord"), F.concat(F.lit(prefix), S.itob36("id")).alias("text"))


def build_vocab(tokens: DataFrame, p: CorpusParams, shapes: DataFrame | None = None) -> DataFrame:
    """EXM1: ``(attr, id, text)``.

    Sizes follow from the parameters, the number of shapes and the 42 time signatures, so the
    vocabulary is small whatever the size of the corpus (K27: signatures by denominator,
    numerator).
    """
    spark = tokens.sparkSession
    special = lambda *t: spark.createDataFrame(list(enumerate(t)), "ord bigint, text string")
    pad = special("PAD")
    measures = supported_used(tokens, p.tpq).select(
        (F.col("denom") * 100 + F.col("numer")).cast("bigint").alias("ord"),
        F.concat(F.lit("M"), S.itob36("numer"), F.lit("/"), S.itob36("denom")).alias("text"))
    tempos = _numbers(spark, p.tempo_min, p.tempo_max + p.tempo_step, "T", p.tempo_step)
    longest = 3 * 4 * p.tpq
    learned = (shapes.filter("shape_id > 1").select(
        F.col("shape_id").cast("bigint").alias("ord"), F.concat(F.lit("U"), "text").alias("text"))
        if shapes is not None else special("U").limit(0))
    parts = {
        "events": [special("PAD", "BOS", "EOS", "SEP"), special("N", "N~"), learned,
                   _numbers(spark, 0, 129, "R"), _numbers(spark, 0, longest, "P"), measures, tempos],
        "pitchs": [pad, _numbers(spark, 0, 128)],
        "durations": [pad, _numbers(spark, 1, p.max_duration + 1)],
        "velocities": [pad, _numbers(spark, p.velocity_step, 128, step=p.velocity_step)],
        "track_numbers": [pad, _numbers(spark, 0, p.max_track_number)],
        "instruments": [pad, _numbers(spark, 0, 129)],
        "tempos": [pad, tempos],
        "time_signatures": [pad, measures],
    }
    rows = [df.select(F.lit(attr).alias("attr"), F.lit(i).alias("part"), "ord", "text")
            for attr, dfs in parts.items() for i, df in enumerate(dfs)]
    w = Window.partitionBy("attr").orderBy("part", "ord")
    return reduce(DataFrame.unionByName, rows).select(
        "attr", (F.row_number().over(w) - 1).cast("int").alias("id"), "text")


def vocab_summary(vocab: DataFrame) -> DataFrame:
    """AGG32."""
    return vocab.groupBy("attr").agg(F.count("*").alias("size"))


def mps_numbers(tokens: DataFrame) -> DataFrame:
    """WIN9: add ``mps``, the number of the maximal permutable run a token belongs to.

    A note opens a run unless a note stands before it, and whatever follows BOS opens one.
    Blocks are numbered on their own; what the first token of a block owes to the token
    before it is settled in the one-row-per-block summary.
    """
    kind = F.col("type")
    notes = ("N", "U", "R")
    base = tokens.withColumn("_block", token_block())
    inside = Window.partitionBy("piece_id", "_block").orderBy("seq")
    before = F.lag("type").over(inside)
    own = F.when(kind == "R", 0).otherwise(1)
    step = (F.when(kind.isin("N", "U") & F.coalesce(before.isin(*notes), F.lit(False)), 0).otherwise(own)
            + F.coalesce((before == "BOS").cast("int"), F.lit(0)))
    stepped = base.withColumn("_step", step)
    local = stepped.withColumn("_local", F.sum("_step").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)))

    # Kinds as numbers, so that the summary is a hash aggregate.
    code = F.when(kind.isin("N", "U"), 2).when(kind == "R", 1).when(kind == "BOS", -1).otherwise(0)
    summary = stepped.groupBy("piece_id", "_block").agg(
        F.sum("_step").alias("total"), F.min_by(code, "seq").alias("opens"),
        F.max_by(code, "seq").alias("closes"))
    blocks = Window.partitionBy("piece_id").orderBy("_block")
    closed = F.lag("closes").over(blocks)
    owed = (F.when((F.col("opens") == 2) & (closed > 0), -1).otherwise(0)
            + F.coalesce((closed == -1).cast("int"), F.lit(0)))
    carried = summary.withColumn("_owed", owed).withColumn("_carry", F.coalesce(
        F.sum(F.col("total") + F.col("_owed")).over(blocks.rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)) + F.col("_owed")).select("piece_id", "_block", "_carry")
    return local.join(carried, ["piece_id", "_block"]).select(
        *tokens.columns, (F.col("_local") + F.col("_carry")).cast("int").alias("mps"))


def _attribute_texts() -> dict[str, Column]:
    text, kind = F.col("text"), F.col("type")
    note, part = kind.isin("N", "U"), lambda i: F.get(F.split(text, ":"), F.lit(i))
    return {
        "evt": F.split_part(text, F.lit(":"), F.lit(1)),
        "pit": F.when(note, part(1)), "dur": F.when(note, part(2)), "vel": F.when(note, part(3)),
        "trn": F.when(note, part(4)).when(kind == "R", part(1)),
    }


def encode_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """JON7: ids of every token; an unknown text gives null."""
    rows = mps_numbers(tokens).withColumns({f"_{a}": t for a, t in _attribute_texts().items()})
    for short, attr in ATTRIBUTES.items():
        ids = vocab.filter(F.col("attr") == attr).select(
            F.col("text").alias(f"_{short}"), F.col("id").alias(short))
        rows = rows.join(F.broadcast(ids), f"_{short}", "left")  # bounded: see build_vocab
    known = [F.when(F.col(f"_{a}").isNull(), 0).otherwise(F.col(a)).alias(a) for a in ATTRIBUTES]
    return rows.select("piece_id", "seq", *known, "mps")


def unknown_pieces(token_rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pieces that JON7 drops: an unknown text, a note in an undeclared or twice declared track."""
    missing = reduce(Column.__or__, [F.col(a).isNull() for a in ATTRIBUTES])
    bad = token_rows.filter(missing).select("piece_id")
    heads = tokens.filter("type = 'R'").groupBy("piece_id", "track_number").agg(F.count("*").alias("n"))
    twice = heads.filter("n > 1").select("piece_id")
    used = tokens.filter(F.col("type").isin("N", "U")).select("piece_id", "track_number").distinct()
    stray = used.join(heads, ["piece_id", "track_number"], "left_anti").select("piece_id")
    return bad.union(twice).union(stray).distinct()


def known_rows(token_rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Token rows without the pieces of ``unknown_pieces``."""
    return token_rows.join(unknown_pieces(token_rows, tokens), "piece_id", "left_anti")


def drop_padding(token_rows: DataFrame) -> DataFrame:
    """FLT17."""
    return token_rows.filter("evt != 0")


def decode_rows(token_rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """JON8: ids back to token texts."""
    rows = drop_padding(token_rows)
    for short, attr in ATTRIBUTES.items():
        texts = vocab.filter(F.col("attr") == attr).select(
            F.col("id").alias(short), F.col("text").alias(f"_{short}"))
        rows = rows.join(F.broadcast(texts), short, "left")
    note = F.substring("_evt", 1, 1).isin("N", "U")
    track = (F.substring("_evt", 1, 1) == "R")
    text = (F.when(note, F.concat_ws(":", "_evt", "_pit", "_dur", "_vel", "_trn"))
            .when(track, F.concat_ws(":", "_evt", "_trn")).otherwise(F.col("_evt")))
    return rows.select("piece_id", "seq", text.alias("text"))


def check_token_rows(token_rows: DataFrame, vocab: DataFrame, max_len: int, max_mps: int) -> DataFrame:
    """FLT14: rows with an id outside its vocabulary, or an mps number that is too large."""
    sizes = {r["attr"]: r["size"] for r in vocab_summary(vocab).collect()}  # eight rows
    outside = [(F.col(a) < 0) | (F.col(a) >= sizes[attr]) for a, attr in ATTRIBUTES.items()]
    bad = reduce(Column.__or__, [F.coalesce(c, F.lit(True)) for c in outside])
    return token_rows.filter(bad | (F.col("mps") < 0) | (F.col("mps") > min(max_len, max_mps)))


def mps_stats(token_rows: DataFrame) -> DataFrame:
    """AGG27: number and mean length of runs of two or more tokens."""
    runs = token_rows.groupBy("piece_id", "mps").agg(F.count("*").alias("n")).filter("n >= 2")
    return runs.agg(F.count("*").alias("n_runs"), F.avg("n").alias("avg_length"))
