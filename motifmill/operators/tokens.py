"""Token sequences: ordering, text, parsing, running time and cuts (WIN5-8, WIN10-15, SCL9-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from motifmill.functions import scalars as S
from motifmill.functions.scan import TOKEN_BLOCK, running, token_block
from motifmill.operators.timing import measure_blocks
from motifmill.params import CorpusParams
from motifmill.session import stage

FIELDS = {
    "onset": "int", "track_number": "int", "instrument": "int", "numer": "int", "denom": "int",
    "position": "int", "bpm": "int", "shape": "string", "pitch": "int", "duration": "int",
    "velocity": "int", "is_cont": "int",
}
TOKEN_COLUMNS = ["piece_id", "seq", "type", *FIELDS, "text"]
NOTE_ORDER = ["track_number", "pitch", "duration", "is_cont", "velocity"]
MULTI_NOTE_ORDER = ["track_number", "k"]


def _token(kind, **fields) -> Column:
    """A token as a struct with all fields, unset ones null."""
    columns = [(F.lit(kind) if isinstance(kind, str) else kind).alias("type")]
    for name, kind_ in FIELDS.items():
        value = fields.get(name)
        columns.append((F.lit(None) if value is None else F.col(value)).cast(kind_).alias(name))
    return F.struct(*columns)


def union_tokens(notes: DataFrame, measures: DataFrame, tempos: DataFrame, p: CorpusParams) -> DataFrame:
    """SET2: notes, measures and tempos as rows of one frame, each with its time block.

    Measures also enter, as copies, every later block they reach into, so that a block on its
    own knows the measure of each of its rows.
    """
    blk = S.idiv("onset", F.lit(p.block_ticks)).cast("int")
    body = notes.withColumns({"prio": F.lit(S.PRIORITY["N"]), "blk": blk})
    m = measure_blocks(measures, p.block_ticks).select(
        "piece_id", "blk", "onset", F.lit(S.PRIORITY["M"]).alias("prio"), "numer", "denom", "copy")
    t = tempos.withColumns({"prio": F.lit(S.PRIORITY["T"]), "blk": blk})
    return body.unionByName(m, True).unionByName(t, True)


def _ordered_body(notes, measures, tempos, p, note_order) -> DataFrame:
    """Body rows with their measure, their local rank and whether a position comes first.

    One shuffle by (piece, block) and one sort; duplicates (neighbours in that order), measures,
    positions and ranks all use it.
    """
    for name in ("shape", "k"):
        if name not in notes.columns:
            notes = notes.withColumn(name, F.lit(None).cast("string" if name == "shape" else "int"))
    rows = union_tokens(notes, measures, tempos, p)
    w = Window.partitionBy("piece_id", "blk").orderBy("onset", "prio", *note_order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    copy = F.coalesce("copy", F.lit(False))
    timed = F.col("prio") > S.PRIORITY["M"]
    place = F.struct("onset", "prio", *note_order)
    before = F.lag(place).over(w)
    twin = (F.col("prio") == S.PRIORITY["N"]) & before.eqNullSafe(place)
    covered = F.coalesce((before["onset"] == F.col("onset")) & (before["prio"] > S.PRIORITY["M"]),
                         F.lit(False))
    return (rows.withColumns({
                "measure_onset": F.last(F.when(~timed, F.col("onset")), True).over(upto),
                "dropped": copy | twin, "needs_position": timed & ~covered})
            .withColumn("rank", F.sum(F.when(F.col("dropped"), 0).otherwise(
                1 + F.col("needs_position").cast("int"))).over(upto))
            # Rows of rejected pieces have no measure.
            .filter(~F.col("dropped") & F.col("measure_onset").isNotNull())
            .withColumn("position", F.col("onset") - F.col("measure_onset")))


def head_tokens(tracks: DataFrame) -> DataFrame:
    """WIN6: the track tokens of each piece."""
    return tracks.select("piece_id", "track_number", "instrument").distinct()


def order_blocks(notes: DataFrame, measures: DataFrame, tempos: DataFrame, p: CorpusParams,
                 note_order: list[str] = NOTE_ORDER) -> DataFrame:
    """WIN5, WIN7: body tokens with their time block ``blk`` and their ``rank`` within it, still without text.

    ``note_order`` is the order among the notes of one onset: by value for plain notes, by
    track and rank within the track for multi-notes (K3).  Pieces without measures drop out.
    """
    body = _ordered_body(notes, measures, tempos, p, note_order)
    kind = (F.when(F.col("prio") == S.PRIORITY["M"], "M").when(F.col("prio") == S.PRIORITY["T"], "T")
            .when(F.col("shape").isNotNull(), "U").otherwise("N"))
    first = F.when(F.col("needs_position"), F.array(F.lit(True), F.lit(False))).otherwise(
        F.array(F.lit(False)))
    doubled = body.withColumn("is_position", F.explode(first))
    own = lambda c: F.when(~F.col("is_position"), F.col(c)).cast(FIELDS[c]).alias(c)
    return doubled.select(
        "piece_id", "blk", (F.col("rank") - F.col("is_position").cast("int")).alias("rank"),
        F.when(F.col("is_position"), "P").otherwise(kind).alias("type"),
        F.col("onset").cast("int").alias("onset"), own("track_number"), own("numer"), own("denom"),
        F.when(F.col("is_position"), F.col("position")).cast("int").alias("position"), own("bpm"),
        own("shape"), own("pitch"), own("duration"), own("velocity"), own("is_cont"))


def _spelt(blocks: DataFrame) -> DataFrame:
    """Rows of ``order_blocks`` with their text, which neither a stored table nor an exchange of them holds."""
    return blocks.withColumn("instrument", F.lit(None).cast("int")).withColumn("text", S.format_token())


def number_tokens(blocks: DataFrame, tracks: DataFrame) -> DataFrame:
    """WIN7: head, body and end of every piece in one sequence.

    ``blocks`` (from ``order_blocks``) is read three times and should be a stored table; only
    the number of tokens per block is scanned per piece.
    """
    sizes = blocks.groupBy("piece_id", "blk").agg(F.max("rank").alias("n"))
    heads = head_tokens(tracks)
    n_tracks = heads.groupBy("piece_id").agg(F.count("*").alias("n_tracks"))
    by_block = Window.partitionBy("piece_id").orderBy("blk")
    # Stored, so that Catalyst knows that it is small and leaves the blocks where they are, as long as it is.
    offsets = stage(sizes.join(n_tracks, "piece_id").select(
        "piece_id", "blk",
        (F.col("n_tracks") + 1 + F.sum("n").over(by_block.rowsBetween(Window.unboundedPreceding, 0))
         - F.col("n")).alias("offset")), "offsets", plain=True)
    placed = _spelt(blocks.join(offsets, ["piece_id", "blk"]).withColumn(
        "seq", (F.col("offset") + F.col("rank")).cast("int"))).select(*TOKEN_COLUMNS)

    lengths = sizes.groupBy("piece_id").agg(F.sum("n").alias("n"))
    at = lambda seq, token: F.struct(seq.cast("int").alias("seq"), token.alias("t"))
    edges = lengths.join(n_tracks, "piece_id").select("piece_id", F.explode(F.array(
        at(F.lit(0), _token("BOS")), at(F.col("n_tracks") + 1, _token("SEP")),
        at(F.col("n_tracks") + F.col("n") + 2, _token("EOS")))).alias("e"))
    track_rows = heads.join(lengths, "piece_id", "left_semi").select(
        "piece_id", at(F.col("track_number") + 1, _token(
            "R", track_number="track_number", instrument="instrument")).alias("e"))
    rest = (edges.unionByName(track_rows).select("piece_id", "e.seq", "e.t.*")
            .withColumn("text", S.format_token()).select(*TOKEN_COLUMNS))
    return placed.unionByName(rest)


def join_blocks(blocks: DataFrame, tracks: DataFrame) -> DataFrame:
    """SNK1 straight from blocks: the text of each piece, without numbering its tokens."""
    body = (_spelt(blocks).groupBy("piece_id", "blk").agg(_in_order("rank", "text").alias("text"))
            .groupBy("piece_id").agg(_in_order("blk", "text").alias("text")))
    track = F.concat(F.lit("R"), S.itob36("instrument"), F.lit(":"), S.itob36("track_number"))
    heads = (head_tokens(tracks).withColumn("track_text", track)
             .groupBy("piece_id").agg(_in_order("track_number", "track_text").alias("head")))
    return heads.join(body, "piece_id").select("piece_id", F.concat_ws(
        " ", F.lit("BOS"), "head", F.lit("SEP"), "text", F.lit("EOS")).alias("text"))


def position_tokens(notes, measures, tempos, p: CorpusParams) -> DataFrame:
    """WIN5 on its own: ``(piece_id, onset, position)``."""
    return (_ordered_body(notes, measures, tempos, p, NOTE_ORDER)
            .filter("needs_position").select("piece_id", "onset", "position"))


# ---- text -------------------------------------------------------------------------------

def _in_order(key: str, value: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(key, value)))
    return F.array_join(F.transform(pairs, lambda s: s[value]), " ")


def join_text(tokens: DataFrame) -> DataFrame:
    """ARR1, SNK1: one line per piece.

    Blocks of the sequence are joined first, so that only block texts meet per piece; a line
    per piece is what the text format asks for.
    """
    blocks = (tokens.withColumn("_block", token_block())
              .groupBy("piece_id", "_block").agg(_in_order("seq", "text").alias("text")))
    return blocks.groupBy("piece_id").agg(_in_order("_block", "text").alias("text"))


def explode_text(corpus: DataFrame) -> DataFrame:
    """ARR1: ``(piece_id, seq, text)``."""
    return corpus.select("piece_id", F.posexplode(F.split("text", " ")).alias("seq", "text"))


def parse_tokens(texts: DataFrame) -> DataFrame:
    """SCL10: typed columns of exploded token texts; row by row, without a shuffle."""
    text = F.col("text")
    first = F.substring(text, 1, 1)
    kind = (F.when(text.isin("BOS", "EOS", "SEP"), text)
            .when(first.isin("R", "M", "P", "T", "N", "U"), first))
    rest = F.substring(text, 2, 2**31 - 1)
    parts = F.split(text, ":")
    is_note, is_kind = F.col("type").isin("N", "U"), lambda k: F.col("type") == k

    def number(condition, value):
        return F.when(condition, S.b36toi(value))

    def pair(separator, i):
        return F.split_part(rest, F.lit(separator), F.lit(i))

    frame = texts.select("piece_id", "seq", kind.alias("type"), "text")
    return frame.select(
        "piece_id", "seq", "type",
        F.lit(None).cast("int").alias("onset"),
        number(is_note | is_kind("R"), F.element_at(parts, -1)).alias("track_number"),
        number(is_kind("R"), pair(":", 1)).alias("instrument"),
        number(is_kind("M"), pair("/", 1)).alias("numer"),
        number(is_kind("M"), pair("/", 2)).alias("denom"),
        number(is_kind("P"), rest).alias("position"),
        number(is_kind("T"), rest).alias("bpm"),
        F.when(is_kind("U"), pair(":", 1)).alias("shape"),
        number(is_note, F.get(parts, F.lit(1))).alias("pitch"),
        number(is_note, F.get(parts, F.lit(2))).alias("duration"),
        number(is_note, F.get(parts, F.lit(3))).alias("velocity"),
        F.when(is_kind("N"), F.startswith(text, F.lit("N~")).cast("int"))
        .when(is_kind("U"), F.lit(0)).alias("is_cont"),
        "text")


def running_time(tokens: DataFrame, tpq: int) -> DataFrame:
    """WIN8: ``onset`` of each token, counted from the first measure.

    Also adds ``measure_no`` (measures begun so far), ``measure_onset`` and ``at`` (position
    within the measure, null before the first position).
    """
    is_measure = F.col("type") == "M"
    length = F.when(is_measure, S.measure_ticks("numer", "denom", tpq))
    place = F.when(is_measure, F.lit(-1)).when(F.col("type") == "P", F.col("position"))
    timed = running(
        tokens, ["piece_id"], ["seq"], token_block(),
        sums={"_ticks": F.coalesce(length, F.lit(0)), "measure_no": is_measure.cast("int")},
        lasts={"_length": length, "_place": place})
    measure_onset = (F.col("_ticks") - F.coalesce("_length", F.lit(0))).cast("int")
    at = F.when(F.col("_place") >= 0, F.col("_place"))
    return timed.withColumns({
        "measure_onset": F.when(F.col("measure_no") > 0, measure_onset),
        "at": at, "measure_no": F.col("measure_no").cast("int"),
    }).withColumn("onset", F.when(F.col("type").isin("M", "P", "T", "N", "U"),
                                  F.col("measure_onset") + F.coalesce("at", F.lit(0)))
                  ).drop("_ticks", "_length", "_place")


def token_measures(tokens: DataFrame, tpq: int) -> DataFrame:
    """The measures written in a token sequence."""
    timed = tokens if "measure_no" in tokens.columns else running_time(tokens, tpq)
    return timed.filter("type = 'M'").select(
        "piece_id", (F.col("measure_no") - 1).alias("measure_idx"),
        F.col("measure_onset").alias("onset"), "numer", "denom",
        S.measure_ticks("numer", "denom", tpq).alias("length"))


# ---- cuts -------------------------------------------------------------------------------

def _measure_number(tokens: DataFrame) -> DataFrame:
    return running(tokens, ["piece_id"], ["seq"], token_block(),
                   sums={"measure_no": (F.col("type") == "M").cast("int")})


def first_k_measures(tokens: DataFrame, k: int) -> DataFrame:
    """WIN11: head and measures 1..k, never EOS."""
    return (_measure_number(tokens).filter((F.col("measure_no") <= k) & (F.col("type") != "EOS"))
            .drop("measure_no"))


def after_k_measures(tokens: DataFrame, k: int) -> DataFrame:
    """WIN12: head, measures k+1.. and EOS."""
    head = F.col("measure_no") == 0
    return (_measure_number(tokens)
            .filter(head | (F.col("measure_no") > k) | (F.col("type") == "EOS")).drop("measure_no"))


def first_k_ticks(tokens: DataFrame, tpq: int, k: int) -> DataFrame:
    """WIN13: everything before the first token later than tick k."""
    late = running_time(tokens, tpq).filter(F.col("onset") > k).groupBy("piece_id").agg(F.min("seq").alias("_late"))
    return tokens.join(late, "piece_id", "left").filter(
        F.col("_late").isNull() | (F.col("seq") < F.col("_late"))).select(*tokens.columns)


def first_k_tokens(tokens: DataFrame, k: int) -> DataFrame:
    """WIN14: the first k tokens, closed with EOS."""
    kept = tokens.filter(F.col("seq") < k)
    cut = tokens.filter((F.col("seq") == k - 1) & (F.col("type") != "EOS"))
    end = cut.select("piece_id", (F.col("seq") + 1).alias("seq"), F.lit("EOS").alias("type"),
                     F.lit("EOS").alias("text"))
    return kept.unionByName(end, True)


def sample_measures(tokens: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """WIN15: head and a run of k measures from a hash-derived start; shorter pieces drop out."""
    numbered = _measure_number(tokens)
    sizes = numbered.filter("type = 'M'").groupBy("piece_id").agg(F.count("*").alias("n"))
    starts = sizes.filter(F.col("n") >= k).select(
        "piece_id", F.pmod(S.shared_hash(F.lit(seed), "piece_id"), F.col("n") - k + 1).alias("first"))
    inside = F.col("measure_no").between(F.col("first") + 1, F.col("first") + k)
    return (numbered.join(starts, "piece_id")
            .filter(((F.col("measure_no") == 0) | inside) & (F.col("type") != "EOS"))
            .drop("measure_no", "first"))


def renumber(tokens: DataFrame) -> DataFrame:
    """Dense ``seq`` after a cut."""
    numbered = running(tokens, ["piece_id"], ["seq"], token_block(), sums={"_n": F.lit(1)})
    return numbered.withColumn("seq", (F.col("_n") - 1).cast("int")).drop("_n")


def head_of(corpus: DataFrame) -> DataFrame:
    """ARR2: track tokens between BOS and SEP, from the text alone."""
    head = F.trim(F.substring_index(F.substring_index("text", " SEP", 1), "BOS", -1))
    return corpus.select("piece_id", F.posexplode(F.split(head, " ")).alias("pos", "track_token"))


def count_substring(text, needle: str) -> Column:
    """ARR3: occurrences of ``needle``."""
    text = F.col(text) if isinstance(text, str) else text
    stripped = F.length(F.replace(text, F.lit(needle), F.lit("")))
    return S.idiv(F.length(text) - stripped, F.lit(len(needle)))
