"""Multi-note byte-pair merges (BPE1-9, JON6, WIN16, AGG20-24).

A track is cut into phrases at rests longer than the neighbour gap; no merge ever reaches over such a rest, so
phrases are independent for the whole run and are the unit of distribution.  While shapes are learned or
applied, a phrase is one row that carries its notes and the reduced pairs they make.  A round surveys only the
phrases that have a pair of the new shape, and keeps the counts of all pairs by adding and subtracting
what changed there.  Phrases of more than ``CHUNK`` notes are rows of blocks, which exchange what
happens at their edges (``phrase_kernel``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import gcd
from time import perf_counter

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from motifmill.functions import scalars as S
from motifmill.operators import merge_kernel as M, phrase_kernel as H
from motifmill.params import LIMITS, MAX_SHAPES, BpeParams, CorpusParams, Limits
from motifmill.session import ship_package, stage

# The two shapes every vocabulary starts with.
DEFAULT_SHAPES = [((0, 0, 1, 0),), ((0, 0, 1, 1),)]

COLUMNS = ["piece_id", "track_number", "phrase", "k", "shape_id", "onset", "pitch", "stretch", "velocity"]
SCHEMA = ("piece_id bigint, track_number int, phrase int, k int, shape_id int, onset int, "
          "pitch int, stretch int, velocity int")


# ---- shapes on the driver: a list of at most 2**16 short tuples ---------------------------

def _b36(x: int) -> str:
    digits = np.base_repr(abs(x), 36)
    return f"-{digits}" if x < 0 else digits


def shape_text(shape) -> str:
    return "".join(f"{_b36(o)},{_b36(p)},{_b36(d)}{'~' if c else ''};" for o, p, d, c in shape)


def shape_tuple(text: str) -> tuple:
    members = []
    for m in text.rstrip(";").split(";"):
        o, p, d = (int(x, 36) for x in m.rstrip("~").split(","))
        members.append((o, p, d, int(m.endswith("~"))))
    return tuple(members)


def canonical(members) -> tuple:
    """Member order: onset, pitch as an unsigned byte, duration, continuation."""
    return tuple(sorted(members, key=lambda m: (m[0], m[1] % 256, m[2], m[3])))


def splits_of(shape: tuple, known: dict[tuple, int]) -> np.ndarray:
    """Every reduced pair of known shapes that joins to ``shape``."""
    found = set()
    for left, left_id in known.items():
        if len(left) >= len(shape):
            continue
        ratios = {m[2] // left[0][2] for m in shape if m[0] == 0 and m[1] == 0}
        for ratio in ratios:
            rest = list(shape)
            try:
                for o, p, d, c in left:
                    rest.remove((o * ratio, p, d * ratio, c))
            except ValueError:
                continue
            rest = canonical(rest)
            at, interval = rest[0][0], rest[0][1]
            # The first member of the right shape is its lowest in its own order.
            for anchor in {m[1] for m in rest if m[0] == at} | {interval}:
                unit = gcd(*[v for o, _, d, _ in rest for v in (o - at, d)])
                right = canonical([((o - at) // unit, p - anchor, d // unit, c) for o, p, d, c in rest])
                right_id = known.get(right)
                if right_id is not None and gcd(at, ratio, unit) == 1:
                    found.add((left_id, right_id, ratio, unit, at, anchor))
    return np.array(sorted(found), dtype=np.int64).reshape(-1, 6)


def shapes_frame(spark: SparkSession, shapes: list[tuple]) -> DataFrame:
    """``(shape_id, shape, text)``; ids 0 and 1 are the single notes."""
    rows = [(i, shape_text(s)) for i, s in enumerate(shapes)]
    df = spark.createDataFrame(rows, "shape_id int, text string")
    return df.select("shape_id", S.parse_shape("text").cast(S.SHAPE_TYPE).alias("shape"), "text")


# ---- notes as multi-notes ---------------------------------------------------------------

def to_multi_notes(timed_notes: DataFrame, tpq: int) -> DataFrame:
    """BPE1, TOP2: single notes as multi-notes of the default shapes, ranked within their phrase.

    A phrase is named by its first onset.  Notes are dealt out by track once; phrases and ranks are windows along it,
    and ``pack`` needs no other exchange.
    """
    base = timed_notes.filter("type = 'N'").select(
        "piece_id", "track_number", F.col("is_cont").alias("shape_id"), "onset", "pitch",
        F.col("duration").alias("stretch"), "velocity")
    track = Window.partitionBy("piece_id", "track_number").orderBy("onset")
    # Notes of one onset begin a phrase together, whatever their order.
    reach = F.max(F.col("onset") + F.col("stretch")).over(track.rangeBetween(Window.unboundedPreceding, -1))
    start = F.when(reach.isNull() | (F.col("onset") > reach + tpq), F.col("onset"))
    placed = base.withColumn("_start", start).withColumn(
        "phrase", F.max("_start").over(track.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    order = Window.partitionBy("piece_id", "track_number", "phrase").orderBy(
        "onset", "pitch", "stretch", "shape_id", "velocity")
    return placed.withColumn("k", F.row_number().over(order)).select(*COLUMNS)


def neighbour_pairs(multi_notes: DataFrame, shapes: DataFrame, gap: int, block_ticks: int = 96,
                    limit: int | None = LIMITS.neighbours) -> DataFrame:
    """JON6 as a join: pairs ``(a, b)`` of ranks within a phrase.

    The left note enters every time block in which a neighbour may start, the right note only
    its own, so candidates meet per (phrase, block) and not per track.
    """
    spans = F.broadcast(shapes.select("shape_id", S.shape_span("shape").alias("span")))
    notes = multi_notes.join(spans, "shape_id").withColumn(
        "end", F.col("onset") + F.col("span") * F.col("stretch"))
    first, last = S.idiv("onset", F.lit(block_ticks)), S.idiv(F.col("end") + gap, F.lit(block_ticks))
    phrase = ["piece_id", "track_number", "phrase"]
    value = F.struct("k", "onset", "end", "shape_id", "pitch", "stretch", "velocity")
    a = notes.select(*phrase, value.alias("a"), F.explode(F.sequence(first, last)).alias("blk"))
    b = notes.select(*phrase, value.alias("b"), first.alias("blk"))
    within = F.lit(True) if limit is None else F.col("b.k") <= F.col("a.k") + limit
    near = (a.join(b, [*phrase, "blk"])
            .filter((F.col("b.k") > F.col("a.k")) & within
                    & (F.col("b.onset") <= F.col("a.end") + gap)))
    after = F.when(F.col("b.onset") >= F.col("a.end"), F.col("b.onset"))
    follow = F.min(after).over(Window.partitionBy(*phrase, "a.k"))
    return (near.withColumn("follow", follow)
            .filter(after.isNull() | (after == F.col("follow")))
            .select(*phrase, "a", "b"))


def adjacent(adjacency: str) -> Column:
    """UDF2: which neighbours count, as a predicate on ``neighbour_pairs``."""
    same = F.col("a.velocity") == F.col("b.velocity")
    if adjacency == "ours":
        return same
    return (same & (F.col("a.onset") == F.col("b.onset")) & (F.col("a.stretch") == F.col("b.stretch")))


def shape_counts_from_pairs(pairs: DataFrame, shapes: DataFrame, adjacency: str, p: CorpusParams,
                            limits: Limits = LIMITS) -> DataFrame:
    """AGG23 for one round, wholly in built-in expressions."""
    lookup = shapes.select("shape_id", "shape")
    reduced = pairs.filter(adjacent(adjacency)).withColumn(
        "unit", S.pair_stretch(F.col("b.onset") - F.col("a.onset"), F.col("a.stretch"),
                               F.col("b.stretch"), p.max_duration))
    keys = reduced.groupBy(
        F.col("a.shape_id").alias("l"), F.col("b.shape_id").alias("r"),
        S.idiv("a.stretch", "unit").cast("int").alias("lr"),
        S.idiv("b.stretch", "unit").cast("int").alias("rr"),
        S.idiv(F.col("b.onset") - F.col("a.onset"), "unit").cast("int").alias("d"),
        (F.col("b.pitch") - F.col("a.pitch")).alias("dp")).agg(F.count("*").alias("n"))
    return named_counts(keys, lookup, limits)


def _name_pairs(keys: DataFrame, lookup: DataFrame, limits: Limits) -> DataFrame:
    """Reduced pairs summed by the shape they make; ``code`` keeps the totals of ``count_pairs``.

    One frame for both, so that the pass over the notes runs once.
    """
    left = F.broadcast(lookup.toDF("l", "left_shape"))  # at most 2**16 rows, by their id type
    right = F.broadcast(lookup.toDF("r", "right_shape"))
    joined = S.join_shapes("left_shape", "right_shape", "lr", "rr", "d", "dp")
    fits = F.forall("shape", lambda m: (m["rel_onset"] <= limits.onset) & (m["rel_dur"] <= limits.duration))
    return (keys.join(left, "l", "left").join(right, "r", "left").withColumn("shape", joined)
            .filter((F.col("l") < 0) | fits)
            .groupBy("shape", F.when(F.col("l") < 0, F.col("l")).alias("code"))
            .agg(F.sum("n").alias("n")))


def named_counts(keys: DataFrame, lookup: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Counts of reduced pairs to counts of shapes; pairs that overflow are gone (SCL18)."""
    return _name_pairs(keys, lookup, limits).filter("code is null").select(
        S.format_shape("shape").alias("text"), "shape", "n")


def _byte_order(shape="shape") -> Column:
    """Arrays in canonical order compare by unsigned pitch."""
    return F.transform(shape, lambda m: F.struct(
        m["rel_onset"].alias("o"), F.pmod(m["rel_pitch"], F.lit(256)).alias("p"),
        m["rel_dur"].alias("d"), m["is_cont"].alias("c")))


def best_shape(counts: DataFrame) -> DataFrame:
    """AGG24: the most frequent shape; among equals the smallest in canonical order."""
    return counts.orderBy(F.desc("n"), _byte_order()).limit(1).select("text", "n")


# ---- the loop ---------------------------------------------------------------------------

def keep_sampled_pieces(multi_notes: DataFrame, rate: float, seed: int, iteration: int) -> DataFrame:
    """FLT18: pieces that score in this iteration, by hash (K8)."""
    if rate >= 1:
        return multi_notes
    bits = 2**20
    draw = F.pmod(S.shared_hash(F.lit(seed), F.lit(iteration), "piece_id"), F.lit(bits))
    return multi_notes.filter(draw < int(rate * bits))


def lay_out(multi_notes: DataFrame) -> DataFrame:
    """One shuffle by phrase; rows in order within each task from here on."""
    return (multi_notes.select(*COLUMNS).repartition(*M.PHRASE)
            .sortWithinPartitions(*M.PHRASE, "k"))


def score_shapes(laid_out: DataFrame, shapes: list[tuple], adjacency: str, gap: int,
                 limits: Limits = LIMITS) -> DataFrame:
    """BPE2: counts of reduced pairs, summed; the only thing that is shuffled in a round."""
    ship_package(laid_out.sparkSession)
    bounds = M.ShapeBounds.of(shapes)
    schema = "l int, r int, lr int, rr int, d int, dp int, n bigint"
    partial = laid_out.mapInPandas(lambda it: M.count_pairs(it, bounds, adjacency, gap, limits), schema)
    return partial.groupBy("l", "r", "lr", "rr", "d", "dp").agg(F.sum("n").alias("n"))


def merge_shape(laid_out: DataFrame, shapes: list[tuple], new_shape: tuple, gap: int,
                include_last: bool = True, limits: Limits = LIMITS) -> DataFrame:
    """BPE3: one shape merged everywhere; narrow, keeps layout and order."""
    ship_package(laid_out.sparkSession)
    bounds = M.ShapeBounds.of(shapes)
    targets = splits_of(new_shape, {s: i for i, s in enumerate(shapes)})
    new_id = len(shapes)
    return laid_out.mapInPandas(
        lambda it: M.merge_pass(it, new_id, targets, bounds, gap, include_last, limits), SCHEMA)


# ---- phrases as rows --------------------------------------------------------------------

#: Notes of a phrase up to which it is one row, and of a block of a longer one.
CHUNK = 1 << 13
_ROW = ", ".join(["piece_id bigint", "track_number int", "phrase int", "chunk int", *(f"{f} array<int>" for f in H.NOTE)])
_CHANGES = "changes array<struct<l:int,r:int,lr:int,rr:int,d:int,dp:int,n:bigint>>"
_STATE = f"{_ROW}, pairs array<bigint>, {_CHANGES}"


def pack(multi_notes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One shuffle by phrase: phrases (of more than ``chunk`` notes: their blocks) as rows with lists of notes.

    Notes are numbered from 1 within their phrase, as ``to_multi_notes`` does.
    """
    note = F.struct(*(F.col(f).cast("int").alias(f) for f in H.NOTE))
    rows = multi_notes.groupBy(*M.PHRASE, S.idiv(F.col("k") - 1, F.lit(chunk)).cast("int").alias("chunk")).agg(
        F.sort_array(F.collect_list(note)).alias("notes"))
    return rows.select(*H.NAME, *(F.col(f"notes.{f}").alias(f) for f in H.NOTE))


def unpack(phrases: DataFrame) -> DataFrame:
    """The notes of phrases as rows."""
    return phrases.select(*M.PHRASE, F.inline(F.arrays_zip(*H.NOTE))).select(*COLUMNS)


def _divided(multi_notes: DataFrame, rules: H.Rules, chunk: int):
    """Phrases that are one row each (with their pairs and the counts of these), and a part for the longer ones."""
    phrases = stage(pack(multi_notes, chunk), "phrases")
    of_long = (F.col("chunk") > 0) | (F.size("k") >= chunk)
    blocks, part = phrases.filter(of_long), None
    if not blocks.isEmpty():
        part = Blocks(blocks) if rules.limits.neighbours is not None else Stream(lay_out(unpack(blocks)))
    return phrases.filter(~of_long), part


def _summed_changes(state: DataFrame) -> DataFrame:
    return state.filter("phrase is null").select(F.inline("changes")).groupBy(*H.PAIR).agg(F.sum("n").alias("n"))


class Blocks:
    """Long phrases as rows of blocks, which different tasks merge.

    A note looks ahead at most ``Limits.neighbours`` rows, so blocks are surveyed with that many notes of the blocks
    around them.  Which notes a block loses to the one before it is settled by transitions: what each block would do for
    every entry state is worked out at once, and one small scan per phrase puts the blocks' tables together.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def edged(self, halo: int) -> DataFrame:
        """Blocks with the last notes of the block before and the first ones of the block after."""
        n = F.size("k")
        before = self.rows.select(*M.PHRASE, (F.col("chunk") + 1).alias("chunk"), *(
            F.slice(f, F.greatest(n - halo + 1, F.lit(1)), F.lit(halo)).alias(f"before_{f}") for f in H.NOTE))
        after = self.rows.select(*M.PHRASE, (F.col("chunk") - 1).alias("chunk"), *(
            F.slice(f, F.lit(1), F.lit(halo)).alias(f"after_{f}") for f in H.NOTE))
        none = F.array().cast("array<int>")
        joined = self.rows.join(before, H.NAME, "left").join(after, H.NAME, "left")
        return joined.select(*H.NAME, *H.NOTE, *(F.coalesce(f"{side}_{f}", none).alias(f"{side}_{f}")
                                                 for side in ("before", "after") for f in H.NOTE))

    def counts(self, rules: H.Rules) -> DataFrame:
        schema = "l int, r int, lr int, rr int, d int, dp int, n bigint"
        found = self.edged(rules.limits.neighbours).mapInArrow(lambda it: H.count_blocks(it, rules), schema)
        return found.groupBy(*H.PAIR).agg(F.sum("n").alias("n"))

    def merge(self, shapes: list[tuple], new_id: int, targets: np.ndarray, rules: H.Rules, include_last: bool) -> "Blocks":
        edged = stage(self.edged(rules.limits.neighbours), "edged")
        moves = edged.mapInArrow(
            lambda it: H.block_transitions(it, targets, rules, include_last),
            "piece_id bigint, track_number int, phrase int, chunk int, open array<int>, sets array<array<int>>, "
            "left array<int>, right array<int>, beyond array<int>")
        entries = moves.groupBy(*M.PHRASE).applyInPandas(
            H.entry_states, "piece_id bigint, track_number int, phrase int, chunk int, gone array<int>")
        merged = edged.join(entries, H.NAME, "left").mapInArrow(
            lambda it: H.merge_blocks(it, new_id, targets, rules, include_last), _ROW)
        return Blocks(_closed_up(stage(merged, "blocks"), rules.limits.neighbours))

    def notes(self) -> DataFrame:
        return unpack(self.rows)

    def of(self, condition: Column) -> "Blocks":
        return Blocks(self.rows.filter(condition))


def _closed_up(blocks: DataFrame, halo: int) -> DataFrame:
    """``blocks`` put together two by two until each but a phrase's last has as many notes as a note may look ahead."""
    while True:
        sizes = blocks.select(*M.PHRASE, "chunk", F.size("k").alias("n"))
        last = sizes.groupBy(*M.PHRASE).agg(F.max("chunk").alias("last"))
        if sizes.filter(F.col("n") < halo).join(last, M.PHRASE).filter("chunk < last").isEmpty():
            return blocks
        two = blocks.groupBy(*M.PHRASE, S.idiv("chunk", F.lit(2)).cast("int").alias("chunk")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("chunk").alias("at"), *H.NOTE))).alias("both"))
        blocks = stage(two.select(*H.NAME, *(F.flatten(F.col(f"both.{f}")).alias(f) for f in H.NOTE)), "blocks")


class Stream:
    """Long phrases as ordered rows, each phrase on one task in constant memory: for merges without a limit of neighbours."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def counts(self, rules: H.Rules) -> DataFrame:
        schema = "l int, r int, lr int, rr int, d int, dp int, n bigint"
        partial = self.rows.mapInPandas(
            lambda it: M.count_pairs(it, rules.bounds, rules.adjacency, rules.gap, rules.limits), schema)
        return partial.groupBy(*H.PAIR).agg(F.sum("n").alias("n"))

    def merge(self, shapes: list[tuple], new_id: int, targets: np.ndarray, rules: H.Rules, include_last: bool) -> "Stream":
        merged = self.rows.mapInPandas(
            lambda it: M.merge_pass(it, new_id, targets, rules.bounds, rules.gap, include_last, rules.limits), SCHEMA)
        return Stream(lay_out(stage(merged, "stream")))

    def notes(self) -> DataFrame:
        return self.rows.select(*COLUMNS)

    def of(self, condition: Column) -> "Stream":
        return Stream(self.rows.filter(condition))


def apply_shapes(multi_notes: DataFrame, learned: list[tuple], gap: int,
                 include_last: bool = True, limits: Limits = LIMITS, chunk: int = CHUNK) -> DataFrame:
    """BPE5, BPE6: all shapes in order, in one pass over each phrase.

    Also the way to apply the vocabulary of one collection to another.  A task keeps, for its batch of phrases,
    which of them have which pair, so a shape costs what it merges and not a look at every note.
    """
    ship_package(multi_notes.sparkSession)
    shapes = [*DEFAULT_SHAPES, *learned]
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"a vocabulary has at most {MAX_SHAPES} shapes")
    rules = H.Rules(M.ShapeBounds.of(shapes), "ours", gap, limits)
    plan, known = [], dict(zip(DEFAULT_SHAPES, range(2)))
    for i in range(2, len(shapes)):
        plan.append((i, splits_of(shapes[i], known)))
        known[shapes[i]] = i
    plan = [(i, targets) for i, targets in plan if len(targets)]
    phrases, long = _divided(multi_notes, rules, chunk)
    merged = unpack(phrases.mapInArrow(lambda it: H.merge_all(it, plan, rules, include_last), _ROW))
    if long is None:
        return merged
    for new_id, targets in plan:
        long = long.merge(shapes, new_id, targets, rules, include_last)
    return merged.union(long.notes())


@dataclass
class Learned:
    shapes: list[tuple]
    multi_notes: DataFrame
    log: list[tuple] = field(default_factory=list)
    start: DataFrame | None = None

    def shapes_frame(self, spark: SparkSession) -> DataFrame:
        return shapes_frame(spark, [*DEFAULT_SHAPES, *self.shapes])

    def iteration_log(self, spark: SparkSession) -> DataFrame:
        """BPE9: a row per round; as long as the number of rounds."""
        return spark.createDataFrame(
            self.log, "iteration int, avg_neighbours double, n_shapes bigint, shape string, "
                      "score bigint, n_multi_notes bigint, cut_notes bigint, oversized_pairs bigint, seconds double")

    def run_log(self) -> DataFrame:
        """BPE9: multi-notes and their mean number in a group before the first and after the last round."""
        sizes = [_sizes(df).withColumnsRenamed({"n": f"{when}_multi_notes", "avg": f"{when}_avg_mulpi"})
                 for when, df in (("start", self.start), ("end", self.multi_notes))]
        return sizes[0].join(F.broadcast(sizes[1]))  # one row each


def _sizes(multi_notes: DataFrame) -> DataFrame:
    return _mulpi_groups(multi_notes, False).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.avg("n").alias("avg"))


def learn(multi_notes: DataFrame, tpq: int, b: BpeParams, chunk: int = CHUNK) -> Learned:
    """BPE4: merge the best shape again and again.  One small job per round.

    Counts are kept from round to round; a round surveys the phrases that have a pair of its shape.  With a
    sampling rate below 1 every round draws other pieces, so their phrases are surveyed each time.  Only the best
    shape and a few numbers come to the driver.  Every few rounds tables are written into the shared folder, which cuts lineage.
    """
    spark = multi_notes.sparkSession
    ship_package(spark)
    shapes = list(DEFAULT_SHAPES)
    rules = H.Rules(M.ShapeBounds.of(shapes), b.adjacency, tpq, b.limits)
    phrases, long = _divided(multi_notes, rules, chunk)
    survey = lambda rows, rules: rows.mapInArrow(lambda it: H.first_survey(it, rules), _STATE)
    named = lambda keys: _name_pairs(keys, shapes_frame(spark, shapes).select("shape_id", "shape"), b.limits)
    keep = lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)
    state = keep(survey(phrases, rules))
    counts = named(_summed_changes(state))
    log, held = [], [state]
    for iteration in range(b.iterations):
        began = perf_counter()
        if b.sampling_rate < 1:
            drawn = lambda df: keep_sampled_pieces(df, b.sampling_rate, b.seed, iteration)
            counts = named(_summed_changes(survey(drawn(state.filter("phrase is not null")).drop("pairs", "changes"), rules)))
        else:
            counts = stage(counts, "counts")  # so that its plan doesn't hold those of all rounds before
        total = counts
        if long is not None:
            of = long if b.sampling_rate >= 1 else type(long)(drawn(long.rows))
            total = total.union(named(of.counts(rules)))
            total = total.groupBy("shape", "code").agg(F.sum("n").alias("n"))
        ranked = _ranked(total)
        if ranked["score"] is None or ranked["score"] <= b.min_score:
            break
        new_shape = shape_tuple(ranked["text"])
        targets = splits_of(new_shape, {s: i for i, s in enumerate(shapes)})
        new_id = len(shapes)
        shapes.append(new_shape)
        rules = H.Rules(M.ShapeBounds.of(shapes), b.adjacency, tpq, b.limits)
        wanted = F.array(*(F.lit(h) for h in H.pair_hash(targets).tolist()))
        state = state.filter("phrase is not null").withColumn("touched", F.coalesce(F.arrays_overlap("pairs", wanted), F.lit(False))).mapInArrow(
            lambda it, new_id=new_id, targets=targets, rules=rules: H.merge_round(it, new_id, targets, rules, True), _STATE)
        if long is not None:
            long = long.merge(shapes, new_id, targets, rules, True)
        if (iteration + 1) % b.checkpoint_every == 0 and iteration + 1 < b.iterations:
            state = stage(state, "state")
        state = keep(state)
        if b.sampling_rate >= 1:
            counts = (counts.union(named(_summed_changes(state))).groupBy("shape", "code").agg(F.sum("n").alias("n"))
                      .filter("n <> 0 or code is not null"))
        held.append(state)
        log.append((iteration, ranked["n_neighbours"] / max(ranked["n_rows"], 1), ranked["n_shapes"],
                    ranked["text"], ranked["score"], ranked["n_rows"], ranked["n_cut"], ranked["n_oversized"],
                    perf_counter() - began))
        # The next round's job fills the new tables from those before; older ones can go.
        for old in held[:-2]:
            old.unpersist()
        held = held[-2:]
    notes = unpack(state.filter("phrase is not null"))
    if long is not None:
        notes = notes.union(long.notes())
    return Learned(shapes[2:], notes, log, multi_notes)


def _ranked(counts: DataFrame):
    """The best shape and the totals of one round."""
    shape = F.col("code").isNull()
    total = lambda code: F.coalesce(F.max(F.when(F.col("code") == code, F.col("n"))), F.lit(0))
    return counts.agg(
        F.max(F.when(shape, F.col("n"))).alias("score"), F.count_if(shape).alias("n_shapes"),
        total(-1).alias("n_neighbours"), total(-2).alias("n_rows"),
        total(-3).alias("n_cut"), total(-4).alias("n_oversized"),
        F.min(F.when(shape, F.struct(-F.col("n"), _byte_order(), "shape"))).alias("best"),
    ).select("score", "n_shapes", "n_neighbours", "n_rows", "n_cut", "n_oversized",
             S.format_shape("best.shape").alias("text")).first()


# ---- totals and text --------------------------------------------------------------------

def avg_mulpi_size(multi_notes: DataFrame, ignore_velocity: bool = False) -> DataFrame:
    """AGG20: mean size of the groups of notes that share onset and stretch."""
    return _mulpi_groups(multi_notes, ignore_velocity).agg(F.avg("n").alias("avg_mulpi_size"))


def _mulpi_groups(multi_notes: DataFrame, ignore_velocity: bool) -> DataFrame:
    key = ["piece_id", "track_number", "onset", "stretch", *([] if ignore_velocity else ["velocity"])]
    return multi_notes.groupBy(*key).agg(F.count("*").alias("n"))


def totals(multi_notes: DataFrame) -> DataFrame:
    """AGG21."""
    per_track = multi_notes.groupBy("piece_id", "track_number").agg(F.count("*").alias("n"))
    return per_track.agg(F.sum("n").alias("n_multi_notes"), F.count("*").alias("n_tracks"))


def avg_neighbours(multi_notes: DataFrame, pairs: DataFrame) -> DataFrame:
    """AGG22."""
    n = multi_notes.agg(F.count("*").alias("n_multi_notes"))
    m = pairs.agg(F.count("*").alias("n_neighbours"))
    # One row each.
    return n.join(F.broadcast(m)).select(
        "n_multi_notes", "n_neighbours", (F.col("n_neighbours") / F.col("n_multi_notes")).alias("avg"))


def as_note_rows(multi_notes: DataFrame, shapes: DataFrame) -> DataFrame:
    """BPE7: multi-notes as rows that ``order_tokens`` takes."""
    text = F.broadcast(shapes.select("shape_id", "text"))
    return multi_notes.join(text, "shape_id").select(
        "piece_id", "onset", "track_number", "phrase", "k", "pitch",
        F.col("stretch").alias("duration"), "velocity",
        (F.col("shape_id") == 1).cast("int").alias("is_cont"),
        F.when(F.col("shape_id") > 1, F.col("text")).alias("shape"))
