"""Mixing sources to target weights: budgets are fitted to documents by their exact lengths.

Each source has a budget of words.  Whole repeats of the source come first; the rest of the budget is a subset-sum
problem over the source's documents, of which only the number per exact length matters.  Most of it is shared out in
proportion over the lengths, so the mix looks like the source; the last ``window`` words are fitted by bounded-knapsack
dynamic programming over the lengths that are left.  Which documents of a length go in is then a draw by a seeded
hash of doc_id.

Texts are read once, where they are; shuffled are numbers only.  Lengths are counted map-side; a task gets the lengths
of one source (a source of w words has less than sqrt(2 w) lengths), never its documents.  Documents of one
source and length are drawn bucket by bucket of their hashes, so a length that a third of all documents has is
the work of many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from motifmill.functions.scan import ranked
from motifmill.llm.tables import prepare
from motifmill.llm.text import BLANK, texts_of
from motifmill.session import stage

#: Documents of a source and length that one task draws from, about.
BUCKET = 1 << 13
PLACES = 1 << 40


def _count_words(batches):
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        begin = ~BLANK[data]
        after = np.append(True, BLANK[data[:-1]]) if len(data) else begin
        after[offsets[:-1][offsets[:-1] < len(data)]] = True
        begin &= after
        sizes = np.diff(np.searchsorted(np.flatnonzero(begin), offsets))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("src"), pa.array(sizes, pa.int64())], names=["doc_id", "src", "size"])


def _knapsack(lengths: list[int], counts: list[int], budget: int, seed: int) -> np.ndarray:
    """How many of each length, at most ``counts``, sum up nearest to ``budget`` (of two, the smaller sum)."""
    out = np.zeros(len(lengths), np.int64)
    there = [i for i, c in enumerate(counts) if c]
    if budget <= 0 or not there:
        return out
    room = budget + min(lengths[i] for i in there) + 1
    by = np.full(room, -1, np.int32)  # the item by which a sum was first reached
    by[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for i in np.random.default_rng(seed).permutation(there).tolist():
        left, times = counts[i], 1
        while left and by[budget] < 0:
            times = min(times, left)
            step = lengths[i] * times
            if step >= room:
                break
            fresh = np.flatnonzero((by[step:] < 0) & (by[:-step] >= 0)) + step
            by[fresh] = len(items)
            items.append((i, times))
            left, times = left - times, times * 2
        if by[budget] >= 0:
            break
    reached = np.flatnonzero(by >= 0)
    total = int(reached[np.argmin(np.abs(reached - budget))])
    while total:
        i, times = items[by[total]]
        out[i] += times
        total -= lengths[i] * times
    return out


def fit(lengths, counts, budget: int, window: int = 1 << 16, seed: int = 0) -> np.ndarray:
    """How many documents of each distinct length come nearest to ``budget`` words.

    All but the last ``window`` words are shared out in proportion, longest documents first, each length
    making up for what rounding has left so far; a budget within the window is fitted wholly by the knapsack.
    """
    lengths, counts = [int(x) for x in lengths], [int(x) for x in counts]
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return np.array(counts, np.int64) * (np.array(lengths, np.int64) > 0)
    taken = np.zeros(len(lengths), np.int64)
    order = sorted((i for i, n in enumerate(lengths) if n > 0 and counts[i] > 0), key=lambda i: -lengths[i])
    coarse, seen, got = max(budget - window, 0), 0, 0
    for i in order:
        seen += lengths[i] * counts[i]
        taken[i] = min(counts[i], max(coarse * seen // total - got, 0) // lengths[i])
        got += int(taken[i]) * lengths[i]
    for i in order:  # lengths that ran out leave more than the window
        more = min(counts[i] - int(taken[i]), max(budget - window - got, 0) // lengths[i])
        taken[i] += more
        got += more * lengths[i]
    left = [c - int(t) if n > 0 else 0 for n, c, t in zip(lengths, counts, taken)]
    return taken + _knapsack(lengths, left, budget - got, seed)


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """``sources`` (src, words, weight) with ``target``: ``share`` of all words by weight, at most ``most`` times a source's own.

    What a source can't take is shared out anew among the others, until none is above its limit: the words per unit of
    weight rise with each round, and a round is one sum over the sources.
    """
    total = sources.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    goal, each = share * (total["words"] or 0), 0.0
    free = total["weight"] or 0
    held = 0
    while free and (goal - most * held) / free > each:
        each = (goal - most * held) / free
        full = F.lit(most) * F.col("words") <= F.lit(each) * F.col("weight")
        now = sources.agg(F.sum(F.when(full, F.col("words"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        held, free = now["held"] or 0, now["free"] or 0
    if not free:  # every source is at its limit
        return sources.withColumn("target", F.lit(most) * F.col("words"))
    return sources.withColumn("target", F.least(F.lit(most) * F.col("words"), F.lit(each) * F.col("weight")))


def _fit_source(rows: pd.DataFrame, window: int, seed: int) -> pd.DataFrame:
    rows = rows.sort_values("size", ignore_index=True)
    words, target = int(rows["words"].iloc[0]), float(rows["target"].iloc[0])
    repeats = int(target // words) if words else 0
    rows["want"] = fit(rows["size"], rows["n"], round(target - repeats * words), window, seed) if words else 0
    rows["repeats"] = repeats
    return rows[["src", "size", "n", "words", "target", "want", "repeats"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        window: int = 1 << 16, seed: int = 0, bucket_rows: int = BUCKET) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix takes, repeats counted.

    ``docs`` has doc_id, text and source.  A document's size is its number of words (other characters than space, tab
    and line ends, one after the other); null and empty texts have none and are never taken.  Sources weigh
    ``weights`` in turn, in the order of their code points, a null source last and of its own.  The mix aims at ``share``
    times all words, by weight; no source and no document is taken more than ``most`` times, a whole number of
    times or that plus once more for those drawn.  One row per row of ``docs``: rows that repeat doc_id are drawn one by
    one, null doc_ids after the others of their length.  The same rows and seed give the same mix.  Other columns are
    not looked at; an empty table gives an empty one.  About ``bucket_rows`` documents are drawn from at once; the
    mix doesn't depend on it.
    """
    spark = docs.sparkSession
    prepare(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("src"))
    rows = stage(plain.mapInArrow(_count_words, "doc_id long, src string, size long")
                 .withColumn("row", F.monotonically_increasing_id()), "sizes")
    lengths = stage(rows.groupBy("src", "size").agg(F.count("*").alias("n")), "lengths")
    words = lengths.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stage(words.join(ranked(words, "src", "place"), "src").select("src", "words", weight.alias("weight")), "sources")
    wanted = stage(lengths.join(targets(sources, share, most), "src").groupBy("src").applyInPandas(
        lambda rows: _fit_source(rows, window, seed),
        "src string, size long, n long, words long, target double, want long, repeats long"), "wanted")

    largest = wanted.agg(F.max("n")).first()[0] or 0
    buckets = 1 << max(0, (largest // bucket_rows).bit_length())
    place = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", "row")), F.lit(PLACES))
    dealt = rows.withColumn("place", place).withColumn(
        "bucket", F.call_function("div", F.col("place"), F.lit(PLACES // buckets)) + F.when(F.col("doc_id").isNull(), buckets).otherwise(0))
    bucket = ["src", "size", "bucket"]
    before = Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*bucket).agg(F.count("*").alias("here"))
    ahead = counts.select(*bucket, F.coalesce(F.sum("here").over(before), F.lit(0)).alias("ahead"))
    left = ahead.join(wanted, ["src", "size"]).select(*bucket, "words", "target", "repeats", (F.col("want") - F.col("ahead")).alias("left"))
    order = Window.partitionBy(*bucket).orderBy("place", "doc_id", "row")
    return (dealt.join(left, bucket).withColumn("drawn", F.row_number().over(order) <= F.col("left"))
            .select("doc_id", "size", F.col("words").alias("source_size"), "target",
                    (F.col("size") * (F.col("repeats") + F.col("drawn").cast("long"))).alias("taken")))
