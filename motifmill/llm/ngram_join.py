"""Similarity join of documents by the Jaccard similarity of their sets of word n-grams.

The similarities are the cells of a sparse matrix product, documents by n-grams times its transpose.
The product is taken in blocks, and only where a bound by size allows a link:

1. *Rows.* Every document's set is hashed; documents with equal sets are one row (``rep``).
2. *Columns.* A row of n n-grams links only with rows that share one of its first
   ``n - ceil(t n) + 1`` columns, in any fixed order of the columns.  Busy columns come last in that
   order.  Which are busy is counted over all documents; their number is bounded by ``BUSY``.
3. *Candidate cells.* Two stages keep large groups of copies from giving all their pairs.  First, a few
   rows drawn from each column's list are paired with the list's other rows, and the links found are
   contracted to components.  Then, rows of one list that are still in different components are paired:
   in short lists by a join, in long ones block by block.  No pair that could join two components is
   left out, so the components are exact.
4. *Bounds.* Sizes bound the overlap from above; so does the parity of the n-grams in each of 2n or
   more buckets, kept as a bitmap: sets differ in at least as many n-grams as parities.
5. *Overlaps.* What is left is dealt out to blocks of rows times rows; a block gets the texts of its rows, lays
   out their incidence with the block's n-grams and adds up, column by column, the cells of the product it was given.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from motifmill.llm.graph import components
from motifmill.llm.tables import keyed, parts, prepare, with_key
from motifmill.llm.text import STEP, mix, ranges_of, shingles_of, texts_of, tidied, word_hashes
from motifmill.session import job, stage

#: A column is busy from so many rows on, or from a power of two more if over BUSY would be.
BUSY_FROM, BUSY = 64, 1 << 20
#: Rows of a list up to which its pairs are joined directly; rows of a block of a longer list.
SHORT, BLOCK = 256, 512
#: Rows that are drawn from each column's list in the first stage.
LEADERS = 3
#: Bits of the filter that keeps texts from being shuffled that no pair asks for.
FILTER_BITS = 1 << 23


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def needed_overlap(a, b, percent: int):
    return -((-percent * (a + b)) // (100 + percent))


def _sets(batch, width):
    """(row, sorted n-gram hashes) of a batch."""
    data, offsets = texts_of(batch.column("text"))
    for i, j in ranges_of(offsets, 4 * STEP):
        hashes, first = word_hashes(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
        for k in range(j - i):
            yield i + k, shingles_of(hashes[first[k]: first[k + 1]], width)


def _digest(grams: np.ndarray) -> bytes:
    both = (mix(grams).sum(dtype=np.uint64), mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return np.array([*both, len(grams)], np.uint64).tobytes()


def _parity(grams: np.ndarray) -> bytes:
    bits = 64
    while bits < 2 * len(grams):
        bits *= 2
    odd = np.bincount((grams % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _folded(x: np.ndarray, to: int) -> np.ndarray:
    """Parities in ``to`` buckets from those in more."""
    while x.shape[-1] > to:
        x = x[..., : x.shape[-1] // 2] ^ x[..., x.shape[-1] // 2:]
    return x


def _differ(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """At least so many n-grams are in one set only, for each pair of parities."""
    out = np.zeros(len(x), np.int64)
    wide = np.array([(len(p) // 8, len(q) // 8) for p, q in zip(x, y)], np.int64).reshape(-1, 2)
    for a, b in np.unique(wide, axis=0).tolist():
        at = np.flatnonzero((wide == (a, b)).all(axis=1))
        left, right = (np.frombuffer(b"".join(z[i] for i in at), np.uint64).reshape(len(at), -1) for z in (x, y))
        to = min(a, b)
        out[at] = np.bitwise_count(_folded(left, to) ^ _folded(right, to)).sum(axis=1)
    return out


@tidied
def _row_batches(batches, width):
    for batch in batches:
        n, digest, parity = [], [], []
        for _, grams in _sets(batch, width):
            n.append(len(grams))
            digest.append(_digest(grams))
            parity.append(_parity(grams))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(parity, pa.binary())],
            names=["key", "n", "digest", "parity"])


def _dealt(part, n_parts, *columns):
    """The columns' values of each part, as bytes."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
    used = np.flatnonzero(np.diff(cuts))
    out = [pa.array(used.astype(np.int32))]
    for c in columns:
        c = c[order]
        out.append(pa.array([c[cuts[p]: cuts[p + 1]].tobytes() for p in used], pa.binary()))
    return out


@tidied
def _count_batches(batches, width, percent, n_parts):
    """How many sets have each n-gram among twice as many of the smallest hashes as a prefix takes."""
    for batch in batches:
        taken = [g[: 2 * prefix_length(len(g), percent)] for _, g in _sets(batch, width) if len(g)]
        if taken:
            grams, count = np.unique(np.concatenate(taken), return_counts=True)
            part = (grams % np.uint64(n_parts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(_dealt(part, n_parts, grams, count.astype(np.uint32)),
                                             names=["part", "grams", "counts"])


@tidied
def _busy(frame: pd.DataFrame) -> pd.DataFrame:
    grams = np.frombuffer(b"".join(frame["grams"]), np.uint64)
    count = np.frombuffer(b"".join(frame["counts"]), np.uint32)
    order = np.argsort(grams, kind="stable")
    at = np.flatnonzero(np.append(True, np.diff(grams[order]) != 0))
    total = np.add.reduceat(count[order].astype(np.int64), at)
    grams, total = grams[order][at][total >= BUSY_FROM], total[total >= BUSY_FROM]
    return pd.DataFrame({"gram": grams.view(np.int64), "rows": total})


def _busy_columns(rows: DataFrame, width, percent, n_parts):
    """Sorted hashes of the busy columns and their counts: at most BUSY of them, so 16 MB."""
    counted = rows.mapInArrow(lambda b: _count_batches(b, width, percent, n_parts),
                              "part int, grams binary, counts binary")
    busy = stage(counted.groupBy("part").applyInPandas(lambda f: _busy(f), "gram long, rows long"), "busy")
    by_size = {r["k"]: r["count"] for r in busy.groupBy(F.floor(F.log2("rows")).alias("k")).count().collect()}
    least, total = BUSY_FROM, sum(by_size.values())
    for k in sorted(by_size):
        if total <= BUSY:
            break
        total, least = total - by_size[k], 2 ** (k + 1)
    found = busy.filter(F.col("rows") >= least).toPandas()
    grams = found["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], found["rows"].to_numpy(np.int64)[order]


@tidied
def _posting_batches(batches, width, percent, n_parts, busy):
    """Prefixes with busy columns last; quiet columns by part, busy ones anywhere."""
    columns, rows = busy.value
    for batch in batches:
        keys = np.asarray(batch.column("key"))
        seen, quiet, loud = set(), [], []
        order = np.argsort(keys, kind="stable")
        sets = dict(_sets(batch, width))
        for i in order:
            g = sets[i]
            digest = _digest(g)
            if not len(g) or digest in seen:  # the first of equal sets speaks for all of the batch
                continue
            seen.add(digest)
            take = prefix_length(len(g), percent)
            if len(columns):
                at = np.minimum(np.searchsorted(columns, g), len(columns) - 1)
                hit = columns[at] == g
                calm, late = g[~hit], g[hit]
                late = late[np.lexsort((late, rows[at[hit]]))]
            else:
                calm, late = g, g[:0]
            calm, late = calm[:take], late[: max(0, take - len(calm))]
            quiet.append((calm, keys[i], len(g)))
            loud.append((late, keys[i], len(g)))
        for busy_ones, found in ((False, quiet), (True, loud)):
            size = [len(x[0]) for x in found]
            if not sum(size):
                continue
            grams = np.concatenate([x[0] for x in found])
            owner = np.repeat(np.array([x[1] for x in found], np.int64), size)
            total = np.repeat(np.array([x[2] for x in found], np.uint32), size)
            part = np.arange(len(grams)) // 4096 % n_parts if busy_ones else (grams % np.uint64(n_parts)).astype(np.int64)
            out = _dealt(part, n_parts, grams, owner & 0xFFFFFFFF, owner >> 32, total)
            out = [out[0], out[1], *(pa.array([_narrow(x.as_py(), w) for x in c], pa.binary())
                                     for c, w in ((out[2], np.int64), (out[3], np.int64), (out[4], np.uint32)))]
            yield pa.RecordBatch.from_arrays([*out, pa.array([busy_ones] * len(out[0]))],
                                             names=["part", "grams", "low", "high", "n", "busy"])


def _narrow(values: bytes, kind) -> bytes:
    return np.frombuffer(values, kind).astype(np.uint32).tobytes()


@tidied
def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Entries of columns that more than one row has."""
    out = []
    for busy, own in frame.groupby("busy"):
        gram = np.frombuffer(b"".join(own["grams"]), np.uint64)
        low, high, n = (np.frombuffer(b"".join(own[c]), np.uint32).astype(np.int64) for c in ("low", "high", "n"))
        key = high << 32 | low
        if not busy:
            order = np.lexsort((key, gram))
            gram, key, n = gram[order], key[order], n[order]
            again = np.append(False, gram[1:] == gram[:-1])
            keep = again | np.append(again[1:], False)
            gram, key, n = gram[keep], key[keep], n[keep]
        out.append(pd.DataFrame({"gram": gram.view(np.int64), "key": key, "n": n}))
    return pd.concat(out)


def _possible(batches, percent):
    """Pairs whose parities leave room for a link."""
    for batch in batches:
        a, b = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
        differ = _differ(batch.column("pa").to_pylist(), batch.column("pb").to_pylist())
        yield batch.select(["a", "b"]).filter(pa.array(differ <= a + b - 2 * needed_overlap(a, b, percent)))


@tidied
def _block_pairs(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of one block of a long list: rows of different components that may link."""
    left, right = frame[frame["side"] != 1], frame[frame["side"] != 0]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    out = []
    # Sizes alone say which rows can meet; of two widths the larger is folded to the smaller, on either side.
    by_width = {}
    wide = np.array([len(p) // 8 for p in right["parity"]])
    for w in np.unique(wide).tolist():
        some = right[wide == w]
        by_width[w] = (some["rep"].to_numpy(), some["n"].to_numpy(), some["component"].to_numpy(),
                       {w: np.array([np.frombuffer(p, np.uint64) for p in some["parity"]])})
    for rep, n, component, parity in zip(left["rep"], left["n"], left["component"], left["parity"]):
        parity = np.frombuffer(parity, np.uint64)
        for w, (reps, sizes, comps, bits) in by_width.items():
            ok = (comps != component) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
            if not ok.any():
                continue
            to = min(w, len(parity))
            if to not in bits:
                bits[to] = _folded(bits[w], to)
            low = np.bitwise_count(bits[to][ok] ^ _folded(parity, to)).sum(axis=1)
            good = low <= sizes[ok] + n - 2 * needed_overlap(sizes[ok], n, percent)
            other = reps[ok][good]
            out.append(np.stack([np.minimum(rep, other), np.maximum(rep, other)], axis=1))
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


@tidied
def _overlaps(key, texts: pd.DataFrame, pairs: pd.DataFrame, width, percent) -> pd.DataFrame:
    """The pairs of one block that link: a sparse product of its rows, for the cells that were asked for."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts["text"], pa.string())], names=["text"])
    sets = [g for _, g in _sets(batch, width)]
    size = np.array([len(g) for g in sets], np.int64)
    first = np.cumsum(size) - size
    columns, column = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    # The incidence matrix, cell by cell in order.
    cells = np.repeat(np.arange(len(sets)), size) * len(columns) + column
    place = pd.Series(np.arange(len(sets)), index=texts["rep"].to_numpy())
    a, b = (place[pairs[c].to_numpy()].to_numpy(np.int64) for c in "ab")
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    both = np.zeros(len(a), np.int64)
    ends, k = np.cumsum(size[a]), 0
    while k < len(a):  # a bounded number of products at a time
        j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + STEP, "right")))
        many = size[a[k:j]]
        pair = np.repeat(np.arange(j - k), many)
        own = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[a[k:j]][pair]
        wanted = b[k:j][pair] * len(columns) + column[own]
        hit = cells[np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)] == wanted
        both[k:j] = np.bincount(pair[hit], minlength=j - k)
        k = j
    return pairs.loc[100 * both >= percent * (size[a] + size[b] - both), ["a", "b"]]


class _Join:
    """One run of the join; ``docs`` is (key, doc_id, text) with unique keys."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        self.spark = docs.sparkSession
        self.n_parts = 2 * parts(self.spark)

    def rows(self) -> DataFrame:
        found = self.docs.select("key", "text").mapInArrow(
            lambda b, w=self.width: _row_batches(b, w), "key long, n long, digest binary, parity binary")
        return stage(found, "sets")

    def postings(self) -> DataFrame:
        source = self.docs.select("key", "text")
        busy = self.spark.sparkContext.broadcast(_busy_columns(source, self.width, self.percent, self.n_parts))
        w, p, k = self.width, self.percent, self.n_parts
        dealt = source.mapInArrow(lambda b: _posting_batches(b, w, p, k, busy),
                                  "part int, grams binary, low binary, high binary, n binary, busy boolean")
        return stage(dealt.groupBy("part").applyInPandas(lambda f: _shared(f), "gram long, key long, n long"), "postings")

    def fits(self, a: str, b: str):
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def possible(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias("n" + x), F.col("parity").alias("p" + x))
        p = self.percent
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lambda b: _possible(b, p), "a long, b long")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of distinct ``pairs`` those that link, block by block."""
        pairs = stage(pairs.distinct(), "pairs")
        nodes = stage(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "nodes")
        blocks = -(-nodes.count() // (4 * BLOCK)) or 1
        block = lambda x: F.pmod(F.xxhash64(F.col(x)), F.lit(blocks))
        pairs = pairs.withColumn("cell", F.struct(block("a").alias("i"), block("b").alias("j")))
        cells = pairs.select(F.col("cell").alias("block"), F.explode(F.array("a", "b")).alias("rep")).distinct()
        slot = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))
        words = (nodes.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32).alias("w"))
                 .agg(F.bit_or(F.pow(F.lit(2.0), F.col("s") % 32).cast("long")).alias("bits")).toPandas())
        table = np.zeros(FILTER_BITS // 32, np.int64)  # 2 MB, however many nodes there are
        table[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
        table = self.spark.sparkContext.broadcast(table.astype(np.uint32))

        def asked_for(batches):
            for b in batches:
                s = np.asarray(b.column("s")).astype(np.int64)
                hit = table.value[s // 32] >> (s % 32).astype(np.uint32) & np.uint32(1)
                yield b.select(["rep", "text"]).filter(pa.array(hit.astype(bool)))

        texts = (self.docs.select(F.col("key").alias("rep"), "text").withColumn("s", slot)
                 .mapInArrow(asked_for, "rep long, text string").join(cells, "rep"))
        w, p = self.width, self.percent
        found = texts.groupBy("block").cogroup(pairs.groupBy("cell")).applyInPandas(
            lambda key, t, x: _overlaps(key, t, x, w, p), "a long, b long")
        return stage(found, "links")

    def run(self) -> DataFrame:
        rows = self.rows()
        first = rows.filter("n > 0").groupBy("digest").agg(F.min("key").alias("rep"))
        named = stage(rows.join(first, "digest", "left")
                      .select("key", "n", F.coalesce("rep", "key").alias("rep")), "named")
        reps = stage(rows.join(named.filter("key = rep").select("key"), "key").select(F.col("key").alias("rep"), "n", "parity"), "reps")
        lists = stage(self.postings().join(named.select("key", "rep"), "key").select("gram", "rep", "n").distinct(),
                      "lists")
        # First stage: rows drawn from each list with the others of the list.
        drawn = lists.groupBy("gram").agg(F.array_distinct(F.array(*(
            F.min_by(F.struct("rep", "n"), F.xxhash64("gram", "rep", F.lit(k))) for k in range(LEADERS)))).alias("leaders"))
        met = (lists.join(drawn, "gram").select("rep", "n", F.explode("leaders").alias("l"))
               .filter((F.col("l.rep") != F.col("rep")) & self.fits("l.n", "n"))
               .select(F.least("rep", "l.rep").alias("a"), F.greatest("rep", "l.rep").alias("b")).distinct())
        links = self.linked(self.possible(met, reps))
        # Second stage: rows of one list that are in different components so far.
        found = components(links)
        lists = stage(lists.join(found, lists["rep"] == found["node"], "left")
                      .select("gram", "rep", "n", F.coalesce("component", "rep").alias("component")), "lists")
        open_ = (lists.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m"))
                 .filter("x <> y").select("gram", "m"))
        lists = stage(lists.join(open_, "gram"), "open")
        links = links.union(self.linked(self.short(lists, reps).union(self.long(lists, reps))))
        found = components(links)
        names = self.docs.select(F.col("key").alias("node"), "doc_id")
        found = found.join(names.withColumnsRenamed({"node": "component", "doc_id": "component_id"}), "component")
        out = named.join(names, named["key"] == names["node"]).drop("node")
        return out.join(found, out["rep"] == found["node"], "left").join(
            names.withColumnsRenamed({"node": "rep", "doc_id": "rep_id"}), "rep").select(
            "key", "doc_id", F.col("n").alias("n_shingles"),
            F.coalesce("component", "rep").alias("component_key"),
            F.coalesce("component_id", "rep_id").alias("component_id"))

    def short(self, lists: DataFrame, reps: DataFrame) -> DataFrame:
        lists = lists.filter(F.col("m") <= SHORT)
        other = lists.select("gram", *(F.col(c).alias("o_" + c) for c in ("rep", "n", "component")))
        pairs = (lists.join(other, "gram").filter((F.col("rep") < F.col("o_rep")) & (F.col("component") != F.col("o_component"))
                                                  & self.fits("n", "o_n"))
                 .select(F.col("rep").alias("a"), F.col("o_rep").alias("b")).distinct())
        return self.possible(pairs, reps)

    def long(self, lists: DataFrame, reps: DataFrame) -> DataFrame:
        """Each row of a long list goes to the blocks of its own part of the list with every other part."""
        many = F.ceil(F.col("m") / BLOCK).cast("int")
        lists = (lists.filter(F.col("m") > SHORT).withColumn("parts", many)
                 .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
                 .join(reps.select("rep", "parity"), "rep"))
        cells = lists.select("gram", "rep", "n", "component", "parity", "own", F.explode(
            F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        cells = cells.select("gram", "rep", "n", "component", "parity", F.least("own", "other").alias("i"),
                             F.greatest("own", "other").alias("j"),
                             F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
        p = self.percent
        return cells.groupBy("gram", "i", "j").applyInPandas(lambda f: _block_pairs(f, p), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(key, doc_id, n_shingles, component_key, component_id) per document of ``docs`` (doc_id, text).

    Texts are lower-cased (A-Z); words are runs of bytes other than ASCII white space.  The set of a document
    holds its distinct runs of ``width`` words, or its whole sequence if it has fewer words.  Documents
    link when 100 * overlap >= ``percent`` * union; ``component_id`` is the smallest doc_id of those
    reachable by links.  Null and blank texts have an empty set and link with nothing.  Rows that repeat
    doc_id and text give one row; rows that repeat only doc_id stay apart (``key``).
    """
    prepare(docs.sparkSession)
    return _Join(keyed(docs), width, percent).run()


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that are linked to a row with a smaller doc_id, with all their columns.

    Of rows with one doc_id and equal texts one stays; rows with empty texts all stay.
    """
    rows, key = with_key(docs)
    with job(docs.sparkSession):
        found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), width, percent)
        first = stage(found.filter("doc_id = component_id").select(F.col("doc_id").alias(key)), "first", outlives_job=True)
    return rows.join(first, key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
