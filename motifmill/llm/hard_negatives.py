"""Hard negatives: rows of another label that are nearly as close to an anchor as one of its positives.

Scores are inner products of whole numbers, computed tile by tile: a tile of anchors times a tile of candidates, by
Strassen's recursion with exact additions.  What a task keeps of its tiles are heaps of bounded size: per anchor the
first few rows of its own label, and, once these are known, per anchor and positive the first few rows of other
labels within the window of scores that the positive opens.  Heaps of several tasks merge into one by taking the
first of all.

Candidates are laid out once, by label, in as many parts as the session shuffles into; a label with many rows
takes several.  Anchors are written into the shared folder in chunks, which tasks read; a chunk is one job over the
candidates, so a task's memory is that of one chunk, its heaps and one tile of scores.  Nothing but chunk numbers
comes to the driver, and what is shuffled grows with anchors times parts, not with anchors times candidates.
"""

from __future__ import annotations

import functools
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, Window, functions as F

from motifmill.functions.scan import ranked
from motifmill.llm.tables import parts, prepare
from motifmill.llm.token_files import _open as open_folder
from motifmill.session import stage

#: Sides up to which a product is not divided any more.
LEAF = 32
#: Anchors and candidates of a tile, and anchors of a chunk; fewer if vectors are long.
TILE = (512, 4096)
CHUNK = 1 << 15
#: Numbers of a vector above which tiles have fewer rows.
WIDTH = 1 << 10
NO = np.iinfo(np.int64).min


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An exact product of int64 matrices: in doubles where no sum can leave their whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), b.shape[1]), np.int64)
    most = [max(abs(int(x.max())), abs(int(x.min()))) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` for int64 matrices, with seven products of halves in place of eight.

    Odd sides are padded with a zero.  Sums wrap modulo 2**64 and so do not disturb results that fit into 64 bits.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _multiply(a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    x, y, z = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]
    b11, b12, b21, b22 = b[:y, :z], b[:y, z:], b[y:, :z], b[y:, z:]
    out = np.zeros((2 * x, 2 * z), np.int64)
    c11, c12, c21, c22 = out[:x, :z], out[:x, z:], out[x:, :z], out[x:, z:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11 += p
    c22 += p
    p = strassen(a21 + a22, b11, leaf)
    c21 += p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12 += p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :n]


class Heaps:
    """For each of ``n`` owners the first ``size`` entries by (score downwards, id, row)."""

    def __init__(self, n: int, size: int):
        self.score = np.full((n, size), NO, np.int64)
        self.id = np.zeros((n, size), np.int64)
        self.row = np.full((n, size), -1, np.int64)

    def last(self) -> np.ndarray:
        """The score below which no entry gets in any more."""
        return self.score[:, -1]

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(owner):
            return
        size = self.score.shape[1]
        some = np.unique(owner)
        held = self.row[some] >= 0
        owner = np.concatenate([owner, np.repeat(some, size)[held.ravel()]])
        score = np.concatenate([score, self.score[some][held]])
        ids = np.concatenate([ids, self.id[some][held]])
        rows = np.concatenate([rows, self.row[some][held]])
        order = np.lexsort((rows, ids, ~score, owner))  # ~ turns the order around without overflow
        owner, score, ids, rows = owner[order], score[order], ids[order], rows[order]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        ok = place < size
        self.score[some], self.row[some] = NO, -1
        self.score[owner[ok], place[ok]] = score[ok]
        self.id[owner[ok], place[ok]] = ids[ok]
        self.row[owner[ok], place[ok]] = rows[ok]

    def entries(self):
        """(owner, score, id, row) of all entries."""
        owner, place = np.nonzero(self.row >= 0)
        return owner, self.score[owner, place], self.id[owner, place], self.row[owner, place]


def _matrix(column) -> np.ndarray:
    """Vectors of a list column as rows of a matrix, shorter ones padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values)[offsets[0]: offsets[-1]] if len(column) else np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and sizes.min() == width:
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of all rows of ``a`` with all of ``b``; the longer vectors meet zeros."""
    k = min(a.shape[1], b.shape[1])
    return strassen(a[:, :k], np.ascontiguousarray(b[:, :k].T))


@functools.lru_cache(maxsize=1)
def _chunk(folder: str, chunk: int):
    """The rows of a chunk of anchors, in the order of their labels."""
    system, path = open_folder(folder)
    table = ds.dataset(path, format="parquet", filesystem=system, exclude_invalid_files=True, ignore_prefixes=["_", "."]).to_table(
        filter=ds.field("chunk") == chunk)
    return table.sort_by([("label", "ascending"), ("row", "ascending")])


def _candidates(batches):
    """(ids, rows, labels, vectors) of tiles of candidates."""
    for batch in batches:
        sizes = np.diff(np.asarray(batch.column("v").offsets))
        step = max(1, TILE[1] * WIDTH // max(WIDTH, int(sizes.max(initial=0))))
        for k in range(0, batch.num_rows, step):
            some = batch.slice(k, step)
            yield (*(np.asarray(some.column(c)) for c in ("vec_id", "row", "label")), _matrix(some.column("v")))


def _anchor_tiles(vectors: np.ndarray, low: int, high: int):
    step = max(1, TILE[0] * WIDTH // max(WIDTH, vectors.shape[1]))
    for k in range(low, high, step):
        yield k, min(k + step, high)


def _positives(batches, folder, chunk, size):
    """The heaps of positives of one chunk of anchors over one part of the candidates."""
    table = _chunk(folder, chunk)
    anchors, rows, labels = _matrix(table["v"]), np.asarray(table["row"]), np.asarray(table["label"])
    heaps = Heaps(len(rows), size)
    for ids, row, label, vectors in _candidates(batches):
        for one in np.unique(label):  # as many as the part has labels; candidates are laid out by label
            low, high = np.searchsorted(labels, one, "left"), np.searchsorted(labels, one, "right")
            own = np.flatnonzero(label == one) if high > low else ()
            if not len(own):
                continue
            for a, b in _anchor_tiles(anchors, low, high):
                scores = _product(anchors[a:b], vectors[own])
                x, y = np.nonzero((scores >= heaps.last()[a:b, None]) & (rows[a:b, None] != row[own]))
                heaps.add(x + a, scores[x, y], ids[own[y]], row[own[y]])
    owner, score, ids, row = heaps.entries()
    for k in range(0, len(owner), 1 << 16):
        part = slice(k, k + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (rows[owner], score, ids, row)],
                                         names=["anchor", "score", "other_id", "other"])


def _negatives(batches, folder, chunk, size, low_percent, high_percent):
    """The heaps of negatives of one chunk of anchors, one heap per positive, over one part of the candidates."""
    table = _chunk(folder, chunk)
    anchors, rows, labels = _matrix(table["v"]), np.asarray(table["row"]), np.asarray(table["label"])
    goals = _matrix(table["scores"])
    n, width = goals.shape
    there = np.arange(width) < np.asarray(table["n_scores"])[:, None]
    # The whole numbers within the window; Python's numbers, as products may leave 64 bits.
    wide = goals.astype(object)
    low = np.where(there, -((-wide * low_percent) // 100), np.iinfo(np.int64).max).astype(np.int64)
    high = np.where(there, wide * high_percent // 100, NO)
    high = np.minimum(high, np.iinfo(np.int64).max).astype(np.int64)
    there &= low <= high
    if not there.any():
        return
    heaps = Heaps(n * width, size)
    for ids, row, label, vectors in _candidates(batches):
        for a, b in _anchor_tiles(anchors, 0, n):
            least = np.maximum(low[a:b], heaps.last().reshape(n, width)[a:b])
            bottom = np.where(there[a:b], least, np.iinfo(np.int64).max).min(axis=1)
            top = np.where(there[a:b], high[a:b], NO).max(axis=1)
            if not (bottom <= top).any():
                continue
            scores = _product(anchors[a:b], vectors)
            x, y = np.nonzero((scores >= bottom[:, None]) & (scores <= top[:, None]) & (labels[a:b, None] != label))
            found = scores[x, y]
            for j in range(width):
                ok = np.flatnonzero(there[a:b][x, j] & (found >= least[x, j]) & (found <= high[a:b][x, j]))
                heaps.add((x[ok] + a) * width + j, found[ok], ids[y[ok]], row[y[ok]])
    owner, score, ids, row = heaps.entries()
    for k in range(0, len(owner), 1 << 16):
        part = slice(k, k + (1 << 16))
        who = owner[part]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[who // width]), pa.array((who % width).astype(np.int32)), *(pa.array(x[part]) for x in (score, ids, row))],
            names=["anchor", "positive", "score", "other_id", "other"])


def _first(found: DataFrame, by: list[str], size: int) -> DataFrame:
    """Heaps of all parts merged: at most ``size`` rows of each part meet."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): components times ``scale``, rounded down.  Rows that can't take part are gone."""
    x = F.col("embedding").cast("array<double>")
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * float(scale)) < float(1 << 63)))
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("embedding")
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).filter(fits).select(
        "vec_id", "label", F.transform("embedding", lambda c: F.floor(c * float(scale)).cast("long")).alias("v"))


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80,
         high_percent: int = 100, scale: int = 256, chunk_rows: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors`` picks.

    ``vectors`` has vec_id, label and embedding.  A row's score is the inner product of its vector with the anchor's, both
    as whole numbers (``scale`` times a component, rounded down); higher scores come first, then smaller vec_ids.  An
    anchor's positives are its first ``positives`` other rows with its label.  For each of them its negatives are the first
    ``negatives`` rows with other labels whose scores are between ``low_percent`` and ``high_percent`` of the positive's.

    Rows with a null vec_id, label or vector or with a component that is null, not finite or beyond 64 bits take
    no part.  Shorter vectors are padded with zeros; empty ones score 0.  Rows that repeat a vec_id each count for themselves.
    Anchors without positives, and positives without negatives, give no row.  Scores have to fit into 64 bits.
    ``chunk_rows`` anchors at most are worked on at once, whatever that changes in memory, not in results.
    """
    spark = vectors.sparkSession
    prepare(spark)
    flagged = whole_numbers(vectors, scale).withColumn("is_anchor", F.coalesce(anchors, F.lit(False)))
    place = F.monotonically_increasing_id()
    # By label for the search of positives; the second key divides labels with many rows.
    laid_out = stage(flagged.withColumn("row", place).repartitionByRange(parts(spark), "label", "row"), "vectors")
    chosen = laid_out.filter("is_anchor").select("row", "vec_id", "label", "v")
    chunk = F.call_function("div", F.col("place"), F.lit(chunk_rows)).cast("int").alias("chunk")
    numbered = stage(chosen.join(ranked(chosen, "row", "place"), "row").select("row", "vec_id", "label", "v", chunk)
                     .repartition(F.col("chunk")), "anchors")
    last = numbered.agg(F.max("chunk")).first()[0]
    n_chunks = 0 if last is None else last + 1
    candidates = laid_out.select("vec_id", "row", "label", "v")
    schema = "anchor long, score long, other_id long, other long"
    folder = _folder(numbered)
    found = [candidates.mapInArrow(functools.partial(_positives, folder=folder, chunk=k, size=positives), schema) for k in range(n_chunks)]
    best = _first(_union(spark, found, schema), ["anchor"], positives)
    best = stage(best.select("anchor", (F.col("rank") - 1).alias("positive"), "score", "other_id"), "positives")
    goals = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("positive", "score"))).alias("of"))
    goals = goals.select(F.col("anchor").alias("row"), F.col("of.score").alias("scores"), F.size("of").alias("n_scores"))
    aimed = stage(numbered.join(goals, "row").repartition(F.col("chunk")), "aims")
    schema = "anchor long, positive int, score long, other_id long, other long"
    folder = _folder(aimed)
    found = [candidates.mapInArrow(functools.partial(
        _negatives, folder=folder, chunk=k, size=negatives, low_percent=low_percent, high_percent=high_percent), schema)
        for k in range(n_chunks if folder else 0)]
    hard = _first(_union(spark, found, schema), ["anchor", "positive"], negatives)
    return (hard.join(best.select("anchor", "positive", F.col("score").alias("positive_score"), F.col("other_id").alias("positive_id")),
                      ["anchor", "positive"])
            .join(numbered.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def _folder(staged: DataFrame) -> str | None:
    """The folder of a staged table that has rows."""
    files = staged.inputFiles()
    return unquote(files[0]).rsplit("/", 1)[0] if files else None


def _union(spark, frames: list[DataFrame], schema: str) -> DataFrame:
    return functools.reduce(DataFrame.union, frames) if frames else spark.createDataFrame([], schema)
