"""Alignment of the tokens of two tokenizers over the same text, and how often their tokens are linked.

Both tokenizations are sequences of byte offsets at which tokens end.  Merged, they are one path through a grid; cut
by evenly spaced diagonals, it falls into pieces of the same number of steps, whose beginnings are found by binary
search along their diagonals.  All pieces of a batch then merge in step, each by itself, and emit the offsets at
which both tokenizations end a token; a piece looks back one token over its beginning, which joins a group that it
shares with the piece before.  The texts of a batch lie one after the other, as each text's end is an end of both.

A *group* is the tokens between two such offsets; each token of A in it is *linked* with each of B.  A pair of ids
counts the documents in which it is linked, over the whole corpus: distinct pairs per document are written once, with
the number of their links, and counted map-side.  The pairs that most documents have, at most ``BUSY`` of them, go
to all tasks, where they are looked up in place; the rest, each in few documents, are joined by pair.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from motifmill.llm.bpe_automaton import byte_letters, tokenize
from motifmill.llm.pretokens import WordTable
from motifmill.llm.tables import prepare
from motifmill.llm.text import ranges_of, texts_of
from motifmill.session import stage

#: Steps of the merge in one piece.
PIECE = 256
#: Pairs that are looked up in place (16 bytes each).
BUSY = 1 << 18
#: Bytes of text that are aligned at once; a longer text without spaces comes alone.
SLICE = 1 << 18
SPACE = "▁"


class Labels:
    """The bytes of each id of a vocabulary, and the id as a decimal number with a separator."""

    def __init__(self, labels: list[bytes]):
        self.size, self.at, self.bytes = self._laid_out(labels)
        self.digits_size, self.digits_at, self.digits = self._laid_out([b"%d," % i for i in range(len(labels))])

    @staticmethod
    def _laid_out(texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        return size, np.cumsum(size) - size, np.frombuffer(b"".join(texts), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        return _gather(self.bytes, self.at[ids], self.size[ids])


def _gather(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    stop = np.cumsum(size)
    if not len(stop) or not stop[-1]:
        return data[:0]
    return data[np.arange(stop[-1]) + np.repeat(at - (stop - size), size)]


@functools.cache
def byte_level(path: str) -> tuple[WordTable, Labels]:
    """A: a byte-level BPE of the tokenizers library, behind a table of words; special tokens are plain text."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    letters = byte_letters()
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    special = tokenizer.get_added_tokens_decoder()
    labels = [b""] * tokenizer.get_vocab_size()
    for text, i in vocab.items():
        labels[i] = text.encode() if i in special else bytes(letters[c] for c in text)

    def encode(words):
        found = tokenizer.encode([w.decode("utf-8", "replace") for w in words], is_pretokenized=True, add_special_tokens=False)
        owner = np.array(found.word_ids, np.int64)
        return np.split(np.array(found.ids, np.uint32), np.searchsorted(owner, np.arange(1, len(words))))

    return WordTable(encode), Labels(labels)


@functools.cache
def pieces(path: str) -> tuple[WordTable, Labels]:
    """B: a sentencepiece model, behind a table of words.

    A word is a run of spaces and what follows up to the next space.  No piece has a space after another character
    (this is checked), so no merge reaches over the beginning of a word, and words are encoded by themselves.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    labels = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if SPACE in piece.lstrip(SPACE):
            raise ValueError(f"{path}: piece {piece!r} reaches over the beginning of a word")
        labels.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(SPACE, " ").encode())

    space = np.array([model.piece_to_id(SPACE)], np.uint32)

    def encode(words):
        # The model puts a space in front of all but empty texts, so the word's first one is left out.
        found = model.encode([w[1:].decode("utf-8", "replace") for w in words], num_threads=1)
        return [np.array(ids, np.uint32) if len(w) > 1 else space for w, ids in zip(words, found)]

    return WordTable(encode), Labels(labels)


def _with_space(data: np.ndarray, offsets: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space in front of ``some``, as far as they aren't empty."""
    some = some & (np.diff(offsets) > 0)
    return np.insert(data, offsets[:-1][some], 32), offsets + np.append(0, np.cumsum(some))


def _b_tokens(data: np.ndarray, offsets: np.ndarray, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of ids of each text) of B; every text begins with a space."""
    space = data == 32
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begin)
    ids, count = table.of(data, starts, np.append(starts[1:], len(data)))
    edge = np.append(0, np.cumsum(count))[np.searchsorted(starts, offsets)]
    return ids, np.diff(edge)


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of ``a`` and ``b`` crosses every ``piece``-th diagonal: places in a and in b.

    Equal values come from ``a`` first.  On a diagonal, the place in ``a`` is the first whose value doesn't come before
    the value in ``b`` across from it; all diagonals are searched at once.
    """
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(d), bool)
        first[open_] = a[middle[open_]] <= b[d[open_] - middle[open_] - 1]
        low = np.where(open_ & first, middle + 1, low)
        high = np.where(open_ & ~first, middle, high)
    return low, d - low


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The places after which ``a`` and ``b``, both ascending, have the same value: numbers of a's and of b's taken by then.

    All pieces of the merge path take their steps together.
    """
    at_a, at_b = diagonals(a, b, piece)
    i, j, stop = at_a[:-1].copy(), at_b[:-1].copy(), at_a[1:] + at_b[1:]
    far = np.append(a, np.iinfo(np.int64).max), np.append(b, np.iinfo(np.int64).max)
    before = np.append(np.iinfo(np.int64).min, a)  # before[i] is the value of a that came last, in the piece or before it
    found_a, found_b, of = [], [], []
    who = np.arange(len(i))
    while len(who := who[i[who] + j[who] < stop[who]]):
        x, y = i[who], j[who]
        from_a = far[0][x] <= far[1][y]
        same = ~from_a & (before[x] == far[1][y])
        found_a.append(x[same])
        found_b.append(y[same] + 1)
        of.append(who[same])
        i[who] += from_a
        j[who] += ~from_a
    if not found_a:
        return i[:0], j[:0]
    # Pieces one after the other, each with its own ends in the order of its steps.
    order = np.argsort(np.concatenate(of), kind="stable")
    return np.concatenate(found_a)[order], np.concatenate(found_b)[order]


def _group_texts(ids_a, ids_b, cut_a, cut_b, labels_a, labels_b) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;...`` of all groups as bytes, each group's end being a semicolon; and where each group's text ends."""
    group_a, group_b = np.diff(np.append(0, cut_a)), np.diff(np.append(0, cut_b))
    size_a, size_b = labels_a.digits_size[ids_a], labels_b.digits_size[ids_b]
    ends_a, ends_b = np.append(0, np.cumsum(size_a)), np.append(0, np.cumsum(size_b))
    wide_a, wide_b = np.diff(np.append(0, ends_a[cut_a])), np.diff(np.append(0, ends_b[cut_b]))
    ends = np.cumsum(wide_a + wide_b)
    starts = ends - wide_a - wide_b
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for ids, groups, sizes, upto, cut, begin, labels in (
            (ids_a, group_a, size_a, ends_a, cut_a, starts, labels_a), (ids_b, group_b, size_b, ends_b, cut_b, starts + wide_a, labels_b)):
        first = np.append(0, upto[cut])[:-1]
        place = np.repeat(begin - first, groups) + upto[:-1]  # of each token
        at = np.repeat(place - upto[:-1], sizes) + np.arange(int(upto[-1]))
        out[at] = _gather(labels.digits, labels.digits_at[ids], sizes)
    out[starts + wide_a - 1] = ord("|")
    out[ends - 1] = ord(";")
    return out, ends


def _pairs(ids_a, ids_b, cut_a, cut_b, of_group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, pair, links) of the distinct linked pairs of each stretch, in that order.

    Ids that repeat within a group are put together first, so a long group of few ids gives few pairs.
    """
    def distinct(ids, cut):
        group = np.repeat(np.arange(len(cut)), np.diff(np.append(0, cut)))
        key, times = np.unique(group << 32 | ids.astype(np.int64), return_counts=True)
        group, ids = key >> 32, key & 0xFFFFFFFF
        return ids, times, np.searchsorted(group, np.arange(len(cut) + 1))

    one, one_times, one_at = distinct(ids_a, cut_a)
    two, two_times, two_at = distinct(ids_b, cut_b)
    many = np.diff(two_at)[np.repeat(np.arange(len(cut_a)), np.diff(one_at))]  # partners of each distinct a
    left = np.repeat(np.arange(len(one)), many)
    group = np.repeat(np.repeat(np.arange(len(cut_a)), np.diff(one_at)), many)
    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + two_at[group]
    pair = one[left] << 32 | two[right]
    links = one_times[left] * two_times[right]
    return _distinct_pairs(of_group[group], pair, links)


def _distinct_pairs(owner, pair, links, already: bool = False):
    """(owner, pair, links) in order, links of the same owner and pair added up."""
    if already or not len(owner):
        return owner, pair, links
    order = np.lexsort((pair, owner))
    owner, pair, links = owner[order], pair[order], links[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])))
    return owner[first], pair[first], np.add.reduceat(links, first)


def _align_slice(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, path_a: str, path_b: str):
    """Per stretch of text: whether its bytes come back, n_a, n_b, n_groups, n_links, its groups as bytes; and the
    distinct pairs with their links and the number of pairs of each stretch.

    Stretches that are ``first`` in their text get the space; the others begin with one.
    """
    (words_a, labels_a), (words_b, labels_b) = byte_level(path_a), pieces(path_b)
    n = len(offsets) - 1
    data, offsets = _with_space(data, offsets, first)
    ids_a, count_a = tokenize(data, offsets, words_a, ())
    ids_b, count_b = _b_tokens(data, offsets, words_b)
    good = np.ones(n, bool)
    for ids, count, labels in ((ids_a, count_a, labels_a), (ids_b, count_b, labels_b)):
        size = np.append(0, np.cumsum(labels.size[ids]))[np.append(0, np.cumsum(count))]
        back = labels.joined(ids)
        same = np.diff(size) == np.diff(offsets)
        if not (same.all() and np.array_equal(back, data)):
            for k in np.flatnonzero(same):
                same[k] = np.array_equal(back[size[k]: size[k + 1]], data[offsets[k]: offsets[k + 1]])
            good &= same
    ids_a, ids_b = ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)]
    count_a, count_b = np.where(good, count_a, 0), np.where(good, count_b, 0)
    cut_a, cut_b = common_ends(np.cumsum(labels_a.size[ids_a]), np.cumsum(labels_b.size[ids_b]))
    of_group = np.searchsorted(np.cumsum(count_a), cut_a, "left")
    n_groups = np.bincount(of_group, minlength=n)
    upto = np.append(0, np.cumsum(n_groups))
    links = np.diff(np.append(0, cut_a)) * np.diff(np.append(0, cut_b))
    n_links = np.diff(np.append(0, np.cumsum(links))[upto])
    text, ends = _group_texts(ids_a, ids_b, cut_a, cut_b, labels_a, labels_b)
    edge, raw = np.append(0, ends)[upto].tolist(), text.tobytes()
    texts = [raw[a:b] for a, b in zip(edge[:-1], edge[1:])]
    of_pair, pair, times = _pairs(ids_a, ids_b, cut_a, cut_b, of_group)
    return good, count_a, count_b, n_groups, n_links, texts, np.bincount(of_pair, minlength=n), pair, times


def _stretches(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the stretches of all texts, and the number of each stretch's text.

    Both tokenizers begin anew at a space that follows another character, so a long text is divided there.
    """
    cuts = []
    for k in np.flatnonzero(np.diff(offsets) > 2 * size):
        own = data[offsets[k]: offsets[k + 1]]
        places = np.flatnonzero((own[1:] == 32) & (own[:-1] != 32)) + 1
        at = np.searchsorted(places, np.arange(size, len(own), size))
        cuts.append(np.unique(places[at[at < len(places)]]) + offsets[k])
    if not cuts:
        return offsets, np.arange(len(offsets) - 1)
    cuts = np.concatenate(cuts)
    place = np.searchsorted(offsets, cuts, "right")
    return np.insert(offsets, place, cuts), np.insert(np.arange(len(offsets) - 1), place - 1, place - 1)


def _align(batches, path_a, path_b, size):
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        n = batch.num_rows
        offsets, owner = _stretches(data, offsets, size)
        first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
        found = [_align_slice(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], first[i:j], path_a, path_b)
                 for i, j in ranges_of(offsets, size)]
        if not found:
            continue
        good, n_a, n_b, n_groups, n_links, texts, n_pairs, pair, times = (
            sum(x, []) if isinstance(x[0], list) else np.concatenate(x) for x in zip(*found))
        begin = np.flatnonzero(first)
        bad = np.zeros(n, bool)
        bad[owner[~good]] = True
        counts = [np.where(bad, 0, np.add.reduceat(x, begin)) for x in (n_a, n_b, n_groups, n_links)]
        shas = []
        for k, (i, j) in enumerate(zip(begin.tolist(), [*begin[1:].tolist(), len(owner)])):
            whole = hashlib.sha256()
            for text in texts[i: j - 1]:
                whole.update(text)
            whole.update(texts[j - 1][:-1])  # without the last semicolon
            shas.append("" if bad[k] or not counts[0][k] else whole.hexdigest())
        row = np.repeat(owner, n_pairs)
        ok = ~bad[row]
        row, pair, times = _distinct_pairs(row[ok], pair[ok], times[ok], len(owner) == n)
        cuts = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=n))), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in counts), pa.array(shas, pa.string()),
             *(pa.ListArray.from_arrays(cuts, pa.array(x, pa.int64())) for x in (pair, times))],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])


def align(docs: DataFrame, path_a: str, path_b: str, size: int = SLICE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links): the tokens of each text, aligned.

    A is the byte-level BPE at ``path_a``, which gets each text with a space in front; B is the sentencepiece model at
    ``path_b``, which puts that space there itself.  ``pairs`` has the distinct linked pairs of ids, A's in the upper and B's in
    the lower 32 bits, and ``links`` how often each is linked.  ``groups_sha256`` hashes the groups, written as
    ``a1,a2|b1;a3|b2,b3``.  Null and empty texts, and those whose bytes either tokenizer doesn't give back, have no
    tokens: zeros and an empty string.  One row per row of ``docs``, repeated ones and null doc_ids included.
    ``size`` bytes are worked on at once; a text of more than twice as many is divided before spaces.
    """
    prepare(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(
        lambda b: _align(b, path_a, path_b, size),
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): the documents that link each pair, and whether no pair with the same a has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    # An id of A has at most as many partners as B has ids.
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("docs") == most)


def _look_up(batches, pair, docs, best):
    """Sums over the pairs that are looked up in place; the others go on."""
    for batch in batches:
        pairs, links = batch.column("pairs"), batch.column("links")
        offsets = np.asarray(pairs.offsets).astype(np.int64)
        low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        own, times = np.asarray(pairs.values)[low:high], np.asarray(links.values)[low:high]
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        at = np.searchsorted(pair, own)
        hit = pair[at] == own
        sums = []
        for value in (best, docs):
            upto = np.append(0, np.cumsum(np.where(hit, times * value[at], 0)))
            sums.append(pa.array(np.diff(upto[offsets - low]), pa.int64()))
        cuts = pa.array(np.append(0, np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))), pa.int32())
        rest = [pa.ListArray.from_arrays(cuts, pa.array(x[~hit], pa.int64())) for x in (own, times)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *sums, *rest], names=["row", "n_best", "count_sum", "pairs", "links"])


def linked_counts(aligned: DataFrame, busy: int = BUSY) -> DataFrame:
    """``aligned`` without its lists, with ``n_best`` and ``count_sum``.

    A pair's count is the number of documents of the corpus that link it; ``n_best`` counts the links whose pair has the
    highest count of its id of A (ties included), ``count_sum`` adds up the counts of all links.  ``busy`` pairs at
    most are looked up in every task; what doesn't fit there is joined by pair, so the result is the same for any.
    """
    spark = aligned.sparkSession
    rows = stage(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stage(pair_counts(rows), "pairs")
    few = counts.orderBy(F.desc("docs"), "pair").limit(busy).toArrow().sort_by("pair")
    full = len(few) >= busy
    # One pair more, which no document has, so that the table is never empty.
    held = spark.sparkContext.broadcast(tuple(
        np.append(np.asarray(few[c]).astype(np.int64), end) for c, end in (("pair", np.iinfo(np.int64).max), ("docs", 0), ("best", 0))))
    schema = "row long, n_best long, count_sum long, pairs array<long>, links array<long>"
    looked_up = rows.select("row", "pairs", "links").mapInArrow(lambda b: _look_up(b, *held.value), schema)
    sums = [looked_up.select("row", "n_best", "count_sum")]
    if full:
        looked_up = stage(looked_up, "looked_up")
        rest = looked_up.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", "p.pairs", "p.links")
        rest = rest.join(counts, rest["pairs"] == counts["pair"]).groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("docs")).alias("count_sum"))
        sums = [looked_up.select("row", "n_best", "count_sum"), rest]
    total = functools.reduce(DataFrame.union, sums).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "links").join(total, "row").drop("row")
