"""Alignment of tokens, mixing of sources and hard negatives next to plain re-implementations."""

import bisect
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill.llm import hard_negatives as N, mixing as M, token_alignment as A
from motifmill.llm.queries import vocabulary
from .conftest_llm import EDGES, words
from .test_single import odd_texts


def piece_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# ---- alignment --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def whole_texts():
    """Tokens of whole texts by the libraries: ids and bytes of A and B."""
    import sentencepiece
    from tokenizers import Tokenizer

    from motifmill.llm.bpe_automaton import byte_letters

    letters = byte_letters()
    a = Tokenizer.from_file(vocabulary())
    a.encode_special_tokens = True
    names = {i: t for t, i in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=piece_model())

    def of(text):
        one, two = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return (one, [bytes(letters[c] for c in names[i]) for i in one],
                two, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in two])
    return of


def aligned_plainly(rows, of):
    """Every row's result by sets of ends, all occurrence pairs and a count of documents."""
    found, docs = [], collections.Counter()
    for i, text in rows:
        one = of(text) if text else ([], [], [], [])
        whole = (" " + text).encode() if text else b""
        if b"".join(one[1]) != whole or b"".join(one[3]) != whole:
            one = ([], [], [], [])
        ids_a, raw_a, ids_b, raw_b = one
        ends_a, ends_b = ([*itertools.accumulate(map(len, raw))] for raw in (raw_a, raw_b))
        i_a = i_b = 0
        groups, links = [], collections.Counter()
        for end in sorted(set(ends_a) & set(ends_b)):
            j_a, j_b = bisect.bisect_right(ends_a, end), bisect.bisect_right(ends_b, end)
            groups.append((ids_a[i_a:j_a], ids_b[i_b:j_b]))
            links.update(itertools.product(*groups[-1]))
            i_a, i_b = j_a, j_b
        docs.update(links.keys())
        text = ";".join("|".join(",".join(map(str, g)) for g in pair) for pair in groups)
        found.append((i, len(ids_a), len(ids_b), len(groups), sum(links.values()), hashlib.sha256(text.encode()).hexdigest() if groups else "", links))
    most = collections.Counter()
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return sorted(((*r[:6], sum(n for p, n in r[6].items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in r[6].items()))
                   for r in found), key=str)


def aligned(docs, size=A.SLICE, busy=A.BUSY):
    rows = A.linked_counts(A.align(docs, vocabulary(), piece_model(), size), busy).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("size, busy", [(A.SLICE, A.BUSY), (300, 40), (7, 1)])
def test_alignment_next_to_all_pairs(spark, docs_of, whole_texts, size, busy):
    rng = random.Random(3)
    texts = [words(rng, rng.choice([1, 5, 40, 120])) for _ in range(40)] + odd_texts()[:150]
    rows = list(enumerate(texts)) + EDGES[:-1] + [
        (900, "x ▁y"), (901, "a "), (902, " "), (903, "  a  b "), (904, "<s> </s> <unk> <0x41><|endoftext|>"), (905, "Ａ ﬁ é 日本語 กขค"),
        (906, "tick " * 900), (907, "x" * 5000)]
    assert aligned(docs_of(rows), size, busy) == aligned_plainly(rows, whole_texts)


def test_alignment_of_nothing(spark, docs_of):
    assert aligned(docs_of([(1, "a")]).limit(0)) == []
    assert aligned(docs_of([(1, None), (None, "")])) == [(1, 0, 0, 0, 0, "", 0, 0), (None, 0, 0, 0, 0, "", 0, 0)]


@pytest.mark.parametrize("piece", [1, 2, 7, 64, 10**6])
def test_pieces_of_a_merge_path(piece):
    rng = np.random.default_rng(piece)
    for n, m in [(0, 0), (1, 1), (1, 30), (200, 170), (5, 400)]:
        a = np.sort(rng.choice(500, n, replace=False))
        b = np.sort(rng.choice(500, m, replace=False))
        at_a, at_b = A.diagonals(a, b, piece)
        order = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        for i, j in zip(at_a.tolist(), at_b.tolist()):  # every crossing takes what a plain merge has taken by then
            assert i == sum(1 for _, side in order[: i + j] if side == 0)
        assert (np.diff(at_a + at_b)[:-1] == piece).all()
        got_a, got_b = A.common_ends(a, b, piece)
        both = np.intersect1d(a, b)
        assert (got_a == np.searchsorted(a, both) + 1).all() and (got_b == np.searchsorted(b, both) + 1).all()


# ---- mixing -----------------------------------------------------------------------------

def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_plainly(words, weights, share, most):
    order = sorted((s for s in words if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in words if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, free, goal = {}, set(words), share * sum(words.values())
    while free:
        each = goal / sum(weight[s] for s in free)
        full = [s for s in free if each * weight[s] >= most * words[s]]
        if not full:
            return out | {s: each * weight[s] for s in free}
        for s in full:
            out[s] = most * words[s]
            goal -= out[s]
            free.remove(s)
    return out


def mixed(docs, **limits):
    return sorted(map(tuple, M.mix(docs, **limits).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


def sourced(docs_of, rows):
    docs = docs_of([(i, t) for i, t, _ in rows])
    source = F.create_map(*(x for i, _, s in rows if s is not None and i is not None for x in (F.lit(i), F.lit(s))))
    return docs.withColumn("source", F.element_at(source, F.coalesce("doc_id", F.lit(-1))))


def test_mix_of_sources(spark, docs_of):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 1, 2, 3, 9, 40]))), rng.choice(["b", "b", "b", "ä", "a", "", None, "𐐷", "Z"]))
            for i in range(600)]
    rows += [(1000, None, "a"), (1001, "one word \x0b two", "only"), (1002, "", "empty"), (1003, None, "empty")]
    docs = sourced(docs_of, rows)
    words = collections.Counter()
    for _, text, source in rows:
        words[source] += size_of(text)
    goals = targets_plainly(words, (5, 2, 1), 1.5, 2.0)
    found = mixed(docs)
    source = {i: s for i, _, s in rows}
    assert {r[0]: r[1] for r in found} == {i: size_of(t) for i, t, _ in rows} and len(found) == len(rows)
    taken = collections.Counter()
    for i, size, whole, target, took in found:
        assert whole == words[source[i]] and target == pytest.approx(goals[source[i]])
        assert took <= 2 * size and (size == 0 or took % size == 0)
        taken[source[i]] += took
    for s in words:  # documents of one word are there, so that every sum is
        assert abs(taken[s] - goals[s]) <= 0.5 + 1e-6
    # The same mix again, however the rows lie and are dealt; another one by another seed.
    assert mixed(docs.repartition(7), bucket_rows=4) == found
    assert mixed(docs, seed=1) != found


def test_mix_draws_from_large_buckets(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    docs = docs.union(spark.range(900).select(F.lit(None).cast("long"), F.lit("a b c"), F.lit("s")))
    docs = docs.union(spark.range(300).select(F.lit(7).cast("long"), F.lit("a b c"), F.lit("s")))
    found = M.mix(docs, weights=(1,), share=0.5, bucket_rows=64).collect()
    assert len(found) == 6200 and abs(sum(r.taken for r in found) - 9300) <= 3
    assert {r.taken for r in found} == {0, 3}


def test_mix_of_nothing(spark, docs_of):
    empty = docs_of([(1, "a")])
    assert mixed(empty.limit(0)) == []
    assert mixed(empty.withColumn("text", F.lit(None).cast("string"))) == [(1, 0, 0, 0.0, 0)]
    assert [r[1:3] for r in mixed(docs_of(EDGES[-1:]))] == [(80000, 80000)]


@pytest.mark.parametrize("seed", range(6))
def test_knapsack_next_to_all_subsets(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(1, 60), 5)
    counts = [rng.randint(0, 4) for _ in lengths]
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + k * n for s in sums for k in range(c + 1)}
    for budget in range(0, max(sums) + 20):
        took = M.fit(lengths, counts, budget, seed=seed)
        assert (took <= counts).all() and (took >= 0).all()
        assert abs(int(took @ np.array(lengths)) - budget) == min(abs(s - budget) for s in sums)


def test_fit_of_more_than_the_window():
    rng = random.Random(1)
    lengths = sorted({rng.randint(1, 5000) for _ in range(800)})
    counts = [rng.randint(1, 3000) for _ in lengths]
    whole = sum(n * c for n, c in zip(lengths, counts))
    for part in (0.1, 0.5, 0.97):
        took = M.fit(lengths, counts, round(whole * part), window=1 << 12)
        assert int(took @ np.array(lengths)) == round(whole * part)
        # The mix looks like the source.
        assert np.abs(took - part * np.array(counts)).max() < 60


# ---- hard negatives ---------------------------------------------------------------------

@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 0, 3), (3, 7, 2), (65, 33, 97), (130, 64, 71), (0, 4, 4)])
@pytest.mark.parametrize("most", [5, 1 << 28])
def test_strassen(shape, most):
    rng = np.random.default_rng(4)
    m, k, n = shape
    a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
    exact = (a.astype(object) @ b.astype(object)) if k else np.zeros((m, n), object)
    assert (N.strassen(a, b, leaf=4) == exact).all() and (N.strassen(a, b) == exact).all()


def mined_plainly(rows, is_anchor):
    """All pairs of rows, with Python's numbers."""
    whole = []
    for k, (i, label, v) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole.append((k, i, label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for k, i, label, v in whole:
        if not is_anchor(i):
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, other, w in whole if m != k)
        for s, j, _, _ in [o for o in others if o[3] == label][:5]:
            hard = [o for o in others if o[3] != label and 80 * -s <= 100 * -o[0] <= 100 * -s][:5]
            out += [(i, j, rank + 1, o[1], -s, -o[0]) for rank, o in enumerate(hard)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, row string, score string, chunk string, rank string"


def mined(spark, rows, is_anchor, parts=3, **limits):
    full = spark.createDataFrame([(*r, "r", "s", "c", "k") for r in rows], VECTORS).repartition(parts)
    found = N.mine(full, is_anchor, **limits)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def vectors(seed, n, wide=9):
    """Rows around few centres, so that many scores are close; a third has one label; ties and repeated vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, wide))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + 0.2 * rng.normal(size=wide)
        rows.append((i, 0 if i % 3 == 0 else int(rng.integers(5)), [float(np.float32(round(x, 1))) for x in v]))
    return rows


@pytest.mark.parametrize("chunk_rows", [N.CHUNK, 4])
def test_hard_negatives_next_to_all_pairs(spark, chunk_rows):
    rows = vectors(1, 400)
    rows += [(20, 1, rows[20][2]), (20, 1, rows[20][2]), (500, None, rows[3][2]), (None, 2, rows[3][2]), (520, 1, None), (540, 1, []),
             (560, 1, [float("nan")] * 9), (580, 1, [float("inf")] * 9), (600, 1, [None] * 9), (620, 2, [0.5] * 4), (640, 3, [0.5] * 14),
             (660, 77, [0.1] * 9), (680, 2, [-0.5] * 9), (700, -4, [0.2] * 9), (720, 2, [0.0] * 9)]
    found = mined(spark, rows, F.col("vec_id") % 20 == 0, chunk_rows=chunk_rows)
    assert found == mined_plainly(rows, lambda i: i % 20 == 0) and len(found) > 100


def test_hard_negatives_of_nothing(spark):
    assert mined(spark, [(1, 0, [1.0])], F.col("vec_id") % 2 == 0) == []
    assert mined(spark, [(0, 0, [1.0]), (1, 1, [1.0])], F.col("vec_id") == 0) == []
    assert mined(spark, [(0, 0, [1.0]), (1, 0, [1.0]), (2, 1, [1.0])], F.col("vec_id") == 0) == [(0, 1, 1, 2, 65536, 65536)]
    assert mined(spark, [(0, None, None)], F.col("vec_id") == 0) == []


def test_heaps_of_parts_merge(spark):
    rows = vectors(2, 300)
    assert mined(spark, rows, F.col("vec_id") % 50 == 0, parts=1) == mined(spark, rows, F.col("vec_id") % 50 == 0, parts=9)
