"""Similarity join, repeated strings, benchmark search: next to brute force."""

import hashlib
import random
import re
import tracemalloc

import pytest
from .conftest_llm import EDGES, words

from motifmill.llm import decontaminate as D, fingerprints as P, graph, ngram_join as N, suffix_dedup as S


def fold(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def grams(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", fold(text))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(rows, width, percent):
    sets, top = {i: grams(t, width) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("short", [256, 3])
@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (2, 50)])
def test_near_duplicates(spark, docs_of, corpus, monkeypatch, short, width, percent):
    monkeypatch.setattr(N, "SHORT", short)  # long lists are paired block by block
    monkeypatch.setattr(N, "BLOCK", 8 if short == 3 else N.BLOCK)
    monkeypatch.setattr(N, "LEADERS", 1)
    found = N.near_duplicates(docs_of(corpus), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(corpus, width, percent)
    assert len(found) == len(corpus)


def test_keep_one(spark, docs_of, corpus):
    docs = docs_of(corpus)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in components(corpus, 5, 80).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == want


def test_parity_never_exceeds_difference():
    import numpy as np
    rng = np.random.default_rng(1)
    for n, m in ((10, 12), (100, 90), (900, 1000), (33, 60)):
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 62, m - n // 2).astype(np.uint64)]))
        low = N._differ([N._parity(x), N._parity(y), N._parity(x)], [N._parity(y), N._parity(x), N._parity(x)])
        assert low[0] == low[1] <= len(set(x.tolist()) ^ set(y.tolist())) and low[2] == 0


def test_overlaps_of_a_block():
    """The cells asked for, next to sets; empty texts and texts that are asked for often among them."""
    import pandas as pd
    rng = random.Random(8)
    base = words(rng, 40).split()
    texts = ["", "a"] + [" ".join(w if rng.random() > 0.03 else "x" for w in base[: rng.randint(20, 40)]) for _ in range(40)]
    frame = pd.DataFrame({"rep": [10 * k for k in range(len(texts))], "text": texts})
    pairs = pd.DataFrame([(10 * i, 10 * j) for i in range(len(texts)) for j in range(i)], columns=["a", "b"])
    sets = {10 * k: grams(t, 3) for k, t in enumerate(texts)}
    want = {(a, b) for a, b in pairs.itertuples(index=False) if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])}
    found = N._overlaps((0,), frame, pairs, 3, 60)
    assert set(found.itertuples(index=False, name=None)) == want and len(want) > 50
    assert N._overlaps((0,), frame, pairs.iloc[:0], 3, 60).empty


@pytest.mark.parametrize("percent, sizes", [(80, (32, 33)), (80, (33, 32)), (80, (30, 36)), (40, (32, 70)), (40, (70, 32))])
def test_block_pairs_across_widths(percent, sizes):
    """A row of a list's lower part and only rows with wider, or narrower, parities in the higher one."""
    import numpy as np
    import pandas as pd
    every = np.unique(np.random.default_rng(3).integers(0, 1 << 62, 80).astype(np.uint64))
    rows = [(0, every[: sizes[0]], 0), *((k, np.roll(every, -(k // 2))[: sizes[1]], 1) for k in (1, 2, 3))]
    frame = pd.DataFrame([(rep, len(g), rep, N._parity(g), side) for rep, g, side in rows],
                         columns=["rep", "n", "component", "parity", "side"])
    linked = {(0, rep) for rep, g, side in rows if side
              and 100 * len(set(g) & set(rows[0][1])) >= percent * len(set(g) | set(rows[0][1]))}
    found = N._block_pairs(frame, percent)
    assert linked and linked <= set(zip(found["a"].tolist(), found["b"].tolist()))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + k, 401 + k) for k in range(60)] + [(5, 5)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x
    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in top}
    assert len(got) == len(top)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats(rows, length):
    """Covered bytes by document, and what is left."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if (w := raw[p:p + length]) in seen:
                mark[p:p + length] = b"\1" * length
            seen.add(w)
        runs = len(re.findall(rb"\x01+", bytes(mark)))
        kept = bytes(c for c, m in zip(raw, mark) if not m)
        out[i] = len(raw), sum(mark), runs, hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("length, trigger, group", [(20, 8, 4096), (24, 6, 2), (100, 32, 4096)])
def test_remove_repeats(spark, docs_of, corpus, length, trigger, group):
    rows = corpus + [(1000, "ab" * 300), (1001, "x" + "ab" * 90 + "\x00" * 60), (1002, "\x00" * 90)]
    found = S.remove_repeats(docs_of(rows), length, trigger, as_text=False, group=group).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in found} == repeats(rows, length)


def test_busy_triggers_are_split(spark, docs_of):
    """One passage in many contexts: its trigger's phrases take several ways, and a trigger's ways are sorted apart."""
    rng = random.Random(6)
    line = words(rng, 30)
    rows = [(i, f"{words(rng, 6)} {line} {words(rng, 6)}") for i in range(140)]
    ways = []
    settle = S._settle
    try:
        S._settle = lambda frame, group: ways.append(settle(frame, group)["ways"].max()) or settle(frame, group)
        import pyarrow as pa
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["key", "text"])
        parts = pa.Table.from_batches(S._parse_batches(iter([batch]), 40, 8, 2)).to_pandas()
        for _, frame in parts.groupby("part"):
            S._settle(frame, 16)
    finally:
        S._settle = settle
    assert max(ways) > 1
    found = S.remove_repeats(docs_of(rows), 40, 8, as_text=False, group=16).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in found} == repeats(rows, 40)


def test_long_text_in_slices(spark, docs_of, monkeypatch):
    from motifmill.llm import text as X
    rng = random.Random(4)
    long = words(rng, 400)
    rows = [(1, long), (2, words(rng, 30) + long[300:900]), (3, long * 2)]
    monkeypatch.setattr(S, "STEP", 128)
    import numpy as np
    data, offsets = X.texts_of(__import__("pyarrow").array([t for _, t in rows]))
    row, first, last, _, _ = S._cut(data, offsets, 30, 8)
    per = {i: np.concatenate([np.arange(a, b + 1) for r, a, b in zip(row, first, last) if r == i]) for i in range(3)}
    for i, (_, t) in enumerate(rows):
        assert sorted(per[i]) == list(range(len(t.encode()) - 29))


def test_without_repeats_keeps_whole_characters(spark, docs_of):
    text = "äöü" * 60
    docs = docs_of([(1, "x" + text), (2, "éa" + text + "b"), (3, None)])
    out = S.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[3] == (None, None)
    assert got[2][0].startswith("éa") and got[2][0].endswith("b") and len(got[2][0]) < 10
    assert all(t is None or n == len(t) for t, n in got.values())


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        p = rng.randrange(len(out))
        out[p:p + 1] = rng.choice([[], [rng.choice("abc")], [out[p], rng.choice("abc")]])
    return "".join(out)


def distance(item, region):
    row = [0] * (len(region) + 1)
    for c in item:
        new = [row[0] + 1]
        for j, d in enumerate(region):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != d)))
        row = new
    return min(row)


def plain(text):
    return re.sub(r"[^0-9a-z\x80-\U0010FFFF]+", " ", text.lower()).strip()


def test_find_items(spark, docs_of):
    rng = random.Random(9)
    items = [(k, words(rng, rng.randint(14, 30))) for k in range(12)] + [(50, None), (51, ""), (52, "short")]
    docs, planted = [], {}
    for k in range(36):
        t = items[k % 12][1]
        hidden = [t, edited(rng, t, len(t) // 40), t.upper().replace(" ", "!! ")][k // 12]
        docs.append((k, words(rng, 40) + " " + hidden + " " + words(rng, 20)))
    docs += [(100 + k, words(rng, 120)) for k in range(10)] + [(200, ""), (201, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_items(docs_of(docs), bench).collect()
    want = {}
    for i, t in docs:
        for j, x in items[:12]:
            if t and (d := distance(plain(x), plain(t))) <= len(plain(x)) // 10:
                want[i, j] = d
    got = {(r.doc_id, r.item_id): r.distance for r in found}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) == 0 for k in want)
    clean = D.drop_contaminated(docs_of(docs), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert D.drop_contaminated(docs_of(docs), bench.limit(0)).count() == len(docs)


def searched(items, docs):
    """(row, item) of the items that are found, by the batch search alone."""
    import pyarrow as pa
    held = D.Items(list(range(len(items))), pa.array(items, pa.string()), 0.1)
    batch = pa.RecordBatch.from_arrays([pa.array(docs, pa.string())], names=["text"])
    return {(r, t): d for r, t, d, _ in D._found(batch, held)}


@pytest.mark.parametrize("share", [0.05, 0.08, 0.1])
def test_edited_short_items_are_all_found(share):
    rng = random.Random(12)
    one_byte = str.maketrans("éñ", "en")
    items = [words(rng, 60).translate(one_byte)[: rng.randint(50, 120)].strip() for _ in range(60)]
    docs = []
    for x in items:  # anywhere
        docs.append(words(rng, 30) + " " + edited(rng, x, int(share * len(x))) + " " + words(rng, 30))
    for x in items:  # evenly spread
        raw, n = list(x), int(share * len(x))
        for k in range(n):
            raw[(2 * k + 1) * len(raw) // (2 * n)] = "q"
        docs.append(words(rng, 9) + " " + "".join(raw) + " " + words(rng, 9))
    found = searched(items, docs)
    assert {(r, r % 60) for r in range(len(docs))} <= set(found)


def test_items_in_text_without_spaces():
    item = "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少"
    docs = ["他说道" + item + "然后走了", "全文：" + item + "。完", "天地玄黄宇宙洪荒日月盈昃", "前面的话　" + item[:9] + "闻" + item[10:] + "，"]
    found = searched([item], docs)
    assert set(found) == {(0, 0), (1, 0), (3, 0)} and found[0, 0] == found[1, 0] == 0


def test_items_of_few_characters_as_whole_words():
    docs = ["we say short, often", "shorter", "a Short", "ashort cut", "one two", "done two", "一「短い」二"]
    assert set(searched(["short", "one two", "短い"], docs)) == {(0, 0), (2, 0), (4, 1), (6, 2)}


def test_plain_words_in_pieces(monkeypatch):
    import pyarrow as pa
    rng = random.Random(21)
    texts = ["", None, "Ab", "c.", *("".join(rng.choice("aB7 .éÀ　。春😀-") for _ in range(rng.randint(0, 40))) for _ in range(60)), None, ""]
    whole, at = D.plain(pa.array(texts, pa.string()))
    assert [whole[a:b].tobytes().decode().strip() for a, b in zip(at[:-1], at[1:])] == [
        re.sub(r"[^0-9a-zéà春]+", " ", (t or "").lower()).strip() for t in texts]
    for step in (1, 2, 5, 64):
        monkeypatch.setattr(D, "STEP", step)
        data, places = D.plain(pa.array(texts, pa.string()))
        assert data.tobytes() == whole.tobytes() and places.tolist() == at.tolist()


def test_plain_words_take_a_few_times_the_text():
    import pyarrow as pa
    column = pa.array(["Some words, of é and 春. " * 400] * 400, pa.string())
    tracemalloc.start()
    D.plain(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * column.nbytes


def test_distance_within():
    rng = random.Random(3)
    for _ in range(60):
        item = plain(words(rng, 8))
        region = words(rng, 3) + edited(rng, item, rng.randint(0, 6)) + words(rng, 3)
        most = rng.randint(0, 8)
        true = distance(item.encode(), region.encode())
        assert D.distance_within(item.encode(), region.encode(), most) == min(true, most + 1)


def test_odd_rows(spark, docs_of):
    docs = docs_of(EDGES)
    found = N.near_duplicates(docs, 4, 85).collect()
    assert len(found) == len(set(EDGES))
    assert all(r.component_id == r.doc_id for r in found if r.n_shingles == 0)
    left = S.remove_repeats(docs, as_text=True).collect()
    assert len(left) == len(set(EDGES))
    assert {r.doc_id: r.n_removed for r in left}[5] == 4999
    assert S.without_repeats(docs).count() == len(EDGES)
    assert N.keep_one(docs).count() >= len(set(EDGES)) - 2
    bench = docs.select("doc_id", "text").limit(0).withColumnRenamed("doc_id", "item_id")
    assert D.find_items(docs, bench).count() == 0
    empty = docs.limit(0)
    assert N.near_duplicates(empty).count() == S.remove_repeats(empty).count() == N.keep_one(empty).count() == 0
    assert S.without_repeats(empty).count() == D.drop_contaminated(empty, bench).count() == 0


# Fingerprints

def test_fingerprints(spark, docs_of, corpus):
    found = {r.doc_id: r for r in P.compare_edited(docs_of(corpus)).collect()}
    order = sorted(corpus, reverse=True)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[:len(text) - half] + after[:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        for other, near in ((new, r.near_edited), (after, r.near_next)):
            x, y = ({tuple(g) for g in P_sets(t)} for t in (text, other))
            assert near == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)  # exact while sketches are not full
    same = {}
    for i, t in corpus:
        same.setdefault(t or "", set()).add(found[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())


def P_sets(text, width=5):
    w = text.lower().split()
    return [w[i:i + width] for i in range(len(w) - width + 1)] if len(w) >= width else [w] if w else []


def test_sketches_merge(spark):
    from pyspark.sql import functions as F
    rng = random.Random(8)
    a, b = words(rng, 900), words(rng, 700)
    rows = spark.createDataFrame([(1, a), (1, b), (2, a), (3, a + " " + b)], "doc_id long, text string")
    sk = P.fingerprints(rows, k=64)
    groups = {r.doc_id: r.sketch for r in P.of_groups(sk, "doc_id", k=64).collect()}
    assert len(groups[1]) == 64 and groups[1] == sorted(groups[1])
    pair = spark.createDataFrame([(groups[1], groups[2], groups[3])], "m array<long>, a array<long>, u array<long>").select(
        P.distinct_count(F.col("a"), 64).alias("n"), P.containment(F.col("a"), F.col("m"), 64).alias("c"),
        P.resemblance(F.col("m"), F.col("u"), 64).alias("r")).first()
    true = len({tuple(g) for g in P_sets(a)})
    assert abs(pair.n - true) < 0.4 * true and pair.c > 0.8 and pair.r > 0.9


def test_odd_fingerprints(spark, docs_of):
    docs = docs_of(EDGES)
    assert P.compare_edited(docs).count() == len(set(EDGES))
    assert P.compare_edited(docs.limit(0)).count() == 0
    one = P.compare_edited(docs_of([(1, "one two three four")])).first()
    assert one.near_next == 1.0 and one.n_chars == 18
