"""Operators on single documents and pages."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from .conftest_llm import EDGES, words

from motifmill.llm import (
    bpe_automaton as B, html_template as H, language as L, license_scan as C, pretokens, quality as Q, token_files as T,
)
from motifmill.llm.queries import vocabulary
from motifmill.llm.text import texts_of

ODD = ["", "  ", "a  b", " \n\n x", "don't 'tis we'll 'sabc x's 'S I'M o''t ' t 'll'", "é  ü 　x", "<|endoftext|>",
       "a <|endoftext|>  <|endoftext|>b  ", "x\t\ty \r\n z", "ﬀ①½ٱ 一二三 😀😀!?..", "a" * 700, "'", "x'", "'re", "á 's", "it's​ok", "\x00\x01 \x00"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def odd_texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(" \n\t'stmdrevlaAé1½.!,<|> 😀中-_=") for _ in range(rng.randint(0, 60))) for _ in range(400)]


def test_bpe_next_to_the_library(spark, docs_of):
    rows = list(enumerate(odd_texts())) + [(5000, None), (None, "ab"), (5, "twice"), (5, "twice")]
    found = B.encode_decode(docs_of(rows), vocabulary()).collect()
    lib, left = library(), {}
    for i, t in rows:
        left.setdefault(i, []).append(t)
    assert len(found) == len(rows)
    for r in found:
        ids = list(r.ids)
        texts = [t or "" for t in left[r.doc_id]]
        assert ids in [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert r.decoded in texts and r.decoded == lib.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(ids)
    assert B.encode_decode(docs_of(rows).limit(0), vocabulary()).count() == 0


def brute_merges(word, merges):
    rank = {m: k for k, m in enumerate(merges)}
    parts = list(word)
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return parts
        pair = merges[best[0]]
        out, i = [], 0
        while i < len(parts):
            if tuple(parts[i:i + 2]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


@pytest.mark.parametrize("seed", range(4))
def test_automaton_next_to_merging(seed):
    rng = random.Random(seed)
    letters = {v: k for k, v in B.byte_letters().items()}
    tokens = [letters[b] for b in range(256)]
    merges, made = [], ["a", "b", "c"]
    while len(merges) < 14:
        pair = rng.choice(made), rng.choice(made)
        if pair not in merges and "".join(pair) not in tokens:
            merges.append(pair)
            made.append("".join(pair))
            tokens.append("".join(pair))
    vocab = {t: i for i, t in enumerate(tokens)}
    automaton = B.Automaton(vocab, merges, {})
    some = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(150)] + ["a" * 30, "b" * 7]
    got = automaton.encode_words([w.encode() for w in some])
    for w, ids in zip(some, got):
        assert [tokens[i] for i in ids] == brute_merges(w, merges), w
        assert automaton.encode_word(w.encode()) == ids.tolist()
        assert automaton.decode(ids).tobytes() == w.encode()


def thue_morse(n):
    """Two words of n letters that any polynomial modulo 2**64 takes for one, from 1,024 letters on."""
    ones = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in ones), "".join("ba"[x] for x in ones)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_take_for_one(spark, docs_of, tmp_path, n):
    from motifmill.llm import ngram_join as N, suffix_dedup as S
    from motifmill.llm.text import Rolling

    one, two = thue_morse(n)
    rows = [(1, one), (2, two), (3, f"{one} a b c d e f"), (4, f"{two} a b c d e f"), (5, f"x {one}")]
    data = np.frombuffer((one + two + one).encode(), np.uint8)
    hashes = Rolling(data).of(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert hashes[0] == hashes[2] != hashes[1]
    lib = library()
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: list(r.ids) for r in B.encode_decode(docs_of(rows, 1), vocabulary()).collect()} == ids
    T.write_tokens(docs_of(rows, 1), str(tmp_path / "tokens"), vocabulary(), 2, 50257)
    assert {r.doc_id: r.ids_crc32 for r in T.read_tokens(spark, str(tmp_path / "tokens")).collect()} == {
        i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in ids.items()}
    assert {r.doc_id: r.component_id for r in N.near_duplicates(docs_of(rows, 1), 1, 80).collect()} == {i: i for i, _ in rows}
    from .test_pairs import repeats
    found = S.remove_repeats(docs_of(rows, 1), as_text=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in found} == repeats(rows, 100)


def test_word_table_forgets(monkeypatch):
    table = pretokens.WordTable(lambda ws: [np.frombuffer(w, np.uint8).astype(np.uint32) for w in ws], limit=3)
    for text in (b"one two three four five", b"six one", b"two two"):
        data = np.frombuffer(text, np.uint8)
        starts = pretokens.split(data, np.array([0, len(data)]))
        ids, count = table.of(data, starts, np.append(starts[1:], len(data)))
        assert bytes(ids.astype(np.uint8)) == text and count.sum() == len(text)


def test_token_files(spark, docs_of, tmp_path):
    rows = [(k * 3 % 97, t) for k, t in enumerate(odd_texts()[:90])] + [(1000, None), (2000, "x " * 3000)]
    folder = f"{tmp_path}/corpus"
    T.write_tokens(docs_of(rows, 5), folder, vocabulary(), 2, 50257)
    found = T.read_tokens(spark, folder).orderBy("position").collect()
    lib, start = library(), 0
    for r, (i, t) in zip(found, sorted(rows, key=lambda x: x[0])):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(found) == len(rows)
    names = sorted(p.name for p in (tmp_path / "corpus").iterdir())
    assert sum(p.stat().st_size for p in (tmp_path / "corpus").glob("*.bin")) == 2 * start
    assert any(n.endswith(".idx") for n in names)


def test_token_files_of_odd_rows(spark, docs_of, tmp_path):
    T.write_tokens(docs_of(EDGES), f"{tmp_path}/a", vocabulary(), 2, 70000)
    found = T.read_tokens(spark, f"{tmp_path}/a").orderBy("position").collect()
    assert len(found) == len(EDGES) and [r.doc_id for r in found][:2] == [None, None]
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    T.write_tokens(docs_of(EDGES).limit(0), f"{tmp_path}/b", vocabulary(), 2, 50257)
    assert T.read_tokens(spark, f"{tmp_path}/b").count() == 0


# Quality

def junk(rng, text, kind):
    w = text.split()
    if kind == 0:
        return " ".join(x + rng.choice(["***", "###", "%%%"]) for x in w)
    if kind == 1:
        return " ".join(x.upper() + "!!" for x in w)
    if kind == 2:
        return " | ".join(w)
    return " ".join(x for y in w for x in [y] * 6)


def test_gradient_is_the_slope_of_the_loss():
    rng = random.Random(0)
    texts = [words(rng, 30).encode(), junk(rng, words(rng, 60), 3).encode(), b"", words(rng, 2).encode()]
    target = np.array([1, 0, 1, 0], np.float32)
    net = Q.Network(3)
    for name in net.names:
        setattr(net, name, getattr(net, name).astype(np.float64))
    _, grads = net.gradient(texts, target)
    for name, at in (("out", (3,)), ("base", (0,)), ("repeat", (2,)), ("shift", (1,)), ("filters", (2, 1, 4)), ("embed", (ord("e"), 2))):
        value = getattr(net, name)
        old, step = value[at], 1e-3
        loss = []
        for d in (step, -step):
            value[at] = old + d
            loss.append(net.gradient(texts, target)[0])
        value[at] = old
        assert grads[name][at] == pytest.approx((loss[0] - loss[1]) / (2 * step), rel=0.15, abs=2e-4), name


def test_quality(spark, docs_of):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(360):
        good = i % 3 > 0
        text = words(rng, rng.randint(12, 80))
        rows.append((i, text if good else words(rng, 10) + " " + junk(rng, text, i // 3 % 4)))
        labels.append((i, int(good)))
    docs, known = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int")
    from pyspark.sql import functions as F
    held = Q.remainder(F.col("doc_id"), 5) == 0
    net = Q.learn(docs, known, held_out=held)
    scored = Q.score(docs, net)
    assert set(scored.columns) == set(docs.columns)
    found = {r.doc_id: r.quality_score for r in scored.collect()}
    test = [i for i in found if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(found[i] >= 0.3) == (i % 3 > 0) for i in test]) > 0.9
    kept = Q.keep_good(docs, net)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in found if found[i] >= 0.3}
    odd = Q.score(docs_of(EDGES), net).collect()
    assert len(odd) == len(EDGES) and all(0 <= r.quality_score <= 1 for r in odd)
    assert Q.score(docs.limit(0), net).count() == 0
    nothing = Q.learn(docs, known.limit(0))
    assert {r.quality_score for r in Q.score(docs.limit(3), nothing).collect()} == {0.5}


def test_scores_do_not_depend_on_the_batch(monkeypatch):
    rng = random.Random(4)
    texts = [words(rng, n) for n in (3, 500, 1, 90)] + [""]
    net = Q.Network(1)
    together = net.scores(*texts_of(pa.array(texts)))
    assert together == pytest.approx([net.scores(*texts_of(pa.array([t])))[0] for t in texts], abs=1e-6)


# Language

def test_scores_of_long_texts_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(8)
    data = (words(rng, 400) + "ab" * 300 + words(rng, 100)).encode()
    data, offsets = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    network = Q.Network(3)
    whole = network.scores(data, offsets)
    top = Q.Network.halves
    laid, first, halves = Q._layout(data, offsets)
    want = network.features(top(network, laid)[0], first, halves)
    seen = []
    monkeypatch.setattr(Q, "STEP", 512)
    monkeypatch.setattr(Q.Network, "features", lambda self, *x: seen.append(FEATURES(self, *x)) or seen[-1])
    assert np.array_equal(network.scores(data, offsets), whole) and np.array_equal(seen[0], want)


FEATURES = Q.Network.features


def test_language(spark, docs_of):
    rng = random.Random(6)
    kinds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "er"], "cc": ["éau", "ion", "les", "que"]}
    rows = []
    for i in range(240):
        lang = "aa bb cc".split()[i % 3]
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(rng.randint(8, 40)))))
    from pyspark.sql import functions as F
    docs = docs_of(rows).withColumn("lang", F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.col("doc_id") % 3 + 1).cast("int")))
    held = Q.remainder(F.col("doc_id"), 4) == 2
    model = L.learn(docs, held)
    found = {r.doc_id: r for r in L.predict(docs, model).collect()}
    assert np.mean([found[i].lang_pred == "aa bb cc".split()[i % 3] for i in found if zlib.crc32(str(i).encode()) % 4 == 2]) > 0.97
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "Ж" * 40), (5, "k"), (None, "kalomi")] + EDGES
    loose = L.predict(docs_of(odd), model, reject=False).collect()
    assert len(loose) == len(odd)
    of = lambda i, text: {r.lang_pred for r, (j, t) in zip(sorted(loose, key=lambda r: str(r.doc_id)), sorted(odd, key=lambda x: str(x[0]))) if j == i and t == text}
    assert of(1, None) == of(2, "") == of(3, "123 !?") == {"und"}
    assert {r.lang_pred for r in loose} <= {"und", *kinds}
    strict = {r.doc_id: r for r in L.predict(docs_of([(4, "Ж" * 40), (6, rows[0][1])]), model).collect()}
    assert strict[4].lang_pred == "und" and strict[6].lang_pred == "aa"
    assert L.predict(docs.limit(0), model).count() == 0
    empty = L.learn(docs.limit(0))
    assert {r.lang_pred for r in L.predict(docs.limit(3), empty).collect()} == {"und"}


# Licences

def test_license_scan(spark, docs_of):
    rng = random.Random(7)
    notice = C.NOTICES[0][1]
    w = notice.split()
    changed = " ".join(w[:9] + ["really"] + w[9:20] + w[22:])
    rows = [(1, "The MIT-License, and the mit license; apache\nlicense"), (2, "GNU general public license v3"), (3, words(rng, 50)),
            (4, words(rng, 20) + " " + notice + " " + words(rng, 5)), (5, changed), (6, " ".join(w[:8])), (7, "mit licenses"), (8, None),
            (9, "Licensed under the Apache License, Version 2.0."), (10, "")] + [(20 + k, t) for k, t in enumerate(ODD)]
    found = {r.doc_id: r for r in C.summary(docs_of(rows)).collect()}
    assert len(found) == len(rows)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    for i, t in rows:
        ws = re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(j, l) for p, l in C.PHRASES.items() for j in range(len(ws)) if ws[j:j + len(p.split())] == p.split()]
        r = found[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(ws), len(places), ",".join(sorted({l for _, l in places}))), i
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert found[4].labels == found[5].labels == "mit" and found[4].score == 1.0 and 0.6 <= found[5].score < 1
    assert found[6].labels == found[3].labels == "" and found[9].labels == "apache"
    assert C.summary(docs_of(EDGES)).count() == len(set(EDGES))
    assert C.summary(docs_of(EDGES).limit(0)).count() == 0


# Pages

def page(body, nav="<nav><ul><li><a href='/'>Home</a></li></ul></nav>"):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body>{nav}{body}</body></html>"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows],
                                 "page_id long, url string, html string, host string, template string")


def test_pages_with_named_parts(spark):
    body = ("<header>Site</header><div class='cookie-notice'>We use cookies</div><div class=ad>Buy</div><article><h1>A &amp; B</h1>"
            "<p>One <b>tw</b>o<br>three&nbsp; four<p>Five<form><input><label>Mail</label></form><div id='comments'><p>Nice</p></div>"
            "<ul><li>six<li>seven</ul><!-- no --></article><aside>More</aside><footer>&copy; 2020</footer>")
    rows = [(1, "http://a.example/x", page(body)), (2, None, None), (3, "odd url", ""), (4, "http://b.example", "plain text &lt;b&gt;"),
            (None, "http://a.example/y", page(body)), (6, "http://c.example/", page("<main><p>kept</main>", nav="<nav><a>x")), (4, "http://b.example", "plain text &lt;b&gt;")]
    found = [(r.page_id, r.text, r.n_chars) for r in H.extract(pages_of(spark, rows)).collect()]
    want = "A & B One two three four Five six seven"
    assert sorted(found, key=str) == sorted(
        [(1, want, len(want)), (2, "", 0), (3, "", 0), (4, "plain text <b>", 14), (None, want, len(want)), (6, "kept", 4),
         (4, "plain text <b>", 14)], key=str)
    assert H.extract(pages_of(spark, rows).limit(0)).count() == 0


def test_template_without_names(spark):
    """Only what differs between a site's pages is main text where nothing is named."""
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(8):
        text = [words(rng, 25), words(rng, 30)]
        body = (f"<div class='w1'><div class='top'>Welcome to the site of all sites</div><div class='k7'><p>{text[0]}</p><p>{text[1]}</p></div>"
                f"<div class='z'><a href='/1'>{words(rng, 4)}</a> <a href='/2'>{words(rng, 4)}</a></div><div class='b'>All rights are kept</div></div>")
        rows.append((i, "https://site.example/p", page(body)))
        want[i] = " ".join(text)
    found = {r.page_id: r.text for r in H.extract(pages_of(spark, rows)).collect()}
    assert found == want
    rules = H.deduce(spark.createDataFrame([("g", i, h) for i, _, h in rows], "grp string, page long, html string")).first()
    assert "/html/body/div.w0/div.k0" in rules.template and rules.content == ["/html/body/div.w0/div.k0"]


def texts_without_names(spark, bodies):
    pages = [(i, "http://z.example/" + str(i), f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    found = H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in found}


def test_short_slots_are_kept(spark):
    rng = random.Random(6)
    bodies = [f"<h1>head {words(rng, 3)}</h1><div class=k1><p>{words(rng, 200)}</p></div><div class=k2>same</div>" for _ in range(6)]
    found = texts_without_names(spark, bodies)
    assert all(t.startswith("head ") and "same" not in t for t in found.values())


@pytest.mark.parametrize("source, want", [
    ("<body class='has-sidebar'><article><p>Long text</p></article></body>", "Long text"),
    ("<body><div id='content-with-sidebar'><article><p>Long text</p></article></div></body>", "Long text"),
    ("<body><main class='comments-open'><p>Long text</p></main></body>", "Long text"),
    ("<body><article class='category-search tag-social'><p>Long text</p></article></body>", "Long text"),
    ("<body><div class=sidebar><main><p>Long text</p></main></div></body>", "Long text"),
    ("<body><div class=widget><article><p>Long text</p></article></div></body>", "Long text"),
    ("<body><article><p>Long</p><section class='related-work'><p>work</p></section><p class='notice'>noted</p></article></body>",
     "Long work noted"),
    ("<body><article><p>Long text</p><div class=ad>Buy</div><div class=comments><p>Nice</p></div></article></body>", "Long text")])
def test_names_do_not_drop_main_parts(source, want):
    assert H.main_text(H.Page(source), set(), set()) == want


def test_compound_names_need_most_of_the_text():
    title = "<h1 class='post-title'>Title</h1><div class='entry-meta'>By me</div>"
    page = H.Page(f"<body>{title}<div class='body-copy'><p>{'long text ' * 20}</p></div></body>")
    assert not any(b[4] for b in page.blocks) and "long text" in H.main_text(page, set(), set())
    page = H.Page(f"<body><div class=x>aside</div><div class='post-body'><p>{'long text ' * 20}</p></div></body>")
    assert [b[4] for b in page.blocks] == [False, True]


def test_one_page_does_not_name_the_host(spark):
    rng = random.Random(2)
    bodies = [f"<h1 class='post-title'>head {words(rng, 3)}</h1><div class='body-copy'><p>copy {words(rng, 60)}</p></div>" for _ in range(6)]
    bodies[0] = bodies[0].split("<div")[0]
    found = texts_without_names(spark, bodies)
    assert all("head" in t and ("copy" in t or i == 0) for i, t in found.items())
