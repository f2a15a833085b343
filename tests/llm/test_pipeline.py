"""The registered queries and the pipeline on the smallest tables."""

import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from motifmill.llm import decontaminate, oracle, queries, quality
from .test_pairs import components, plain
from .test_single import library


@pytest.fixture(scope="module")
def tables(folder):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "pages", "embeddings"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(oracle.QUERIES))
def test_query_next_to_sql(spark, folder, tables, name):
    df = entry.queries()[name](spark, folder)
    cursor = tables.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, cursor.fetchall())


def test_all_thirteen_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(queries.queries()) == set(names) and "pipeline" in entry.queries()


def test_exact_passages_are_found(spark, folder, tables):
    found = {(r.doc_id, r.item_id) for r in entry.queries()["op2_decontaminate"](spark, folder).collect()}
    exact = set(tables.execute("select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)").fetchall())
    assert exact and exact <= found


def test_held_out_quality_and_language(spark, folder, tables):
    labels = dict(tables.execute("select doc_id, quality from labels").fetchall())
    rows = entry.queries()["op7_quality"](spark, folder).collect()
    assert len(rows) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum((r.predicted == labels[r.doc_id]) for r in rows if r.doc_id in labels) > 0.85 * len(labels)
    langs = dict(tables.execute("select doc_id, lang from documents").fetchall())
    rows = entry.queries()["op10_language"](spark, folder).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) > 0.93 * len(held)


def test_pipeline_step_by_step(spark, folder, tables):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    steps = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, step in corpus_pipeline.STAGES:
        steps.append(step(spark, steps[-1], folder).cache())
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    texts = [{r.doc_id: r.text for r in s.collect()} for s in steps[:-1]]
    # Quality: what the labels call junk goes, clean documents stay.
    labels = dict(tables.execute("select doc_id, quality from labels").fetchall())
    assert sum(i in texts[1] for i in labels if labels[i]) > 0.95 * sum(labels.values())
    assert sum(i not in texts[1] for i in labels if not labels[i]) > 0.8 * sum(1 - q for q in labels.values())
    # One of each group stays.
    assert set(texts[2]) == {i for i, (_, c) in components(sorted(texts[1].items()), 5, 80).items() if i == c}
    # Strings of 100 bytes that stand earlier go, shrunk to whole characters.
    seen = set()
    for i, text in sorted(texts[2].items()):
        raw = text.encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if (x := raw[p:p + 100]) in seen:
                mark[p:p + 100] = b"\1" * 100
            seen.add(x)
        kept, p = "", 0
        for c in text:
            n = len(c.encode())
            kept += c if not all(mark[p:p + n]) else ""
            p += n
        assert texts[3][i] == kept
    # No benchmark item is left; only documents that hold one are gone.
    items = [plain(t) for _, t in tables.execute("select * from benchmark").fetchall()]
    near = lambda text: any(decontaminate.distance_within(t.encode(), plain(text).encode(), len(t) // 10) <= len(t) // 10 for t in items)
    assert all(near(texts[3][i]) for i in set(texts[3]) - set(texts[4]))
    assert not any(t in plain(x) for x in texts[4].values() for t in items)
    # Ids are the library's.
    lib = library()
    last = {r.doc_id: r for r in steps[-1].collect()}
    assert set(last) == set(texts[4])
    for i, r in last.items():
        assert list(r.ids) == lib.encode(texts[4][i], add_special_tokens=False).ids and r.decoded == texts[4][i]
    assert docs


def test_pipeline_asks_for_batches_of_a_megabyte(spark, docs_of, folder):
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, default)
        corpus_pipeline.good_quality(spark, docs_of([(1, "some words")]), folder)
        assert int(spark.conf.get(name)) <= 1 << 20
    finally:
        spark.conf.set(name, before)


def test_pipeline_of_odd_rows(spark, docs_of, folder):
    from .conftest_llm import EDGES
    docs = docs_of(EDGES)
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = step(spark, docs, folder)
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    empty = docs_of(EDGES).limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, folder).count() == 0
