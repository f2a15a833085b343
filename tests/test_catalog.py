"""Every registered query next to its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from motifmill.plans import catalog

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Nothing scores above the limit or differs in these at this scale.
MAY_BE_EMPTY = {"bpe08_verify_merged", "jon09_compare_chunking"}


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def normal(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    assert mine or name in MAY_BE_EMPTY
    if name in SQL:
        cursor = con.execute(SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(df.columns) == sorted(columns)
        assert mine == normal(columns, cursor.fetchall())


def test_motifs_grow(spark, folder):
    """The merges of recurring motifs reach shapes of three members and more, and foreign ones differ from own ones."""
    w = catalog.Workspace.of(spark, folder)
    assert max(len(s) for s in w.learned(motifs=True).shapes) >= 3
    assert w.learned(motifs=True).shapes != w.learned().shapes


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_merged_corpus_through_rows(spark, folder):
    """Every token of the merged corpus has an id and comes back from it; its text survives a store."""
    run = lambda name: QUERIES[name](spark, folder)
    tokens = catalog.Workspace.of(spark, folder).merged
    assert tokens.filter("type = 'U'").count() > 0
    texts = {(r.piece_id, r.seq): r.text for r in tokens.select("piece_id", "seq", "text").collect()}
    assert {(r.piece_id, r.seq): r.text for r in run("jon08_merged_rows_and_back").collect()} == texts
    lines = {r.piece_id: r.text.split(" ") for r in run("bpe07_snk04_merged_corpus").collect()}
    assert {(p, k): t for p, line in lines.items() for k, t in enumerate(line)} == texts


def test_running_time_is_found_once(spark, folder, monkeypatch):
    """Queries on decoded notes and queries on multi-notes share the stored running time."""
    named, table = [], catalog.stage
    monkeypatch.setattr(catalog, "stage", lambda df, name="stage", **more: named.append(name) or table(df, name, **more))
    w = catalog.Workspace(spark, folder)
    assert w.decoded.notes.count() > 0 and w.multi_notes.count() > 0
    assert named.count("timed") == 1
