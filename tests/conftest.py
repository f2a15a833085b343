import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from motifmill.session import local_session, stage  # noqa: E402
from motifmill.sources import raw as R  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # Tiny tables: compiling code for them costs more than it saves.
    return local_session("*", 4, app="tests", **{
        "spark.driver.memory": "4g", "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.parquet.compression.codec": "uncompressed"})


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture
def make_raw(spark):
    """Raw tables of one or more hand-written pieces, at 12 ticks per beat unless told otherwise."""
    def make(notes, time_sigs=((0, 0, 4, 4),), tempos=((0, 0, 120.0),), tracks=None, beat=12):
        """``notes``: (piece, track, start, end, pitch, velocity); changes: (piece, time, ...)."""
        pieces = sorted({n[0] for n in notes} | {t[0] for t in time_sigs} | {t[0] for t in (tracks or [])})
        tracks = tracks or sorted({(n[0], n[1], 0, False) for n in notes})
        frame = lambda rows, name: stage(spark.createDataFrame(list(rows), R.SCHEMAS[name]).coalesce(1))
        numbered = lambda rows: [(r[0], i, *r[1:]) for i, r in enumerate(rows)]
        return R.RawTables(
            frame([(p, f"a/{p}.mid", beat) for p in pieces], "pieces"), frame(tracks, "raw_tracks"),
            frame(notes, "raw_notes"), frame(numbered(time_sigs), "raw_time_sigs"),
            frame(numbered(tempos), "raw_tempos"))
    return make


def rows(df, *columns, order=True):
    out = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(out, key=str) if order else out
