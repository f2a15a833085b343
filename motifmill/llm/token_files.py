"""Token ids of a corpus as flat binary files that can be mapped into memory.

A corpus is a folder with, for each part of a range of doc_ids, ``*.bin`` (all ids one after the other, as unsigned
little-endian integers of 16 or 32 bits), ``*.idx`` (64-bit offsets of the documents in ids, one more at the
end) and ``*.doc`` (64-bit doc_ids), and a table ``manifest`` with each part's place in the whole: its first
document and first id are sums over the parts before it.

Texts are encoded where they are read; only ids are shuffled, each to the part of its doc_id.  A task writes
its parts while it reads them, in files with names of their own; the manifest names those of tasks that ended, so
tasks can be repeated.  The driver sees one row per part.
"""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from motifmill.llm.bpe_automaton import tokenize
from motifmill.llm.pretokens import WordTable
from motifmill.llm.tables import parts, prepare, range_bounds, texts
from motifmill.llm.text import texts_of
from motifmill.session import ensure_checkpoint_dir

NO_ID = np.iinfo(np.int64).min


def _open(uri: str):
    """The file system of a folder, and the folder's path there."""
    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)


@functools.cache
def _encoder(path: str, dtype: str):
    """The library's encoder behind a table of the words it has encoded."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}

    def encode(words):
        found = tokenizer.encode([w.decode("utf-8", "replace") for w in words], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, dtype)
        owner = np.array(found.word_ids, np.int64)
        return np.split(ids, np.searchsorted(owner, np.arange(1, len(words))))

    return WordTable(encode, np.dtype(dtype)), tuple(special)


def _encode(batches, path, dtype, bounds, end_id):
    table, special = _encoder(path, dtype)
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        ids, counts = tokenize(data, offsets, table, special)
        # The end of each document.
        ids = np.insert(ids, np.cumsum(counts), end_id)
        counts = counts + 1
        docs = np.asarray(batch.column("doc_id").fill_null(NO_ID))
        cuts = np.append(0, np.cumsum(counts)) * ids.itemsize
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.searchsorted(bounds, docs, "left").astype(np.int32)), pa.array(docs),
             pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids)])
             .cast(pa.binary())], names=["part", "doc", "ids"])


def _write(batches, folder, width):
    """Write the parts of one task as their rows come by, in order."""
    system, path = _open(folder)
    part, out, name, docs, offsets = None, None, None, [], [0]

    def close():
        out.close()
        for ending, values in ((".idx", offsets), (".doc", docs)):
            with system.open_output_stream(f"{path}/{name}{ending}") as file:
                file.write(np.array(values, "<i8").tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([name]), pa.array([len(docs)], pa.int64()), pa.array([offsets[-1]], pa.int64())],
            names=["part", "name", "n_docs", "n_ids"])

    for batch in batches:
        for p, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc", "ids"))):
            if p != part:
                if out:
                    yield close()
                part, name, docs, offsets = p, f"{p:06d}-{uuid.uuid4().hex}", [], [0]
                out = system.open_output_stream(f"{path}/{name}.bin", buffer_size=1 << 20)
            out.write(ids)
            docs.append(doc)
            offsets.append(offsets[-1] + len(ids) // width)
    if out:
        yield close()


def _map(folder: str, name: str, dtype: str):
    """(ids, offsets, doc_ids) of a part, mapped; parts of other file systems are fetched first."""
    system, path = _open(folder)
    kinds = ((".bin", dtype), (".idx", "<i8"), (".doc", "<i8"))
    if isinstance(system, fs.LocalFileSystem):
        return [np.memmap(f"{path}/{name}{e}", k, "r") for e, k in kinds]
    found = []
    for ending, kind in kinds:
        with tempfile.NamedTemporaryFile() as here:  # stays mapped once it has no name
            fs.copy_files(f"{path}/{name}{ending}", here.name, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
            found.append(np.memmap(here.name, kind, "r"))
    return found


def _read(batches, folder, dtype):
    for batch in batches:
        for name, first, base in zip(*(batch.column(c).to_pylist() for c in ("name", "first_doc", "first_id"))):
            ids, offsets, docs = _map(folder, name, dtype)
            for k in range(0, len(docs), 4096):
                some, cuts = docs[k: k + 4096], offsets[k: k + 4097].tolist()
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(some), mask=np.array(some) == NO_ID), pa.array(np.arange(k, k + len(some)) + first),
                     pa.array(np.array(cuts[:-1]) + base), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())],
                    names=["doc_id", "position", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, vocabulary: int) -> None:
    """Encode ``docs`` (doc_id, text) with the vocabulary file ``path``, end every document with ``end_id``,
    and write the corpus into ``folder`` in ascending order of doc_id.

    Null texts are empty, so they hold the end only; null doc_ids come first; rows with the same doc_id are ordered
    by their ids.  The file has to be at the same path on all executors.
    """
    spark = docs.sparkSession
    prepare(spark)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    width, n = int(dtype[-1]), parts(spark)
    docs = texts(docs)
    bounds = range_bounds(docs, n)
    system, place = _open(folder)
    system.create_dir(place, recursive=True)
    encoded = docs.mapInArrow(lambda b: _encode(b, path, dtype, bounds, end_id), "part int, doc long, ids binary")
    files = encoded.repartition(n, "part").sortWithinPartitions("part", "doc", "ids").mapInArrow(
        lambda b: _write(b, folder, width), "part int, name string, n_docs long, n_ids long")
    written = files.toPandas().sort_values("part")
    written["first_doc"] = written["n_docs"].cumsum() - written["n_docs"]
    written["first_id"] = written["n_ids"].cumsum() - written["n_ids"]
    written["dtype"] = dtype
    spark.createDataFrame(
        written, "part int, name string, n_docs long, n_ids long, first_doc long, first_id long, dtype string"
    ).write.parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, position, start, n_tokens, ids_crc32) of every document of a corpus on disk."""
    prepare(spark)
    manifest = spark.read.parquet(f"{folder}/manifest")
    kinds = [r["dtype"] for r in manifest.select("dtype").distinct().collect()]
    dtype = kinds[0] if kinds else "<u2"
    return manifest.repartition(parts(spark), "part").mapInArrow(
        lambda b: _read(b, folder, dtype),
        "doc_id long, position long, start long, n_tokens long, ids_crc32 long")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the one the cluster shares."""
    return f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
