"""Removal of long repeated strings by prefix-free parsing.

Texts are parsed into phrases at rolling-hash triggers: of every ``length`` consecutive bytes, the
``trigger``-byte window with the smallest hash (the leftmost of equals) is the trigger, and the
``length``-byte windows in a row that share one trigger are covered by one phrase.  Neighbouring
phrases overlap, so every window lies in exactly one phrase, and equal windows have equal triggers
at equal offsets wherever they occur: what repeats can be found phrase by phrase, and no match has
to be followed from one phrase into the next.

1. *Parse.* Each document becomes a list of (trigger hash, phrase hash, start); a batch of documents
   sends only the earliest occurrence of each phrase and marks the others as repeated right away, so a
   huge group of copies is thinned out before anything is shuffled.
2. *Dictionary.* Per range of trigger hashes, the parse is brought together.  All but the first
   occurrence of a phrase are repeated as a whole.  A trigger with a single distinct phrase has
   nothing more to give.
3. *Suffix arrays.* Of the other phrases the first occurrences are looked up in the texts, and the
   phrase suffixes of one trigger that are at least ``length`` long are sorted by their first
   ``length`` bytes.  Runs of equals in that order are the repeated strings; combined with the
   parse positions, all but the first of each run are removed.
4. The removed windows of a document are merged into spans.

Phrases are matched by 64-bit hash, suffixes by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from motifmill.llm.tables import asked_for, keyed, parts, prepare, with_key
from motifmill.llm.text import STEP, Rolling, mix, ranges_of, texts_of, tidied
from motifmill.session import job, stage

#: Bits of a window's packed key that hold its place in a slice; the rest orders triggers.
_PLACE = np.uint64((1 << 28) - 1)
#: Most phrases of one trigger that one group sorts; beyond, the suffixes are dealt out by hash.
GROUP = 4096


def _cut(data: np.ndarray, offsets: np.ndarray, length: int, trigger: int):
    """Parse all rows: arrays (row, first window, last window, trigger hash, phrase hash)."""
    found = []
    for i, j in ranges_of(offsets):
        low, high = int(offsets[i]), int(offsets[j])
        if j > i + 1:
            found.append(_cut_slice(data[low:high], offsets[i: j + 1] - low, i, 0, length, trigger))
            continue
        # A long row is taken in slices that share length - 1 bytes, so that no window is lost.
        for at in range(low, high, STEP):
            piece = data[at: min(high, at + STEP + length - 1)]
            found.append(_cut_slice(piece, np.array([0, len(piece)]), i, at - low, length, trigger))
    return [np.concatenate(x) for x in zip(*found)] if found else _nothing()


def _nothing():
    return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2


def _cut_slice(data, bounds, row0, shift, length, trigger):
    n, width = len(data), length - trigger + 1
    if n < length:
        return _nothing()
    rolling = Rolling(data)
    grams = rolling.grams(trigger)
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(key) // width) * width, (1 << 64) - 1, np.uint64)
    padded[: len(key)] = key
    padded = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    place = (np.minimum(back[:windows], ahead[width - 1: width - 1 + windows]) & _PLACE).astype(np.int64)
    # Windows that reach into the next row don't count.
    whole = np.ones(windows, bool)
    inner = bounds[1:-1]
    for k in range(1, length):
        at = inner - k
        whole[at[(at >= 0) & (at < windows)]] = False
    at = np.flatnonzero(whole)
    if not len(at):
        return _nothing()
    place = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    first, last = at[begin], np.append(at[begin[1:] - 1], at[-1])
    place = place[begin]
    row = np.searchsorted(bounds, first, "right") - 1
    base = bounds[row]
    phrase = rolling.of(first, last + length)
    phrase = mix(phrase + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return [row + row0, first - base + shift, last - base + shift, grams[place], phrase]


@tidied
def _parse_batches(batches, length, trigger, n_parts):
    """Per batch: the earliest occurrence of each phrase, by range of triggers, and the repeats."""
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        keys = np.asarray(batch.column("key"))
        row, first, last, anchor, phrase = _cut(data, offsets, length, trigger)
        if not len(row):
            continue
        rec = np.empty(len(row), _SENT)
        rec["phrase"], rec["anchor"] = phrase, anchor & np.uint64(0xFFFFFFFF)
        rec["doc"], rec["start"], rec["more"] = keys[row], first, last - first
        part = (anchor >> np.uint64(33)) % np.uint64(n_parts)
        order = np.lexsort((rec["start"], rec["doc"], rec["phrase"]))
        rec, part = rec[order], part[order]
        lead = np.ones(len(rec), bool)
        lead[1:] = rec["phrase"][1:] != rec["phrase"][:-1]
        by = np.argsort(part[lead], kind="stable")
        cuts = np.searchsorted(part[lead][by], np.arange(n_parts + 1))
        kept, again = rec[lead][by], _windows(rec[~lead])
        out = {"part": [], "keys": [], "spans": []}
        for p in np.flatnonzero(np.diff(cuts)):
            out["part"].append(int(p))
            out["keys"].append(kept[cuts[p]: cuts[p + 1]].tobytes())
            out["spans"].append(b"")
        share = max(1, len(again) // n_parts + 1)
        for k in range(0, len(again), share):
            out["part"].append((k // share) % n_parts)
            out["keys"].append(b"")
            out["spans"].append(again[k: k + share].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["part"], pa.int32()), pa.array(out["keys"], pa.binary()), pa.array(out["spans"], pa.binary())],
            names=["part", "keys", "spans"])


#: What is sent of a phrase: 64 bits of its hash, 32 of its trigger's, where it is, and its windows.
_SENT = np.dtype([("phrase", "<u8"), ("anchor", "<u4"), ("doc", "<i8"), ("start", "<u4"), ("more", "<u2")])
_SPAN = np.dtype([("doc", "<i8"), ("start", "<i8"), ("stop", "<i8")])


def _windows(rec):
    """The windows of phrases as spans (doc, first, after the last)."""
    out = np.empty(len(rec), _SPAN)
    out["doc"], out["start"] = rec["doc"], rec["start"]
    out["stop"] = out["start"] + rec["more"] + 1
    return _join_spans(out)


def _join_spans(s):
    if not len(s):
        return s
    s = s[np.lexsort((s["start"], s["doc"]))]
    new = np.ones(len(s), bool)
    new[1:] = (s["doc"][1:] != s["doc"][:-1]) | (s["start"][1:] > s["stop"][:-1])
    at = np.flatnonzero(new)
    out = s[at].copy()
    out["stop"] = np.maximum.reduceat(s["stop"], at)
    return out


@tidied
def _settle(frame: pd.DataFrame, group: int) -> pd.DataFrame:
    """One range of triggers: spans repeated as a whole (kind 0), phrases to look into (kind 1)."""
    spans = [np.frombuffer(b"".join(frame["spans"]), _SPAN)]
    keys = np.frombuffer(b"".join(frame["keys"]), _SENT)
    look = keys[:0]
    weight = np.zeros(0, np.int64)
    if len(keys):
        keys = keys[np.lexsort((keys["start"], keys["doc"], keys["phrase"], keys["anchor"]))]
        lead = np.ones(len(keys), bool)
        lead[1:] = (keys["phrase"][1:] != keys["phrase"][:-1]) | (keys["anchor"][1:] != keys["anchor"][:-1])
        spans.append(_windows(keys[~lead]))
        look = keys[lead]
        _, back, count = np.unique(look["anchor"], return_inverse=True, return_counts=True)
        look, weight = look[count[back] > 1], count[back][count[back] > 1]
    s = _join_spans(np.concatenate(spans))
    return pd.DataFrame({
        "key": np.concatenate([s["doc"], look["doc"]]),
        "start": np.concatenate([s["start"], look["start"].astype(np.int64)]),
        "stop": np.concatenate([s["stop"], look["start"].astype(np.int64) + look["more"] + 1]),
        "grp": np.concatenate([np.full(len(s), -1), (int(frame["part"].iloc[0]) << 32) + look["anchor"].astype(np.int64)]),
        "ways": np.concatenate([np.zeros(len(s), np.int32), -(-weight // group)]).astype(np.int32),
    })


@tidied
def _phrases(batches, length):
    """Cut the phrases to look into out of their documents."""
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        out = [[], [], [], [], []]
        wanted = batch.column("wanted").to_pylist()
        keys = batch.column("key").to_pylist()
        for i, items in enumerate(wanted):
            text = data[offsets[i]: offsets[i + 1]]
            for x in items or ():
                piece = text[x["start"]: x["stop"] + length - 1].tobytes()
                for way in range(x["ways"]):
                    for column, value in zip(out, (x["grp"], way, keys[i], x["start"], (piece, x["ways"]))):
                        column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
             pa.array(out[3], pa.int64()), pa.array([x[0] for x in out[4]], pa.binary()),
             pa.array([x[1] for x in out[4]], pa.int32())],
            names=["grp", "way", "key", "start", "phrase", "ways"])


@tidied
def _sort_suffixes(batches, length, group):
    """Sort the phrase suffixes of whole triggers; all but the first of equals are repeated.

    Triggers are hashed to partitions, so a partition's suffixes are sorted in one go, in steps.
    """
    held = [b.to_pandas() for b in batches if b.num_rows]
    if not held:
        return
    frame = pd.concat(held).sort_values(["grp", "way"], kind="stable")
    grp = frame["grp"].to_numpy() * np.int64(1 << 16) + frame["way"].to_numpy()
    edges = np.append(np.flatnonzero(np.append(True, grp[1:] != grp[:-1])), len(frame))
    i = 0
    while i < len(edges) - 1:
        # Whole groups, a bounded number of phrases at a time.
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + group, "right")) - 1)
        part = frame.iloc[edges[i]: edges[j]]
        yield from _repeats(part, length)
        i = j


def _repeats(part, length):
    phrases = part["phrase"].tolist()
    sizes = np.array([len(x) for x in phrases], np.int64)
    text = np.frombuffer(b"".join(phrases), np.uint8)
    at = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(phrases)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = at[owner] + inner
    ways = part["ways"].to_numpy()
    if (ways > 1).any():  # a busy trigger: this group takes its share of the suffixes
        mine = Rolling(text).of(place, place + length) % ways[owner].astype(np.uint64)
        keep = mine == part["way"].to_numpy()[owner].astype(np.uint64)
        owner, inner, place = owner[keep], inner[keep], place[keep]
    suffixes = np.lib.stride_tricks.sliding_window_view(text, length)[place]
    suffixes = np.ascontiguousarray(suffixes).view(f"S{length}").ravel()
    keys, starts = part["key"].to_numpy()[owner], part["start"].to_numpy()[owner] + inner
    order = np.lexsort((starts, keys, suffixes))
    ranked = suffixes[order]
    again = order[1:][ranked[1:] == ranked[:-1]]
    s = np.empty(len(again), _SPAN)
    s["doc"], s["start"], s["stop"] = keys[again], starts[again], starts[again] + 1
    s = _join_spans(s)
    if len(s):
        yield pa.RecordBatch.from_arrays([pa.array(s["doc"]), pa.array(s["start"]), pa.array(s["stop"])],
                                         names=["key", "start", "stop"])


def repeated_windows(docs: DataFrame, length: int = 100, trigger: int = 32, group: int = GROUP) -> DataFrame:
    """(key, start, stop): starts of the ``length``-byte strings of ``docs`` (key, text) that also
    start earlier, as half-open runs.  Earlier means a smaller key, or the same and a smaller start.
    At most ``group`` phrases are sorted at once; the result doesn't depend on it.
    """
    spark = docs.sparkSession
    n_parts = 2 * parts(spark)
    parsed = docs.mapInArrow(lambda b: _parse_batches(b, length, trigger, n_parts),
                             "part int, keys binary, spans binary")
    settled = stage(parsed.groupBy("part").applyInPandas(
        lambda f: _settle(f, group), "key long, start long, stop long, grp long, ways int"), "parse")
    look = settled.filter("grp >= 0")
    some, _ = asked_for(docs, "key", look)
    look = look.groupBy("key").agg(F.collect_list(F.struct("start", "stop", "grp", "ways")).alias("wanted"))
    phrases = some.join(look, "key").mapInArrow(
        lambda b: _phrases(b, length), "grp long, way int, key long, start long, phrase binary, ways int")
    sorted_ = phrases.repartition(parts(spark), "grp", "way").mapInArrow(
        lambda b: _sort_suffixes(b, length, group), "key long, start long, stop long")
    return settled.filter("grp < 0").select("key", "start", "stop").union(sorted_)


def _merge(runs, length: int) -> list[tuple[int, int]]:
    """Runs of window starts to maximal runs of bytes."""
    out: list[list[int]] = []
    for start, stop in sorted((r["start"], r["stop"] - 1 + length) for r in runs or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _whole_characters(text: bytes, spans):
    """Spans shrunk to whole UTF-8 characters."""
    for start, stop in spans:
        while start < stop and text[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop -= 1
        if start < stop:
            yield start, stop


@tidied
def _remove(batches, length, as_text):
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        sizes, removed, spans, kept = [], [], [], []
        for i, runs in enumerate(batch.column("runs").to_pylist()):
            text = data[offsets[i]: offsets[i + 1]].tobytes()
            cut = _merge(runs, length)
            if as_text:
                cut = list(_whole_characters(text, cut))
            edges = [0, *(x for span in cut for x in span), len(text)]
            rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            sizes.append(len(text))
            removed.append(len(text) - len(rest))
            spans.append(len(cut))
            kept.append(rest if as_text else hashlib.sha256(rest).hexdigest().encode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(spans, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 100, trigger: int = 32, as_text: bool = True, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per document of ``docs`` (doc_id, text).

    ``kept`` is what is left of the text, with spans shrunk to whole characters; without
    ``as_text`` spans are cut at any byte and ``kept`` is the SHA-256 of the remaining bytes.
    Null texts are empty; texts shorter than ``length`` bytes keep everything; rows that repeat
    both doc_id and text give one row, rows that repeat only doc_id count as documents in the order
    of their texts' hashes, and a null doc_id comes before all others.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs)
    runs = _runs(rows.select("key", "text"), length, trigger, group)
    some, rest = asked_for(rows, "key", runs)
    text = F.coalesce("text", F.lit(""))
    rest = rest.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                       F.lit(0).cast("long").alias("n_spans"), (text if as_text else F.sha2(text, 256)).alias("kept"))
    return some.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(
        lambda b: _remove(b, length, as_text),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept string").union(rest)


def _runs(rows: DataFrame, length: int, trigger: int, group: int = GROUP) -> DataFrame:
    """(key, runs) of the texts that have repeats, written; what led to it is dropped."""
    with job(rows.sparkSession):
        found = repeated_windows(rows, length, trigger, group).groupBy("key").agg(
            F.collect_list(F.struct("start", "stop")).alias("runs"))
        return stage(found, "runs", outlives_job=True)


def without_repeats(docs: DataFrame, length: int = 100, trigger: int = 32) -> DataFrame:
    """``docs`` with all rows and columns; ``text`` without what repeats an earlier string, ``n_chars`` (if there) counted anew."""
    prepare(docs.sparkSession)
    rows, key = with_key(docs)
    names, schema = docs.columns, docs.schema
    found_in = "runs"
    while found_in in (c.lower() for c in rows.columns):
        found_in += "_"
    runs = _runs(rows.select(F.col(key).alias("key"), "text"), length, trigger).withColumnsRenamed({"key": key, "runs": found_in})
    some, rest = asked_for(rows, key, runs)
    if "n_chars" in names:
        rest = rest.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType))

    @tidied
    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            valid = batch.column("text").is_valid().to_pylist()
            out = []
            for i, found in enumerate(batch.column(found_in).to_pylist()):
                text = data[offsets[i]: offsets[i + 1]].tobytes()
                cut = list(_whole_characters(text, _merge(found, length)))
                edges = [0, *(x for span in cut for x in span), len(text)]
                out.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8") if valid[i] else None)
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array(out, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if x is None else len(x) for x in out]).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    columns = [F.col(f"`{c}`") for c in names]
    return some.join(runs, key, "left").select(*columns, found_in).mapInArrow(run, schema).union(rest.select(*columns))
