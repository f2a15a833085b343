"""Byte-pair encoding with an automaton that is built merge by merge.

The automaton's states are tokens; an arc from x to y says that y may follow x.  It starts with the byte
values, every one of which may follow every other.  The gadget of a merge (u, v) adds the state uv,
which is reached from wherever u is and goes on wherever v goes, and takes away the arc from u to v; it has nothing
to do if that arc is gone already.  As the
new state takes over its parts' arcs, an arc from x to y exists at the end unless a gadget cut it while
its two ends were at the edges of what became x and y.  The edges of a token with the time when each of them
disappeared into a larger one are its *left* and *right spine*, so the arcs need not be stored: whether one exists is
read off the spines and the gadgets, and kept in a transition table once it is known.

A sequence of tokens is the encoding of its text exactly if all its arcs exist, and every text has
exactly one.  So a word is encoded from left to right: the state after each byte is the one token that ends there and may
follow the state at its own beginning.  All new words of a batch take their steps together.  Decoding
emits the labels of the arcs, which are the tokens' bytes.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from motifmill.llm.pretokens import WordTable, split
from motifmill.llm.tables import prepare
from motifmill.llm.text import Rolling, ranges_of, texts_of, tidied

NEVER = 1 << 30
#: Longer words take their steps alone.
LOCKSTEP = 32


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """Compiled merges of a vocabulary file (``vocab``: text to id; ``merges``: pairs of texts)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[bytes, int]):
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in vocab}
        size = max([*vocab.values(), *special.values()]) + 1
        self.special = special
        self.labels: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.labels[i] = raw[text]
        for text, i in special.items():
            self.labels[i] = text
        self.label_size = np.array([len(x) for x in self.labels], np.int64)
        self.label_at = np.cumsum(self.label_size) - self.label_size
        self.label_bytes = np.frombuffer(b"".join(self.labels), np.uint8)
        # Gadgets, one after the other: parts, and when the state came to be.
        gadgets: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        left = {i: [(i, NEVER)] for t, i in vocab.items() if len(t) == 1}
        right = {i: [(i, NEVER)] for t, i in vocab.items() if len(t) == 1}

        def arc(x, y):
            """Whether the arc from x to y is there: no gadget cut it while both its ends were bare."""
            for a, a_gone in right[x]:
                for b, b_gone in left[y]:
                    time = gadgets.get((a, b))
                    # Of one merge's places the leftmost goes first.
                    if time is not None and time < a_gone and time <= b_gone:
                        return False
            return True

        for time, (u, v) in enumerate(merges):
            u, v, new = vocab[u], vocab[v], vocab[u + v]
            if u not in left or v not in left or not arc(u, v):
                continue
            gadgets[u, v] = time
            if new not in left:
                left[new] = [(new, NEVER), (u, time), *left[u][1:]]
                right[new] = [(new, NEVER), (v, time), *right[v][1:]]
        self.ids = {raw[t]: i for t, i in vocab.items() if i in left}
        self.longest = max(map(len, self.ids))
        # For steps in common: tokens by the hash of their bytes, spines and gadgets as arrays.
        token_ids = np.array(sorted(left), np.int64)
        text = np.frombuffer(b"".join(self.labels[i] for i in token_ids), np.uint8)
        ends = np.cumsum(self.label_size[token_ids])
        hashes = Rolling(text).of(ends - self.label_size[token_ids], ends)
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], token_ids[order]
        pairs = np.array([u << 32 | v for u, v in gadgets], np.int64)
        times, order = np.array(list(gadgets.values()), np.int64), np.argsort(pairs)
        self.pairs, self.times = pairs[order], times[order]
        self.left_spine, self.left_gone = self._spines(left, size)
        self.right_spine, self.right_gone = self._spines(right, size)
        # The transition table: pairs of states, and whether there is an arc.
        self.known, self.may = np.full(1, -1, np.int64), np.zeros(1, bool)
        self.fresh, self.n_fresh = [], 0

    @staticmethod
    def _spines(spines, size):
        depth = max(map(len, spines.values()))
        token, gone = np.full((depth, size), -1, np.int64), np.full((depth, size), NEVER, np.int64)
        for i, spine in spines.items():
            token[: len(spine), i], gone[: len(spine), i] = zip(*spine)
        return token, gone

    def follows(self, x: int, y: int) -> bool:
        found = self.arcs.get((x, y))
        if found is None:
            if len(self.arcs) > 1 << 16:
                self.arcs.clear()
            self.arcs[x, y] = found = bool(self._check(np.array([x]), np.array([y]))[0])
        return found

    def _follow(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``follows`` for many pairs, by the transition table as far as it is filled."""
        key = x << 32 | y
        at = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
        hit = self.known[at] == key
        out = self.may[at] & hit
        if not hit.all():
            new, back = np.unique(key[~hit], return_inverse=True)
            value = self._check(new >> 32, new & 0xFFFFFFFF)
            out[~hit] = value[back]
            self.fresh.append((new, value))
            self.n_fresh += len(new)
            if self.n_fresh > 1 << 16:
                if len(self.known) > 1 << 20:
                    self.known, self.may = self.known[:1], self.may[:1]
                keys = np.concatenate([self.known, *(k for k, _ in self.fresh)])
                values = np.concatenate([self.may, *(v for _, v in self.fresh)])
                self.known, at = np.unique(keys, return_index=True)
                self.may, self.fresh, self.n_fresh = values[at], [], 0
        return out

    def _check(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``follows`` along the spines of all pairs at once: no gadget cut an arc while both its ends were bare."""
        ok = np.ones(len(x), bool)
        for a, a_gone in zip(self.right_spine, self.right_gone):
            some = np.flatnonzero(a[x] >= 0)
            if not len(some):
                break
            for b, b_gone in zip(self.left_spine, self.left_gone):
                some = some[b[y[some]] >= 0]
                if not len(some):
                    break
                key = a[x[some]] << 32 | b[y[some]]
                at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                time = np.where(self.pairs[at] == key, self.times[at], NEVER)
                ok[some[(time < a_gone[x[some]]) & (time <= b_gone[y[some]]) & (time < NEVER)]] = False
        return ok

    def encode_word(self, word: bytes) -> list[int]:
        """One word's ids, one step after the other."""
        state, size = [-1], [0]
        for end in range(1, len(word) + 1):
            for n in range(min(end, self.longest), 0, -1):
                token = self.ids.get(word[end - n: end])
                if token is not None and (n == end or self.follows(state[end - n], token)):
                    state.append(token)
                    size.append(n)
                    break
        out, end = [], len(word)
        while end:
            out.append(state[end])
            end -= size[end]
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        lengths = np.array([len(w) for w in words])
        for i in np.flatnonzero(lengths > LOCKSTEP):
            out[i] = np.array(self.encode_word(words[i]), np.uint32)
        short = np.flatnonzero(lengths <= LOCKSTEP)
        short = short[np.argsort(-lengths[short], kind="stable")]
        for k in range(0, len(short), 1 << 14):
            some = short[k: k + (1 << 14)]
            for i, ids in zip(some.tolist(), self._lockstep([words[i] for i in some.tolist()], lengths[some])):
                out[i] = ids
        for i, w in enumerate(words):
            if w in self.special:
                out[i] = np.array([self.special[w]], np.uint32)
        return out

    def _lockstep(self, words: list[bytes], lengths: np.ndarray):
        """Words from long to short, all at once: the table of states, and the ids read back from the end."""
        m, n = len(words), int(lengths[0])
        rolling = Rolling(np.frombuffer(b"".join(words), np.uint8))
        base = np.cumsum(lengths) - lengths
        state = np.full((n + 1, m), -1, np.int64)
        size = np.zeros((n + 1, m), np.int64)
        for end in range(1, n + 1):
            open_ = np.arange(np.searchsorted(-lengths, -end, "right"))
            for k in range(min(end, self.longest), 0, -1):
                hashes = rolling.of(base[open_] + end - k, base[open_] + end)
                at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                fits = np.flatnonzero(self.hashes[at] == hashes)
                if not len(fits):
                    continue
                who, token = open_[fits], self.hash_ids[at[fits]]
                if k < end:
                    ok = self._follow(state[end - k, who], token)
                    who, token, fits = who[ok], token[ok], fits[ok]
                state[end, who], size[end, who] = token, k
                open_ = np.delete(open_, fits)
                if not len(open_):
                    break
        ids = np.zeros((n, m), np.uint32)
        count = np.zeros(m, np.int64)
        end = lengths.copy()
        who = np.arange(m)
        while len(who):
            ids[n - 1 - count[who], who] = state[end[who], who]
            count[who] += 1
            end[who] -= size[end[who], who]
            who = who[end[who] > 0]
        return [row[n - c:] for row, c in zip(ids.T.copy(), count.tolist())]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The labels of the arcs, one after the other."""
        size = self.label_size[ids]
        stop = np.cumsum(size)
        if not len(stop):
            return self.label_bytes[:0]
        return self.label_bytes[np.arange(stop[-1]) + np.repeat(self.label_at[ids] - (stop - size), size)]


def compile_file(text: str) -> Automaton:
    """From the JSON of a byte-level BPE tokenizer."""
    spec = json.loads(text)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
    return Automaton({t: i for t, i in spec["model"]["vocab"].items() if t.encode() not in special}, merges, special)


@functools.cache
def _compiled(path: str) -> tuple[Automaton, WordTable]:
    with open(path, encoding="utf-8") as file:
        automaton = compile_file(file.read())
    return automaton, WordTable(automaton.encode_words)


def tokenize(data: np.ndarray, offsets: np.ndarray, table: WordTable, special) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of ids of each row), in steps of bounded size where rows are not too long."""
    ids, counts = [], []
    for i, j in ranges_of(offsets, 1 << 20):
        low = int(offsets[i])
        own, bounds = data[low: int(offsets[j])], offsets[i: j + 1] - low
        starts = split(own, bounds, special)
        found, count = table.of(own, starts, np.append(starts[1:], len(own)))
        edge = np.append(0, np.cumsum(count))[np.searchsorted(starts, bounds)]
        ids.append(found)
        counts.append(np.diff(edge))
    return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


@tidied
def _encode(batches, path, with_ids):
    automaton, table = _compiled(path)
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        ids, counts = tokenize(data, offsets, table, tuple(automaton.special))
        cuts = np.append(0, np.cumsum(counts))
        shas, decoded = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            shas.append(hashlib.sha256(ids[a:b].astype("<u4", copy=False).tobytes()).hexdigest())
            text = automaton.decode(ids[a:b]).tobytes().decode("utf-8", "replace")
            decoded.append(text if with_ids else hashlib.sha256(text.encode("utf-8")).hexdigest())
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas), pa.array(decoded)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded" if with_ids else "decoded_sha256"]
        if with_ids:
            columns.insert(2, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))))
            names.insert(2, "ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def encode_decode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Encode every text with the vocabulary file at ``path`` and decode the ids again.

    (doc_id, n_tokens, ids, ids_sha256, decoded); without ``with_ids``, (doc_id, n_tokens, ids_sha256,
    decoded_sha256).  One row per row of ``docs``, repeated ones and null doc_ids included; null and empty
    texts have no tokens.  The file has to be installed at the same path on all executors.
    """
    prepare(docs.sparkSession)
    schema = ("doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded string" if with_ids
              else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda b: _encode(b, path, with_ids), schema)
