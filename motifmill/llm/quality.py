"""Quality of texts by a convolutional network over bytes, in numpy.

A byte is embedded in a few numbers; filters ``WIDTH`` bytes wide run over the whole text.  A further input says for how many
bytes in a row the text has repeated something that stands at most ``LAG`` bytes before it.  The
filters' largest values in each of a text's overlapping chunks are taken, of these the largest and the
mean over all chunks, and a logistic unit makes one probability of them.  The filters, the embedding and the unit are
learned by gradient descent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from motifmill.llm.tables import prepare, smallest_hashes
from motifmill.llm.text import STEP, ranges_of, texts_of, tidied

WIDTH, FILTERS, EMBEDDING = 8, 16, 6
#: Bytes of half a chunk; chunks overlap by a half.  Zero bytes before and after each text.
HALF, PAD = 128, 40
LAG, RUN = 32, 64


def _layout(data: np.ndarray, offsets: np.ndarray):
    """Texts side by side, each in half chunks of its own, with zeros before and after; and each text's halves."""
    size = np.diff(offsets)
    halves = -(-(WIDTH + size + PAD) // HALF)
    first = np.cumsum(halves) - halves
    out = np.zeros(int(halves.sum()) * HALF + WIDTH, np.uint8)
    shift = np.repeat(first * HALF + WIDTH - offsets[:-1], size)  # no filter reaches from one text into the next
    out[np.arange(len(data)) + shift] = data
    return out, first, halves


def repeats(data: np.ndarray) -> np.ndarray:
    """For how many bytes in a row (up to RUN, as a share of it) eight bytes have repeated earlier ones nearby."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(len(data), np.float32)
    gram = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(np.uint64).ravel()
    again = np.zeros(n, bool)
    for lag in range(3, LAG + 1):
        again[lag:] |= gram[lag:] == gram[:-lag]
    again &= gram != 0
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(again, -1, place))
    run = np.where(again, np.minimum(place - last, RUN), 0)
    out = np.zeros(len(data), np.float32)
    out[:n] = run / RUN
    return out


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.embed[0] = 0
        self.filters = rng.normal(0, 0.3, (WIDTH, EMBEDDING, FILTERS)).astype(np.float32)
        self.repeat = rng.normal(0, 0.5, FILTERS).astype(np.float32)
        self.shift = np.full(FILTERS, -0.1, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    names = ("embed", "filters", "repeat", "shift", "out", "base")

    def halves(self, data: np.ndarray, where: bool = False):
        """The filters' largest values in each half chunk, and where they are."""
        tables = np.einsum("be,wef->wbf", self.embed, self.filters).astype(np.float32)
        again = repeats(data)
        n = (len(data) - WIDTH) // HALF
        top = np.empty((n, FILTERS), np.float32)
        place = np.empty((n, FILTERS), np.int64) if where else None
        step = 64
        for k in range(0, n, step):
            a, b = k * HALF, min(n, k + step) * HALF
            z = again[a:b, None] * self.repeat
            for w in range(WIDTH):
                z += tables[w].take(data[a + w: b + w], axis=0)
            z = z.reshape(-1, HALF, FILTERS)
            if where:
                place[k: k + step] = z.argmax(axis=1)
            top[k: k + step] = z.max(axis=1)
        return top, place, again

    def features(self, top: np.ndarray, first: np.ndarray, halves: np.ndarray):
        """Largest and mean value over the overlapping chunks of each text."""
        value = np.maximum(top + self.shift, 0)
        chunk = value.copy()
        chunk[:-1] = np.maximum(value[:-1], value[1:])
        last = first + halves - 1
        chunk[last] = value[last]
        return np.hstack([np.maximum.reduceat(chunk, first), np.add.reduceat(chunk, first) / halves[:, None]])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One probability per text; a text is worked through in slices of bounded size."""
        out = []
        for i, j in ranges_of(offsets):
            low, high = int(offsets[i]), int(offsets[j])
            if high - low > 2 * STEP:
                # A very long text: chunks of all slices together, each slice with the half chunk before it for what reaches back.
                halves = np.array([-(-(WIDTH + high - low + PAD) // HALF)])
                laid = np.zeros(int(halves[0]) * HALF + WIDTH, np.uint8)
                laid[WIDTH: WIDTH + high - low] = data[low:high]
                tops = []
                for a in range(0, int(halves[0]), STEP // HALF):
                    lead = min(a, -(-(WIDTH + LAG + RUN) // HALF))
                    piece = laid[(a - lead) * HALF: (a + STEP // HALF) * HALF + WIDTH]
                    tops.append(self.halves(piece)[0][lead:])
                top = np.concatenate(tops)
                first = np.zeros(1, np.int64)
            else:
                laid, first, halves = _layout(data[low:high], offsets[i: j + 1] - low)
                top = self.halves(laid)[0]
            out.append(self.features(top, first, halves) @ self.out + self.base)
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def gradient(self, texts: list[bytes], target: np.ndarray):
        offsets = np.append(0, np.cumsum([len(t) for t in texts]))
        laid, first, halves = _layout(np.frombuffer(b"".join(texts), np.uint8), offsets)
        top, place, again = self.halves(laid, where=True)
        value = np.maximum(top + self.shift, 0)
        n = len(value)
        # The half from which each chunk has its value.
        source = np.repeat(np.arange(n)[:, None], FILTERS, 1)
        chunk = value.copy()
        more = value[1:] > value[:-1]
        last = first + halves - 1
        inner = np.ones(n, bool)
        inner[last] = False
        take = more & inner[:-1, None]
        chunk[:-1][take] = value[1:][take]
        source[:-1][take] += 1
        owner = np.repeat(np.arange(len(texts)), halves)
        most = np.maximum.reduceat(chunk, first)
        mean = np.add.reduceat(chunk, first) / halves[:, None]
        x = np.hstack([most, mean])
        p = 1 / (1 + np.exp(-np.clip(x @ self.out + self.base, -30, 30)))
        error = ((p - target) / len(texts)).astype(np.float32)
        d_x = error[:, None] * self.out
        d_chunk = d_x[:, FILTERS:][owner] / halves[owner, None]
        is_most = chunk == most[owner]
        rank = np.cumsum(is_most, axis=0)
        before = np.vstack([np.zeros((1, FILTERS), rank.dtype), rank])[first]
        is_most &= rank == before[owner] + 1  # the first of equals
        d_chunk = d_chunk + is_most * d_x[:, :FILTERS][owner]
        d_value = np.zeros_like(value)
        np.add.at(d_value, (source, np.arange(FILTERS)[None, :]), d_chunk)
        d_value *= value > 0
        at = place + np.arange(n)[:, None] * HALF
        grads = {"out": x.T @ error, "base": np.array([error.sum()]), "shift": d_value.sum(axis=0),
                 "repeat": (d_value * again[at]).sum(axis=0)}
        d_embed, d_filters = np.zeros_like(self.embed), np.zeros_like(self.filters)
        which = np.repeat(np.arange(FILTERS)[None, :], n, 0)
        for w in range(WIDTH):
            d_table = np.zeros((256, FILTERS), np.float32)
            np.add.at(d_table, (laid[at + w], which), d_value)
            d_filters[w] = self.embed.T @ d_table
            d_embed += d_table @ self.filters[w].T
        d_embed[0] = 0
        loss = -np.mean(np.where(target == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9)))
        return loss, grads | {"embed": d_embed, "filters": d_filters}

    def fit(self, texts: list[bytes], target: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.01, seed: int = 1):
        """Adam on shuffled batches, both labels with the same weight in each."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(getattr(self, k)) for k in self.names}
        second = {k: np.zeros_like(getattr(self, k)) for k in self.names}
        groups = [np.flatnonzero(target == c) for c in (0, 1)]
        if not all(map(len, groups)):
            self.out[:] = 0
            self.base[:] = (4 if len(groups[1]) else -4) if len(texts) else 0
            return self
        t, size = 0, max(map(len, groups))
        for epoch in range(epochs):
            order = [np.concatenate([rng.permutation(g) for _ in range(-(-size // len(g)))])[:size] for g in groups]
            for k in range(0, size, batch // 2):
                some = np.concatenate([o[k: k + batch // 2] for o in order])
                _, grads = self.gradient([texts[i] for i in some], target[some].astype(np.float32))
                t += 1
                pace = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
                for name in self.names:
                    g = grads[name].astype(np.float32)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    move = first[name] / (1 - 0.9**t) / (np.sqrt(second[name] / (1 - 0.99**t)) + 1e-7)
                    setattr(self, name, (getattr(self, name) - pace * move).astype(np.float32))
        return self


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def _excerpts(batches, most):
    """Texts for learning: of a long one, stretches from all over it."""
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        out = []
        for i in range(len(offsets) - 1):
            text = data[offsets[i]: offsets[i + 1]]
            if len(text) > most:
                rng = np.random.default_rng(len(text))
                at = np.sort(rng.integers(0, len(text) - 512, most // 512))
                text = np.concatenate([text[a: a + 512] for a in at])
            out.append(text.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column("label")], names=["text", "label"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: Column | None = None,
          per_label: int = 1500, most: int = 8192) -> Network:
    """A network for ``labels`` (doc_id, ``label`` of 0 or 1), from at most ``per_label`` documents of each label.

    They are those with the smallest hashes of their ids, without the ``held_out``; of texts with more than
    ``most`` bytes stretches from all over the text are used.  So at most 2 * per_label * most bytes reach the driver.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        "doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    known = known.filter("label = other").drop("other")  # nothing is learned from labels that contradict each other
    if held_out is not None:
        known = known.filter(~held_out)
    picked = smallest_hashes(known, "label", per_label)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(picked), "doc_id")  # at most 2 * per_label rows
    found = texts.mapInArrow(lambda b: _excerpts(b, most), "text binary, label int").toPandas()
    found = found.sort_values(["label", "text"], kind="stable")[: 2 * per_label]
    return Network().fit(found["text"].tolist(), found["label"].to_numpy())


def score(docs: DataFrame, network: Network) -> DataFrame:
    """The columns of ``docs`` and ``quality_score``, the probability of label 1, for every whole text.

    Null texts are empty; an empty text has the probability that the network gives to no input at all.  A column of that name is
    replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("quality_score")
    model = docs.sparkSession.sparkContext.broadcast(network)

    @tidied
    def run(batches):
        for batch in batches:
            found = model.value.scores(*texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "quality_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, network: Network, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text has a probability of ``least`` or more, with all their columns."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(network)

    @tidied
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.value.scores(*texts_of(batch.column("text"))) >= least))

    return docs.mapInArrow(run, docs.schema)
