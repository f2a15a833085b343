"""Language of texts by their nearest centroid.

A text is a vector of hashed letter trigrams, weighted by TF-IDF and normalised.  The vectors of a language's sample
are clustered, and a text gets the language of the centroid with the largest cosine.  A centroid rejects texts that are
farther from it than nearly all of its own sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from motifmill.llm.tables import prepare, smallest_hashes
from motifmill.llm.text import ranges_of, texts_of

#: Trigrams are hashed to so many numbers.
DIMENSIONS = 1 << 12
UNKNOWN = "und"
# Letters and bytes of other scripts stand for themselves, all else for a space.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _grams(data: np.ndarray) -> np.ndarray:
    """The hashed trigram that begins at each byte but the last two; -1 for three spaces."""
    x = _LETTER[data].astype(np.uint32)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    out = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)).astype(np.int32)
    out[code == 0x202020] = -1
    return out


def counts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram counts, one row per text."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    if len(data) < 3:
        return out
    grams = _grams(data)
    row = np.repeat(np.arange(n), np.diff(offsets))[: len(grams)]
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(grams)]
    ok = (grams >= 0) & (np.arange(len(grams)) + 3 <= ends)
    return np.bincount(row[ok] * DIMENSIONS + grams[ok], minlength=n * DIMENSIONS).reshape(n, -1).astype(np.float32)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Centroids:
    weights: np.ndarray
    vectors: np.ndarray
    names: list[str]
    radius: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray):
        """(nearest centroid, cosine, accepted) of each text."""
        best, cosine = [], []
        for i, j in ranges_of(offsets):
            for k in range(i, j, 128):
                m = min(k + 128, j)
                low, high = int(offsets[k]), int(offsets[m])
                if high - low > 1 << 22:  # one very long text: its counts are added up
                    counts = sum(counts_of(data[a: min(high, a + (1 << 21) + 2)], np.array([0, min(high, a + (1 << 21) + 2) - a]))
                                 for a in range(low, high, 1 << 21))
                else:
                    counts = counts_of(data[low:high], offsets[k: m + 1] - low)
                near = _normal(np.log1p(counts) * self.weights) @ self.vectors.T
                best.append(near.argmax(axis=1))
                cosine.append(near.max(axis=1))
        best = np.concatenate(best) if best else np.zeros(0, np.int64)
        cosine = np.concatenate(cosine) if cosine else np.zeros(0)
        return best, np.clip(cosine.astype(np.float64), 0, 1), cosine >= self.radius[best] if len(self.radius) else cosine > 2


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (unit centroids, index of each row's)."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        centre = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centre[c] for c in range(len(centre))])
        centre = _normal(centre)
    return centre, (x @ centre.T).argmax(axis=1)


def fit(counts: np.ndarray, langs: list[str], k: int = 4, quantile: float = 0.002) -> Centroids:
    df = (counts > 0).sum(axis=0)
    weights = np.log((1 + len(counts)) / (1 + df)).astype(np.float32) + 0.01
    x = _normal(np.log1p(counts) * weights)
    lang = np.array(langs)
    vectors, names, radius = [], [], []
    for name in sorted(set(langs)):
        own = x[lang == name]
        centre, which = cluster(own, k)
        for c in range(len(centre)):
            if (which == c).any():
                vectors.append(centre[c])
                names.append(name)
                radius.append(0.8 * np.quantile(own[which == c] @ centre[c], quantile))
    return Centroids(weights, np.array(vectors, np.float32).reshape(-1, DIMENSIONS), names, np.array(radius))


def _sparse(batches):
    for batch in batches:
        data, offsets = texts_of(pc.utf8_lower(batch.column("text").cast(pa.large_string())))
        where, value = [], []
        for i in range(batch.num_rows):
            counts = counts_of(data[offsets[i]: offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0]
            at = np.flatnonzero(counts)
            where.append(at.astype(np.uint16).tobytes())
            value.append(counts[at].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(where, pa.binary()), pa.array(value, pa.binary())],
                                         names=["lang", "where", "value"])


def learn(docs: DataFrame, held_out: Column | None = None, per_language: int = 500, most: int = 8000, k: int = 4) -> Centroids:
    """Centroids from ``docs`` (doc_id, text, lang), without the ``held_out``.

    At most ``per_language`` documents of each language are used, those with the smallest hashes of their ids, and at most
    ``most`` altogether (shared evenly by the languages), so the driver gets at
    most ``most`` vectors of trigram counts.  Null languages and texts are left out.
    """
    prepare(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and text is not null and lang is not null")
    if held_out is not None:
        known = known.filter(~held_out)
    n = known.select("lang").distinct().count()
    each = max(1, min(per_language, most // max(1, n)))
    picked = smallest_hashes(known.select("doc_id", "lang"), "lang", each).distinct().limit(most)
    found = known.join(F.broadcast(picked), ["doc_id", "lang"]).mapInArrow(_sparse, "lang string, where binary, value binary").toPandas()
    found = found.sort_values(["lang", "where", "value"], kind="stable")
    counts = np.zeros((len(found), DIMENSIONS), np.float32)
    for row, (at, value) in enumerate(zip(found["where"], found["value"])):
        counts[row, np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
    return fit(counts, found["lang"].tolist(), k)


def predict(docs: DataFrame, model: Centroids, reject: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) per row of ``docs`` (doc_id, text), repeated rows included.

    ``score`` is the cosine with the nearest centroid.  Null texts and texts without a letter are ``und`` with a
    score of 0; so is every text if nothing was learned; with ``reject``, texts too far from their centroid too.
    """
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = np.array([*held.value.names, UNKNOWN], object)
        for batch in batches:
            column = batch.column("text").cast(pa.large_string())
            letters = np.asarray(pc.match_substring_regex(column, r"\pL").fill_null(False))
            best, score, near = held.value.scores(*texts_of(pc.utf8_lower(column))) if len(names) > 1 else (
                np.zeros(len(column), int), np.zeros(len(column)), np.zeros(len(column), bool))
            near = near & letters
            known = letters if not reject else near
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[np.where(known, best, len(names) - 1)], pa.string()),
                 pa.array(np.where(letters, score, 0.0)), pa.array(near)], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, accepted boolean")
