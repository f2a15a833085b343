import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use inside.
    *(T.StructField(c, T.StringType()) for c in ("key", "rep", "n", "score", "part", "start", "quality_score")),
])
SYLLABLES = ["the", "an", "tion", "er", "ou", "éa", "st", "ing", "ver", "ñe"]


@pytest.fixture
def docs_of(spark):
    """Documents with columns that clash with the operators' own."""
    def make(rows, parts=3):
        full = [(i, t, "en", "s", None if t is None else len(t), "k", "r", "n", "s", "p", "b", "q") for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)
    return make


def words(rng, n):
    return [" ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))][0]


@pytest.fixture
def corpus():
    """Small documents with exact and near copies, shared passages, empty and null texts."""
    rng = random.Random(5)
    out = [words(rng, rng.choice([1, 3, 8, 40, 90])) for _ in range(60)]
    line = words(rng, 14)
    base = words(rng, 60)
    for k in range(25):  # near copies with one to several words changed
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = words(rng, 1)
        out.append(" ".join(w))
    out += [out[3]] * 6 + [line + "\n" + words(rng, 30) for _ in range(20)] + ["", None, " \n ", "word", "Word"]
    out.append(out[40].upper())
    rng.shuffle(out)
    return list(enumerate(out))


EDGES = [(7, None), (7, None), (None, "a b c d e f"), (7, "x y"), (7, "x y"), (7, "y x"), (None, None), (3, ""), (4, "ünï ¿? \x00 zero"),
         (5, "a" * 5000), (6, "a b " * 40000)]
