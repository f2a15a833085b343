"""A corpus from raw documents to token ids: five stages, each on all rows that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motifmill.llm import bpe_automaton, decontaminate, ngram_join, quality, suffix_dedup
from motifmill.llm.queries import vocabulary
from motifmill.llm.tables import prepare
from motifmill.session import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network doesn't reject; it learns from the labels of these documents.

    As the first stage it asks for smaller batches than single operators do: what one session's workers and caches hold adds up.
    """
    prepare(spark, batch_bytes=1 << 20)
    network = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, network)


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by 80 % common shingles of five words."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that stand earlier in the corpus, to whole characters."""
    return suffix_dedup.without_repeats(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, and the texts decoded from them."""
    return bpe_automaton.encode_decode(docs, vocabulary()).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram jaccard join", one_of_a_kind),
    ("suffix-array dedup", no_repeats),
    ("benchmark decontamination", no_benchmark),
    ("bpe encoding and decoding", tokens),
]

#: The classifier, the search with edits and the merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), step.__name__)
    return docs
