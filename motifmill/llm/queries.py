"""The registered queries of the operators over text, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from motifmill.llm import (
    bpe_automaton, decontaminate, fingerprints, hard_negatives, html_template, language, license_scan, mixing, ngram_join, oracle, quality,
    suffix_dedup, token_alignment, token_files,
)
from motifmill.llm.tables import documents, texts


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that share 85 % of their distinct four-word shingles, as components."""
    return ngram_join.near_duplicates(documents(spark, folder), width=4, percent=85).select(
        "doc_id", "n_shingles", "component_id")


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes that repeat an earlier string of 100 bytes, removed."""
    return suffix_dedup.remove_repeats(documents(spark, folder), as_text=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def vocabulary() -> str:
    """Where the vocabulary file of the byte-level queries is, on the driver and the executors alike."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of whole texts and the texts decoded from them."""
    return bpe_automaton.encode_decode(documents(spark, folder), vocabulary(), with_ids=False)


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids written as binary files and read back."""
    place = token_files.scratch_folder(spark)
    token_files.write_tokens(documents(spark, folder), place, vocabulary(), end_id=2, vocabulary=50257)
    return token_files.read_tokens(spark, place).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Bottom-k sketches of texts, of their edited texts, and their likeness."""
    return fingerprints.compare_edited(documents(spark, folder))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and notices in whole texts."""
    return license_scan.summary(documents(spark, folder))


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a tenth of it edited."""
    return decontaminate.find_items(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of label 1 for whole texts; a fifth of the labels is held out."""
    docs = texts(documents(spark, folder))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held_out = quality.remainder(F.col("doc_id"), 5) == 0
    network = quality.learn(docs, labels, held_out=held_out)
    return quality.score(docs, network).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of whole texts; a quarter of the documents is held out from learning."""
    docs = documents(spark, folder)
    held_out = quality.remainder(F.col("doc_id"), 4) == 2
    model = language.learn(docs, held_out)
    return language.predict(docs, model, reject=False).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of whole web pages."""
    return html_template.extract(spark.read.parquet(f"{folder}/pages.parquet"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of two tokenizers over whole texts, in groups between common ends, and how often their ids are linked."""
    import public_tokenizers

    aligned = token_alignment.align(documents(spark, folder), vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.linked_counts(aligned).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of all sources takes of each document."""
    return mixing.mix(documents(spark, folder), weights=(5, 2, 1), share=1.5, most=2.0)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of other labels within 80 to 100 % of an anchor's positives' scores."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_ngram_join,
        op2_decontaminate,
        op3_fingerprints,
        op4_suffix_dedup,
        op5_license_scan,
        op6_bpe,
        op7_quality,
        op8_token_files,
        op9_html,
        op10_language,
        op11_alignment,
        op12_mixing,
        op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.QUERIES)
