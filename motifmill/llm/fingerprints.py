"""Fingerprints of documents: the k smallest distinct hashes of their word shingles (bottom-k sketches).

Built of column expressions only.  A sketch is a sorted array of 48-bit hashes.  Sketches of parts give the sketch of
the whole (``merged``), and two of them estimate how much of their union, or of one of them, is common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from motifmill.llm.tables import keyed, parts, range_bounds

SIZE, WIDTH, BITS = 256, 5, 48
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def codes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def hashes(codes_: str, width: int = WIDTH) -> Column:
    """Hashes of the runs of ``width`` words; of the whole sequence if it is shorter; none without words.

    ``codes_`` names a column: an expression would be evaluated anew for every run.
    """
    cut = lambda c: F.shiftrightunsigned(c, 64 - BITS)
    n = F.size(codes_)
    return (F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: cut(
                F.xxhash64(*(F.get(codes_, i + k) for k in range(width))))))
            .when(n > 0, F.array(cut(F.xxhash64(codes_)))).otherwise(F.array().cast("array<bigint>")))


def bottom(values: Column, k: int = SIZE) -> Column:
    return F.slice(F.array_distinct(F.sort_array(values)), 1, k)


def merged(a: Column, b: Column, k: int = SIZE) -> Column:
    """The sketch of what either sketch stands for."""
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of the union that both have; 1 if both are empty."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    n = F.size(a).cast("double")
    return F.when(F.size(a) < k, n).otherwise((n - 1) * float(1 << BITS) / F.try_element_at(a, F.lit(-1)))


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; 1 if ``a`` is empty."""
    share = resemblance(a, b, k) * distinct_count(merged(a, b, k), k) / F.nullif(distinct_count(a, k), F.lit(0.0))
    return F.coalesce(F.least(share, F.lit(1.0)), F.lit(1.0))


def text_of(sketch: Column) -> Column:
    """Twelve hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def of_groups(sketches: DataFrame, *groups: str, sketch: str = "sketch", k: int = SIZE) -> DataFrame:
    """One sketch for each group of parts.

    Only the k smallest hashes of a group in each task are shuffled, so a group may have any number of parts.
    """
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy("h"))
    few = (sketches.select(*groups, F.explode(sketch).alias("h")).distinct()
           .withColumn("rank", rank).filter(F.col("rank") <= k))
    return few.groupBy(*groups).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def fingerprints(docs: DataFrame, k: int = SIZE, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_chars, n_shingles, sketch) per row of ``docs`` (doc_id, text); null texts are empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), codes(words(F.col("text"))).alias("codes")).select(
        "doc_id", "n_chars", bottom(hashes("codes", width), k).alias("sketch")).select(
        "doc_id", "n_chars", distinct_count(F.col("sketch"), k).alias("n_shingles"), "sketch")


def _with_next(rows: DataFrame) -> tuple[DataFrame, Window]:
    """``rows`` (key, text) by part with a row more in each: the document that follows its last one.

    Documents follow each other by descending key, and the first follows the last.  Parts are ranges of keys,
    so a text is shuffled once; the rows that are added are as many as parts.
    """
    bounds = range_bounds(rows.withColumnRenamed("doc_id", "was").withColumnRenamed("key", "doc_id"),
                          parts(rows.sparkSession))
    part = F.lit(0) if not bounds else F.size(F.filter(
        F.array(*(F.lit(b) for b in bounds)), lambda b: b < F.col("key")))
    rows = rows.withColumn("part", part.cast("int")).withColumn("extra", F.lit(False))
    edges = sorted((r["part"], r["top"]) for r in rows.groupBy("part").agg(F.max("key").alias("top")).collect())
    if edges:
        after = {top: edges[(k + 1) % len(edges)][0] for k, (_, top) in enumerate(edges)}
        goes = F.element_at(F.create_map(*(F.lit(x) for pair in after.items() for x in pair)), F.col("key"))
        more = rows.filter(F.col("key").isin(list(after))).withColumn("part", goes.cast("int")).withColumn("extra", F.lit(True))
        rows = rows.union(more)
    return rows, Window.partitionBy("part").orderBy("extra", F.desc("key"))


def compare_edited(docs: DataFrame, k: int = SIZE, width: int = WIDTH) -> DataFrame:
    """Fingerprints of texts and of edited texts, whose last half is taken from the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles,
    edited_contained) per document of ``docs`` (doc_id, text).  The next document has the next smaller doc_id, after the smallest
    comes the largest.  Null texts are empty; of rows that repeat doc_id and text there is one; rows that
    repeat only doc_id follow each other by the hash of the text; a null doc_id is smaller than all others.
    """
    rows, window = _with_next(keyed(docs).select("key", "doc_id", F.coalesce("text", F.lit("")).alias("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    kept = rows.select(
        "part", "extra", "key", "doc_id", "text", F.length("text").alias("n_chars"),
        F.lead("text").over(window).alias("next")).select(
        "part", "extra", "key", "doc_id", "text", "n_chars",
        F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half),
                 F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)).alias("edited"))
    cut = kept.select(
        "part", "extra", "key", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        codes(words(F.col("text"))).alias("own"), codes(words(F.col("edited"))).alias("other"))
    sketched = cut.select(
        "part", "extra", "key", "doc_id", "n_chars", "edited_sha256",
        bottom(hashes("own", width), k).alias("a"), bottom(hashes("other", width), k).alias("b"))
    a, b = F.col("a"), F.col("b")
    return sketched.withColumn("next", F.lead("a").over(window)).filter(~F.col("extra")).select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        text_of(a).alias("fingerprint"), text_of(b).alias("edited_fingerprint"),
        resemblance(a, b, k).alias("near_edited"),
        resemblance(a, F.col("next"), k).alias("near_next"),
        distinct_count(a, k).alias("n_shingles"), containment(b, a, k).alias("edited_contained"))
