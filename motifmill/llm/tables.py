"""Reading the tables, and shipping the package to the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from motifmill.functions.scan import ranked
from motifmill.session import ship_package, stage


#: Bytes of an Arrow batch that goes to a Python task, unless the session has its own setting: a task's memory
#: is then bounded by a few of them, whatever the length of the texts (a longer text comes alone).
BATCH_BYTES = 8 << 20
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """What Python tasks need: the package on the workers, and batches of bounded size."""
    ship_package(spark)
    if spark.conf.get(_SETTING, None) == _DEFAULT:
        spark.conf.set(_SETTING, batch_bytes)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``, so that no other column can clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def parts(spark: SparkSession) -> int:
    """As many parts as the session shuffles into: the cluster's own measure of parallelism."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text) with a unique ``key`` in the order of doc_id; the key is doc_id where it can be.

    If a doc_id is null or occurs more than once, rows that repeat both doc_id and text are put
    together, and the rest is numbered by doc_id (null first) and the hash of the text.
    """
    docs = texts(docs)
    odd = docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(1).count()
    if not odd:
        return docs.select(F.col("doc_id").alias("key"), "doc_id", "text")
    docs = docs.dropDuplicates(["doc_id", "text"]).withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    docs = docs.withColumn("none", F.col("text").isNull())
    # Texts are hashed again for the join, and not written.
    numbered = stage(ranked(docs.select(F.struct("doc_id", "h", "none").alias("place")), "place", "key"), "keys")
    numbered = numbered.select("key", F.col("place.doc_id").alias("d"), F.col("place.h").alias("g"), F.col("place.none").alias("m"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("none") == F.col("m"))
    return docs.join(numbered, same).select("key", "doc_id", "text")


def range_bounds(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 doc_ids that cut the documents into parts of about the same number."""
    if n < 2:
        return []
    found = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [k / n for k in range(1, n)], max(0.1 / n, 1e-4))
    return sorted({int(x) for x in found})


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with all its columns and rows and a unique key in the order of doc_id, and the key's name.

    The key is doc_id where it can be; otherwise rows are numbered by doc_id (null first), in a written table.
    """
    name = "key"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    odd = docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(1).count()
    if not odd:
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    docs = stage(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    order = docs.select(F.struct(F.col("doc_id").alias("d"), F.col(name).alias("was")).alias("at"))
    order = ranked(order, "at", "place").select(F.col("at.was").alias("was"), "place")
    columns = [F.col(f"`{c}`") for c in docs.columns if c != name]
    return docs.join(order, docs[name] == order["was"]).select(*columns, order["place"].alias(name)), name


#: Values whose counts are sent to every task.
MANY_VALUES = 1 << 16


def smallest_hashes(ids: DataFrame, by: str, each: int) -> DataFrame:
    """(doc_id, ``by``) of the ``each`` rows with the smallest hashes of doc_id, per value of ``by``.

    Rows whose hash is too large for that by far are left out before rows of one value meet, so a value with
    any number of rows brings a few times ``each`` together.
    """
    counts = stage(ids.groupBy(by).agg(F.count("*").alias("of_value")), "counts")
    if counts.count() <= MANY_VALUES:  # so that rows of one value needn't meet before most are left out
        counts = F.broadcast(counts)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    few = ids.join(counts, by).withColumn("place", place).filter(F.col("place") * F.col("of_value") <= 4 * each + 40)
    order = Window.partitionBy(by).orderBy("place", "doc_id")
    return few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= each).select("doc_id", by)


#: Slots of the table by which rows are told apart that a small set of keys asks for: at most 2**20 numbers.
SLOTS = 1 << 20


def asked_for(docs: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: all rows whose ``key`` is among ``keys`` (and a few more), and rows whose key isn't.

    The slots of the keys' hashes are broadcast, so that texts that nothing is joined to needn't be shuffled.
    """
    slot = lambda of: F.pmod(F.xxhash64(of), F.lit(SLOTS))
    slots = keys.select(slot(keys[key]).alias("slot")).distinct()
    same = slot(docs[key]) == slots["slot"]
    return docs.join(F.broadcast(slots), same, "left_semi"), docs.join(F.broadcast(slots), same, "left_anti")
