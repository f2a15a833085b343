"""Corpus statistics (AGG1-8, AGG28, AGG32, WIN18, TOP4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from motifmill.functions import scalars as S
from motifmill.functions.scan import running
from motifmill.session import stage

TOKEN_TYPES = {"multinote": ("N", "U"), "tempo": ("T",), "position": ("P",), "measure": ("M",),
               "track": ("R",)}


def tokens_per_piece(tokens: DataFrame) -> DataFrame:
    """AGG2."""
    return tokens.groupBy("piece_id").agg(F.count("*").alias("n_tokens"))


def average_tokens(tokens: DataFrame) -> DataFrame:
    """AGG2: mean number of tokens per piece."""
    return tokens_per_piece(tokens).agg(F.avg("n_tokens").alias("avg_tokens"))


def max_mps_bound(tokens: DataFrame) -> DataFrame:
    """AGG3: an upper bound of the mps numbers of any piece."""
    kind = F.col("type")
    per_piece = tokens.groupBy("piece_id").agg(
        (2 * F.count_if(kind.isin("M", "P")) + F.count_if(kind == "T") + 4).alias("bound"))
    return per_piece.agg(F.max("bound").alias("max_mps_number"))


def time_signatures_used(tokens: DataFrame) -> DataFrame:
    """AGG4: the distinct measure tokens."""
    return tokens.filter("type = 'M'").select("numer", "denom", "text").distinct()


def supported_used(tokens: DataFrame, tpq: int = 12) -> DataFrame:
    """SET3: supported time signatures that occur."""
    supported = S.supported_time_signatures(tokens.sparkSession, tpq).select("numer", "denom")
    return time_signatures_used(tokens).select("numer", "denom").intersect(supported)


def token_type_counts(tokens: DataFrame) -> DataFrame:
    """AGG5: tokens of each type, per piece."""
    return tokens.groupBy("piece_id").agg(
        *[F.count_if(F.col("type").isin(*kinds)).alias(n) for n, kinds in TOKEN_TYPES.items()],
        F.count("*").alias("all"))


def token_type_totals(tokens: DataFrame) -> DataFrame:
    """AGG5: tokens of each type, over all pieces."""
    return tokens.agg(
        *[F.count_if(F.col("type").isin(*kinds)).alias(n) for n, kinds in TOKEN_TYPES.items()],
        F.count("*").alias("all"))


def instrument_distribution(tokens: DataFrame) -> DataFrame:
    """AGG6: track tokens per instrument, with zeros, and the name (SCL20)."""
    counts = tokens.filter("type = 'R'").groupBy("instrument").agg(F.count("*").alias("n"))
    return (S.instruments(tokens.sparkSession).join(counts, "instrument", "left")
            .withColumn("n", F.coalesce("n", F.lit(0))))


def shape_distribution(tokens: DataFrame) -> DataFrame:
    """AGG7: how often each shape occurs, and its share; the two single-note shapes included."""
    text = (F.when(F.col("shape").isNotNull(), F.col("shape"))
            .when(F.col("is_cont") == 1, "0,0,1~;").otherwise("0,0,1;"))
    counts = (tokens.filter(F.col("type").isin("N", "U")).groupBy(text.alias("shape"))
              .agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("total"))
    # One row on the right.
    return counts.join(F.broadcast(total)).select(
        "shape", "n", (F.col("n") / F.col("total")).alias("share"))


def top_shapes(distribution: DataFrame, n: int) -> DataFrame:
    """TOP4: the most frequent shapes of more than one note."""
    return (distribution.filter(~F.col("shape").isin("0,0,1;", "0,0,1~;"))
            .orderBy(F.desc("n"), F.desc("shape")).limit(n))


def describe(values: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """AGG8: count, mean, std, min, quartiles (linear, exact) and max of each named series.

    Quartiles come from running counts over the ranges of a range sort, which hold about the
    same number of distinct values whatever their distribution, so no task holds a whole series.
    """
    v = (values.select(F.col(name).alias("name"), F.col(value).cast("double").alias("value"))
         .filter(F.col("value").isNotNull() & ~F.isnan("value")))
    moments = v.groupBy("name").agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    counts = v.groupBy("name", "value").agg(F.count("*").alias("n"))
    # A handful of series: one row each.
    placed = counts.join(F.broadcast(moments.select("name", "count")), "name")
    placed = stage(placed.orderBy("name", "value").withColumn("range", F.spark_partition_id()), "ranges")
    ranked = running(placed, ["name"], ["value"], F.col("range"), sums={"upto": F.col("n")})

    quartiles = {}
    for label, q in (("25%", 0.25), ("50%", 0.5), ("75%", 0.75)):
        at = (F.col("count") - 1) * q
        low, high = F.floor(at), F.ceil(at)
        first = F.col("upto") - F.col("n")
        pick = lambda r: F.max(F.when((first <= r) & (r < F.col("upto")), F.col("value")))
        part = F.max(at - low)
        quartiles[label] = pick(low) + (pick(high) - pick(low)) * part
    points = ranked.groupBy("name").agg(*[c.alias(n) for n, c in quartiles.items()])
    return moments.join(F.broadcast(points), "name").select(
        "name", "count", "mean", "std", "min", "25%", "50%", "75%", "max")


def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns to ``(piece_id, name, value)``."""
    cast = df.select("piece_id", *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(["piece_id"], columns, "name", "value")


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """JOB7: the description of tokens per piece, by type."""
    counts = token_type_counts(tokens)
    return describe(unpivot(counts, [*TOKEN_TYPES, "all"]))


def shape_size_histogram(tokens: DataFrame) -> DataFrame:
    """AGG28: how many notes the multi-notes of a corpus hold; ``describe_shape_sizes`` sums it up."""
    size = F.when(F.col("shape").isNotNull(),
                  F.length("shape") - F.length(F.replace(F.col("shape"), F.lit(";"), F.lit(""))))
    return (tokens.filter(F.col("type").isin("N", "U"))
            .groupBy(F.coalesce(size, F.lit(1)).alias("shape_size")).agg(F.count("*").alias("n")))


def describe_shape_sizes(tokens: DataFrame) -> DataFrame:
    """AGG28: the description of the sizes of the distinct shapes that occur."""
    distinct = tokens.filter(F.col("type").isin("N", "U")).select("shape").distinct()
    size = F.length("shape") - F.length(F.replace(F.col("shape"), F.lit(";"), F.lit("")))
    return describe(distinct.select(F.lit("shape_size").alias("name"), F.coalesce(size, F.lit(1)).alias("value")))


def _share_order(items):
    return Window.partitionBy("attr").orderBy(F.desc("n"), "item")


def truncate_top_p(dist: DataFrame, threshold: float) -> DataFrame:
    """WIN18: per ``attr``, the most likely items while their summed share stays below ``threshold``.

    At least the top item stays.  ``dist`` is ``(attr, item, n)`` over a vocabulary.
    """
    w = _share_order(dist)
    total = F.sum("n").over(Window.partitionBy("attr"))
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total
    ranked = dist.withColumns({"p": F.col("n") / total, "upto": upto, "pos": F.row_number().over(w)})
    keep = F.lit(True) if threshold >= 1 else (F.col("upto") < threshold) | (F.col("pos") == 1)
    return ranked.filter(keep).select("attr", "item", "n", "p")


def truncate_top_k(dist: DataFrame, threshold: float) -> DataFrame:
    """WIN18: per ``attr``, the ``max(1, int(size * threshold))`` most likely items."""
    size = F.count("*").over(Window.partitionBy("attr"))
    ranked = dist.withColumns({"pos": F.row_number().over(_share_order(dist)), "size": size})
    k = F.greatest(F.lit(1), F.floor(F.col("size") * threshold))
    return ranked.filter(F.col("pos") <= k).select("attr", "item", "n")
