"""Train, valid and test splits by path (JON3, JON14, SET6-7, AGG30, TOP6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def path_suffixes(pieces: DataFrame) -> DataFrame:
    """Every component-aligned suffix of every path."""
    parts = F.split("path", "/")
    n = F.size(parts)
    suffix = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, k, n), "/"))
    return pieces.select("piece_id", F.explode(suffix).alias("path_suffix"))


def apply_splits(pieces: DataFrame, splits: DataFrame) -> DataFrame:
    """JON3: ``(piece_id, path, split)``; a path in both lists is test only (K9).

    Suffix matching as an equi-join, whatever the size of the lists.
    """
    listed = splits.filter("trim(path_suffix) != ''").select(
        F.trim("path_suffix").alias("path_suffix"), "split")
    # 'test' sorts before 'valid'.
    found = (path_suffixes(pieces).join(listed, "path_suffix")
             .groupBy("piece_id").agg(F.min("split").alias("split")))
    return pieces.join(found, "piece_id", "left").select(
        "piece_id", "path", F.coalesce("split", F.lit("train")).alias("split"))


def exclude_paths(pieces: DataFrame, *lists: DataFrame) -> DataFrame:
    """SET6: pieces whose path ends in none of the listed suffixes."""
    excluded = lists[0].select("path_suffix")
    for other in lists[1:]:
        excluded = excluded.union(other.select("path_suffix"))
    hit = path_suffixes(pieces).join(excluded, "path_suffix", "left_semi")
    return pieces.join(hit, "piece_id", "left_anti")


def split_overlap(splits: DataFrame) -> DataFrame:
    """SET7: suffixes in both lists."""
    of = lambda name: splits.filter(F.col("split") == name).select("path_suffix")
    return of("test").intersect(of("valid"))


def split_report(pieces: DataFrame, splits: DataFrame) -> DataFrame:
    """AGG30: sizes per split; suffixes without a piece, listed twice, or in both lists."""
    sizes = apply_splits(pieces, splits).groupBy(F.col("split").alias("item")).agg(F.count("*").alias("n"))
    unmatched = (splits.select("path_suffix").distinct()
                 .join(path_suffixes(pieces), "path_suffix", "left_anti"))
    twice = splits.groupBy("path_suffix", "split").agg(F.count("*").alias("c")).filter("c > 1")
    line = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
    return (sizes.unionByName(line(unmatched, "unmatched suffixes"))
            .unionByName(line(twice, "suffixes listed twice"))
            .unionByName(line(split_overlap(splits), "suffixes in both lists")))


def attach_paths(corpus: DataFrame, pieces: DataFrame) -> DataFrame:
    """JON14."""
    return corpus.join(pieces.select("piece_id", "path"), "piece_id")


def first_n(paths: DataFrame, n: int) -> DataFrame:
    """TOP6: the first n paths; all of them for 0."""
    ordered = paths.orderBy("path")
    return ordered.limit(n) if n else ordered
