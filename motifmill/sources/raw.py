"""Raw inputs: file inventory, decoded event tables, path lists, split lists (SRC1-2, 7, 11)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from motifmill.functions.scan import ranked


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


SCHEMAS = {
    "pieces": "piece_id bigint, path string, ticks_per_beat int",
    "raw_tracks": "piece_id bigint, track_idx int, program int, is_drum boolean",
    "raw_notes": "piece_id bigint, track_idx int, start_tick bigint, end_tick bigint, "
                 "pitch int, velocity int",
    "raw_time_sigs": "piece_id bigint, change_idx int, time_tick bigint, numer int, denom int",
    "raw_tempos": "piece_id bigint, change_idx int, time_tick bigint, bpm double",
}


@dataclass(frozen=True)
class RawTables:
    pieces: DataFrame
    tracks: DataFrame
    notes: DataFrame
    time_sigs: DataFrame
    tempos: DataFrame


def list_files(spark: SparkSession, roots: list[str], pattern: str = "*.{mid,midi,MID}") -> DataFrame:
    """SRC1: every file of that pattern of names below all roots, by path (K2: all roots count).

    Only names and sizes are read.  An empty result is an error.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(roots)
        .select("path", "length")
    )
    if found.isEmpty():
        raise FileNotFoundError(f"no note files below {roots}")
    return found.orderBy("path")


def number_paths(paths: DataFrame) -> DataFrame:
    """TOP5: ``piece_id`` is the rank of the path."""
    return ranked(paths, "path", "piece_id")


def write_notes(raw: RawTables, folder: str, mode: str = "errorifexists") -> None:
    """The five tables as ``read_notes`` takes them."""
    for name, table in zip(SCHEMAS, (raw.pieces, raw.tracks, raw.notes, raw.time_sigs, raw.tempos)):
        table.write.mode(mode).parquet(f"{folder}/{name}")


def read_notes(spark: SparkSession, folder: str) -> RawTables:
    """SRC2: the five tables of decoded events, with fixed schemas."""
    t = {n: spark.read.schema(_schema(s)).parquet(f"{folder}/{n}") for n, s in SCHEMAS.items()}
    return RawTables(t["pieces"], t["raw_tracks"], t["raw_notes"], t["raw_time_sigs"], t["raw_tempos"])


def read_pathlist(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: a text list of paths, blank lines ignored."""
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path != ''")


def read_splits(spark: SparkSession, test: str, valid: str) -> DataFrame:
    """SRC11: the two suffix lists as ``(path_suffix, split)``."""
    def one(path, name):
        return read_pathlist(spark, path).select(F.col("path").alias("path_suffix"),
                                                 F.lit(name).alias("split"))
    return one(test, "test").unionByName(one(valid, "valid"))
