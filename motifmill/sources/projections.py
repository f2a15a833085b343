"""Projections of star-schema tables onto the raw event tables.

One piece per supplier, one track per line number, one note per line item.  The SQL is plain
integer arithmetic, so that it means the same in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motifmill.sources.raw import SCHEMAS, RawTables

PROJECTION_SQL = {
    "pieces": """
        select s_suppkey as piece_id,
               concat('data/midis/fx/', cast(s_nationkey as string), '/',
                      cast(s_suppkey as string), '_orch.mid') as path,
               480 as ticks_per_beat
        from supplier""",
    "raw_tracks": """
        select distinct l_suppkey as piece_id, l_linenumber - 1 as track_idx,
               (l_suppkey*5 + (l_linenumber-1)*13) % 128 as program,
               (l_suppkey + l_linenumber - 1) % 7 = 0 as is_drum
        from lineitem""",
    "raw_notes": """
        select l_suppkey as piece_id, l_linenumber - 1 as track_idx,
               (l_orderkey*97 + l_partkey*31) % 61440 as start_tick,
               (l_orderkey*97 + l_partkey*31) % 61440 + cast(floor(l_quantity) as int)*60 as end_tick,
               30 + l_partkey % 60 as pitch,
               1 + (l_orderkey*7 + l_partkey) % 127 as velocity
        from lineitem""",
    "raw_time_sigs": """
        select s_suppkey as piece_id, i as change_idx,
               case i when 0 then 0 when 1 then 7680
                      when 2 then case when s_suppkey % 10 = 9 then 15400 else 15360 end
                      else 26880 end as time_tick,
               case when i < 2 then 4
                    when i = 2 then case when s_suppkey % 3 = 0 then 3 else 4 end
                    else case when s_suppkey % 10 = 8 then 5 when s_suppkey % 3 = 0 then 6 else 4 end
               end as numer,
               case when i < 3 then 4
                    else case when s_suppkey % 10 = 8 then 16 when s_suppkey % 3 = 0 then 8 else 4 end
               end as denom
        from supplier cross join (values (0),(1),(2),(3)) v(i)""",
    "raw_tempos": """
        select s_suppkey as piece_id, i as change_idx, i*12000 as time_tick,
               cast(60 + (s_suppkey*17 + i*23) % 120 as double) + 0.5 as bpm
        from supplier cross join (values (0),(1),(2),(3)) v(i)""",
    "splits": """
        select concat(cast(s_nationkey as string), '/', cast(s_suppkey as string), '_orch.mid')
                   as path_suffix, 'test' as split
        from supplier where s_suppkey % 10 = 3
        union all
        select concat(cast(s_nationkey as string), '/', cast(s_suppkey as string), '_orch.mid'), 'valid'
        from supplier where s_suppkey % 10 = 4 or s_suppkey % 20 = 3""",
}


def project(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One projected table, cast to the fixed schema."""
    sql = PROJECTION_SQL[name]
    source = "lineitem" if "from lineitem" in sql else "supplier"
    frame = spark.read.parquet(f"{folder}/{source}.parquet")
    df = spark.sql(sql.replace(f"from {source}", "from {source}"), source=frame)
    if name in SCHEMAS:
        casts = [c.strip().split(" ") for c in SCHEMAS[name].split(",")]
        df = df.selectExpr(*[f"cast({c} as {t}) as {c}" for c, t in casts])
    return df


def raw_tables(spark: SparkSession, folder: str) -> RawTables:
    return RawTables(*[project(spark, folder, n) for n in
                       ("pieces", "raw_tracks", "raw_notes", "raw_time_sigs", "raw_tempos")])


#: Pieces with something wrong, by their ids; the columns of ``PROJECTION_SQL``, read from its tables.
ODD_SQL = {
    "od_raw_tracks": "select piece_id, track_idx, program, is_drum from raw_tracks where piece_id % 12 <> 1",
    "od_raw_notes": """
        select piece_id, track_idx, start_tick + case when piece_id % 12 = 5 then 10600000 else 0 end as start_tick,
               end_tick + case when piece_id % 12 = 5 then 10600000 when piece_id % 12 = 4 and start_tick % 50 = 0 then 700000
                               else 0 end as end_tick, pitch, velocity
        from raw_notes
        where piece_id % 12 not in (1, 2) and (piece_id % 12 <> 9 or start_tick < 4000 or start_tick > 50000)
          and (piece_id % 12 <> 10 or start_tick < 3840 or start_tick > 34560)""",
    "od_raw_time_sigs": """
        select piece_id, change_idx, case when change_idx > 0 then time_tick when piece_id % 12 = 6 then 3840
                                          when piece_id % 12 = 7 then 40 else time_tick end as time_tick, numer, denom
        from raw_time_sigs where piece_id % 12 <> 3""",
    "od_raw_tempos": """
        select piece_id, change_idx, time_tick + case when piece_id % 12 = 8 then 9000000 else 0 end as time_tick, bpm
        from raw_tempos""",
}


#: Quarter notes of two pitches in turn, with gaps, so that the same motifs come again and again.
MOTIF_SQL = {
    "mo_raw_notes": """
        select piece_id, track_idx, start_tick - start_tick % 480 as start_tick, start_tick - start_tick % 480 + 480 as end_tick,
               case when start_tick % 960 < 480 then 60 else 64 end as pitch, 64 as velocity
        from raw_notes""",
}


def motif_tables(spark: SparkSession, folder: str) -> RawTables:
    """``raw_tables`` with recurring motifs."""
    raw = raw_tables(spark, folder)
    notes = spark.sql(MOTIF_SQL["mo_raw_notes"].replace("from raw_notes", "from {source}"), source=raw.notes)
    return RawTables(raw.pieces, raw.tracks, notes.to(raw.notes.schema), raw.time_sigs, raw.tempos)


def odd_tables(spark: SparkSession, folder: str) -> RawTables:
    """``raw_tables`` with pieces that break one rule each."""
    raw = raw_tables(spark, folder)
    sources = {"raw_tracks": raw.tracks, "raw_notes": raw.notes, "raw_time_sigs": raw.time_sigs, "raw_tempos": raw.tempos}

    def of(name):
        sql, source = ODD_SQL[f"od_{name}"], sources[name]
        return spark.sql(sql.replace(f"from {name}", "from {source}"), source=source).to(source.schema)
    return RawTables(raw.pieces, *(of(n) for n in sources))


def splits(spark: SparkSession, folder: str) -> DataFrame:
    return project(spark, folder, "splits")
