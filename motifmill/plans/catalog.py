"""Every registered query: a Spark job over the projected tables, and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from motifmill.functions import scalars as S
from motifmill.functions.scan import ranked
from motifmill.operators import (
    bpe as B, cleaning as C, decode as D, examples as E, features as X, splits as P, stats as T,
    timing as W, tokens as K, verify as Y, vocab as V,
)
from motifmill.params import CORPUS, EVALUATION, BpeParams, CorpusParams, ExampleParams
from motifmill.plans import jobs as J, oracle as O
from motifmill.session import ensure_checkpoint_dir, stage
from motifmill.sources import projections, raw as R, tables as Z

COARSE = CORPUS.with_(velocity_step=16, tempo_step=16, tempo_min=16)
SHORT = CORPUS.with_(max_duration=24)
FEW_TRACKS = CORPUS.with_(max_track_number=5)
CUT_NOTES = CORPUS.with_(use_cont_note=False)
EXAMPLES = ExampleParams(max_len=64, step_ratio=1.0, pitch_range=1)
ROUNDS = 4


def columns_of(spec: str) -> list[tuple[str, str]]:
    """``"a b:s c:d"`` as ``[(a, i), (b, s), (c, d)]``; i, s and d are the kinds of column."""
    return [(c.partition(":")[0], c.partition(":")[2] or "i") for c in spec.split()]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    """The columns of ``spec`` in plain types, unset values as -1 or '' so that engines agree."""
    cast = {"i": lambda c: F.coalesce(c.cast("bigint"), F.lit(-1)),
            "s": lambda c: F.coalesce(c.cast("string"), F.lit("")),
            "d": lambda c: F.coalesce(F.round(c.cast("double"), 6), F.lit(-1.0))}
    return df.select(*[cast[kind](F.col(f"`{c}`")).alias(c) for c, kind in columns_of(spec)])


class Workspace:
    """Shared intermediate tables of one folder, each staged once per session."""

    _known: dict[tuple[str, str], "Workspace"] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._builds: dict = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> "Workspace":
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._known:
            cls._known[key] = cls(spark, folder)
        return cls._known[key]

    @cached_property
    def raw(self) -> R.RawTables:
        return projections.raw_tables(self.spark, self.folder)

    @cached_property
    def odd(self) -> J.CorpusBuild:
        return J.build_corpus(projections.odd_tables(self.spark, self.folder), CORPUS)

    @cached_property
    def splits(self) -> DataFrame:
        return projections.splits(self.spark, self.folder)

    def build(self, p: CorpusParams = CORPUS) -> J.CorpusBuild:
        if p not in self._builds:
            self._builds[p] = J.build_corpus(self.raw, p)
        return self._builds[p]

    def tokens_of(self, p: CorpusParams) -> DataFrame:
        return self._once(("tokens", p), lambda: stage(self.build(p).tokens, "tokens"))

    def timed_of(self, p: CorpusParams) -> DataFrame:
        return self._once(("timed", p), lambda: stage(J.timed_tokens(self.tokens_of(p), p.tpq), "timed"))

    def decoded_of(self, p: CorpusParams) -> D.Decoded:
        return self._once(("decoded", p), lambda: J.staged(D.decode_tokens(self.timed_of(p), p.tpq)))

    def _once(self, key, make):
        if key not in self._builds:
            self._builds[key] = make()
        return self._builds[key]

    @property
    def tokens(self) -> DataFrame:
        return self.tokens_of(CORPUS)

    @property
    def timed(self) -> DataFrame:
        return self.timed_of(CORPUS)

    @cached_property
    def corpus(self) -> DataFrame:
        return stage(self.build().corpus, "corpus")

    @property
    def decoded(self) -> D.Decoded:
        return self.decoded_of(CORPUS)

    @cached_property
    def features(self) -> DataFrame:
        return stage(X.scalar_features(self.decoded), "features")

    @cached_property
    def hists(self) -> DataFrame:
        return stage(X.histograms(self.decoded.notes, CORPUS.tpq), "hists")

    @cached_property
    def test_and_train(self) -> tuple[DataFrame, DataFrame]:
        """Summed histograms of the test split and of the training split."""
        named = P.apply_splits(self.build().accepted, self.splits)
        of = lambda s: X.aggregate_histograms(
            self.hists.join(named.filter(F.col("split") == s), "piece_id", "left_semi"))
        return stage(of("test"), "test_hist"), stage(of("train"), "train_hist")

    @cached_property
    def single_shapes(self) -> DataFrame:
        return B.shapes_frame(self.spark, B.DEFAULT_SHAPES)

    @cached_property
    def multi_notes(self) -> DataFrame:
        return stage(B.to_multi_notes(self.timed, CORPUS.tpq), "multi_notes")

    @cached_property
    def pairs(self) -> DataFrame:
        return stage(B.neighbour_pairs(self.multi_notes, self.single_shapes, CORPUS.tpq), "pairs")

    @cached_property
    def motif_notes(self) -> DataFrame:
        """Multi-notes of pieces with recurring motifs."""
        build = J.build_corpus(projections.motif_tables(self.spark, self.folder), CORPUS)
        return stage(J.multi_notes_of(build.tokens, CORPUS.tpq), "motif_notes")

    def learned(self, adjacency: str = "ours", motifs: bool = False) -> B.Learned:
        def run():
            notes = self.motif_notes if motifs else self.multi_notes
            found = B.learn(notes, CORPUS.tpq, BpeParams(iterations=ROUNDS, adjacency=adjacency))
            return B.Learned(found.shapes, stage(found.multi_notes, "learned"), found.log, notes)
        return self._once(("learned", adjacency, motifs), run)

    @cached_property
    def applied(self) -> DataFrame:
        return stage(B.apply_shapes(self.multi_notes, self.learned().shapes, CORPUS.tpq), "applied")

    @cached_property
    def merged(self) -> DataFrame:
        shapes = self.learned().shapes_frame(self.spark)
        return stage(J.merged_tokens(self.applied, shapes, self.timed, CORPUS), "merged")

    @cached_property
    def merged_build(self) -> J.ExampleBuild:
        """Vocabulary, rows and examples of the merged corpus."""
        return J.ExampleBuild(self.merged, CORPUS, EXAMPLES, shapes=self.learned().shapes_frame(self.spark))

    @cached_property
    def merged_decoded(self) -> D.Decoded:
        return J.staged(D.decode_tokens(stage(J.timed_tokens(self.merged, CORPUS.tpq)), CORPUS.tpq))

    @cached_property
    def example_build(self) -> J.ExampleBuild:
        build = J.ExampleBuild(self.tokens, CORPUS, EXAMPLES)
        build.__dict__["token_rows"] = stage(build.token_rows, "rows")
        return build

    @cached_property
    def examples(self) -> DataFrame:
        return stage(self.example_build.examples, "examples")

    def scratch(self, name: str) -> str:
        """A fresh folder next to the checkpoints."""
        import uuid

        return f"{ensure_checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Query:
    spec: str
    run: Callable[[Workspace], DataFrame]
    sql: str | None
    more: tuple = ()


QUERIES: dict[str, Query] = {}


def query(name: str, spec: str, run, sql: str | None = None, *more) -> None:
    QUERIES[name] = Query(spec, run, sql, more)


TOKEN_SPEC = ("piece_id seq type:s onset track_number instrument numer denom position bpm pitch "
              "duration velocity is_cont text:s")
NOTE_SPEC = "piece_id onset track_number pitch duration is_cont velocity"
DECODED_SPEC = "piece_id track_number start end pitch velocity"
MN_SPEC = "piece_id track_number phrase k shape_id onset pitch stretch velocity"

# ---- sources and sinks ------------------------------------------------------------------

query("src02_raw_notes", "piece_id track_idx start_tick end_tick pitch velocity",
      lambda w: w.raw.notes, "select * from raw_notes")
query("src02_raw_tempos", "piece_id change_idx time_tick bpm:d", lambda w: w.raw.tempos,
      "select * from raw_tempos")


def _corpus_round_trip(w: Workspace) -> DataFrame:
    folder = w.scratch("corpus")
    Z.write_corpus(w.corpus, folder)
    return Z.read_corpus(w.spark, folder)


LINES = "select piece_id, string_agg(text, ' ' order by seq) as text from {t} group by piece_id"
query("src03_snk01_corpus_round_trip", "piece_id text:s", _corpus_round_trip, LINES.format(t="tokens"))
query("src04_get_piece", "piece_id text:s", lambda w: Z.get_piece(w.corpus, 3),
      f"select * from ({LINES.format(t='tokens')}) where piece_id = 3")
CORPUS_LINES = f"select *, row_number() over (order by piece_id) - 1 as line from ({LINES.format(t='tokens')})"
query("src04_get_line", "piece_id text:s", lambda w: Z.get_line(w.corpus, -1),
      f"select * from ({CORPUS_LINES}) where line = (select max(line) from ({CORPUS_LINES}))")
query("src04_corpus_lines", "piece_id line", lambda w: Z.corpus_lines(w.corpus), CORPUS_LINES)
query("src05_corpus_len", "n", lambda w: w.corpus.agg(F.lit(Z.corpus_len(w.corpus)).alias("n")),
      "select count(*) as n from pieces where piece_id not in (select piece_id from rejects)")


def _notes_round_trip(w: Workspace) -> R.RawTables:
    folder = w.scratch("notes")
    R.write_notes(w.raw, folder)
    return R.read_notes(w.spark, folder)


query("src02_read_notes", "piece_id track_idx start_tick end_tick pitch velocity",
      lambda w: _notes_round_trip(w).notes, "select * from raw_notes")
query("src02_read_time_sigs", "piece_id change_idx time_tick numer denom",
      lambda w: _notes_round_trip(w).time_sigs, "select * from raw_time_sigs")


def _listed_files(w: Workspace) -> DataFrame:
    """A tree of files with the pieces' ids as contents; only their names and sizes are listed."""
    folder = w.scratch("files")
    paths = w.raw.pieces.select(F.col("piece_id").cast("string").alias("value"), (F.col("piece_id") % 7).alias("d"))
    paths.write.partitionBy("d").option("compression", "none").text(folder)
    return R.list_files(w.spark, [f"{folder}/d={d}" for d in range(7)], "*.txt").agg(F.sum("length").alias("n"))


query("src01_listed_bytes", "n", _listed_files, "select sum(length(cast(piece_id as varchar)) + 1) as n from pieces")


def _pathlist_round_trip(w: Workspace) -> DataFrame:
    folder = w.scratch("paths")
    Z.write_pathlist(w.build().accepted, folder)
    return R.read_pathlist(w.spark, f"{folder}/pathlist")


query("src07_snk02_pathlist", "path:s", _pathlist_round_trip,
      "select path from pieces where piece_id not in (select piece_id from rejects)")


def _splits_round_trip(w: Workspace) -> DataFrame:
    folder = w.scratch("splits")
    for name in ("test", "valid"):
        w.splits.filter(F.col("split") == name).select("path_suffix").write.text(f"{folder}/{name}")
    return R.read_splits(w.spark, f"{folder}/test", f"{folder}/valid")


query("src11_read_splits", "path_suffix:s split:s", _splits_round_trip, "select * from splits")


def _stats_round_trip(w: Workspace) -> DataFrame:
    path = w.scratch("stats")
    Z.write_stats(T.token_type_counts(w.tokens), path)
    return w.spark.read.schema("piece_id bigint, multinote bigint, all bigint").json(path)


query("snk07_written_stats", "piece_id multinote all", _stats_round_trip,
      """select piece_id, count(*) filter (type in ('N', 'U')) as multinote, count(*) as "all" from tokens group by 1""")


def _shapes_round_trip(w: Workspace) -> DataFrame:
    """The shapes of all pairs of single notes, most frequent first, as a vocabulary on disk."""
    found = stage(_kernel_counts(w, "ours"), "found")
    order = found.select(F.struct((-F.col("n")).alias("n"), "text").alias("place"))
    named = ranked(order, "place", "i").select((F.col("i") + 2).cast("int").alias("shape_id"), F.col("place.text").alias("text"))
    path = w.scratch("shapes")
    Z.write_shapes(named, path)
    return Z.read_shapes(w.spark, path).filter("shape_id > 1")


def _rows_round_trip(w: Workspace) -> DataFrame:
    folder = w.scratch("rows")
    Z.write_token_rows(w.example_build.token_rows, folder)
    train = P.apply_splits(w.build().accepted, w.splits).filter("split = 'train'")
    return Z.read_token_rows(w.spark, folder, train)


SPLIT_OF = """
    select f.piece_id, path, coalesce(min(s.split), 'train') as split
    from pieces f left join splits s on ends_with('/' || path, '/' || path_suffix)
    where f.piece_id not in (select piece_id from rejects) group by f.piece_id, path"""
query("src10_snk06_token_rows_of_split", "piece_id seq evt pit dur vel trn mps", _rows_round_trip,
      f"select * from rows where piece_id in (select piece_id from ({SPLIT_OF}) where split = 'train')")


def _vocab_round_trip(w: Workspace) -> DataFrame:
    folder = w.scratch("vocab")
    Z.write_vocab(w.example_build.vocab, folder)
    return Z.read_vocab(w.spark, folder)


query("src09_snk05_vocab_round_trip", "attr:s id text:s", _vocab_round_trip, "select * from vocab")


def _features_round_trip(w: Workspace) -> DataFrame:
    folder = w.scratch("features")
    Z.write_features(X.hist_to_map(w.test_and_train[0]), folder)
    return Z.read_features(w.spark, folder)


SUMMED = ("select feature, bin, sum(n) as n from hist where piece_id in "
          "(select piece_id from ({s}) where split = '{name}') group by feature, bin")
TEST_HIST, TRAIN_HIST = (SUMMED.format(s=SPLIT_OF, name=n) for n in ("test", "train"))
query("src12_snk08_arr04_features_round_trip", "feature:s bin:s n", _features_round_trip, TEST_HIST)
query("snk09_set05_extract", "piece_id text:s", lambda w:
      Z.extract(w.corpus, "0, 2:5, 6, -1, 20:"),
      f"""select piece_id, text from ({CORPUS_LINES})
          where line = 0 or line between 2 and 4 or line = 6 or line >= 20 or line = (select max(line) from ({CORPUS_LINES}))""")

# ---- scalars ----------------------------------------------------------------------------

query("scl01_scl02_quantised_notes", "piece_id track_number instrument start end pitch velocity",
      lambda w: w.build().quantised,
      'select piece_id, track_number, instrument, s as "start", e as "end", pitch, velocity from quant')
query("scl03_requantised_changes", "piece_id change_idx time numer denom",
      lambda w: C.requantize_changes(w.raw.time_sigs, w.raw.pieces, CORPUS),
      f"""select t.*, {O.quantise('time_tick', 12)} as time
          from raw_time_sigs t join pieces f on t.piece_id = f.piece_id""")
query("scl04_quantised_tempo", "piece_id change_idx q",
      lambda w: w.raw.tempos.withColumn("q", S.quantize_tempo("bpm", CORPUS)),
      "select *, least(greatest(floor((bpm*2+8)/16)*8, 8), 240) as q from raw_tempos")
query("scl05_quantised_velocity", "velocity q n",
      lambda w: w.raw.notes.groupBy("velocity", S.quantize_velocity("velocity", 4).alias("q"))
      .agg(F.count("*").alias("n")),
      """select velocity, least(greatest((2*velocity+4)//8*4, 4), 124) as q, count(*) as n
         from raw_notes group by velocity""")
query("scl06_split_long_notes", NOTE_SPEC, lambda w: C.dedup_notes(w.build().chunks), "select * from chunks")
query("scl06_cut_long_notes", NOTE_SPEC, lambda w: C.dedup_notes(w.build(CUT_NOTES).chunks),
      "select * from cn_chunks", O.corpus_ctes("cn_", CUT_NOTES))
query("scl07_program_of", "piece_id track_idx instrument program is_drum",
      lambda w: (lambda df: df.withColumns(dict(zip(("program", "is_drum"), S.split_program("instrument")))))(
          w.raw.tracks.withColumn("instrument", S.program_of("program", "is_drum"))),
      """select piece_id, track_idx, i as instrument, i % 128 as program, cast(i = 128 as int) as is_drum
         from (select *, case when is_drum then 128 else program end as i from raw_tracks)""")
query("scl08_base36", "x text:s back",
      lambda w: w.raw.notes.select((F.col("pitch") - F.col("velocity")).alias("x")).distinct()
      .withColumn("text", S.itob36("x")).withColumn("back", S.b36toi("text")),
      f"select distinct x, {O.b36('x')} as text, x as back from (select pitch - velocity as x from raw_notes)")
query("scl12_scl13_time_signatures", "numer denom length n",
      lambda w: S.supported_time_signatures(w.spark).join(
          T.time_signatures_used(w.tokens).select("numer", "denom")
          .join(w.tokens.filter("type = 'M'").groupBy("numer", "denom").agg(F.count("*").alias("n")),
                ["numer", "denom"]), ["numer", "denom"], "left").fillna(0),
      """select s.numer, s.denom, 48 * s.numer // s.denom as length, coalesce(n, 0) as n
         from (select unnest(range(1, least(24, 3 * denom) + 1)) as numer, denom
               from (values (2), (4), (8)) v(denom)) s
         left join (select numer, denom, count(*) as n from tokens where type = 'M' group by 1, 2) m
              on s.numer = m.numer and s.denom = m.denom""")
query("scl14_scl15_duration_fractions", "ticks fraction:s value:d n",
      lambda w: w.decoded.notes.groupBy((F.col("end") - F.col("start")).alias("ticks"))
      .agg(F.count("*").alias("n")).withColumn("fraction", S.duration_fraction("ticks", 12))
      .withColumn("value", S.fraction_to_double("fraction")),
      """select d as ticks, cast(d // gcd(d, 12) as varchar) || '/' || cast(12 // gcd(d, 12) as varchar)
                as fraction, d / 12 as value, count(*) as n
         from (select "end" - "start" as d from decoded) group by d""")
query("scl16_pitch_classes", "piece_id pc n",
      lambda w: w.decoded.notes.groupBy("piece_id", S.pitch_class("pitch").alias("pc"))
      .agg(F.count("*").alias("n")),
      "select piece_id, pitch % 12 as pc, count(*) as n from decoded group by 1, 2")
query("scl17_gcd_of", "piece_id track_number g n",
      lambda w: w.multi_notes.groupBy("piece_id", "track_number", S.gcd_of(
          F.array(F.col("onset").cast("int"), F.col("stretch"), F.col("stretch") * 2)).alias("g"))
      .agg(F.count("*").alias("n")),
      """select piece_id, track_number, gcd(onset, stretch) as g, count(*) as n from mn group by 1, 2, 3""")


def _pair_shape_rows(w: Workspace) -> DataFrame:
    a, b, shape = F.col("a"), F.col("b"), w.single_shapes.select("shape_id", "shape")
    left = F.broadcast(shape.toDF("l", "left_shape"))
    right = F.broadcast(shape.toDF("r", "right_shape"))
    pairs = (w.pairs.filter(B.adjacent("ours")).withColumns({"l": a["shape_id"], "r": b["shape_id"]})
             .join(left, "l").join(right, "r"))
    shapes = S.shape_of_pair("left_shape", "right_shape", a["stretch"], b["stretch"],
                             b["onset"] - a["onset"], b["pitch"] - a["pitch"], CORPUS.max_duration)
    return (pairs.withColumn("shape", shapes).filter("shape is not null")
            .select("piece_id", S.format_shape(S.parse_shape(S.format_shape("shape"))).alias("text"),
                    S.shape_span("shape").alias("span"))
            .groupBy("text").agg(F.count("*").alias("n"), F.max("span").alias("span")))


query("scl11_scl18_scl19_shapes_of_pairs", "text:s n span", _pair_shape_rows,
      f"""select text, max(n) as n, max(span) as span from (
            select p.text, p.n, s.span from ({O.pair_shapes('')}) p join (
              select {'text'}, max(greatest(l1, d1 + r1)) as span from (
                select l1, r1, d1, case when row(0, 0, l1, lc) <= row(d1, (dp + 256) % 256, r1, rc)
                  then '0,0,' || {O.b36('l1')} || case when lc = 1 then '~;' else ';' end || {O.b36('d1')} || ','
                       || {O.b36('dp')} || ',' || {O.b36('r1')} || case when rc = 1 then '~;' else ';' end
                  else {O.b36('d1')} || ',' || {O.b36('dp')} || ',' || {O.b36('r1')}
                       || case when rc = 1 then '~;' else ';' end
                       || '0,0,' || {O.b36('l1')} || case when lc = 1 then '~;' else ';' end end as text
                from reduced where d1 <= 127) group by text) s on p.text = s.text) group by text""")
query("scl20_agg06_instrument_distribution", "instrument instrument_name:s n",
      lambda w: T.instrument_distribution(w.tokens),
      "select i as instrument, name as instrument_name, coalesce(n, 0) as n from (select unnest(range(0, 129)) as i,"
      " unnest([" + ", ".join("'" + n.replace("'", "''") + "'" for n in S.INSTRUMENT_NAMES) + "]) as name)"
      " left join (select instrument, count(*) as n from tokens where type = 'R' group by 1) t on t.instrument = i")

# ---- filters and rejection --------------------------------------------------------------

query("flt01_flt02_live_tracks", "piece_id track_idx program",
      lambda w: C.drop_empty_tracks(w.raw.tracks, C.drop_invalid_notes(w.raw.notes)),
      """select piece_id, track_idx, program from raw_tracks t where exists (
           select 1 from raw_notes n where n.piece_id = t.piece_id and n.track_idx = t.track_idx
           and end_tick > start_tick)""")
query("flt03_playable_notes", "piece_id track_number start end pitch velocity",
      lambda w: C.keep_playable_notes(w.build().quantised),
      """select piece_id, track_number, s as "start", e as "end", pitch, velocity from quant
         where s >= 0 and s <= 131071 and e <= 131071 and (instrument <> 128 or pitch between 35 and 81)""")
FINE = CORPUS.with_(tpq=4096)
query("flt04_corrupt_pieces", "piece_id rank",
      lambda w: C.reject_corrupt(C.requantize_notes(
          w.raw.notes.filter("end_tick > start_tick").join(w.raw.pieces, "piece_id"), FINE)),
      f"""select piece_id, min(rank) as rank from (
            select piece_id, case when s > 262143 and e > 262143 then 3 when e - s > 16383 then 4 end as rank
            from (select n.piece_id, {O.quantise("start_tick", 4096)} as s, {O.quantise("end_tick", 4096)} as e
                  from raw_notes n join pieces f on n.piece_id = f.piece_id where end_tick > start_tick))
          where rank is not null group by piece_id""")
query("flt05_flt11_rejects", "piece_id rank reason:s", lambda w: w.build().rejects, "select * from rejects")
query("flt05_flt11_all_reasons", "piece_id rank", lambda w: w.odd.rejects,
      "select piece_id, min(rank) as rank from od_broken group by piece_id", O.odd_ctes())
query("win02_win03_odd_measures", "piece_id measure_idx onset length", lambda w: w.odd.all_measures,
      "select * from od_measures", O.odd_ctes())
query("agg01_rejection_counts", "reason:s n", lambda w: C.rejection_counts(w.build().rejects),
      "select reason, count(*) as n from rejects group by reason")


def _busy_tracks(w: Workspace) -> DataFrame:
    few = w.raw.tracks.withColumn("program", ((F.col("piece_id") + F.col("track_idx")) % 3).cast("int"))
    return C.merge_tracks(few.withColumn("is_drum", F.lit(False)), C.drop_invalid_notes(w.raw.notes), FEW_TRACKS)


MERGED = """
    with ranked as (
      select piece_id, track_idx, program, n,
             row_number() over (partition by piece_id order by n desc, track_idx) as r,
             count(*) over (partition by piece_id) as c
      from (select piece_id, track_idx, (piece_id + track_idx) % 3 as program, count(*) as n
            from raw_notes where end_tick > start_tick group by 1, 2)),
    six as (select e.piece_id, e.track_idx as extra, e.n as extra_n,
                   arg_max(k.track_idx, row(-k.n, k.r)) as into_idx
            from ranked e join ranked k on e.piece_id = k.piece_id and e.program = k.program and k.r <= 5
            where e.r = 6 group by e.piece_id, e.track_idx, e.n),
    grown as (select k.piece_id, k.track_idx, k.program, k.r, k.n + coalesce(s.extra_n, 0) as n,
                     case when s.extra is null then 0 else 1 end as touched
              from ranked k left join six s on k.piece_id = s.piece_id and k.track_idx = s.into_idx
              where k.r <= 5 and k.c > 5),
    seven as (select e.piece_id, e.track_idx as extra, e.n as extra_n,
                     arg_max(k.track_idx, row(-k.n, case when k.touched = 1 and exists (
                       select 1 from grown o where o.piece_id = k.piece_id and o.program = k.program
                       and o.track_idx <> k.track_idx and o.n = k.n) then 100 else k.r end)) as into_idx
              from ranked e join grown k on e.piece_id = k.piece_id and e.program = k.program
              where e.r = 7 group by e.piece_id, e.track_idx, e.n),
    final_kept as (select g.piece_id, g.track_idx, g.program, g.r, g.n + coalesce(s.extra_n, 0) as n,
                          g.touched + case when s.extra is null then 0 else 1 end as touched
                   from grown g left join seven s on g.piece_id = s.piece_id and g.track_idx = s.into_idx),
    numbered as (select *, row_number() over (partition by piece_id order by program_rank, n desc, touched, r) - 1
                           as track_number
                 from (select *, min(r) over (partition by piece_id, program) as program_rank from final_kept))
    select piece_id, track_idx, program as instrument, track_number from numbered
    union all
    select s.piece_id, extra, program, track_number
    from (select * from six union all select * from seven) s
         join numbered n on s.piece_id = n.piece_id and s.into_idx = n.track_idx
    union all
    select piece_id, track_idx, program, cast(null as bigint) from ranked e where r > 5 and not exists (
      select 1 from ranked k where k.piece_id = e.piece_id and k.program = e.program and k.r <= 5)
    union all
    select piece_id, track_idx, program,
           row_number() over (partition by piece_id order by track_idx) - 1
    from ranked where c <= 5"""
query("jon01_flt06_merge_tracks", "piece_id track_idx instrument track_number", _busy_tracks, MERGED)
query("flt06_track_limit", "piece_id rank",
      lambda w: C.reject_track_limit(w.build(FEW_TRACKS).track_map),
      """select piece_id, 2 as rank from (select distinct piece_id, track_idx from raw_notes
         where end_tick > start_tick) group by piece_id having count(*) > 5""")
query("flt15_filter_failed", "piece_id path:s",
      lambda w: J.filter_failed(w.raw.pieces, w.build().rejects),
      "select piece_id, path from pieces where piece_id not in (select piece_id from rejects)")
query("flt16_notes_in_pitch_range", "piece_id track_number pitch onset",
      lambda w: D.drop_out_of_range_notes(
          w.multi_notes.withColumn("pitch", F.col("pitch") + F.col("velocity") - 40)),
      """select piece_id, track_number, pitch + velocity - 40 as pitch, onset from mn
         where pitch + velocity - 40 between 0 and 127""")
query("flt18_sampled_multi_notes", MN_SPEC,
      lambda w: B.keep_sampled_pieces(w.multi_notes, 0.5, 7, 0),
      f"select * from mn where {O.shared_hash('7', '0', 'piece_id')} % 1048576 < 524288")
query("flt03_dropped_notes", "piece_id reason:s n", lambda w: C.dropped_notes(w.build().quantised, CORPUS.with_(event_time_limit=1200)),
      """select piece_id, reason, count(*) as n from (
           select piece_id, case when s >= e or s < 0 then 'no length' when s > 1200 or e > 1200 then 'too late'
                                 when instrument = 128 and pitch not between 35 and 81 then 'no drum' end as reason from quant)
         where reason is not null group by 1, 2""")
query("agg31_piece_extent", "piece_id first_onset last_end max_onset", lambda w: w.build().extent,
      "select * from extent")

# ---- measures, tempos, positions, order -------------------------------------------------

query("win01_win02_segments", "piece_id time next_time numer denom length", lambda w: w.build().segments,
      "select * from segments")
query("win03_measures", "piece_id measure_idx onset numer denom length", lambda w: w.build().measures,
      "select * from measures")
query("win04_tempos", "piece_id onset bpm", lambda w: w.build().tempos, "select * from tempos")
query("win05_positions", "piece_id onset position",
      lambda w: K.position_tokens(w.build().chunks, w.build().measures, w.build().tempos, CORPUS),
      "select * from positions")
query("win06_head_tokens", "piece_id track_number instrument", lambda w: w.build().tracks, "select * from tracks")
query("win07_set01_set02_scl09_tokens", TOKEN_SPEC, lambda w: w.tokens, "select * from tokens")
query("job01_corpus", "piece_id text:s", lambda w: w.corpus, LINES.format(t="tokens"))
query("job01_coarse_corpus", "piece_id text:s", lambda w: w.build(COARSE).corpus,
      LINES.format(t="co_tokens"), O.corpus_ctes("co_", COARSE))
query("win10_empty_measure_runs", "piece_id longest_run",
      lambda w: C.empty_measure_runs(
          w.build().note_measures.join(w.build().rejects, "piece_id", "left_anti"), w.build().measures),
      """with hit as (select distinct c.piece_id, m.measure_idx from notes c asof join measures m
                      on c.piece_id = m.piece_id and c.onset >= m.onset where c.onset < m.onset + m.length),
              runs as (select piece_id, measure_idx - coalesce(lag(measure_idx) over (
                         partition by piece_id order by measure_idx), -1) as run, measure_idx from hit)
         select a.piece_id, greatest(max(run), max(n) - 1 - max(measure_idx)) as longest_run
         from (select piece_id, count(*) as n from measures group by 1) a join runs r on a.piece_id = r.piece_id
         group by a.piece_id""")
query("jon02_note_measures", "piece_id onset track_number pitch measure_idx measure_onset",
      lambda w: W.assign_measure(w.build().notes, w.build().measures, CORPUS.block_ticks),
      """select n.piece_id, n.onset, track_number, pitch, measure_idx, m.onset as measure_onset
         from notes n asof join measures m on n.piece_id = m.piece_id and n.onset >= m.onset""")
query("scl10_win08_parsed_tokens", TOKEN_SPEC + " measure_no",
      lambda w: K.running_time(K.parse_tokens(K.explode_text(w.corpus)), CORPUS.tpq),
      "select * from timed")
query("win11_first_measures", "piece_id seq text:s", lambda w: K.first_k_measures(w.tokens, 3),
      "select piece_id, seq, text from timed where measure_no <= 3 and type <> 'EOS'")
query("win12_after_measures", "piece_id seq text:s", lambda w: K.after_k_measures(w.tokens, 3),
      "select piece_id, seq, text from timed where measure_no = 0 or measure_no > 3 or type = 'EOS'")
query("win13_first_ticks", "piece_id seq text:s", lambda w: K.first_k_ticks(w.tokens, 12, 200),
      """select piece_id, seq, text from timed t where seq < coalesce(
           (select min(seq) from timed u where u.piece_id = t.piece_id and u.onset > 200), 1000000000)
         and (type <> 'EOS' or not exists (select 1 from timed u where u.piece_id = t.piece_id and u.onset > 200))""")
query("win14_first_tokens", "piece_id seq text:s", lambda w: K.first_k_tokens(w.tokens, 500),
      """select piece_id, seq, text from tokens where seq < 500
         union all select piece_id, 500, 'EOS' from tokens where seq = 499 and type <> 'EOS'""")
query("win15_sampled_measures", "piece_id seq text:s", lambda w: K.sample_measures(w.tokens, 4, 11),
      f"""select t.piece_id, seq, text from timed t join (
            select piece_id, {O.shared_hash('11', 'piece_id')} % (count(*) - 3) as first from tokens where type = 'M'
            group by piece_id having count(*) >= 4) s on t.piece_id = s.piece_id
          where type <> 'EOS' and (measure_no = 0 or measure_no between first + 1 and first + 4)""")
query("win09_mps_numbers", "piece_id seq mps", lambda w: V.mps_numbers(w.tokens),
      """select piece_id, seq, sum(step) over (partition by piece_id order by seq rows unbounded preceding) as mps
         from steps""")
query("top07_largest", "length position",
      lambda w: w.tokens.agg(F.max(S.measure_ticks("numer", "denom", 12)).alias("length"),
                             F.max("position").alias("position")),
      "select max(48 * numer // denom) as length, max(position) as position from tokens")

# ---- decoding, verification, audits -----------------------------------------------------

query("jon04_jon05_job02_decoded_notes", DECODED_SPEC, lambda w: w.decoded.notes, "select * from decoded")
query("job02_decoded_tempos", "piece_id onset bpm", lambda w: w.decoded.tempos,
      "select piece_id, onset, bpm from timed where type = 'T'")
query("job02_decoded_time_signatures", "piece_id onset numer denom", lambda w: w.decoded.time_sigs,
      """select piece_id, onset, numer, denom from (select *, lag(row(numer, denom)) over (
           partition by piece_id order by measure_idx) as prev from bars)
         where prev is null or prev <> row(numer, denom)""")
query("job02_decoded_lines", DECODED_SPEC, lambda w: J.decode_corpus(w.corpus, CORPUS.tpq).notes,
      "select * from decoded")
query("jon13_piano_roll", "mark:s piece_id x0:d x1:d pitch is_drum track_number bpm",
      lambda w: D.piano_roll(w.decoded),
      """select 'note' as mark, d.piece_id, "start" as x0, "end" - 0.25 as x1, pitch,
                cast(instrument = 128 as int) as is_drum, d.track_number, null as bpm
         from decoded d join tracks t on d.piece_id = t.piece_id and d.track_number = t.track_number
         union all select 'measure', piece_id, onset, null, null, null, null, null from bars
         union all select 'bpm', piece_id, onset + 0.05, null, null, null, null, bpm from timed where type = 'T'""")
DIFFS = """
    select piece_id, 'notes' as reason from (
      (select distinct piece_id, track_number, {e}, pitch, velocity from decoded
       except select piece_id, track_number, {e}, pitch, velocity from {x}decoded)
      union all
      (select distinct piece_id, track_number, {e}, pitch, velocity from {x}decoded
       except select piece_id, track_number, {e}, pitch, velocity from decoded))"""
TEMPO_DIFF = """
    select piece_id, 'tempos' as reason from (
      (select piece_id, onset, bpm from timed where type = 'T'
       except select piece_id, onset, bpm from {x}timed where type = 'T')
      union all
      (select piece_id, onset, bpm from {x}timed where type = 'T'
       except select piece_id, onset, bpm from timed where type = 'T'))"""
STRUCTURE_DIFF = """
    select piece_id, 'time signatures' as reason from (
      with a as (select piece_id, onset, numer, denom from (select *, lag(row(numer, denom)) over (
                   partition by piece_id order by measure_idx) as prev from bars)
                 where prev is null or prev <> row(numer, denom)),
           b as (select piece_id, onset, numer, denom from (select *, lag(row(numer, denom)) over (
                   partition by piece_id order by measure_idx) as prev from {x}bars)
                 where prev is null or prev <> row(numer, denom))
      (select * from a except select * from b) union all (select * from b except select * from a))
    union
    select piece_id, 'tracks' from (
      (select * from tracks except select * from {x}tracks) union all
      (select * from {x}tracks except select * from tracks))"""


def _all_diffs(x: str) -> str:
    edges = [DIFFS.format(x=x, e=f'"{e}"') for e in ("start", "end")]
    return "select distinct * from (" + " union all ".join(
        [*edges, TEMPO_DIFF.format(x=x), f"select * from ({STRUCTURE_DIFF.format(x=x)})"]) + ")"


query("jon09_compare_coarse", "piece_id reason:s",
      lambda w: Y.compare_corpora(w.decoded, w.decoded_of(COARSE)), _all_diffs("co_"), O.corpus_ctes("co_", COARSE))
query("jon09_compare_chunking", "piece_id reason:s",
      lambda w: Y.compare_corpora(w.decoded, w.decoded_of(SHORT)), _all_diffs("sh_"), O.corpus_ctes("sh_", SHORT))
query("set04_note_set_diff", "piece_id track_number at pitch velocity side edge:s",
      lambda w: Y.note_set_diff(w.decoded.notes, w.decoded_of(COARSE).notes),
      " union all ".join(
          f"""select piece_id, track_number, "{e}" as at, pitch, velocity, {sign} as side, '{e}' as edge from (
                select piece_id, track_number, "{e}", pitch, velocity from {a}
                except select piece_id, track_number, "{e}", pitch, velocity from {b})"""
          for e in ("start", "end") for sign, a, b in ((1, "decoded", "co_decoded"), (-1, "co_decoded", "decoded"))),
      O.corpus_ctes("co_", COARSE))


def _scrambled(w: Workspace) -> DataFrame:
    """Tokens of which every 97th body token is lost, to have something to audit."""
    return K.renumber(w.tokens.filter("type in ('BOS','EOS') or (piece_id + seq) % 97 != 0"))


SCRAMBLED = """
    with kept as (select * replace (row_number() over (partition by piece_id order by seq) - 1 as seq)
                  from tokens where type in ('BOS', 'EOS') or (piece_id + seq) % 97 <> 0),
         seen as (select *, lag(type) over w as prev,
                         sum(cast(type = 'SEP' as int)) over (partition by piece_id order by seq) as n_sep,
                         last(case when type = 'M' then -1 when type = 'P' then position end ignore nulls) over
                           (partition by piece_id order by seq rows between unbounded preceding and 1 preceding) as place,
                         last(case when type in ('P', 'T') then type end ignore nulls) over
                           (partition by piece_id order by seq rows between unbounded preceding and 1 preceding) as pt
                  from kept window w as (partition by piece_id order by seq)),
         stray as (select piece_id, track_number, min(seq) as seq from kept n where type = 'N' and not exists (
                     select 1 from kept r where r.type = 'R' and r.piece_id = n.piece_id
                     and r.track_number = n.track_number) group by 1, 2)"""
query("flt12_audit_grammar", "piece_id seq violation:s", lambda w: Y.audit_grammar(_scrambled(w)),
      SCRAMBLED + """
    select piece_id, seq, 'track in body' as violation from seen where type = 'R' and n_sep > 0
    union all select piece_id, seq, 'measure in head' from seen where type = 'M' and n_sep = 0
    union all select piece_id, seq, 'position in head' from seen where type = 'P' and n_sep = 0
    union all select piece_id, seq, 'tempo in head' from seen where type = 'T' and n_sep = 0
    union all select piece_id, seq, 'note in head' from seen where type = 'N' and n_sep = 0
    union all select piece_id, seq, 'no position before tempo' from seen
      where type = 'T' and n_sep > 0 and coalesce(place, -1) < 0
    union all select piece_id, seq, 'no position before note' from seen
      where type = 'N' and n_sep > 0 and coalesce(place, -1) < 0
    union all select piece_id, seq, 'note in undeclared track' from stray""")
query("flt13_audit_order", "piece_id seq violation:s", lambda w: Y.audit_order(_scrambled(w)),
      SCRAMBLED + """
    select piece_id, seq, 'after BOS only tracks' as violation from seen where prev = 'BOS' and type <> 'R'
    union all select piece_id, seq, 'after track only track or separator' from seen
      where prev = 'R' and type not in ('R', 'SEP')
    union all select piece_id, seq, 'after separator only measure' from seen where prev = 'SEP' and type <> 'M'
    union all select piece_id, seq, 'head token in body' from seen
      where type in ('R', 'SEP', 'BOS') and prev not in ('BOS', 'R')
    union all select piece_id, seq, 'note or tempo right after measure' from seen
      where prev = 'M' and type in ('N', 'T')
    union all select piece_id, seq, 'position after position' from seen where prev = 'P' and type = 'P'
    union all select piece_id, seq, 'tempo after note' from seen where prev = 'N' and type = 'T'
    union all select piece_id, seq, 'position does not increase' from seen
      where type = 'P' and place >= 0 and position <= place
    union all select piece_id, seq, 'second tempo at position' from seen where type = 'T' and pt = 'T'
    union all select piece_id, seq, 'note in undeclared track' from stray""")

# ---- statistics -------------------------------------------------------------------------

query("agg02_tokens_per_piece", "piece_id n_tokens", lambda w: T.tokens_per_piece(w.tokens),
      "select piece_id, count(*) as n_tokens from tokens group by 1")
query("agg02_average_tokens", "avg_tokens:d", lambda w: T.average_tokens(w.tokens),
      "select count(*) / count(distinct piece_id) as avg_tokens from tokens")
query("agg03_max_mps_bound", "max_mps_number", lambda w: T.max_mps_bound(w.tokens),
      """select max(b) as max_mps_number from (
           select 2 * count(case when type in ('M', 'P') then 1 end) + count(case when type = 'T' then 1 end) + 4 as b
           from tokens group by piece_id)""")
query("agg04_set03_time_signatures_used", "numer denom", lambda w: T.supported_used(w.tokens),
      "select distinct numer, denom from tokens where type = 'M' and denom in (2, 4, 8)")
TYPES = {"multinote": "N", "tempo": "T", "position": "P", "measure": "M", "track": "R"}
COUNTS = ", ".join(f'count(case when type = \'{t}\' then 1 end) as "{n}"' for n, t in TYPES.items())
query("agg05_token_type_counts", "piece_id multinote tempo position measure track all",
      lambda w: T.token_type_counts(w.tokens), f'select piece_id, {COUNTS}, count(*) as "all" from tokens group by 1')
query("agg05_token_type_totals", "multinote tempo position measure track all",
      lambda w: T.token_type_totals(w.tokens), f'select {COUNTS}, count(*) as "all" from tokens')
SHAPES = """select case when is_cont = 1 then '0,0,1~;' else '0,0,1;' end as shape, count(*) as n
            from tokens where type = 'N' group by 1"""
query("agg07_shape_distribution", "shape:s n share:d", lambda w: T.shape_distribution(w.tokens),
      f"select shape, n, n / sum(n) over () as share from ({SHAPES})")
MERGED_SHAPES = "select shape, count(*) as n from m{r}_notes where k is not null group by shape".format(r=ROUNDS)
query("agg07_top04_merged_shapes", "shape:s n share:d",
      lambda w: T.top_shapes(T.shape_distribution(w.merged), 20),
      f"""select shape, n, share from (
            select {O.shape_sql('shape')} as shape, n, n / sum(n) over () as share, len(shape) as members from ({MERGED_SHAPES}) s)
          where members > 1 order by n desc, shape desc limit 20""", O.merge_ctes("", CORPUS, ROUNDS))
DESCRIBE = """select name, count(value) as count, avg(value) as mean, stddev_samp(value) as std, min(value) as min,
    quantile_cont(value, 0.25) as "25%", quantile_cont(value, 0.5) as "50%", quantile_cont(value, 0.75) as "75%",
    max(value) as max from ({rows}) group by name"""
DESCRIBE_SPEC = "name:s count mean:d std:d min:d 25%:d 50%:d 75%:d max:d"
query("agg08_job07_snk07_corpus_stats", DESCRIBE_SPEC, lambda w: T.corpus_stats(w.tokens),
      DESCRIBE.format(rows=f"""unpivot (select {COUNTS}, count(*) as "all" from tokens group by piece_id)
                               on multinote, tempo, position, measure, track, "all" into name name value value"""))
query("agg27_mps_stats", "n_runs avg_length:d", lambda w: V.mps_stats(w.example_build.token_rows),
      """select count(*) as n_runs, avg(n) as avg_length from (
           select count(*) as n from rows group by piece_id, mps having count(*) >= 2)""")
query("agg28_shape_sizes", "shape_size n", lambda w: T.shape_size_histogram(w.merged),
      f"select len(shape) as shape_size, sum(n) as n from ({MERGED_SHAPES}) group by 1", O.merge_ctes("", CORPUS, ROUNDS))
# Both single notes have no text of a shape and are one.
query("agg28_described_shape_sizes", DESCRIBE_SPEC, lambda w: T.describe_shape_sizes(w.merged),
      DESCRIBE.format(rows=f"""select 'shape_size' as name, value from (
        select distinct case when len(shape) > 1 then shape end as s, len(shape) as value from ({MERGED_SHAPES}))"""),
      O.merge_ctes("", CORPUS, ROUNDS))
query("win18_top_p_pitches", "attr:s item n p:d", lambda w: T.truncate_top_p(
    w.decoded.notes.groupBy(F.lit("pitch").alias("attr"), F.col("pitch").alias("item"))
    .agg(F.count("*").alias("n")), 0.5),
      """select 'pitch' as attr, item, n, p from (
           select *, row_number() over (order by n desc, item) as pos,
                  sum(n) over (order by n desc, item rows unbounded preceding) / sum(n) over () as upto,
                  n / sum(n) over () as p
           from (select pitch as item, count(*) as n from decoded group by 1)) where upto < 0.5 or pos = 1""")
query("win18_top_k_velocities", "attr:s item n", lambda w: T.truncate_top_k(
    w.decoded.notes.groupBy(F.lit("velocity").alias("attr"), F.col("velocity").alias("item"))
    .agg(F.count("*").alias("n")), 0.3),
      """select 'velocity' as attr, item, n from (
           select *, row_number() over (order by n desc, item) as pos, count(*) over () as size
           from (select velocity as item, count(*) as n from decoded group by 1))
         where pos <= greatest(1, floor(size * 0.3))""")
query("arr01_explode_text", "piece_id seq text:s", lambda w: K.explode_text(w.corpus),
      "select piece_id, seq, text from tokens")
query("arr02_head_of", "piece_id pos track_token:s", lambda w: K.head_of(w.corpus),
      "select piece_id, track_number as pos, text as track_token from tokens where type = 'R'")
query("arr03_count_substring", "piece_id n_measures n_positions",
      lambda w: w.corpus.select("piece_id", K.count_substring("text", " M").alias("n_measures"),
                                K.count_substring("text", " P").alias("n_positions")),
      """select piece_id, count(case when type = 'M' then 1 end) as n_measures,
                count(case when type = 'P' then 1 end) as n_positions from tokens group by 1""")

# ---- features ---------------------------------------------------------------------------

ZERO = """select p.piece_id, b.bin, coalesce(n, 0) as n
          from (select distinct piece_id from tracks) p cross join (select unnest(range(0, 128)) as bin) b
          left join (select piece_id, {c} as bin, count(*) as n from decoded group by 1, 2) h
               on h.piece_id = p.piece_id and h.bin = b.bin"""
query("agg09_pitch_histogram", "piece_id bin n",
      lambda w: X.zero_filled(X.pitch_histogram(w.decoded.notes), w.build().accepted), ZERO.format(c="pitch"))
query("agg10_pitch_class_entropy", "piece_id pitch_class_entropy:d",
      lambda w: X.pitch_class_entropy(w.decoded.notes), "select piece_id, pce as pitch_class_entropy from entropy")
query("agg11_duration_distribution", "piece_id feature:s bin:s n",
      lambda w: X.duration_distribution(w.decoded.notes, 12),
      "select * from hist where feature = 'duration_distribution'")
query("agg12_velocity_histogram", "piece_id bin n",
      lambda w: X.zero_filled(X.velocity_histogram(w.decoded.notes), w.build().accepted), ZERO.format(c="velocity"))
query("agg13_instrumentation_self_similarity", "piece_id instrumentation_self_similarity:d",
      lambda w: w.features, "select piece_id, iss as instrumentation_self_similarity from instr")
query("agg14_grooving_self_similarity", "piece_id grooving_self_similarity:d",
      lambda w: w.features, "select piece_id, gss as grooving_self_similarity from groove")
query("job03_piece_histograms", "piece_id feature:s bin:s n", lambda w: w.hists, "select * from hist")
FEATURE_SPEC = "piece_id pitch_class_entropy:d instrumentation_self_similarity:d grooving_self_similarity:d"
FEATURES = """select piece_id, pce as pitch_class_entropy, iss as instrumentation_self_similarity,
                     gss as grooving_self_similarity from {x}features"""
query("job04_raw_features", FEATURE_SPEC, lambda w: J.raw_features(w.raw)[0], FEATURES.format(x="ev_"),
      O.evaluation_ctes())
query("agg15_job05_described_features", DESCRIBE_SPEC, lambda w: X.aggregate_scalars(w.features),
      DESCRIBE.format(rows=f"""unpivot ({FEATURES.format(x='')}) on pitch_class_entropy,
          instrumentation_self_similarity, grooving_self_similarity into name name value value"""))
query("agg15_summed_histograms", "feature:s bin:s n", lambda w: X.aggregate_histograms(w.hists),
      "select feature, bin, sum(n) as n from hist group by 1, 2")
ALIGNED = f"""select coalesce(p.feature, t.feature) as feature, coalesce(p.bin, t.bin) as bin,
                     p.n as pred, t.n as true_n
              from ({TEST_HIST}) p full join ({TRAIN_HIST}) t on p.feature = t.feature and p.bin = t.bin"""
query("jon10_aligned_histograms", "feature:s bin:s pred true_n",
      lambda w: X.align_histograms(*w.test_and_train).withColumnRenamed("true", "true_n"), ALIGNED)
SHARES = f"""(select *, pred / sum(pred) over w as p, true_n / sum(true_n) over w as t
              from ({ALIGNED}) {{where}} window w as (partition by feature))"""
KLD = f"""select feature, sum(case when coalesce(true_n, 0) = 0 then 0 else t * ln(t / p) end) as kld
          from {SHARES.format(where='where pred is not null')} group by feature"""
HI = f"""select feature, sum(least(coalesce(p, 0), coalesce(t, 0))) as hi from {SHARES.format(where='')} group by 1"""
query("agg16_kl_divergence", "feature:s kld:d",
      lambda w: X.kl_divergence(X.align_histograms(*w.test_and_train)), KLD)
query("agg17_normal_moments", "feature:s mean:d std:d", lambda w: X.normal_moments(w.test_and_train[0]),
      f"""select feature, sum(x * n) / sum(n) as mean, sqrt(sum(x * x * n) / sum(n) - (sum(x * n) / sum(n)) ** 2) as std
          from (select feature, n, case when bin like '%/%' then cast(split_part(bin, '/', 1) as double)
                  / cast(split_part(bin, '/', 2) as double) else cast(bin as double) end as x
                from ({TEST_HIST})) group by feature""")
MOMENTS = """select feature, m, sqrt(greatest(s2 - m * m, 0)) as s from (
    select feature, sum(x * n) / sum(n) as m, sum(x * x * n) / sum(n) as s2
    from (select feature, n, case when bin like '%/%' then cast(split_part(bin, '/', 1) as double)
          / cast(split_part(bin, '/', 2) as double) else cast(bin as double) end as x from ({rows})) group by feature)"""
BELOW = lambda x, m, s: f"(1 + {O.erf(f'(({x}) - {m}) / ({s} * sqrt(2.0))')}) / 2"
PART = lambda x: f"abs({BELOW(x, 'm1', 's1')} - {BELOW(x, 'm2', 's2')})"
OVERLAP = f"""select feature, case when not (s1 > 0 and s2 > 0) then 'NaN'::double
    when s1 = s2 then 1 - {O.erf('abs(m2 - m1) / (2 * s1 * sqrt(2.0))')} else 1 - {PART('c + r')} - {PART('c - r')} end as oa
  from (select *, (m1 * s2 * s2 - m2 * s1 * s1) / nullif(s2 * s2 - s1 * s1, 0) as c,
               s1 * s2 * sqrt((m2 - m1) ** 2 + (s2 * s2 - s1 * s1) * ln(s2 * s2 / (s1 * s1))) / nullif(s2 * s2 - s1 * s1, 0) as r
        from (select a.feature, a.m as m1, a.s as s1, b.m as m2, b.s as s2
              from ({MOMENTS.format(rows=TEST_HIST)}) a join ({MOMENTS.format(rows=TRAIN_HIST)}) b on a.feature = b.feature))"""
query("agg17_normal_overlap", "feature:s oa:d", lambda w: X.normal_overlap(*w.test_and_train), OVERLAP)
query("agg18_histogram_intersection", "feature:s hi:d",
      lambda w: X.histogram_intersection(X.align_histograms(*w.test_and_train)), HI)
query("agg19_job06_compare_with_ref", "feature:s kld:d oa:d hi:d", lambda w: X.compare_with_ref(*w.test_and_train),
      f"""select k.feature, kld, oa, hi from ({KLD}) k join ({OVERLAP}) o on k.feature = o.feature
          join ({HI}) h on k.feature = h.feature""")
query("agg25_notes_per_piece", "piece_id n_notes", lambda w: X.notes_per_piece(w.decoded.notes),
      "select piece_id, count(*) as n_notes from decoded group by 1")
query("agg25_note_totals", "n_notes avg_notes:d", lambda w: X.note_totals(w.decoded.notes),
      "select count(*) as n_notes, count(*) / count(distinct piece_id) as avg_notes from decoded")
query("agg26_playback_seconds", "piece_id seconds:d",
      lambda w: X.playback_seconds(w.decoded.notes, w.decoded.tempos, 12),
      """with ends as (select piece_id, max("end") as e from decoded group by 1)
         select t.piece_id, sum(greatest(least(coalesce(nxt, e), e) - onset, 0) * 60 / (bpm * 12)) as seconds
         from (select *, lead(onset) over (partition by piece_id order by onset) as nxt
               from timed where type = 'T') t join ends on t.piece_id = ends.piece_id group by 1""")
query("agg29_programs_present", "piece_id n_programs", lambda w: X.programs_present(w.decoded.tracks),
      "select piece_id, count(distinct instrument) as n_programs from tracks group by 1")

# ---- merges -----------------------------------------------------------------------------

query("bpe01_top02_multi_notes", MN_SPEC, lambda w: w.multi_notes, "select * from mn")
query("jon06_neighbour_pairs", "piece_id track_number phrase a_k b_k",
      lambda w: w.pairs.select("piece_id", "track_number", "phrase", F.col("a.k").alias("a_k"),
                               F.col("b.k").alias("b_k")), "select * from pairs")
query("agg20_avg_mulpi_size", "avg_mulpi_size:d", lambda w: B.avg_mulpi_size(w.multi_notes),
      """select avg(n) as avg_mulpi_size from (select count(*) as n from mn
         group by piece_id, track_number, onset, stretch, velocity)""")
query("agg20_avg_mulpi_size_any_velocity", "avg_mulpi_size:d", lambda w: B.avg_mulpi_size(w.multi_notes, True),
      """select avg(n) as avg_mulpi_size from (select count(*) as n from mn
         group by piece_id, track_number, onset, stretch)""")
query("agg21_totals", "n_multi_notes n_tracks", lambda w: B.totals(w.multi_notes),
      "select count(*) as n_multi_notes, count(distinct row(piece_id, track_number)) as n_tracks from mn")
query("agg22_avg_neighbours", "n_multi_notes n_neighbours avg:d", lambda w: B.avg_neighbours(w.multi_notes, w.pairs),
      """select m as n_multi_notes, n as n_neighbours, n / m as avg
         from (select count(*) as m from mn), (select count(*) as n from pairs)""")


def _kernel_counts(w: Workspace, adjacency: str) -> DataFrame:
    keys = B.score_shapes(B.lay_out(w.multi_notes), B.DEFAULT_SHAPES, adjacency, CORPUS.tpq)
    return B.named_counts(keys.filter("l >= 0"), w.single_shapes.select("shape_id", "shape"))


OURS, MULPI = O.pair_shapes(""), O.pair_shapes("", "a_onset = b_onset and ls = rs")
query("agg23_shape_counts_ours", "text:s n",
      lambda w: B.shape_counts_from_pairs(w.pairs, w.single_shapes, "ours", CORPUS), OURS)
query("agg23_udf02_shape_counts_mulpi", "text:s n",
      lambda w: B.shape_counts_from_pairs(w.pairs, w.single_shapes, "mulpi", CORPUS), MULPI)
query("bpe02_score_shapes_ours", "text:s n", lambda w: _kernel_counts(w, "ours"), OURS)
query("bpe02_score_shapes_mulpi", "text:s n", lambda w: _kernel_counts(w, "mulpi"), MULPI)
query("agg24_best_shape", "text:s n", lambda w: B.best_shape(_kernel_counts(w, "ours")),
      f"select text, n from ({OURS}) order by n desc, text limit 1")
query("src08_snk03_shapes_round_trip", "shape_id text:s", _shapes_round_trip,
      f"select row_number() over (order by n desc, text) + 1 as shape_id, text from ({OURS})")


def _merged_once(w: Workspace) -> DataFrame:
    best = B.best_shape(_kernel_counts(w, "ours")).first()["text"]
    return B.merge_shape(B.lay_out(w.multi_notes), B.DEFAULT_SHAPES, B.shape_tuple(best), CORPUS.tpq)


query("bpe03_win16_merged_once", MN_SPEC, _merged_once, O.merged_once(""))
query("jon06_neighbours_within_two", "piece_id track_number phrase a_k b_k",
      lambda w: B.neighbour_pairs(w.multi_notes, w.single_shapes, CORPUS.tpq, limit=2).select(
          "piece_id", "track_number", "phrase", F.col("a.k").alias("a_k"), F.col("b.k").alias("b_k")),
      "select piece_id, track_number, phrase, a_k, b_k from pairs where b_k <= a_k + 2")
OURS_MERGES = O.merge_ctes("", CORPUS, ROUNDS)
MULPI_MERGES = O.merge_ctes("mu_", CORPUS, ROUNDS, condition="a_onset = b_onset and ls = rs")
MOTIF_MERGES = O.motif_ctes() | O.merge_ctes("mo_", CORPUS, ROUNDS, "mo_mn")
FOREIGN_MERGES = O.corpus_ctes("sh_", SHORT) | O.bpe_ctes("sh_", SHORT) | O.merge_ctes("sh_", SHORT, ROUNDS, "sh_mn", best="")
LAST = f"m{ROUNDS}_notes"


def _log_sql(x: str, condition: str = "true") -> str:
    return " union all ".join(
        f"""select {r} as iteration, (select count(*) from {x}m{r}_pairs) / (select count(*) from {x}m{r}_notes) as avg_neighbours,
                   (select count(*) from {x}m{r}_counts) as n_shapes, {O.shape_sql('shape')} as shape, n as score,
                   (select count(*) from {x}m{r}_notes) as n_multi_notes, 0 as cut_notes,
                   (select count(*) from {x}m{r}_named where not fits and ({condition})) as oversized_pairs from {x}m{r}_best"""
        for r in range(ROUNDS))


query("bpe04_win16_learned_multi_notes", MN_SPEC, lambda w: w.learned().multi_notes, f"select * from {LAST}", OURS_MERGES)
query("bpe04_learned_mulpi", MN_SPEC, lambda w: w.learned("mulpi").multi_notes, f"select * from mu_{LAST}", MULPI_MERGES)
query("bpe04_learned_motifs", MN_SPEC, lambda w: w.learned(motifs=True).multi_notes, f"select * from mo_{LAST}", MOTIF_MERGES)
LOG_SPEC = "iteration avg_neighbours:d n_shapes shape:s score n_multi_notes cut_notes oversized_pairs"
query("bpe09_iteration_log", LOG_SPEC, lambda w: w.learned().iteration_log(w.spark), _log_sql(""), OURS_MERGES)
query("bpe09_iteration_log_motifs", LOG_SPEC, lambda w: w.learned(motifs=True).iteration_log(w.spark), _log_sql("mo_"), MOTIF_MERGES)
MULPI_SIZE = """(select avg(n) from (select count(*) as n from {t} group by piece_id, track_number, onset, stretch, velocity))"""
query("bpe09_run_log", "start_multi_notes start_avg_mulpi:d end_multi_notes end_avg_mulpi:d", lambda w: w.learned(motifs=True).run_log(),
      f"""select (select count(*) from mo_mn) as start_multi_notes, {MULPI_SIZE.format(t='mo_mn')} as start_avg_mulpi,
                 (select count(*) from mo_{LAST}) as end_multi_notes, {MULPI_SIZE.format(t='mo_' + LAST)} as end_avg_mulpi""", MOTIF_MERGES)
query("bpe05_bpe03_applied_multi_notes", MN_SPEC, lambda w: w.applied, f"select * from {LAST}", OURS_MERGES)


def _foreign(w: Workspace) -> DataFrame:
    """The shapes of one corpus applied to another one, which has other notes and wouldn't learn them."""
    other = B.to_multi_notes(J.timed_tokens(w.tokens_of(SHORT), SHORT.tpq), SHORT.tpq)
    return B.apply_shapes(other, w.learned().shapes, SHORT.tpq)


query("bpe06_apply_foreign", MN_SPEC, _foreign, f"select * from sh_{LAST}", OURS_MERGES | FOREIGN_MERGES)


def _merged_round_trip(w: Workspace) -> DataFrame:
    folder = w.scratch("merged")
    Z.write_corpus(K.join_text(w.merged), folder)
    return Z.read_corpus(w.spark, folder)


MERGED = OURS_MERGES | O.merged_ctes("mg_", ROUNDS)
query("bpe07_snk04_merged_corpus", "piece_id text:s", _merged_round_trip, LINES.format(t="mg_tokens"), MERGED)
query("exm01_merged_vocab", "attr:s id text:s", lambda w: w.merged_build.vocab, "select * from mg_vocab", MERGED)
query("jon07_merged_rows", "piece_id seq evt pit dur vel trn mps", lambda w: w.merged_build.token_rows, "select * from mg_rows", MERGED)
query("jon08_merged_rows_and_back", "piece_id seq text:s",
      lambda w: V.decode_rows(w.merged_build.token_rows, w.merged_build.vocab), "select piece_id, seq, text from mg_tokens", MERGED)
query("exm04_merged_examples", "piece_id vp_idx pitch_shift pos evt pit dur vel trn mps", lambda w: w.merged_build.examples,
      "select piece_id, vp_idx, shift as pitch_shift, pos, evt, pit, dur, vel, trn, mps4 as mps from mg_shifted", MERGED)
# Merging changes no feature.
query("job03_merged_features", FEATURE_SPEC, lambda w: J.piece_features(w.merged, CORPUS.tpq)[0], FEATURES.format(x=""))


def _edges(notes: DataFrame) -> DataFrame:
    """Starts and ends as sets; which of two overlapping twins ends first is not in the text."""
    edge = lambda e: notes.select("piece_id", "track_number", F.col(e).alias("at"), "pitch", "velocity",
                                  F.lit(e).alias("edge")).distinct()
    return edge("start").unionByName(edge("end"))


query("bpe08_merged_notes_as_before", "piece_id track_number at pitch velocity edge:s",
      lambda w: _edges(w.merged_decoded.notes),
      """select distinct piece_id, track_number, "start" as at, pitch, velocity, 'start' as edge from decoded
         union all
         select distinct piece_id, track_number, "end", pitch, velocity, 'end' from decoded""")
query("bpe08_verify_merged", "piece_id reason:s", lambda w: Y.compare_corpora(w.decoded, w.merged_decoded),
      "select piece_id, text as reason from tokens where false")
def _damaged(d: D.Decoded) -> D.Decoded:
    """A corpus with something lost or changed in some pieces, and a note twice in others, which is no difference."""
    piece = F.col("piece_id")
    notes = d.notes.filter((piece % 7 != 2) | (F.col("pitch") != F.col("start") % 60 + 30))
    return replace(d, notes=notes.union(notes.filter((piece % 5 == 0) & (F.col("start") % 3 == 0))),
                   tempos=d.tempos.withColumn("bpm", F.col("bpm") + F.when((piece % 11 == 3) & (F.col("onset") > 0), 8).otherwise(0)),
                   tracks=d.tracks.filter((piece % 13 != 4) | (F.col("track_number") > 0)),
                   time_sigs=d.time_sigs.filter((piece % 9 != 6) | (F.col("onset") == 0)))


query("bpe08_verify_damaged", "piece_id reason:s", lambda w: Y.compare_corpora(w.decoded, _damaged(w.merged_decoded)),
      """select distinct piece_id, 'notes' as reason from decoded where piece_id % 7 = 2 and pitch = "start" % 60 + 30
         union all select distinct t.piece_id, 'tempos' from tempos t join m0 z on t.piece_id = z.piece_id where t.piece_id % 11 = 3 and onset > m0
         union all select distinct piece_id, 'tracks' from tracks where piece_id % 13 = 4 and track_number = 0
         union all select distinct piece_id, 'time signatures' from (
           select b.*, lag(row(numer, denom)) over (partition by piece_id order by onset) as prev from bars b)
         where piece_id % 9 = 6 and prev is not null and prev <> row(numer, denom)""")
query("jon04_expanded_multi_notes", "piece_id track_number onset pitch duration is_cont velocity",
      lambda w: D.expand_multi_notes(w.applied, w.learned().shapes_frame(w.spark)),
      "select * from timed where type = 'N'")
query("jon12_within_shape_links", "piece_id track_number k i j link:s from_tick to_tick",
      lambda w: D.within_shape_links(w.learned(motifs=True).multi_notes, w.learned(motifs=True).shapes_frame(w.spark), CORPUS.tpq),
      f"""select piece_id, track_number, k, i, j, case when b_onset < a_end then 'overlap' else 'following' end as link,
                 case when b_onset < a_end then a_onset else a_end end as from_tick, b_onset as to_tick
          from (select piece_id, track_number, k, i, j, onset + shape[i + 1][1] * stretch as a_onset,
                       onset + (shape[i + 1][1] + shape[i + 1][3]) * stretch as a_end, onset + shape[j + 1][1] * stretch as b_onset
                from (select *, unnest(range(i + 1, len(shape))) as j from (
                        select *, unnest(range(0, len(shape))) as i from mo_{LAST} where len(shape) > 1)))
          where b_onset - a_end <= {4 * CORPUS.tpq}""", MOTIF_MERGES)

# ---- vocabularies and rows --------------------------------------------------------------

query("exm01_vocab", "attr:s id text:s", lambda w: w.example_build.vocab, "select * from vocab")
query("agg32_vocab_summary", "attr:s size", lambda w: V.vocab_summary(w.example_build.vocab),
      "select attr, count(*) as size from vocab group by 1")
query("jon07_token_rows", "piece_id seq evt pit dur vel trn mps", lambda w: w.example_build.token_rows,
      "select * from rows")
query("jon08_flt17_decoded_rows", "piece_id seq text:s",
      lambda w: V.decode_rows(w.example_build.token_rows, w.example_build.vocab),
      "select piece_id, seq, text from tokens")
def _padded_rows(w: Workspace) -> DataFrame:
    """Token rows with rows of zeros after each piece's last, as batches have them."""
    rows = w.example_build.token_rows
    last = rows.groupBy("piece_id").agg(F.max("seq").alias("last"))
    zeros = [F.lit(0).alias(a) for a in E.ATTRS]
    return rows.unionByName(last.select("piece_id", F.explode(F.sequence(F.col("last") + 1, F.col("last") + 1 + F.col("piece_id") % 5)).alias("seq"), *zeros))


query("flt17_dropped_padding", "piece_id seq evt pit dur vel trn mps", lambda w: V.drop_padding(_padded_rows(w)), "select * from rows")
query("jon08_flt17_padded_rows", "piece_id seq text:s", lambda w: V.decode_rows(_padded_rows(w), w.example_build.vocab),
      "select piece_id, seq, text from tokens")
query("flt14_bad_rows", "piece_id seq mps",
      lambda w: V.check_token_rows(w.example_build.token_rows, w.example_build.vocab, 1024, 300),
      "select piece_id, seq, mps from rows where mps > 300")

# ---- splits -----------------------------------------------------------------------------

query("jon03_splits", "piece_id path:s split:s", lambda w: P.apply_splits(w.build().accepted, w.splits), SPLIT_OF)
query("set06_excluded", "piece_id path:s",
      lambda w: P.exclude_paths(w.build().accepted, w.splits.filter("split = 'valid'"), w.splits.filter("split = 'test'")),
      f"select piece_id, path from ({SPLIT_OF}) where split = 'train'")
query("set07_split_overlap", "path_suffix:s", lambda w: P.split_overlap(w.splits),
      """select path_suffix from splits where split = 'test'
         intersect select path_suffix from splits where split = 'valid'""")
query("agg30_split_report", "item:s n", lambda w: P.split_report(w.build().accepted, w.splits),
      f"""select split as item, count(*) as n from ({SPLIT_OF}) group by 1
          union all select 'unmatched suffixes', count(distinct path_suffix) from splits s where not exists (
            select 1 from ({SPLIT_OF}) q where ends_with('/' || q.path, '/' || s.path_suffix))
          union all select 'suffixes listed twice', count(*) from (
            select 1 from splits group by path_suffix, split having count(*) > 1)
          union all select 'suffixes in both lists', count(*) from (
            select path_suffix from splits where split = 'test'
            intersect select path_suffix from splits where split = 'valid')""")
query("jon14_attached_paths", "piece_id path:s text:s", lambda w: P.attach_paths(w.corpus, w.raw.pieces),
      f"select c.piece_id, path, text from ({LINES.format(t='tokens')}) c join pieces p on c.piece_id = p.piece_id")
query("top05_numbered_paths", "piece_id path:s", lambda w: R.number_paths(w.raw.pieces),
      "select row_number() over (order by path) - 1 as piece_id, path from pieces")
query("top06_first_paths", "path:s", lambda w: P.first_n(w.build().accepted, 10),
      """select path from pieces where piece_id not in (select piece_id from rejects) order by path limit 10""")

# ---- examples ---------------------------------------------------------------------------

query("win17_virtual_pieces", "piece_id vp_idx start n_rows body_start", lambda w: w.example_build.starts,
      "select * from starts")
query("exm02_cut_examples", "piece_id vp_idx pos evt pit dur vel trn mps",
      lambda w: E.cut_examples(w.example_build.token_rows, w.example_build.starts, EXAMPLES), "select * from cut")
query("exm03_exm04_augmented", "piece_id vp_idx pitch_shift pos evt pit dur vel trn mps", lambda w: w.examples,
      "select piece_id, vp_idx, shift as pitch_shift, pos, evt, pit, dur, vel, trn, mps4 as mps from shifted")
ALL_ATTRS = "piece_id vp_idx pitch_shift pos evt pit dur vel trn mps"
OF_EXAMPLE = "piece_id, vp_idx, shift"
query("exm05_permuted_tracks", ALL_ATTRS,
      lambda w: E.permute_tracks(w.examples, CORPUS.max_track_number, EXAMPLES),
      f"""select s.piece_id, s.vp_idx, s.shift as pitch_shift, pos, evt, pit, dur, vel, coalesce(place, 0) as trn, mps4 as mps
          from shifted s left join (
            select *, row_number() over (partition by {OF_EXAMPLE} order by {O.shared_hash('0', OF_EXAMPLE, 't')}, t) as place
            from (select *, unnest(range(1, {CORPUS.max_track_number + 1})) as t from (select distinct {OF_EXAMPLE} from shifted))) p
          on s.piece_id = p.piece_id and s.vp_idx = p.vp_idx and s.shift = p.shift and s.trn = p.t""")
query("exm06_permuted_mps", ALL_ATTRS, lambda w: E.permute_mps(w.examples, EXAMPLES),
      f"""select piece_id, vp_idx, shift as pitch_shift, evt, pit, dur, vel, trn, mps4 as mps,
                 row_number() over (partition by {OF_EXAMPLE} order by is_body, mps4, {O.shared_hash('0', OF_EXAMPLE, 'pos')}) - 1 as pos
          from shifted""")
query("exm07_rotated", "piece_id vp_idx start", lambda w: E.rotate(w.example_build.starts, 5),
      """select piece_id, vp_idx, start from (select *, count(*) over (partition by piece_id) as n from starts)
         where vp_idx = 5 % n""")
query("exm08_example_count", "n_examples", lambda w: E.example_count(w.example_build.starts, EXAMPLES),
      "select count(*) * 3 as n_examples from starts")


def _padded(w: Workspace) -> DataFrame:
    rows = E.pad_batch(E.to_arrays(w.examples), EXAMPLES.max_len, "left")
    text = lambda a: F.concat_ws(",", F.col(a).cast("array<string>"))
    return rows.select("piece_id", "vp_idx", "pitch_shift", "length", *(text(a).alias(a) for a in E.ATTRS))


ATTR_SQL = {a: "mps4" if a == "mps" else a for a in E.ATTRS}
query("exm09_arr05_padded", "piece_id vp_idx pitch_shift length " + " ".join(f"{a}:s" for a in E.ATTRS), _padded,
      "select piece_id, vp_idx, shift as pitch_shift, count(*) as length, " + ", ".join(
          f"repeat('0,', 64 - count(*)) || string_agg(cast({c} as varchar), ',' order by pos) as {a}" for a, c in ATTR_SQL.items())
      + " from shifted group by 1, 2, 3")
def _exported(w: Workspace) -> DataFrame:
    """All examples written in shards of 100 kB, the first waves by an export that is broken off, and read back."""
    folder, arrays = w.scratch("export"), stage(E.to_arrays(w.examples), "arrays")
    E.export_examples(arrays, folder, EXAMPLES, shard_bytes=100_000, bucket_width=16, wave=3, waves=1)
    E.export_examples(arrays, folder, EXAMPLES, shard_bytes=100_000, bucket_width=16)
    rows = E.read_shards(w.spark, folder)
    text = lambda a: F.concat_ws(",", F.slice(a, F.lit(1), F.col("length")).cast("array<string>"))
    return rows.select("piece_id", "vp_idx", "pitch_shift", "length", "bucket", *(text(a).alias(a) for a in E.ATTRS))


query("exm09_exported_shards", "piece_id vp_idx pitch_shift length bucket " + " ".join(f"{a}:s" for a in E.ATTRS), _exported,
      "select piece_id, vp_idx, shift as pitch_shift, count(*) as length, (count(*) + 15) // 16 * 16 as bucket, " + ", ".join(
          f"string_agg(cast({c} as varchar), ',' order by pos) as {a}" for a, c in ATTR_SQL.items()) + " from shifted group by 1, 2, 3")
query("arr06_shifted_targets", "piece_id vp_idx pitch_shift pos evt " + " ".join(f"target_{a}" for a in E.ATTRS),
      lambda w: E.shift_targets(w.examples, drop_mps=False),
      "select * from (select piece_id, vp_idx, shift as pitch_shift, pos, evt, " + ", ".join(
          f"lead({c}) over w as target_{a}" for a, c in ATTR_SQL.items())
      + " from shifted window w as (partition by piece_id, vp_idx, shift order by pos)) where target_evt is not null")
query("exm10_primers_measures", "piece_id seq text:s", lambda w: J.primer_tokens(w.tokens, 4, "measure", CORPUS),
      "select piece_id, seq, text from timed where measure_no <= 4 and type <> 'EOS'")
query("exm10_primers_ticks", "piece_id seq text:s", lambda w: J.primer_tokens(w.tokens, 100, "tick", CORPUS),
      """select piece_id, seq, text from timed t where type <> 'EOS' and seq < coalesce(
           (select min(seq) from timed u where u.piece_id = t.piece_id and u.onset > 100), 1000000000)""")
query("exm10_primers_merged", "piece_id seq text:s",
      lambda w: J.primer_tokens(w.tokens, 4, "measure", CORPUS, w.learned().shapes),
      "select piece_id, seq, text from pm_tokens where type <> 'EOS'", OURS_MERGES | O.primer_ctes(4, ROUNDS))
query("exm10_primers_tokens", "piece_id seq text:s", lambda w: J.primer_tokens(w.tokens, 64, "token", CORPUS),
      "select piece_id, seq, text from tokens where seq < 64")


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(q: Query):
        return lambda spark, folder: shaped(q.run(Workspace.of(spark, folder)), q.spec)
    return {name: runner(q) for name, q in QUERIES.items()}


def oracle_queries() -> dict[str, str]:
    return {name: O.compose(q.sql, q.spec, *q.more) for name, q in QUERIES.items() if q.sql}
