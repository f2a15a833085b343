"""Column expressions: quantising, base-36 text, tokens and shapes."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from motifmill.params import CorpusParams, SHAPE_DURATION_LIMIT, SHAPE_ONSET_LIMIT

# Token type priorities of the corpus format.
PRIORITY = {"BOS": 0, "R": 1, "SEP": 2, "M": 3, "P": 4, "T": 5, "N": 6, "U": 6, "EOS": 7}

# The General MIDI program names, in program order, then the drum kit.
INSTRUMENT_NAMES = (
    "Acoustic Grand Piano", "Bright Acoustic Piano", "Electric Grand Piano",
    "Honky-tonk Piano", "Electric Piano 1", "Electric Piano 2", "Harpsichord", "Clavinet",
    "Celesta", "Glockenspiel", "Music Box", "Vibraphone", "Marimba", "Xylophone",
    "Tubular Bells", "Dulcimer", "Drawbar Organ", "Percussive Organ", "Rock Organ",
    "Church Organ", "Reed Organ", "Accordion", "Harmonica", "Tango Accordion",
    "Acoustic Guitar (nylon)", "Acoustic Guitar (steel)", "Electric Guitar (jazz)",
    "Electric Guitar (clean)", "Electric Guitar (muted)", "Overdriven Guitar",
    "Distortion Guitar", "Guitar harmonics", "Acoustic Bass", "Electric Bass (finger)",
    "Electric Bass (pick)", "Fretless Bass", "Slap Bass 1", "Slap Bass 2", "Synth Bass 1",
    "Synth Bass 2", "Violin", "Viola", "Cello", "Contrabass", "Tremolo Strings",
    "Pizzicato Strings", "Orchestral Harp", "Timpani", "String Ensemble 1",
    "String Ensemble 2", "Synth Strings 1", "Synth Strings 2", "Choir Aahs", "Voice Oohs",
    "Synth Voice", "Orchestra Hit", "Trumpet", "Trombone", "Tuba", "Muted Trumpet",
    "French Horn", "Brass Section", "Synth Brass 1", "Synth Brass 2", "Soprano Sax",
    "Alto Sax", "Tenor Sax", "Baritone Sax", "Oboe", "English Horn", "Bassoon", "Clarinet",
    "Piccolo", "Flute", "Recorder", "Pan Flute", "Blown Bottle", "Shakuhachi", "Whistle",
    "Ocarina", "Lead 1 (square)", "Lead 2 (sawtooth)", "Lead 3 (calliope)", "Lead 4 (chiff)",
    "Lead 5 (charang)", "Lead 6 (voice)", "Lead 7 (fifths)", "Lead 8 (bass + lead)",
    "Pad 1 (new age)", "Pad 2 (warm)", "Pad 3 (polysynth)", "Pad 4 (choir)", "Pad 5 (bowed)",
    "Pad 6 (metallic)", "Pad 7 (halo)", "Pad 8 (sweep)", "FX 1 (rain)", "FX 2 (soundtrack)",
    "FX 3 (crystal)", "FX 4 (atmosphere)", "FX 5 (brightness)", "FX 6 (goblins)",
    "FX 7 (echoes)", "FX 8 (sci-fi)", "Sitar", "Banjo", "Shamisen", "Koto", "Kalimba",
    "Bag pipe", "Fiddle", "Shanai", "Tinkle Bell", "Agogo", "Steel Drums", "Woodblock",
    "Taiko Drum", "Melodic Tom", "Synth Drum", "Reverse Cymbal", "Guitar Fret Noise",
    "Breath Noise", "Seashore", "Bird Tweet", "Telephone Ring", "Helicopter", "Applause",
    "Gunshot", "Drumset",
)

SHAPE_TYPE = "array<struct<rel_onset:int,rel_pitch:int,rel_dur:int,is_cont:int>>"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _constant_array(values) -> Column:
    """An array constant written as one text, which the optimiser folds into a literal."""
    return F.split(F.lit(",".join(str(v) for v in values)), ",")


def idiv(a, b) -> Column:
    """Integer division, as a BIGINT."""
    return F.call_function("div", _col(a), _col(b))


# ---- quantising (SCL1-SCL5, SCL12) ------------------------------------------------------

def quantize_tick(tick, ticks_per_beat, tpq: int) -> Column:
    """SCL1: ``tick / ticks_per_beat * tpq`` rounded half up, in exact integers (K1: fixed)."""
    t, b = _col(tick).cast("bigint"), _col(ticks_per_beat).cast("bigint")
    return (F.signum(t).cast("bigint") * idiv(F.abs(t) * (2 * tpq) + b, b * 2)).cast("int")


def quantize_tempo(bpm, p: CorpusParams) -> Column:
    """SCL4: snap half up to the step, clamp into the inclusive range."""
    doubled = _col(bpm).cast("decimal(30,12)") * 2 + p.tempo_step
    snapped = F.floor(doubled / (2 * p.tempo_step)).cast("int") * p.tempo_step
    return F.least(F.greatest(snapped, F.lit(p.tempo_min)), F.lit(p.tempo_max))


def quantize_velocity(velocity, step: int) -> Column:
    """SCL5: snap half up to the step, clamp into ``[step, 127 div step * step]``."""
    snapped = idiv(_col(velocity) * 2 + step, F.lit(2 * step)).cast("int") * step
    return F.least(F.greatest(snapped, F.lit(step)), F.lit(127 // step * step))


def measure_ticks(numer, denom, tpq: int) -> Column:
    """SCL12: length of one measure."""
    return idiv(_col(numer) * (4 * tpq), _col(denom)).cast("int")


def supported_time_signatures(spark: SparkSession, tpq: int = 12) -> DataFrame:
    """SCL13: denominators 2, 4, 8; numerators up to three whole notes, at most 24."""
    return (
        spark.range(1, 4)
        .select(F.expr("cast(shiftleft(1, cast(id as int)) as int)").alias("denom"))
        .select(F.explode(F.expr("sequence(1, least(24, 3 * denom))")).alias("numer"), "denom")
        .withColumn("length", measure_ticks("numer", "denom", tpq))
    )


def is_supported_time_signature(numer, denom) -> Column:
    n, d = _col(numer), _col(denom)
    return d.isin(2, 4, 8) & (n >= 1) & (n <= F.least(F.lit(24), d * 3))


# ---- programs (SCL7, SCL16, SCL20) ------------------------------------------------------

def program_of(program, is_drum) -> Column:
    """SCL7: drum tracks get instrument 128."""
    return F.when(_col(is_drum), F.lit(128)).otherwise(_col(program)).cast("int")


def split_program(instrument) -> tuple[Column, Column]:
    """SCL7 inverse: ``(program, is_drum)``."""
    return _col(instrument) % 128, _col(instrument) == 128


def pitch_class(pitch) -> Column:
    """SCL16."""
    return F.pmod(_col(pitch), F.lit(12))


def instruments(spark: SparkSession) -> DataFrame:
    """The 129 instruments with their names: a lookup of fixed size."""
    names = F.split(F.lit("|".join(INSTRUMENT_NAMES)), r"\|")
    return spark.range(1).select(F.posexplode(names).alias("instrument", "instrument_name"))


def instrument_name(df: DataFrame, column: str = "instrument") -> DataFrame:
    """SCL20: add ``instrument_name``."""
    names = instruments(df.sparkSession).withColumnRenamed("instrument", column)
    return df.join(F.broadcast(names), column, "left")


# ---- base 36 and tokens (SCL8, SCL9, SCL11) ---------------------------------------------

def _two_digit_texts() -> Column:
    """Base-36 texts of 0..1295, by rule: first digit, second digit, no leading zero."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return _constant_array((a + b).lstrip("0") or "0" for a in digits for b in digits)


def itob36(x) -> Column:
    """SCL8: signed, upper-case base-36 text.

    Token values are small, so most are looked up instead of converted digit by digit.
    """
    x = _col(x)
    return F.when(x.between(0, 36 * 36 - 1), F.get(_two_digit_texts(), x.cast("int"))).otherwise(
        F.conv(x.cast("string"), 10, -36))


def b36toi(s) -> Column:
    """SCL8 inverse."""
    return F.conv(_col(s), 36, -10).cast("int")


def note_event(shape, is_cont) -> Column:
    """``N``, ``N~`` or ``U`` followed by the shape."""
    plain = F.when(_col(is_cont) == 1, F.lit("N~")).otherwise(F.lit("N"))
    return F.when(_col(shape).isNotNull(), F.concat(F.lit("U"), _col(shape))).otherwise(plain)


def format_token(kind="type") -> Column:
    """SCL9: token text from the typed columns of a token row."""
    t, b = _col(kind), itob36
    return (
        F.when(t.isin("N", "U"), F.concat_ws(
            ":", note_event("shape", "is_cont"), b("pitch"), b("duration"), b("velocity"),
            b("track_number")))
        .when(t == "P", F.concat(F.lit("P"), b("position")))
        .when(t == "M", F.concat(F.lit("M"), b("numer"), F.lit("/"), b("denom")))
        .when(t == "T", F.concat(F.lit("T"), b("bpm")))
        .when(t == "R", F.concat(F.lit("R"), b("instrument"), F.lit(":"), b("track_number")))
        .otherwise(t)
    )


def format_shape(shape) -> Column:
    """SCL11: ``onset,pitch,dur[~];`` per member, in base 36."""
    return F.array_join(F.transform(_col(shape), lambda m: F.concat(
        itob36(m["rel_onset"]), F.lit(","), itob36(m["rel_pitch"]), F.lit(","),
        itob36(m["rel_dur"]), F.when(m["is_cont"] == 1, "~").otherwise(""), F.lit(";"))), "")


def parse_shape(text) -> Column:
    """SCL11 inverse."""
    members = F.filter(F.split(_col(text), ";"), lambda s: s != "")

    def member(s):
        f = F.split(F.rtrim(s, F.lit("~")), ",")
        return F.struct(
            b36toi(f[0]).alias("rel_onset"), b36toi(f[1]).alias("rel_pitch"),
            b36toi(f[2]).alias("rel_dur"), F.endswith(s, F.lit("~")).cast("int").alias("is_cont"))

    return F.transform(members, member)


def shared_hash(*parts) -> Column:
    """48 bits of a text key's MD5: a draw that any engine can repeat."""
    key = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint")


# ---- durations (SCL14, SCL15) -----------------------------------------------------------

def gcd_upto(a, b, bound: int) -> Column:
    """SCL17 for two values, ``0 <= b <= bound``, ``a >= 0``; ``gcd(0, b) = b``.

    Looks up a table built from the rule, so the expression stays inside generated code.  A
    ``b`` beyond the bound is an error: ``gcd_of`` takes any values.
    """
    a, b = _col(a), _col(b)
    table = _constant_array(
        gcd(i, j) for j in range(bound + 1) for i in range(bound + 1)).cast("array<int>")
    reduced = F.when(b == 0, F.lit(0)).otherwise(a % F.greatest(b, F.lit(1))).cast("int")
    return (F.when(b == 0, a).when(b > bound, F.raise_error(F.lit("gcd_upto: beyond its bound")).cast("int"))
            .otherwise(F.get(table, b.cast("int") * (bound + 1) + reduced)).cast("int"))


#: Values up to which ``gcd_of`` looks a pair up.
GCD_TABLE = 127


def gcd_of(values) -> Column:
    """SCL17: greatest common divisor of an array of non-negative values, zeros ignored; 0 if all are 0.

    A pair is looked up as soon as one of its values is small, as durations are.  Others go through Euclid's
    algorithm: 93 divisions reach the end for any two 64-bit numbers.
    """
    table = _constant_array(
        gcd(i, j) for j in range(GCD_TABLE + 1) for i in range(GCD_TABLE + 1)).cast("array<int>")

    def found(small, other):
        rest = (other % F.greatest(small, F.lit(1))).cast("int")
        return F.get(table, small.cast("int") * (GCD_TABLE + 1) + rest).cast("bigint")

    def euclid(x, y):
        pair = lambda a, b: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
        step = lambda s, _: F.when(s["b"] == 0, s).otherwise(pair(s["b"], s["a"] % F.greatest(s["b"], F.lit(1))))
        return F.aggregate(F.sequence(F.lit(1), F.lit(93)), pair(x, y), step, lambda s: s["a"])

    def both(x, y):
        y = y.cast("bigint")
        small = lambda v: v.between(0, GCD_TABLE)
        return (F.when(x == 0, y).when(y == 0, x).when(small(y), found(y, x)).when(small(x), found(x, y))
                .otherwise(euclid(x, y)))

    return F.aggregate(_col(values), F.lit(0).cast("bigint"), both)


def duration_fraction(ticks, tpq: int) -> Column:
    """SCL14: duration as a reduced ``num/den`` of a quarter note."""
    g = gcd_upto(ticks, F.lit(tpq), tpq)
    return F.concat_ws("/", idiv(ticks, g).cast("string"), idiv(F.lit(tpq), g).cast("string"))


def fraction_to_double(key) -> Column:
    """SCL15: ``'3/4'`` to 0.75; a plain number stays itself."""
    k = _col(key)
    den = F.when(F.contains(k, F.lit("/")), F.split_part(k, F.lit("/"), F.lit(2))).otherwise("1")
    return F.split_part(k, F.lit("/"), F.lit(1)).cast("double") / den.cast("double")


# ---- shapes (SCL18, SCL19) --------------------------------------------------------------

def shape_span(shape) -> Column:
    """SCL19: largest relative end."""
    return F.array_max(F.transform(_col(shape), lambda m: m["rel_onset"] + m["rel_dur"]))


def join_shapes(left, right, left_ratio, right_ratio, delta_onset, delta_pitch) -> Column:
    """The combined shape in canonical member order.

    Members sort by onset, pitch as an unsigned byte, duration, continuation (K17).
    """
    def scaled(shape, ratio, shift, lift):
        return F.transform(_col(shape), lambda m: F.struct(
            (m["rel_onset"] * ratio + shift).cast("int").alias("rel_onset"),
            F.pmod((m["rel_pitch"] + lift).cast("int"), F.lit(256)).alias("byte_pitch"),
            (m["rel_dur"] * ratio).cast("int").alias("rel_dur"),
            m["is_cont"].alias("is_cont")))

    members = F.array_sort(F.concat(
        scaled(left, _col(left_ratio), F.lit(0), F.lit(0)),
        scaled(right, _col(right_ratio), _col(delta_onset), _col(delta_pitch))))
    return F.transform(members, lambda m: F.struct(
        m["rel_onset"].alias("rel_onset"),
        F.when(m["byte_pitch"] > 127, m["byte_pitch"] - 256).otherwise(m["byte_pitch"])
        .alias("rel_pitch"),
        m["rel_dur"].alias("rel_dur"), m["is_cont"].alias("is_cont")))


def pair_stretch(delta_onset, left_stretch, right_stretch, bound: int) -> Column:
    """Common time unit of a pair.

    Every shape is itself reduced, so only the distance and the two stretches matter.
    """
    return gcd_upto(right_stretch, gcd_upto(delta_onset, left_stretch, bound), bound)


def shape_of_pair(left, right, left_stretch, right_stretch, delta_onset, delta_pitch,
                  bound: int) -> Column:
    """SCL18: shape of two multi-notes, null when a relative onset or duration overflows (K4)."""
    ls, rs, d = _col(left_stretch), _col(right_stretch), _col(delta_onset)
    g = pair_stretch(d, ls, rs, bound)
    joined = join_shapes(left, right, idiv(ls, g), idiv(rs, g), idiv(d, g), delta_pitch)
    fits = F.forall(joined, lambda m: (m["rel_onset"] <= SHAPE_ONSET_LIMIT)
                    & (m["rel_dur"] <= SHAPE_DURATION_LIMIT))
    return F.when(fits, joined)
