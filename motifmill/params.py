"""Parameter sets, passed around as plain literals."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Limits (in quantised ticks) of the data model.
NOTE_TIME_CORRUPTION_LIMIT = 2**18 - 1
NOTE_DURATION_CORRUPTION_LIMIT = 2**14 - 1
EVENT_TIME_LIMIT = 2**17 - 1
DRUM_PITCHES = (35, 81)
EMPTY_MEASURE_LIMIT = 20
NEIGHBOUR_LIMIT = 126
SHAPE_ONSET_LIMIT = 127
SHAPE_DURATION_LIMIT = 255
MAX_SHAPES = 2**16


@dataclass(frozen=True)
class CorpusParams:
    """How raw ticks become a token corpus.

    ``block_ticks`` only steers the physical layout: sequences are cut into blocks of
    that many ticks so that one huge piece is spread over many tasks.  With onsets bounded
    by ``event_time_limit`` a piece has at most ``event_time_limit / block_ticks + 1`` blocks.
    Notes that start or end after ``event_time_limit`` are no notes of the corpus
    (``cleaning.dropped_notes`` reports them); pieces with ``empty_measure_limit`` empty measures
    in a row are rejected.
    """

    tpq: int = 12
    max_track_number: int = 40
    max_duration: int = 48
    velocity_step: int = 4
    tempo_min: int = 8
    tempo_max: int = 240
    tempo_step: int = 8
    use_cont_note: bool = True
    deny_long_empty_measures: bool = True
    strict_track_limit: bool = False
    block_ticks: int = 384
    event_time_limit: int = EVENT_TIME_LIMIT
    empty_measure_limit: int = EMPTY_MEASURE_LIMIT

    def __post_init__(self):
        if self.event_time_limit < 0 or self.empty_measure_limit < 1:
            raise ValueError("event_time_limit and empty_measure_limit have to be positive")
        if self.tpq <= 2 or self.tpq % 2:
            raise ValueError("tpq has to be an even number above 2")
        if not 1 <= self.max_track_number <= 255:
            raise ValueError("max_track_number has to be within 1..255")
        if not 1 <= self.max_duration <= 255:
            raise ValueError("max_duration has to be within 1..255")
        if not 1 <= self.velocity_step <= 127:
            raise ValueError("velocity_step has to be within 1..127")
        if self.tempo_min > self.tempo_max or self.tempo_step <= 0:
            raise ValueError("bad tempo quantisation")

    def with_(self, **changes) -> "CorpusParams":
        return replace(self, **changes)


CORPUS = CorpusParams()
CLI_DEFAULTS = CorpusParams(
    max_track_number=24, velocity_step=16, tempo_min=24, tempo_max=200, tempo_step=16,
    use_cont_note=False,
)
EVALUATION = CorpusParams(
    tpq=48, max_track_number=255, max_duration=192, velocity_step=1,
    tempo_min=1, tempo_max=512, tempo_step=1, deny_long_empty_measures=False,
    block_ticks=1536,
)


@dataclass(frozen=True)
class Limits:
    """How far merges reach.  The defaults are those of the established vocabularies.

    ``neighbours``: rows that a note looks ahead in its phrase, ``None`` for all that the gap
    allows.  ``onset``, ``duration``: largest relative onset and duration of a shape's member.
    The iteration log counts what they leave out.
    """

    neighbours: int | None = NEIGHBOUR_LIMIT
    onset: int = SHAPE_ONSET_LIMIT
    duration: int = SHAPE_DURATION_LIMIT

    def __post_init__(self):
        if (self.neighbours is not None and self.neighbours < 1) or self.onset < 0 or self.duration < 1:
            raise ValueError("limits have to be positive")


LIMITS = Limits()


@dataclass(frozen=True)
class BpeParams:
    """A vocabulary has at most ``MAX_SHAPES`` shapes, so its table can be broadcast."""

    iterations: int = 4
    adjacency: str = "ours"
    min_score: int = 1
    sampling_rate: float = 1.0
    seed: int = 0
    checkpoint_every: int = 8
    limits: Limits = LIMITS

    def __post_init__(self):
        if not 0 <= self.iterations <= MAX_SHAPES - 2:
            raise ValueError(f"iterations has to be within 0..{MAX_SHAPES - 2}")
        if self.adjacency not in ("ours", "mulpi"):
            raise ValueError("adjacency is 'ours' or 'mulpi'")
        if not 0 < self.sampling_rate <= 1:
            raise ValueError("sampling_rate has to be within (0, 1]")


@dataclass(frozen=True)
class ExampleParams:
    max_len: int = 64
    step_ratio: float = 1.0
    flatten: bool = True
    pitch_range: int = 0
    seed: int = 0
