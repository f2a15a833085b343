"""The same results as plain SQL for DuckDB, to check the Spark jobs against.

Each function returns common table expressions, ``{name: sql}``; ``compose`` puts them in
front of a final select.  Written with per-piece windows and joins, without any blocks.
"""

from __future__ import annotations

from motifmill.params import CORPUS, EVALUATION, CorpusParams
from motifmill.sources.projections import MOTIF_SQL, ODD_SQL, PROJECTION_SQL

NULL = "cast(null as bigint)"
DIGITS = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def b36(x: str) -> str:
    digit = lambda d: f"substr({DIGITS}, cast({d} as bigint) + 1, 1)"
    size = f"case when abs({x}) < 36 then {digit(f'abs({x})')} else {digit(f'abs({x}) // 36')} || {digit(f'abs({x}) % 36')} end"
    return f"(case when {x} < 0 then '-' else '' end || {size})"


def quantise(column: str, tpq: int) -> str:
    return f"((2 * {column} * {tpq} + ticks_per_beat) // (2 * ticks_per_beat))"


def corpus_ctes(x: str, p: CorpusParams) -> dict[str, str]:
    """Raw tables to ordered tokens, with names prefixed by ``x``."""
    m, step = p.max_duration, p.velocity_step
    velocity = f"least(greatest((2*velocity + {step}) // {2*step} * {step}, {step}), {127 // step * step})"
    if p.use_cont_note:
        split = f"""
            select piece_id, track_number, s + i * {m} as onset, pitch,
                   least({m}, e - s - i * {m}) as duration,
                   case when i < (e - s - 1) // {m} then 1 else 0 end as is_cont, velocity
            from (select *, unnest(range(0, (e - s - 1) // {m} + 1)) as i from {x}playable)"""
    else:
        split = f"""
            select piece_id, track_number, s as onset, pitch, least(e - s, {m}) as duration,
                   0 as is_cont, velocity from {x}playable"""
    bpm = (f"least(greatest(floor((bpm * 2 + {p.tempo_step}) / {2 * p.tempo_step}) * {p.tempo_step},"
           f" {p.tempo_min}), {p.tempo_max})")
    note_order = "track_number, pitch, duration, is_cont, velocity"
    return {
        f"{x}map": """
            select t.piece_id, t.track_idx, case when is_drum then 128 else program end as instrument,
                   row_number() over (partition by t.piece_id order by t.track_idx) - 1 as track_number
            from raw_tracks t
            where exists (select 1 from raw_notes n where n.piece_id = t.piece_id
                          and n.track_idx = t.track_idx and end_tick > start_tick)""",
        f"{x}quant": f"""
            select n.piece_id, track_number, instrument, {quantise('start_tick', p.tpq)} as s,
                   greatest({quantise('end_tick', p.tpq)}, {quantise('start_tick', p.tpq)} + 1) as e,
                   pitch, velocity
            from raw_notes n join {x}map t on n.piece_id = t.piece_id and n.track_idx = t.track_idx
                 join pieces f on n.piece_id = f.piece_id
            where end_tick > start_tick""",
        f"{x}playable": f"""
            select piece_id, track_number, s, e, pitch, {velocity} as velocity from {x}quant
            where s >= 0 and s <= 131071 and e <= 131071 and (instrument <> 128 or pitch between 35 and 81)""",
        f"{x}chunks": f"select distinct * from ({split})",
        f"{x}extent": f"""
            select piece_id, min(onset) as first_onset,
                   last(onset + duration order by onset, {note_order}) as last_end,
                   max(onset) as max_onset
            from {x}chunks group by piece_id""",
        f"{x}sigs": f"""
            select t.piece_id, change_idx, numer, denom, {quantise('time_tick', p.tpq)} as time,
                   first_onset, last_end
            from raw_time_sigs t join pieces f on t.piece_id = f.piece_id
                 join {x}extent e on t.piece_id = e.piece_id
            where {quantise('time_tick', p.tpq)} <= last_end""",
        f"{x}changes": f"""
            select * from (select *, lag(row(numer, denom)) over w as prev from {x}sigs
                           window w as (partition by piece_id order by time, change_idx))
            where prev is null or prev <> row(numer, denom)""",
        f"{x}segments": f"""
            select *, coalesce(lead(time) over (partition by piece_id order by time, change_idx),
                               time + ((last_end - time) // length + 1) * length) as next_time
            from (select *, {4 * p.tpq} * numer // denom as length from {x}changes)""",
        f"{x}allmeasures": f"""
            select *, row_number() over (partition by piece_id order by onset) - 1 as measure_idx
            from (select piece_id, numer, denom, length,
                         unnest(range(time + greatest((first_onset - time) // length, 0) * length,
                                      least(next_time, last_end + 1), length)) as onset
                  from {x}segments where next_time > first_onset)""",
        f"{x}rejects": f"""
            select piece_id, min(rank) as rank,
                   case min(rank) when 7 then 'unsupported time signature'
                        else 'misaligned time signature' end as reason
            from (select piece_id, 7 as rank from {x}sigs
                  where not (denom in (2, 4, 8) and numer between 1 and least(24, 3 * denom))
                  union all
                  select piece_id, 8 from {x}segments
                  where next_time > first_onset and (next_time - time) % length <> 0)
            group by piece_id""",
        f"{x}measures": f"""
            select * from {x}allmeasures where piece_id not in (select piece_id from {x}rejects)""",
        f"{x}notes": f"""
            select * from {x}chunks where piece_id not in (select piece_id from {x}rejects)""",
        f"{x}m0": f"select piece_id, min(onset) as m0 from {x}measures group by piece_id",
        f"{x}tempoticks": f"""
            select piece_id, onset, m0, last(b order by time, change_idx) as bpm from (
              select t.piece_id, change_idx, {quantise('time_tick', p.tpq)} as time, m0,
                     greatest({quantise('time_tick', p.tpq)}, m0) as onset, cast({bpm} as bigint) as b
              from raw_tempos t join pieces f on t.piece_id = f.piece_id
                   join {x}m0 m on t.piece_id = m.piece_id join {x}extent e on t.piece_id = e.piece_id
              where {quantise('time_tick', p.tpq)} <= last_end)
            group by piece_id, onset, m0""",
        f"{x}tempos0": f"""
            select piece_id, onset, bpm from (
              select *, lag(bpm) over (partition by piece_id order by onset) as prev from {x}tempoticks)
            where prev is null or prev <> bpm""",
        f"{x}tempos": f"""
            select * from {x}tempos0
            union all
            select m.piece_id, m0, 120 from {x}m0 m
            where not exists (select 1 from {x}tempos0 t where t.piece_id = m.piece_id and t.onset <= m0)""",
        f"{x}spots": f"""
            select piece_id, onset from {x}notes union select piece_id, onset from {x}tempos""",
        f"{x}positions": f"""
            select s.piece_id, s.onset, s.onset - m.onset as position
            from {x}spots s asof join {x}measures m on s.piece_id = m.piece_id and s.onset >= m.onset""",
        f"{x}tracks": f"""
            select distinct piece_id, track_number, instrument from {x}map
            where piece_id not in (select piece_id from {x}rejects)""",
        f"{x}body": f"""
            select piece_id, onset, 3 as prio, 'M' as type, {NULL} as track_number, {NULL} as pitch,
                   {NULL} as duration, {NULL} as is_cont, {NULL} as velocity, numer, denom,
                   {NULL} as position, {NULL} as bpm,
                   'M' || {b36('numer')} || '/' || {b36('denom')} as text from {x}measures
            union all
            select piece_id, onset, 4, 'P', null, null, null, null, null, null, null, position, null,
                   'P' || {b36('position')} from {x}positions
            union all
            select piece_id, onset, 5, 'T', null, null, null, null, null, null, null, null, bpm,
                   'T' || {b36('bpm')} from {x}tempos
            union all
            select piece_id, onset, 6, 'N', track_number, pitch, duration, is_cont, velocity,
                   null, null, null, null,
                   case when is_cont = 1 then 'N~:' else 'N:' end || {b36('pitch')} || ':' ||
                   {b36('duration')} || ':' || {b36('velocity')} || ':' || {b36('track_number')}
            from {x}notes""",
        f"{x}heads": f"select piece_id, count(*) as n_tracks from {x}tracks group by piece_id",
        f"{x}tokens": f"""
            select b.piece_id, n_tracks + 1 + row_number() over (
                     partition by b.piece_id order by onset, prio, {note_order}) as seq,
                   type, onset, track_number, {NULL} as instrument, numer, denom, position, bpm,
                   pitch, duration, velocity, is_cont, text
            from {x}body b join {x}heads h on b.piece_id = h.piece_id
            union all
            select piece_id, track_number + 1, 'R', null, track_number, instrument, null, null, null,
                   null, null, null, null, null,
                   'R' || {b36('instrument')} || ':' || {b36('track_number')} from {x}tracks
            union all
            select piece_id, 0, 'BOS', null, null, null, null, null, null, null, null, null, null, null,
                   'BOS' from {x}heads
            union all
            select piece_id, n_tracks + 1, 'SEP', null, null, null, null, null, null, null, null, null,
                   null, null, 'SEP' from {x}heads
            union all
            select h.piece_id, n_tracks + 2 + n, 'EOS', null, null, null, null, null, null, null, null,
                   null, null, null, 'EOS'
            from {x}heads h join (select piece_id, count(*) as n from {x}body group by piece_id) b
                 on h.piece_id = b.piece_id""",
        # Times as a decoder sees them: from the first measure on.
        f"{x}timed": f"""
            select t.* replace (t.onset - m0 as onset),
                   count(case when type = 'M' then 1 end) over w as measure_no
            from {x}tokens t join {x}m0 m on t.piece_id = m.piece_id
            window w as (partition by t.piece_id order by seq rows unbounded preceding)""",
        f"{x}bars": f"select m.* replace (m.onset - m0 as onset) from {x}measures m join {x}m0 z on m.piece_id = z.piece_id",
        f"{x}links": f"""
            select n.*, rn = 1 and exists (
                     select 1 from {x}timed c where c.is_cont = 1 and c.piece_id = n.piece_id
                     and c.track_number = n.track_number and c.pitch = n.pitch
                     and c.velocity = n.velocity and c.onset + c.duration = n.onset) as linked
            from (select *, row_number() over (partition by piece_id, track_number, pitch, velocity, onset
                                               order by duration, is_cont) as rn
                  from {x}timed where type = 'N') n""",
        f"{x}chain": f"""
            select piece_id, track_number, pitch, velocity, onset as first, onset + duration as until, is_cont
            from {x}links where not linked
            union all
            select c.piece_id, c.track_number, c.pitch, c.velocity, c.first, n.onset + n.duration, n.is_cont
            from {x}chain c join {x}links n on c.piece_id = n.piece_id and c.track_number = n.track_number
                 and c.pitch = n.pitch and c.velocity = n.velocity and c.until = n.onset and n.linked
            where c.is_cont = 1""",
        f"{x}decoded": f"""
            select piece_id, track_number, first as "start", until as "end", pitch, velocity
            from {x}chain where is_cont = 0""",
        f"{x}lastbar": f"""
            select piece_id, count(*) as n_measures, max(onset) as last_start,
                   last(length order by onset) as last_length, max(length) as longest
            from {x}bars group by piece_id""",
        f"{x}nbars": f"""
            select b.*, 1 + n_measures + greatest(0, cast(ceil((latest - last_start) / last_length) as bigint)) as n
            from {x}lastbar b join (select piece_id, max("start") as latest from {x}decoded group by piece_id) d
                 on b.piece_id = d.piece_id""",
        f"{x}placed": f"""
            select d.piece_id, d.track_number, d."start", m.onset + (d."start" - m.onset) // m.length * m.length as bar
            from {x}decoded d asof join {x}bars m on d.piece_id = m.piece_id and d."start" >= m.onset""",
        f"{x}instr": f"""
            select n.piece_id, 1 - sum(o * (n - o)) / (max(w) * max(n) * (max(n) - 1) / 2) as iss
            from (select p.piece_id, instrument, count(distinct bar) as o
                  from {x}placed p join {x}tracks t on p.piece_id = t.piece_id and p.track_number = t.track_number
                  group by p.piece_id, instrument) c
                 join {x}nbars n on c.piece_id = n.piece_id
                 join (select piece_id, count(distinct instrument) as w from {x}tracks group by piece_id) v
                 on c.piece_id = v.piece_id
            group by n.piece_id""",
        f"{x}groove": f"""
            select n.piece_id, 1 - sum(o * (n - o)) / (max(longest) * max(n) * (max(n) - 1) / 2) as gss
            from (select piece_id, "start" - bar as at, count(distinct bar) as o
                  from {x}placed group by piece_id, "start" - bar) c
                 join {x}nbars n on c.piece_id = n.piece_id
            group by n.piece_id""",
        f"{x}entropy": f"""
            select piece_id, -sum(c / t * ln(c / t)) as pce from (
              select piece_id, pitch % 12, count(*) as c, sum(count(*)) over (partition by piece_id) as t
              from {x}decoded group by piece_id, pitch % 12)
            group by piece_id""",
        f"{x}features": f"""
            select e.piece_id, pce, iss, gss from {x}entropy e
            join {x}instr i on e.piece_id = i.piece_id join {x}groove g on e.piece_id = g.piece_id""",
        f"{x}hist": f"""
            select piece_id, 'pitch_histogram' as feature, cast(pitch as varchar) as bin, count(*) as n
            from {x}decoded group by piece_id, pitch
            union all
            select piece_id, 'velocity_histogram', cast(velocity as varchar), count(*)
            from {x}decoded group by piece_id, velocity
            union all
            select piece_id, 'duration_distribution', cast(d // gcd(d, {p.tpq}) as varchar) || '/' ||
                   cast({p.tpq} // gcd(d, {p.tpq}) as varchar), count(*)
            from (select piece_id, "end" - "start" as d from {x}decoded) group by piece_id, d""",
    }


def bpe_ctes(x: str, p: CorpusParams) -> dict[str, str]:
    """Single notes as multi-notes, their neighbours and the shapes of pairs."""
    gap = p.tpq
    return {
        f"{x}mn0": f"""
            select *, max(onset + duration) over (
                     partition by piece_id, track_number order by onset
                     range between unbounded preceding and 1 preceding) as reach
            from {x}timed where type = 'N'""",
        f"{x}mn1": f"""
            select *, max(case when reach is null or onset > reach + {gap} then onset end) over (
                     partition by piece_id, track_number order by onset
                     range between unbounded preceding and current row) as phrase from {x}mn0""",
        f"{x}mn": f"""
            select piece_id, track_number, phrase, row_number() over (
                     partition by piece_id, track_number, phrase
                     order by onset, pitch, duration, is_cont, velocity) as k,
                   is_cont as shape_id, onset, pitch, duration as stretch, velocity
            from {x}mn1""",
        f"{x}near": f"""
            select a.piece_id, a.track_number, a.phrase, a.k as a_k, b.k as b_k,
                   a.onset as a_onset, b.onset as b_onset, a.onset + a.stretch as a_end,
                   a.stretch as ls, b.stretch as rs, a.shape_id as lc, b.shape_id as rc,
                   b.pitch - a.pitch as dp, a.velocity as lv, b.velocity as rv,
                   min(case when b.onset >= a.onset + a.stretch then b.onset end) over (
                     partition by a.piece_id, a.track_number, a.phrase, a.k) as follow
            from {x}mn a join {x}mn b on a.piece_id = b.piece_id and a.track_number = b.track_number
                 and a.phrase = b.phrase and b.k > a.k and b.k <= a.k + 126
                 and b.onset <= a.onset + a.stretch + {gap}""",
        f"{x}pairs": f"select * from {x}near where b_onset < a_end or b_onset = follow",
        f"{x}reduced": f"""
            select *, ls // g as l1, rs // g as r1, (b_onset - a_onset) // g as d1
            from (select *, gcd(gcd(b_onset - a_onset, ls), rs) as g from {x}pairs where lv = rv)""",
    }


def pair_texts(x: str, condition: str = "true") -> str:
    """Pairs of single notes and the texts of their shapes."""
    member = lambda o, d, pitch, c: (
        f"{b36(o)} || ',' || {b36(pitch)} || ',' || {b36(d)} || case when {c} = 1 then '~;' else ';' end")
    left, right = member("0", "l1", "0", "lc"), member("d1", "r1", "dp", "rc")
    first = "row(0, 0, l1, lc) <= row(d1, (dp + 256) % 256, r1, rc)"
    return f"""
        select *, case when {first} then {left} || {right} else {right} || {left} end as text
        from {x}reduced where d1 <= 127 and ({condition})"""


def pair_shapes(x: str, condition: str = "true") -> str:
    """Counts of the shapes of pairs of single notes."""
    return f"select text, count(*) as n from ({pair_texts(x, condition)}) group by text"


def merged_once(x: str) -> str:
    """All notes after the most frequent shape of a pair was merged.

    The pairs of a phrase are walked in order of their notes; a pair is merged if both are free.
    """
    key = "piece_id, track_number, phrase"
    on = " and ".join(f"w.{c} = p.{c}" for c in key.split(", "))
    return f"""
        with recursive best as (select text from ({pair_shapes(x)}) order by n desc, text limit 1),
        chosen as (select {key}, a_k, b_k, g, row_number() over (partition by {key} order by a_k, b_k) as i
                 from ({pair_texts(x)}) where text = (select text from best)),
        walk as (
          select distinct {key}, 0::bigint as i, []::bigint[] as used, []::bigint[] as taken from chosen
          union all
          select w.piece_id, w.track_number, w.phrase, p.i,
                 case when list_contains(used, a_k) or list_contains(used, b_k) then used else list_concat(used, [a_k, b_k]) end,
                 case when list_contains(used, a_k) or list_contains(used, b_k) then taken else list_append(taken, p.i) end
          from walk w join chosen p on {on} and p.i = w.i + 1),
        ends as (select {key}, arg_max(taken, i) as taken from walk group by all),
        done as (select p.* from chosen p join ends w on {on} and list_contains(taken, p.i))
        select m.piece_id, m.track_number, m.phrase, m.k, case when d.g is null then m.shape_id else 2 end as shape_id,
               m.onset, m.pitch, coalesce(d.g, m.stretch) as stretch, m.velocity
        from {x}mn m left join done d on m.piece_id = d.piece_id and m.track_number = d.track_number and m.phrase = d.phrase and m.k = d.a_k
        where not exists (select 1 from done e where e.piece_id = m.piece_id and e.track_number = m.track_number
                          and e.phrase = m.phrase and e.b_k = m.k)"""


class Once(str):
    """A common table expression that several others read, to be worked out once."""


def merge_ctes(x: str, p: CorpusParams, rounds: int, start: str = "mn", condition: str = "true",
               best: str | None = None) -> dict[str, str]:
    """``rounds`` merges of the notes of ``start``: ``{x}m{r}_notes`` holds them before round r.

    A shape is the list of its members, each a list of onset, pitch as a byte, duration and continuation, in
    order.  Every round finds all neighbours anew, counts the shapes that those within ``condition`` make, takes the
    best (or that of the same round of the merges named ``best``) and walks each phrase from left to right.
    """
    key = "piece_id, track_number, phrase"
    same = lambda a, b: " and ".join(f"{a}.{c} = {b}.{c}" for c in key.split(", "))
    out = {f"{x}m0_notes": Once(f"""
        select {key}, k, shape_id, [[0, 0, 1, cast(shape_id as bigint)]] as shape, 1 as span, onset, pitch, stretch, velocity from {start}""")}
    for r in range(rounds):
        m = f"{x}m{r}_"
        chosen = f"{m}best" if best is None else f"{best}m{r}_best"
        free = "not list_contains(used, a_k) and not list_contains(used, b_k)"
        out |= {
            f"{m}rows": Once(f"select *, row_number() over (partition by {key} order by k) as rn from {m}notes"),
            f"{m}near": f"""
                select a.piece_id, a.track_number, a.phrase, a.k as a_k, b.k as b_k, a.onset as a_onset, b.onset as b_onset,
                       a.onset + a.span * a.stretch as a_end, a.stretch as ls, b.stretch as rs, a.shape as lshape, b.shape as rshape,
                       (b.pitch - a.pitch + 512) % 256 as dp, a.velocity = b.velocity as same,
                       min(case when b.onset >= a.onset + a.span * a.stretch then b.onset end) over (
                         partition by a.piece_id, a.track_number, a.phrase, a.k) as follow
                from {m}rows a join {m}rows b on {same('a', 'b')} and b.rn > a.rn and b.rn <= a.rn + 126
                     and b.onset <= a.onset + a.span * a.stretch + {p.tpq}""",
            f"{m}pairs": Once(f"""
                select *, ls // g as l1, rs // g as r1, (b_onset - a_onset) // g as d1
                from (select *, gcd(gcd(b_onset - a_onset, ls), rs) as g from {m}near where b_onset < a_end or b_onset = follow)"""),
            f"{m}kinds": Once(f"""
                select *, row_number() over () as kind
                from (select distinct lshape, rshape, l1, r1, d1, dp from {m}pairs where same)"""),
            f"{m}joined": Once(f"""
                select any_value(lshape) as lshape, any_value(rshape) as rshape, any_value(l1) as l1, any_value(r1) as r1,
                       any_value(d1) as d1, any_value(dp) as dp, list([o, q, d, c] order by o, q, d, c) as shape,
                       max(o) <= 127 and max(d) <= 255 as fits, max(o + d) as span
                from (select kind, lshape, rshape, l1, r1, d1, dp, n[1] * l1 as o, n[2] as q, n[3] * l1 as d, n[4] as c
                      from (select *, unnest(lshape) as n from {m}kinds)
                      union all
                      select kind, lshape, rshape, l1, r1, d1, dp, n[1] * r1 + d1, (n[2] + dp) % 256, n[3] * r1, n[4]
                      from (select *, unnest(rshape) as n from {m}kinds)) group by kind"""),
            f"{m}named": Once(f"""
                select t.*, j.shape, j.fits, j.span from {m}pairs t join {m}joined j on t.lshape = j.lshape and t.rshape = j.rshape
                     and t.l1 = j.l1 and t.r1 = j.r1 and t.d1 = j.d1 and t.dp = j.dp where t.same"""),
            f"{m}counts": f"select shape, count(*) as n, any_value(span) as span from {m}named where fits and ({condition}) group by shape",
            f"{m}best": Once(f"select shape, n, span from {m}counts where n > 1 order by n desc, shape limit 1"),
            f"{m}chosen": Once(f"""
                select {key}, a_k, b_k, g, row_number() over (partition by {key} order by a_k, b_k) as i
                from {m}named where shape = (select shape from {chosen})"""),
            f"{m}walk": f"""
                select distinct {key}, 0::bigint as i, []::bigint[] as used, []::bigint[] as taken from {m}chosen
                union all
                select w.piece_id, w.track_number, w.phrase, c.i,
                       case when {free} then list_concat(used, [a_k, b_k]) else used end,
                       case when {free} then list_append(taken, c.i) else taken end
                from {m}walk w join {m}chosen c on {same('w', 'c')} and c.i = w.i + 1""",
            f"{m}done": Once(f"""
                select c.* from {m}chosen c join (select {key}, arg_max(taken, i) as taken from {m}walk group by all) w
                on {same('w', 'c')} and list_contains(taken, c.i)"""),
            f"{x}m{r + 1}_notes": Once(f"""
                select n.piece_id, n.track_number, n.phrase, n.k, case when d.g is null then n.shape_id else {r + 2} end as shape_id,
                       case when d.g is null then n.shape else (select shape from {chosen}) end as shape,
                       case when d.g is null then n.span else (select span from {chosen}) end as span,
                       n.onset, n.pitch, coalesce(d.g, n.stretch) as stretch, n.velocity
                from {m}notes n left join {m}done d on {same('n', 'd')} and n.k = d.a_k
                where not exists (select 1 from {m}done e where {same('e', 'n')} and e.b_k = n.k)"""),
        }
    return out


def shape_sql(shape: str) -> str:
    """A list of members as text."""
    member = (f"{b36('m[1]')} || ',' || {b36('case when m[2] > 127 then m[2] - 256 else m[2] end')} || ',' || {b36('m[3]')}"
              f" || case when m[4] = 1 then '~;' else ';' end")
    return f"(select string_agg({member}, '' order by i) from (select unnest({shape}) as m, unnest(range(1, len({shape}) + 1)) as i))"


def primer_ctes(measures: int, rounds: int) -> dict[str, str]:
    """The first measures of each piece, merged with the shapes of ``merge_ctes("")``."""
    return {
        "pr_timed": f"select * from timed where measure_no <= {measures} and type <> 'EOS'",
        "pr_bars": f"select * from bars where measure_idx < {measures}",
    } | bpe_ctes("pr_", CORPUS) | merge_ctes("pr_", CORPUS, rounds, "pr_mn", best="") | merged_ctes("pm_", rounds, "pr_")


def motif_ctes() -> dict[str, str]:
    """``MOTIF_SQL`` up to multi-notes."""
    own = lambda sql: sql.replace("raw_notes", "mo_raw_notes")
    return dict(MOTIF_SQL) | {n: own(sql) for n, sql in corpus_ctes("mo_", CORPUS).items()} | bpe_ctes("mo_", CORPUS)


def shared_hash(*parts: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12) as bigint)"


def erf(x: str) -> str:
    """The error function, by the logarithms of its terms."""
    size = f"greatest(least(abs({x}), 6.0), 1e-300)"
    terms = (f"list_sum(list_transform(range(0, 121), lambda n: exp((2 * n + 1) * ln({size}) + 2 * n * ln(2.0)"
             f" + lgamma(n + 1.0) - lgamma(2 * n + 2.0))))")
    return f"(sign({x}) * least(1.0, 2 / sqrt(pi()) * exp(-({size}) * ({size})) * {terms}))"


def merged_ctes(x: str, rounds: int, of: str = "") -> dict[str, str]:
    """The token sequences after ``merge_ctes(of)``, their vocabulary, rows and examples.

    Time structure is that of ``{of}timed`` and ``{of}bars``; among notes of one onset, tracks and ranks decide.
    """
    notes, timed, bars = f"{of}m{rounds}_notes", f"{of}timed", f"{of}bars"
    nothing = f"{NULL} as track_number, {NULL} as k, {NULL} as numer, {NULL} as denom"
    shape = f"case when shape_id > 1 then 'U' || {shape_sql('shape')} when shape_id = 1 then 'N~' else 'N' end"
    best = " union all ".join(f"select {r + 2} as ord, 'U' || {shape_sql('shape')} as text from m{r}_best" for r in range(rounds))
    return {
        f"{x}spots": f"""
            select piece_id, onset from {notes} union select piece_id, onset from {timed} where type = 'T'""",
        f"{x}body": f"""
            select piece_id, onset, 3 as prio, 'M' as type, {NULL} as track_number, {NULL} as k, numer, denom,
                   'M' || {b36('numer')} || '/' || {b36('denom')} as text from {bars}
            union all
            select s.piece_id, s.onset, 4, 'P', {nothing}, 'P' || {b36('(s.onset - b.onset)')}
            from {x}spots s asof join {bars} b on s.piece_id = b.piece_id and s.onset >= b.onset
            union all
            select piece_id, onset, 5, 'T', {nothing}, text from {timed} where type = 'T'
            union all
            select piece_id, onset, 6, case when shape_id > 1 then 'U' else 'N' end, track_number, k, {NULL}, {NULL},
                   {shape} || ':' || {b36('pitch')} || ':' || {b36('stretch')} || ':' || {b36('velocity')} || ':' || {b36('track_number')}
            from {notes}""",
        f"{x}tokens": Once(f"""
            select b.piece_id, n_tracks + 1 + row_number() over (partition by b.piece_id order by onset, prio, track_number, k) as seq,
                   type, numer, denom, text
            from {x}body b join heads h on b.piece_id = h.piece_id
            union all
            select piece_id, seq, type, null, null, text from tokens where type in ('BOS', 'R', 'SEP')
            union all
            select h.piece_id, n_tracks + 2 + n, 'EOS', null, null, 'EOS'
            from heads h join (select piece_id, count(*) as n from {x}body group by piece_id) b on h.piece_id = b.piece_id"""),
    } | vocab_ctes(x, CORPUS, best) | example_ctes(x, 64, 64, 1)


def vocab_ctes(x: str, p: CorpusParams, learned: str = "") -> dict[str, str]:
    numbers = lambda a, b, prefix="", step=1: (
        f"select v as ord, '{prefix}' || {b36('v')} as text from (select unnest(range({a}, {b}, {step})) as v)")
    pad = "select 0 as ord, 'PAD' as text"
    used = (f"select distinct denom * 100 + numer as ord, text from {x}tokens where type = 'M'"
            f" and denom in (2, 4, 8) and numer between 1 and least(24, 3 * denom)")
    tempo = numbers(p.tempo_min, p.tempo_max + p.tempo_step, "T", p.tempo_step)
    parts = {
        "events": ["select * from (values (0,'PAD'),(1,'BOS'),(2,'EOS'),(3,'SEP')) v(ord, text)",
                   "select * from (values (0,'N'),(1,'N~')) v(ord, text)", *([learned] if learned else []),
                   numbers(0, 129, "R"), numbers(0, 12 * p.tpq, "P"), used, tempo],
        "pitchs": [pad, numbers(0, 128)],
        "durations": [pad, numbers(1, p.max_duration + 1)],
        "velocities": [pad, numbers(p.velocity_step, 128, "", p.velocity_step)],
        "track_numbers": [pad, numbers(0, p.max_track_number)],
        "instruments": [pad, numbers(0, 129)],
        "tempos": [pad, tempo],
        "time_signatures": [pad, used],
    }
    union = " union all ".join(
        f"select '{attr}' as attr, {i} as part, ord, text from ({sql})"
        for attr, sqls in parts.items() for i, sql in enumerate(sqls))
    note = lambda i: f"case when type in ('N', 'U') then split_part(t.text, ':', {i}) end"
    trn = "case when type in ('N', 'U') then split_part(t.text, ':', 5) when type = 'R' then split_part(t.text, ':', 2) end"
    joins = "".join(
        f" left join {x}vocab {s} on {s}.attr = '{a}' and {s}.text = {v}"
        for s, a, v in (("ve", "events", "split_part(t.text, ':', 1)"), ("vp", "pitchs", note(2)),
                        ("vd", "durations", note(3)), ("vv", "velocities", note(4)),
                        ("vt", "track_numbers", trn)))
    return {
        f"{x}vocab": f"""
            select attr, row_number() over (partition by attr order by part, ord) - 1 as id, text
            from ({union})""",
        f"{x}steps": f"""
            select *, case when type = 'R' then 0
                           when type in ('N', 'U') and before in ('N', 'U', 'R') then 0 else 1 end
                      + case when before = 'BOS' then 1 else 0 end as step
            from (select *, lag(type) over (partition by piece_id order by seq) as before from {x}tokens)""",
        f"{x}rows": f"""
            select t.piece_id, t.seq, ve.id as evt, coalesce(vp.id, 0) as pit, coalesce(vd.id, 0) as dur,
                   coalesce(vv.id, 0) as vel, coalesce(vt.id, 0) as trn, mps
            from (select *, sum(step) over (partition by piece_id order by seq
                                            rows unbounded preceding) as mps from {x}steps) t {joins}""",
    }


def example_ctes(x: str, max_len: int, step: int, shifts: int = 0) -> dict[str, str]:
    return {
        f"{x}layout": f"""
            select piece_id, count(*) as n_rows, min(case when evt = 3 then seq end) + 1 as body_start
            from {x}rows group by piece_id""",
        f"{x}firsts": f"""
            select r.piece_id, n_rows, body_start, min(seq) as start
            from {x}rows r join {x}layout l on r.piece_id = l.piece_id
                 join {x}vocab v on v.attr = 'events' and v.id = r.evt and v.text like 'M%'
            where seq > {step} and n_rows > {max_len}
            group by r.piece_id, n_rows, body_start, (seq + {step} - 1) // {step}""",
        f"{x}starts": f"""
            select piece_id, start, n_rows, body_start,
                   row_number() over (partition by piece_id order by start) - 1 as vp_idx
            from (select piece_id, n_rows, body_start, body_start as start from {x}layout
                  union all
                  select f.piece_id, n_rows, body_start, start from {x}firsts f
                  where not exists (select 1 from {x}firsts g where g.piece_id = f.piece_id
                                    and g.start < f.start and g.start > g.n_rows - {max_len}))""",
        f"{x}cut": f"""
            select r.piece_id, vp_idx, body_start,
                   case when seq >= start and seq >= body_start then seq - start + body_start else seq end as pos,
                   seq >= start as is_body, evt, pit, dur, vel, trn, mps
            from {x}starts s join {x}rows r on s.piece_id = r.piece_id
                 and (seq < body_start or (seq >= start and seq < start + {max_len} - body_start))""",
        f"{x}based": f"""
            select *, case when is_body then mps - min(case when is_body then mps end)
                      over (partition by piece_id, vp_idx) + 4 else mps end as mps4 from {x}cut""",
        f"{x}shifted": f"""
            select piece_id, vp_idx, shift, pos, is_body, evt, dur, vel, trn, mps4,
                   case when moves then pit + least(greatest(shift, 1 - min(case when moves then pit end) over e),
                                                   128 - max(case when moves then pit end) over e)
                        else pit end as pit
            from (select b.*, unnest(range({-shifts}, {shifts + 1})) as shift,
                         is_body and pit <> 0 and not exists (
                           select 1 from {x}rows h join {x}vocab v on v.attr = 'events' and v.id = h.evt
                           where v.text = 'R3K' and h.piece_id = b.piece_id and h.trn = b.trn
                                 and h.seq < b.body_start) as moves
                  from {x}based b)
            window e as (partition by piece_id, vp_idx, shift)""",
    }


def base_ctes() -> dict[str, str]:
    ctes = dict(PROJECTION_SQL)
    ctes.update(corpus_ctes("", CORPUS))
    ctes.update(bpe_ctes("", CORPUS))
    ctes.update(vocab_ctes("", CORPUS))
    ctes.update(example_ctes("", 64, 64, 1))
    return ctes


def odd_ctes() -> dict[str, str]:
    """``ODD_SQL`` up to the reasons of rejection, all rules written out."""
    ctes = dict(ODD_SQL)
    ctes |= {n: sql.replace("raw_", "od_raw_") for n, sql in corpus_ctes("od_", CORPUS).items()
             if n in ("od_map", "od_quant", "od_playable", "od_chunks", "od_extent", "od_sigs", "od_changes")}
    ctes["od_first"] = """
        select piece_id, numer, denom, first_onset, last_end, length,
               case when row_number() over w = 1 and time = 1 and coalesce(lead(time) over w % length = 0, true)
                    then 0 else time end as time
        from (select *, 48 * numer // denom as length from od_changes)
        window w as (partition by piece_id order by time, change_idx)"""
    ctes["od_filled"] = """
        select * from od_first union all
        select piece_id, 4, 4, any_value(first_onset), any_value(last_end), 48, 0 from od_first
        group by piece_id having min(time) > any_value(first_onset)"""
    ctes["od_segments"] = """
        select *, coalesce(lead(time) over (partition by piece_id order by time),
                           time + ((last_end - time) // length + 1) * length) as next_time from od_filled where length > 0"""
    ctes["od_measures"] = """
        select *, row_number() over (partition by piece_id order by onset) - 1 as measure_idx
        from (select piece_id, length, unnest(range(time + greatest((first_onset - time) // length, 0) * length,
                                                    least(next_time, last_end + 1), length)) as onset
              from od_segments where next_time > first_onset)"""
    ctes["od_span"] = """
        select piece_id, min(onset) as a, max(onset) as z, max(onset + length) as stop, count(*) as n
        from od_measures group by piece_id"""
    ctes["od_busy"] = """
        select distinct c.piece_id, measure_idx from od_chunks c join od_measures m on c.piece_id = m.piece_id
             and c.onset >= m.onset and c.onset < m.onset + m.length"""
    ctes["od_runs"] = """
        select s.piece_id, greatest(coalesce(max(run), 0), any_value(n) - 1 - coalesce(max(measure_idx), -1)) as longest
        from od_span s left join (select *, measure_idx - coalesce(lag(measure_idx) over (
          partition by piece_id order by measure_idx), -1) as run from od_busy) b on s.piece_id = b.piece_id group by s.piece_id"""
    ctes["od_broken"] = f"""
        select piece_id, 1 as rank from pieces where piece_id not in (select piece_id from od_raw_tracks)
        union all select piece_id, 3 from od_quant where s > 262143 and e > 262143
        union all select piece_id, 4 from od_quant where e - s > 16383
        union all select piece_id, 5 from pieces where piece_id not in (select piece_id from od_extent)
        union all select piece_id, 6 from od_extent where piece_id not in (select piece_id from od_sigs)
        union all select piece_id, 7 from od_sigs where not (denom in (2, 4, 8) and numer between 1 and least(24, 3 * denom))
        union all select piece_id, 8 from od_segments where next_time > first_onset and (next_time - time) % length <> 0
        union all select e.piece_id, case when s.z is null or not (z <= last_end and last_end < stop) then 9 else 10 end
                  from od_extent e left join od_span s on e.piece_id = s.piece_id
                  where s.z is null or not (z <= last_end and last_end < stop) or a > first_onset
        union all select t.piece_id, 11 from od_raw_tempos t join pieces f on t.piece_id = f.piece_id join od_extent e on e.piece_id = t.piece_id
                  group by t.piece_id having min({quantise('time_tick', 12)}) > any_value(last_end)
        union all select piece_id, 12 from od_runs where longest >= 20"""
    return ctes


def evaluation_ctes(x: str = "ev_") -> dict[str, str]:
    return corpus_ctes(x, EVALUATION.with_(deny_long_empty_measures=False))


def compose(final: str, spec: str, *more: dict[str, str]) -> str:
    """``spec`` names the output columns; see ``catalog.columns_of``."""
    from motifmill.plans.catalog import columns_of

    ctes = base_ctes()
    for extra in more:
        ctes.update(extra)
    casts = {"i": "coalesce(cast({c} as bigint), -1)", "s": "coalesce(cast({c} as varchar), '')",
             "d": "coalesce(round(cast({c} as double), 6), -1)"}
    columns = ", ".join(f'{casts[kind].format(c=_quote(c))} as {_quote(c)}' for c, kind in columns_of(spec))
    body = ",\n".join(f"{n} as {'materialized ' if isinstance(sql, Once) else ''}({sql})" for n, sql in _needed(ctes, final).items())
    return f"with recursive {body}\nselect {columns} from ({final}) result"


def _quote(name: str) -> str:
    return f'"{name}"'


def _needed(ctes: dict[str, str], final: str) -> dict[str, str]:
    """Only the expressions the final select reaches, in order."""
    import re

    words = lambda sql: set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    wanted, todo = set(), [final]
    while todo:
        for name in words(todo.pop()) & set(ctes):
            if name not in wanted:
                wanted.add(name)
                todo.append(ctes[name])
    return {n: sql for n, sql in ctes.items() if n in wanted}
