"""SQL for the queries that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from motifmill.llm import license_scan

_FOLD = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"

OP1 = rf"""
with recursive words as (
  select doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') w from documents),
grams as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from words where len(w) > 0)),
sizes as (select doc_id, count(*) n from grams group by doc_id),
shared as (select x.doc_id a, y.doc_id b, count(*) o from grams x join grams y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from shared join sizes s on s.doc_id = a join sizes t on t.doc_id = b where 100 * o >= 85 * (s.n + t.n - o)),
reach(a, b) as (select doc_id, doc_id from words union select r.a, l.b from reach r join links l on l.a = r.b)
select w.doc_id, coalesce(any_value(s.n), 0)::bigint n_shingles, min(r.b) component_id
from words w join reach r on r.a = w.doc_id left join sizes s on s.doc_id = w.doc_id group by w.doc_id
"""

OP4 = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
sized as (select doc_id, h, len(h) // 2 n from docs),
windows as (select doc_id, i, substring(h, 2 * i + 1, 200) w
  from (select doc_id, h, unnest(range(0, n - 99)) i from sized where n >= 100)),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by w order by doc_id, i) k from windows) where k > 1),
steps as (select doc_id, i, i > 1 + max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) + 99 fresh from again),
runs as (select doc_id, i, sum(case when fresh is null or fresh then 1 else 0 end) over (partition by doc_id order by i) r from steps),
spans as (select doc_id, r, min(i) a, max(i) + 100 b from runs group by doc_id, r),
edges as (select doc_id, lag(b, 1, 0) over (partition by doc_id order by a) a, a b, r from spans
  union all select s.doc_id, max(s.b), any_value(n), max(s.r) + 1 from spans s join sized z on z.doc_id = s.doc_id group by s.doc_id),
kept as (select e.doc_id, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' order by r) k from edges e join sized z on z.doc_id = e.doc_id group by e.doc_id),
total as (select doc_id, sum(b - a) removed, count(*) spans from spans group by doc_id)
select z.doc_id, n::bigint n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(spans, 0)::bigint n_spans, sha256(unhex(coalesce(k, h))) kept_sha256
from sized z left join total t on t.doc_id = z.doc_id left join kept k on k.doc_id = z.doc_id
"""


def _templates() -> str:
    rows = []
    for t, label, phrase, seeds, length, q, x, y in license_scan.seeds():
        rows.append(f"({t}, '{label}', {str(phrase).lower()}, {seeds}, {length}, {q}, '{x}', '{y}')")
    return "(values " + ", ".join(rows) + ") s(t, label, phrase, seeds, length, q, x, y)"


OP5 = rf"""
with words as (select doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
pairs as (select doc_id, i - 1 p, w[i] x, w[i + 1] y from (select doc_id, w, unnest(range(1, len(w))) i from words)),
votes as (select doc_id, t, label, phrase, seeds, length, p - q d, count(*) votes, min(p) a, max(p) + 1 b
  from pairs join {_templates()} using (x, y) group by all),
marked as (select *, case when phrase or d - lag(d) over (partition by doc_id, t order by d) <= {license_scan.GAP} is not true then 1 else 0 end fresh from votes),
runs as (select *, sum(fresh) over (partition by doc_id, t order by d) r from marked),
spans as (select doc_id, label, phrase, seeds, sum(votes) votes, min(a) a, max(b) b, max(length) length from runs group by doc_id, t, label, phrase, seeds, r),
good as (select doc_id, label, phrase, a, least(1.0::double, votes::double / seeds) cover from spans
  where case when phrase then votes = seeds else least(1.0::double, votes::double / seeds) >= {license_scan.COVER} and votes >= 2 and b - a < 2 * length end),
found as (select doc_id, count(*) filter (phrase) n_base, min(a) filter (phrase) first_word, max(a) filter (phrase) last_word,
  string_agg(distinct label, ',' order by label) filter (phrase) base_labels, string_agg(distinct label, ',' order by label) labels, max(cover) score
  from good group by doc_id)
select w.doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0)::double score
from words w left join found f on f.doc_id = w.doc_id
"""

OP13 = """
with parts as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as i
  from embeddings where label is not null and embedding is not null),
odd as (select distinct vec_id from parts where x is null or isnan(x) or isinf(x)),
cells as (
  select vec_id, label, cast(floor(256 * cast(x as double)) as bigint) as c, i
  from parts where vec_id not in (select vec_id from odd)),
scores as (
  select a.vec_id as anchor_id, b.vec_id as vec_id, any_value(a.label = b.label) as same, cast(sum(a.c * b.c) as bigint) as score
  from cells a join cells b on a.i = b.i and a.vec_id <> b.vec_id
  where a.vec_id % 100 = 0 group by a.vec_id, b.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from scores where same) where k <= 5),
negatives as (
  select p.anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as k
  from positives p join scores s on s.anchor_id = p.anchor_id
  where not same and 80 * positive_score <= 100 * score and score <= positive_score)
select anchor_id, positive_id, cast(k as integer) as rank, negative_id, positive_score, negative_score from negatives where k <= 5
"""

QUERIES = {"op1_ngram_join": OP1, "op4_suffix_dedup": OP4, "op5_license_scan": OP5, "op13_hard_negatives": OP13}
