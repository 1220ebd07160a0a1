"""DuckDB SQL of those queries that SQL can express."""

NEAR = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words)),
sizes as (select w.doc_id, count(s.s) as n from words w left join shingles s on w.doc_id = s.doc_id group by w.doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * common.n >= 75 * (x.n + y.n - common.n)),
edges as (select a, b from links union select b, a from links),
reach as (select doc_id as node, doc_id as seen from sizes union select node, b from reach join edges on seen = a)
select doc_id, n as n_shingles, c as component_id, doc_id = c as kept
from sizes join (select node, min(seen) as c from reach group by node) on doc_id = node
"""

REPEATS = r"""
with texts as (
  select doc_id, text, list_filter(regexp_extract_all(coalesce(text, ''), '(?s).*?(?:\n|[.!?][\x20\x09-\x0D]|\z)'), lambda x: x <> '') as p from documents),
pieces as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as pos, len(p) as n, unnest(list_prepend(chr(10), p)[:len(p)]) as prior from texts),
placed as (
  select *, sum(length(piece)) over (partition by doc_id order by pos) - length(piece) as start,
    regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from pieces),
units as (
  select *, row_number() over (partition by doc_id order by pos) as seq,
    row_number() over (partition by array_to_string(w, ' ') order by doc_id, pos) > 1 as again,
    case when len(w) >= 4 or (prior[-1:] = chr(10) and (piece[-1:] = chr(10) or pos = n)) then len(w) else 0 end as counted
  from placed where len(w) > 0),
runs as (
  select doc_id, min(start) as start, max(start + length(piece)) as stop, count(*) as many
  from (select *, seq - row_number() over (partition by doc_id order by seq) as run from units where again)
  group by doc_id, run having sum(counted) >= 30),
spans as (select doc_id, sum(many) as many, string_agg(start || ':' || stop, ',' order by start) as removed from runs group by doc_id),
kept as (
  select doc_id, string_agg(piece, '' order by pos) as kept from placed p
  where not exists (select 1 from runs r where r.doc_id = p.doc_id and p.start >= r.start and p.start + length(p.piece) <= r.stop) group by doc_id)
select t.doc_id, coalesce(u.n, 0) as n_units, cast(coalesce(s.many, 0) as bigint) as n_removed, coalesce(s.removed, '') as removed,
  case when t.text is not null then coalesce(k.kept, '') end as kept_text
from texts t left join (select doc_id, count(*) as n from units group by doc_id) u on u.doc_id = t.doc_id
left join spans s on s.doc_id = t.doc_id left join kept k on k.doc_id = t.doc_id
"""

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5
"""

ORACLES = {"op3_near_duplicates": NEAR, "op8_line_dedup": REPEATS, "op9_top_k": TOP_K}
