"""DuckDB SQL that says the same as the registered queries, from the same tables."""

from __future__ import annotations

from kinfold.functions.transforms import PREFIXES

_IN_PREFIXES = "(" + ", ".join("'" + p.replace("'", "''") + "'" for p in PREFIXES) + ")"


def _split(source: str) -> str:
    """(id, pos, term) of the names in ``source`` (id, name): words are numbered, a group ends
    with each word that is no prefix, a group without one is dropped."""
    return f"""(
  with words as (
    select id, unnest(string_split(replace(trim(name), '-', ' '), ' ')) as w, unnest(range(len(string_split(replace(trim(name), '-', ' '), ' ')))) as n from {source}
  ), kept as (select id, trim(w) as w, n, trim(w) not in {_IN_PREFIXES} as stop from words where trim(w) <> ''),
  numbered as (select *, coalesce(sum(stop::int) over (partition by id order by n rows between unbounded preceding and 1 preceding), 0) as g from kept)
  select id, g::int as pos, string_agg(w, ' ' order by n) as term from numbered group by id, g having bool_or(stop)
)"""


_NAME = f"select 0::int as field_idx, id, pos, term from {_split('(select p_partkey as id, upper(p_name) as name from part)')}"
_TYPE = "select 1::int as field_idx, p_partkey as id, 0::int as pos, p_type as term from part"
_BRAND = "select 2::int as field_idx, p_partkey as id, 0::int as pos, substring(split_part(p_brand || p_type, '#', 1), 1, 5) as term from part"
_PARTS = f"tokens as ({_NAME} union all {_TYPE} union all {_BRAND})"


def _learnt(tokens: str, hashes: int, source: str = "tokens") -> str:
    """CTEs: counts, vocab with ordinals, totals and weights, and the fields' offsets."""
    return f"""{tokens},
counts as (select field_idx, term, count(*) as cnt from {source} where term <> '' group by field_idx, term),
vocab as (
  select field_idx, term, cnt, (row_number() over (partition by field_idx order by term) - 1)::bigint as term_idx,
    (sum(cnt) over (partition by field_idx))::bigint as total, count(*) over (partition by field_idx) as dim,
    ln((sum(cnt) over (partition by field_idx))::double / cnt) as weight
  from counts
),
fields as (
  select field_idx, total, dim, coalesce(sum(dim * {hashes}) over (order by field_idx rows between unbounded preceding and 1 preceding), 0)::bigint as field_offset
  from (select field_idx, any_value(total) as total, any_value(dim) as dim from vocab group by field_idx)
)"""


def _quantised(i: str) -> str:
    h = f"md5('planes:' || ({i})::varchar)"
    u1 = f"((('0x' || substring({h}, 1, 8))::bigint + 1.0) / 4294967297.0)"
    u2 = f"(('0x' || substring({h}, 9, 8))::bigint / 4294967296.0)"
    return f"least(65535, greatest(0, floor((sqrt(-2.0 * ln({u1})) * cos(2 * pi() * {u2}) + 8.0) * 4096.0)))::int"


def _planes(hashes: int) -> str:
    return f"""planes as (
  select v.field_idx, v.term_idx, v.term, v.weight, h.h::int as h, {_quantised("f.field_offset + h.h * v.dim + v.term_idx")} as q
  from vocab v join fields f using (field_idx), range({hashes}) h(h)
)"""


def _signed(hashes: int, width: int, ids: str) -> str:
    """CTE signed (id, chunk_idx, chunk_val) for learnt terms; ``ids`` gives every id."""
    return f"""sums as (
  select i.id, h.h::int as h, coalesce(s.s, 0.0) as s from ({ids}) i cross join range({hashes}) h(h) left join (
    select t.id, p.h, sum(p.weight * (p.q / 4096.0 - 8.0)) as s from tokens t join planes p on t.field_idx = p.field_idx and t.term = p.term group by t.id, p.h
  ) s on s.id = i.id and s.h = h.h
),
signed as (
  select id, (h // {width})::int as chunk_idx, bit_or(case when s >= -1e-9 then 1::bigint << (h % {width}) else 0 end)::bigint as chunk_val
  from sums where h < {hashes // width * width} group by id, h // {width}
)"""


_ALL_PARTS = "select p_partkey as id from part"
_SIGNED_PARTS = f"with {_learnt(_PARTS, 64)}, {_planes(64)}, {_signed(64, 8, _ALL_PARTS)}"
_MATCHES = "select q.id as query_id, s.id, count(*) as matches from signed q join signed s using (chunk_idx, chunk_val) where q.id % {} = 0 group by q.id, s.id"

_DENSE = "v as (select vec_id, embedding::double[] as a from embeddings), pairs as (select x.vec_id, x.a, y.a as b from v x join v y on y.vec_id = x.vec_id + 1)"
_SPARSE = "list_transform({}, lambda x: case when abs(x) > 0.1 then x else 0.0 end)"
_CELLS = "cells as (select o_orderkey as seq, 0::int as field_pos, case when o_orderkey % 11 = 0 then '' else o_orderstatus end as term from orders union all select o_orderkey, 1, o_orderpriority from orders)"


def _encoder(where: str) -> str:
    return f"""{_CELLS},
counts as (select field_pos, term, count(*) as cnt, min(seq) as first from cells where term <> '' and ({where}) group by field_pos, term),
known as (
  select field_pos, term, cnt, (row_number() over (partition by field_pos order by first, term) - 1)::bigint as term_id,
    (sum(cnt) over (partition by field_pos))::bigint as record_count, count(*) over (partition by field_pos) as dim
  from counts
),
starts as (
  select field_pos, coalesce(sum(dim) over (order by field_pos rows between unbounded preceding and 1 preceding), 0)::bigint as field_offset
  from (select distinct field_pos, dim from known)
)"""


_NAME_ROWS = ", ".join(f"({k}, '{n}')" for k, n in enumerate(x.replace("'", "''") for x in ["ST CLAIR", "ST CLAIR-JONES", "DEL RAY", "DUFF HESTER", "ROSADO DE GRACIA", "CONNOLLY-MC LEISH", "DU BRUCQ", "VAN NUYS- CRUZ", "OSBORNE - BARTON", "SAINT VIL-COACHY", "SIMO D' OLEO", "DE LA RENTA", "DEL-PILAR", "MARIA DE", "DE LA", ""]))

_OOV_TOKENS = """every as (select 0::int as field_idx, c_custkey as id, c_name as term from customer union all select 1, c_custkey, c_mktsegment from customer),
tokens as (select * from every where id % 2 = 0)"""
_OOV = f"""with {_learnt(_OOV_TOKENS, 32)}, {_planes(32)},
asked as (select * from every),
placed as (
  select a.id, a.field_idx, coalesce(k.term_idx, (select count(*) from vocab v where v.field_idx = a.field_idx and v.term < a.term)) as term_idx,
    coalesce(k.weight, 'inf'::double) as weight
  from asked a left join vocab k on k.field_idx = a.field_idx and k.term = a.term
),
failed as (select p.id, bool_or(p.term_idx >= f.dim) as failed from placed p join fields f using (field_idx) group by p.id),
sums as (
  select p.id, q.h, sum(p.weight * (q.q / 4096.0 - 8.0)) as s from placed p join planes q using (field_idx, term_idx) group by p.id, q.h
),
chunks as (
  select id, h // 8 as c, bit_or(case when not isnan(s) and s >= -1e-9 then 1::bigint << (h % 8) else 0 end) as v from sums group by id, h // 8
)
select f.id, case when not f.failed then s.signature end as signature, f.failed
from failed f left join (select id, string_agg(v::varchar, ',' order by c) as signature from chunks group by id) s using (id)"""

_EMPTY_TOKENS = """rows_(id, n, m) as (values (1::bigint, 'RED ROSE', 'a'), (2, '', 'b'), (3, 'RED', ''), (4, '', '')),
tokens(field_idx, id, term) as (values (0::int, 1::bigint, 'RED'), (0, 1, 'ROSE'), (0, 3, 'RED'), (1, 1, 'a'), (1, 2, 'b'), (1, 3, ''), (1, 4, ''))"""
_EMPTY_ATTR = f"""with {_learnt(_EMPTY_TOKENS, 16)}, {_planes(16)},
placed as (
  select t.id, t.field_idx, coalesce(k.term_idx, 0) as term_idx, coalesce(k.weight, 'inf'::double) as weight
  from tokens t left join vocab k on k.field_idx = t.field_idx and k.term = t.term
),
sums as (
  select r.id, h.h, coalesce(s.s, 0.0) as s from rows_ r cross join range(16) h(h) left join (
    select p.id, q.h, sum(p.weight * (q.q / 4096.0 - 8.0)) as s from placed p join planes q using (field_idx, term_idx) group by p.id, q.h
  ) s on s.id = r.id and s.h = h.h
)
select id, (h // 4)::int as chunk_idx, bit_or(case when not isnan(s) and s >= -1e-9 then 1::bigint << (h % 4)::int else 0 end)::bigint as chunk_val
from sums group by id, h // 4"""

_PLANES20 = f"planes as (select (i // 64)::int as k, (i % 64)::int as j, {_quantised('i')} / 4096.0 - 8.0 as x from range(1280) r(i))"
_SIDES = f"""with {_PLANES20}, e as (select vec_id, unnest(embedding::double[]) as x, unnest(range(len(embedding))) as j from embeddings),
d as (select e.vec_id, p.k, sum(e.x * p.x) as s from e join planes p on p.j = e.j group by e.vec_id, p.k)"""

ORACLE = {
    "scan_project": "select c_custkey as id, c_mktsegment as segment, c_name as name from customer",
    "csv_quotes_empty": "select * from (values (1::bigint, 'a \"b\", c', 'x'), (2, '', 'two' || chr(10) || 'lines'), (4294967295, '', '''')) t(id, first, last)",
    "source_definition": "select c_custkey as id, c_mktsegment as segment, c_name as name from customer",
    "concat_attrs": "select c_custkey, c_mktsegment || c_name as joined from customer",
    "xf_substr": "select p_partkey, 0::int as pos, substring(p_type, 3, 3) as term from part",
    "xf_upcase": "select p_partkey, 0::int as pos, upper(p_name) as term from part",
    "xf_trim": "select p_partkey, 0::int as pos, trim(p_name) as term from part",
    "xf_killafter": "select c_custkey, 0::int as pos, split_part(c_name, '#', 1) as term from customer",
    "xf_split_names": f"with names(id, name) as (select * from (values {_NAME_ROWS}) t(id, name) union all select p_partkey + 1000, upper(p_name) from part) select id::bigint as id, pos, term from {_split('names')}",
    "pipeline_multi": f"select id as p_partkey, pos, substring(term, 1, 3) as term from {_split('(select p_partkey as id, upper(p_name) as name from part)')}",
    "terms_of_parts": f"with {_PARTS} select id, field_idx, pos, term from tokens",
    "learn_counts": f"with {_learnt(_PARTS, 64)} select * from counts",
    "vocab_weights": f"with {_learnt(_PARTS, 64)} select field_idx, term, cnt, term_idx, total, dim, round(weight, 6) as weight from vocab",
    "field_offsets": f"with {_learnt(_PARTS, 64)} select * from fields",
    "fingerprint": f"with {_learnt(_PARTS, 64)} select field_idx, md5(count(*)::varchar || ':' || sum(('0x' || substring(md5(term || ':' || cnt::varchar), 1, 15))::bigint)::varchar) as fingerprint from counts group by field_idx",
    "document_vocabulary": """with w as (select unnest(string_split(text, ' ')) as term from documents), c as (select term, count(*) as cnt from w where term <> '' group by term)
select term, cnt, (row_number() over (order by term) - 1)::bigint as term_idx, (sum(cnt) over ())::bigint as total, count(*) over () as dim from c""",
    "gauss_components": f"select i, q, round(q / 4096.0 - 8.0, 9) as x from (select i, {_quantised('i')} as q from range(20000) r(i))",
    "plane_components": f"with {_learnt(_PARTS, 64)}, {_planes(64)} select field_idx, term_idx, h as plane, q from planes",
    "field_signature": f"""with {_learnt(f"tokens as ({_NAME})", 16)}, {_planes(16)}, {_signed(16, 8, _ALL_PARTS)} select id, h as plane, round(s, 6) + 0.0 as value from sums""",
    "record_signature": f"{_SIGNED_PARTS} select * from signed",
    "record_signature_tail": f"with {_learnt(f'tokens as ({_NAME} union all {_TYPE})', 60)}, {_planes(60)}, {_signed(60, 7, _ALL_PARTS)} select * from signed",
    "schema_round_trip": f"{_SIGNED_PARTS} select * from signed",
    "signature_oov": _OOV,
    "signature_empty_attr": _EMPTY_ATTR,
    "index_postings_set": f"{_SIGNED_PARTS} select chunk_idx, chunk_val, id from signed",
    "index_postings_multiset": f"{_SIGNED_PARTS} select chunk_idx, chunk_val, id, case when id % 3 = 0 then 2 else 1 end::bigint as n from signed",
    "index_rewrite_latest": "select c_custkey as id, case when c_custkey % 5 = 0 then c_name || ' II' else c_name end as name from customer",
    "index_round_trip": f"{_SIGNED_PARTS}, m as ({_MATCHES.format(50)}) select m.query_id, m.id, p_name, p_type, m.matches from m join part on p_partkey = m.id",
    "index_stream": f"{_SIGNED_PARTS}, m as ({_MATCHES.format(50)}) select m.query_id, m.id, p_name, p_type, m.matches from m join part on p_partkey = m.id",
    "match_query": f"{_SIGNED_PARTS}, m as ({_MATCHES.format(50)}) select m.query_id, m.id, p_name, p_type, m.matches from m join part on p_partkey = m.id",
    "match_top": f"{_SIGNED_PARTS}, m as ({_MATCHES.format(50)}) select query_id, id, matches from m where matches >= 3 qualify row_number() over (partition by query_id order by matches desc, id) <= 5",
    "match_injected_golden": "select * from (values (0::bigint, 1::bigint, 'John', 'Doe', 4::bigint), (0, 2, 'Jane', 'Roe', 3)) t(query_id, id, first, last, matches)",
    "index_fetch": "select c_custkey as id, case when c_custkey % 5 = 0 then c_name || ' II' else c_name end as name, c_mktsegment from customer where c_custkey % 3 = 0",
    "command_line": f"{_SIGNED_PARTS}, m as ({_MATCHES.format(50)}) select m.query_id, m.id, p_name, p_type, m.matches from m join part on p_partkey = m.id",
    "command_hash": f"select i, q, round(q / 4096.0 - 8.0, 9) as x from (select i, {_quantised('i')} as q from range(20000) r(i))",
    "signature_2048": f"with {_learnt(f'tokens as ({_NAME} union all {_TYPE})', 2048)}, {_planes(2048)}, {_signed(2048, 16, _ALL_PARTS)} select id, md5(string_agg(chunk_val::varchar, ',' order by chunk_idx)) as signature from signed group by id",
    "key_codecs": """with k as (select o_orderkey * 77377 % 4294967296 as id from orders)
select id, to_base64(unhex(printf('%02X%04X', id % 256, id % 65536))) as bucket, to_base64(unhex(printf('%08X', id))) as key, id as back from k""",
    "vec_norm": "select vec_id, len(embedding)::bigint as dimension, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as norm, round(embedding[4]::double, 6) as third from embeddings",
    "vec_dot": f"with {_DENSE} select vec_id, round(list_dot_product(a, b), 6) + 0.0 as dot from pairs",
    "vec_cosine": f"with {_DENSE} select vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) + 0.0 as cosine from pairs",
    "vec_quantised": """with q as (select vec_id, list_transform(embedding::double[], lambda x: floor((x + 8.0) * 4096.0)::int) as q from embeddings)
select vec_id, list_sum(q)::bigint as steps, round(sqrt(list_sum(list_transform(q, lambda x: (x / 4096.0 - 8.0) * (x / 4096.0 - 8.0)))), 6) as norm from q""",
    "vec_sparse_dot": f"""with {_DENSE}, s as (select vec_id, {_SPARSE.format("a")} as a, {_SPARSE.format("b")} as b from pairs)
select vec_id, round(list_dot_product(a, b), 6) + 0.0 as dot, round(sqrt(list_dot_product(a, a)), 6) as norm, round(a[6], 6) + 0.0 as fifth from s""",
    "vec_mixed_dot": f"with {_DENSE} select vec_id, round(list_dot_product(a, {_SPARSE.format('b')}), 6) + 0.0 as dot from pairs",
    "vec_dispatch": f"with {_DENSE}, s as (select *, {_SPARSE.format('a')} as sa, {_SPARSE.format('b')} as sb from pairs) select vec_id, " + ", ".join(f"round(list_dot_product({x}, {y}), 6) + 0.0 as dot_{x}_{y}, round(list_dot_product({x}, {y}) / (sqrt(list_dot_product({x}, {x})) * sqrt(list_dot_product({y}, {y}))), 6) + 0.0 as cos_{x}_{y}" for x in ("a", "sa") for y in ("b", "sb")) + " from s",
    "vec_random": f"select o_orderkey, p::int as pos, {_quantised('100 + p')} as q from orders, range(8) r(p)",
    "vec_hash": f"{_SIDES} select vec_id, s >= 0 as side from d where k = 0",
    "vec_signature16": f"{_SIDES} select vec_id, bit_or(case when s >= 0 then 1::int << k else 0 end)::int as signature from d where k < 16 group by vec_id",
    "encoder_vocab": f"with {_encoder('true')} select field_pos, term, cnt, term_id, record_count, dim from known",
    "encoder_weights": f"with {_encoder('true')} select field_pos, term, field_offset, round(ln(record_count::double / cnt), 6) as weight from known join starts using (field_pos)",
    "encoder_encode": f"""with {_encoder("seq % 2 = 1 and seq in (select seq from cells where field_pos = 0 and term in ('O', 'F'))")}
select c.seq, (select sum(dim)::bigint from (select distinct field_pos, dim from known)) as dimension, c.field_pos as pos,
  case when c.term = '' then 0 else s.field_offset + coalesce(k.term_id, 0) end::bigint as index,
  case when c.term = '' then 0.0 else round(ln(coalesce(k.record_count, z.record_count)::double / coalesce(k.cnt, z.cnt)), 6) end as value
from cells c join starts s using (field_pos) left join known k on k.field_pos = c.field_pos and k.term = c.term
left join known z on z.field_pos = c.field_pos and z.term_id = 0""",
}
ORACLE["encoder_round_trip"] = ORACLE["encoder_encode"]
