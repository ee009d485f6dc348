"""DuckDB SQL for the queries that SQL can express.

The other queries learn models, draw hashed random numbers or call tokenizers;
``tests/llm`` holds them against plain versions.
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Runs of ASCII letters, digits and characters beyond ASCII.
_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

# Components of the undirected links (a, b): the smallest id that can be reached.
_REACH = """
reach(id, r) as (
  select id, id from nodes
  union
  select reach.id, links.b from reach join links on links.a = reach.r),
comp as (select id, min(r) as component_id from reach group by id)"""

ORACLE: dict[str, str] = {
    "op2_vector_dedup": f"""
with recursive v as (
  select vec_id as id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
u as (
  select id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v
  where label is not null and e is not null
    and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select x.id as a, y.id as b from u x join u y on x.label = y.label and x.id <> y.id and len(x.e) = len(y.e)
  where list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.98),
nodes as (select distinct id from v),{_REACH},
deg as (select a as id, count(*) as n from links group by a)
select v.id as vec_id, coalesce(deg.n, 0) as n_links, comp.component_id, v.id = comp.component_id as kept
from v join comp on comp.id = v.id left join deg on deg.id = v.id""",

    "op5_shingle_join": f"""
with recursive w as (
  select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                          '[^\\x20\\x09-\\x0D]+') as ws
  from documents),
s as (
  select distinct id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
         else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh
  from w),
size as (select w.id, count(s.sh) as n from w left join s on s.id = w.id group by w.id),
shared as (select x.id as a, y.id as b, count(*) as k from s x join s y on x.sh = y.sh and x.id <> y.id group by all),
links as (
  select a, b from shared join size p on p.id = a join size q on q.id = b where 100 * k >= 75 * (p.n + q.n - k)),
nodes as (select distinct id from w),{_REACH}
select size.id as doc_id, size.n as n_shingles, comp.component_id from size join comp on comp.id = size.id""",

    "op11_exact_dedup": """
with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
       row_number() over (partition by text order by doc_id desc nulls last) = 1 as kept, sha256(text) as text_sha256
from t""",

    "op12_lexical_search": f"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') as ts
  from documents where text is not null),
lens as (select r, doc_id, len(ts) as n from d where len(ts) > 0),
total as (select count(*) as docs, sum(n)::bigint as words from lens),
tf as (select r, t, count(*) as tf from (select r, unnest(ts) as t from d) group by all),
weights as (
  select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select t, count(*) as df from tf group by t), total),
items as (
  select item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) as t
  from benchmark where text is not null),
asked as (select item_id, t, count(*) as times from items group by all),
scores as (
  select item_id, tf.r,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::bigint as score
  from asked join tf on tf.t = asked.t join weights on weights.t = tf.t join lens on lens.r = tf.r, total
  group by all),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
  from scores join lens using (r) where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20""",
}
