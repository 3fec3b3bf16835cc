"""DuckDB SQL for the queries that SQL can express on whole tables."""

from .license_scan import GROWTH, TEMPLATES, WIDTH

SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

OP1 = f"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g')) as text_sha256 from documents
), g as (
  select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by text_sha256
)
select distinct d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, d.text_sha256
from d join g using (text_sha256)
"""

OP4 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 20
"""

OP6 = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by payload_digest
)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when f.first_id is distinct from p.page_id and p.payload_bytes >= 100 then 'revisit' else 'response' end as record_type,
       case when f.first_id is distinct from p.page_id and p.payload_bytes >= 100 then f.first_id end as refers_to
from p left join f using (payload_digest)
"""

OP7 = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as words
  from documents
), s as (
  select distinct doc_id, array_to_string(words[i:i + 4], ' ') as shingle
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from w where len(words) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as inter
  from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as (
  select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * inter >= 75 * (x.n + y.n - inter)
), reach as (
  select a as node, b as other from links union select b, a from links
  union
  select r.node, case when l.a = r.other then l.b else l.a end
  from reach r join links l on l.a = r.other or l.b = r.other
)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(min(r.other), w.doc_id)) as component_id
from w left join n using (doc_id) left join reach r on r.node = w.doc_id
group by w.doc_id, n.n
"""

_TOKENS = r"regexp_extract_all(lower({}), '([\p{{L}}\p{{N}}]+(?:[.\-][\p{{L}}\p{{N}}]+)*)', 1)"
_NOTICES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))

# shingles of every text that a template has, and the windows they lie in, which start at multiples of the template's span
OP9 = f"""
with t as (
  select template, license, {_TOKENS.format("notice")} as words from (values {_NOTICES}) v(template, license, notice)
), ts as (
  select distinct template, license, array_to_string(words[i:i + {WIDTH - 1}], ' ') as shingle
  from (select *, unnest(range(1, len(words) - {WIDTH - 2})) as i from t)
), tn as (
  select template, count(*) as n, cast(ceil(pow({GROWTH}, ceil(ln(count(*)) / ln({GROWTH}) - 1e-9))) as bigint) as span from ts group by template
), d as (
  select row_number() over () as place, doc_id, {_TOKENS.format("coalesce(text, '')")} as words from documents
), ds as (
  select place, i - 1 as p, array_to_string(words[i:i + {WIDTH - 1}], ' ') as shingle
  from (select place, words, unnest(range(1, len(words) - {WIDTH - 2})) as i from d where len(words) >= {WIDTH})
), hits as (
  select place, template, license, n, shingle, p // span as w from ds join ts using (shingle) join tn using (template)
), held as (
  select place, template, license, count(distinct shingle) / n as share
  from (select * from hits union all select place, template, license, n, shingle, w - 1 from hits where w > 0)
  group by place, template, license, n, w
), good as (
  select place, string_agg(distinct license, ',' order by license) as licenses, count(distinct template) as matches, max(share) as best
  from held where share >= 0.75 group by place
)
select d.doc_id, coalesce(g.licenses, '') as licenses, coalesce(g.matches, 0) as matches, coalesce(g.best, 0.0::double) as best
from d left join good g using (place)
"""

ORACLE_SQL = {"op1_exact_dedup": OP1, "op4_topk": OP4, "op6_warc": OP6, "op7_ngram_join": OP7, "op9_license_scan": OP9}
