"""Queries over conversations and pages."""

from __future__ import annotations

from feedloom.llm.common import table
from feedloom.llm.registry import query
from feedloom.llm.trie import conversation_trie
from feedloom.llm.warc import read_archive, write_archive

TRIE_SQL = r"""
with t as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn asc nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
own as (
  select c, count(*) as n, c - c % 20 as head, cast(c as varchar) as s from t group by c),
convs as (
  select o.c, o.head, o.n, xor(4294967295, list_reduce(
           list_concat([cast(4294967295 as bigint)], list_transform(range(1, length(o.s) + 1), lambda i: cast(ascii(o.s[i]) as bigint))),
           lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 4 as h,
         coalesce(f.n, 0) as n_head
  from own o left join own f on f.c = o.head),
sizes as (select *, least(h, n_head) as shared, least(h, n_head) + greatest(n - h, 0) as length from convs),
rebuilt as (
  select s.c, t.pos as depth, t.role, t.text from sizes s join t on t.c = s.head and t.pos <= s.shared
  union all
  select s.c, t.pos - s.h + s.shared, t.role, t.text from sizes s join t on t.c = s.c and t.pos > s.h),
members as (
  select c, depth, string_agg(md5(concat(length(role), ':', role, text)), '') over (partition by c order by depth) as k,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from rebuilt
  union all select c, 0, '', 0 from sizes),
nodes as (
  select depth, k, min(c) as conv_id, count(*) as n_convs, max(words) as words, left(k, 32 * (depth - 1)) as pk from members group by depth, k),
children as (select depth - 1 as depth, pk as k, count(*) as n_children from nodes where depth > 0 group by 1, 2),
shape as (select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join children c on c.depth = n.depth and c.k = n.k),
sums as (
  select m.depth, m.k, sum(case when n.n_children = 0 then 1 else 0 end) as n_leaves, sum((n.n_convs - 1) * n.words) as saved_tokens
  from shape n join members m on m.c = n.conv_id and m.depth <= n.depth group by m.depth, m.k),
ends as (
  select m.depth, m.k, string_agg(cast(m.c as varchar), ',' order by m.c) as ids
  from members m join sizes s on s.c = m.c and s.length = m.depth group by m.depth, m.k)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children,
       cast(s.n_leaves as bigint) as n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from shape n join sums s on s.depth = n.depth and s.k = n.k
     left join shape p on p.depth = n.depth - 1 and p.k = n.pk and n.depth > 0
     left join ends e on e.depth = n.depth and e.k = n.k"""


@query("op11_conversation_trie", TRIE_SQL)
def op11_conversation_trie(spark, sf_dir):
    """Every node of the trie of conversations that share the heads of their families."""
    return conversation_trie(table(spark, sf_dir, "conversations"), shared_heads=True)


WARC_SQL = r"""
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
first as (select d, min(page_id) as page_id from p where n >= 100 group by d)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
       case when f.page_id is null or f.page_id is not distinct from p.page_id then 'response' else 'revisit' end as record_type,
       case when f.page_id is distinct from p.page_id then f.page_id end as refers_to
from p left join first f on f.d = p.d"""


@query("op13_warc_capture_index", WARC_SQL)
def op13_warc_capture_index(spark, sf_dir):
    """Every page written as a WARC record and read back through the capture index."""
    records = read_archive(write_archive(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
