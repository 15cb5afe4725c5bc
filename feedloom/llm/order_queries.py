"""Queries of the operators that order or deal out whole tables: mixing and sharding."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.llm.common import table
from feedloom.llm.mixing import fair_queue
from feedloom.llm.registry import query
from feedloom.llm.sharding import shard_by_bytes

MIX_SQL = r"""
with sizes as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         cast('0x' || substr(md5(concat('9:', coalesce(cast(doc_id as varchar), 'null'))), 1, 15) as bigint) as h
  from documents),
per as (
  select source, cast(sum(size) as bigint) as source_size, 3 * cast(sum(size) as bigint) as lim,
         (row_number() over (order by source asc nulls last) - 1) % 3 + 1 as w
  from sizes group by source),
filling as (
  select *, lim / w as ratio,
         (sum(source_size) over () - coalesce(sum(lim) over (order by lim / w, source asc nulls last
              rows between unbounded preceding and 1 preceding), 0))
         / sum(w) over (order by lim / w, source asc nulls last rows between current row and unbounded following) as level
  from per),
level as (select min_by(level, ratio) as level from filling where level <= ratio),
targets as (select source, source_size, least(cast(lim as double), level.level * w) as target from filling, level),
queued as (
  select s.doc_id, s.source, s.size, t.source_size, t.target,
         sum(s.size) over (partition by s.source order by s.h, s.doc_id, s.size rows unbounded preceding) as upto,
         row_number() over (partition by s.source order by s.h, s.doc_id, s.size) as place
  from sizes s join targets t on s.source is not distinct from t.source),
copies as (
  select q.*, turn, (turn * source_size + upto) / target as finish
  from queued q, (select unnest([0, 1, 2]) as turn) where target > 0),
ordered as (
  select *, sum(size) over (order by finish, source asc nulls last, place, turn rows unbounded preceding) as spent from copies),
used as (
  select source, place, count(*) as n from ordered where spent <= (select sum(size) from sizes) group by source, place)
select q.doc_id, q.size, q.source_size, q.target, cast(q.size * coalesce(u.n, 0) as bigint) as taken
from queued q left join used u on q.source is not distinct from u.source and q.place = u.place"""


@query("op9_mix_fair_queueing", MIX_SQL)
def op9_mix_fair_queueing(spark, sf_dir):
    """All documents, mixed to the target weights of their sources."""
    return fair_queue(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_shard_sampled_splitters")
def op5_shard_sampled_splitters(spark, sf_dir):
    """All documents in 40 shards of near-equal bytes, equal texts side by side."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
