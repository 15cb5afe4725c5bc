import zlib

import oracle
import pandas as pd
import pytest
from feedloom.llm import mixing, sharding
from feedloom.llm.registry import load
from pyspark.sql import functions as F

# The shard of every record from running byte totals over the whole order.
SHARDS = """
with records as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 16 as size, cast('0x' || substr(md5(coalesce(text, '')), 1, 15) as bigint) as k
  from documents),
placed as (
  select *, cast(sum(size) over (order by k, doc_id nulls first, size rows unbounded preceding) as bigint) as upto,
         row_number() over (order by k, doc_id nulls first, size) as place, cast(sum(size) over () as bigint) as total
  from records),
dealt as (select *, cast(((upto - 1) * 40) // total as int) as shard from placed)
select doc_id, cast(size as bigint) as size, shard, cast(place - min(place) over (partition by shard) as bigint) as slot from dealt"""


def test_shards_of_the_whole_table(spark, sf):
    got = load()[0]["op5_shard_sampled_splitters"](spark, sf).toPandas().sort_values("doc_id", ignore_index=True)
    want = oracle.connect(sf).execute(SHARDS).df().sort_values("doc_id", ignore_index=True)
    assert got[["doc_id", "size", "shard", "slot"]].astype("int64").equals(want.astype("int64"))
    texts = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    assert all(zlib.crc32(texts[d].encode()) == c for d, c in zip(got.doc_id, got.text_crc32, strict=True))
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    per = got.groupby("shard")["size"].sum()
    # A document larger than a share fills its shard alone.
    share = got["size"].sum() / 40
    assert set(per.index) <= set(range(40)) and per.max() <= share + got["size"].max()


def test_overfull_ranges_are_cut_again(spark, monkeypatch):
    """One text that is most of the table, and too few samples, still give even shards."""
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 2)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = sharding.shard_by_bytes(docs, 8, range_rows=100).toPandas()
    per = got.groupby("shard").agg(n=("size", "sum"), slots=("slot", "nunique"), last=("slot", "max"), rows=("slot", "size"))
    assert len(per) == 8 and per.n.max() - per.n.min() <= 64
    assert (per.slots == per.rows).all() and (per["last"] == per.rows - 1).all()


def test_odd_records(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "é", 7), (2, "é", 8)], "doc_id long, text string, key int")
    got = sharding.shard_by_bytes(docs, 40).toPandas()
    assert sorted(got["size"]) == [16, 16, 18, 18] and sorted(got.text_crc32) == [0, 0] + [zlib.crc32("é".encode())] * 2
    assert got.groupby("shard").slot.min().eq(0).all()
    assert sharding.shard_by_bytes(docs.limit(0), 40).count() == 0


def brute_targets(sizes):
    """The law as it is stated: share by weight, cap, reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            full.add(s)


@pytest.mark.parametrize("bucket", [3, 50_000])
def test_mix_by_the_stated_law(spark, bucket):
    rows, n = [], 0
    for source, count, words in (("a", 40, 9), ("b", 2, 5), ("c", 300, 3), (None, 1, 2), ("é", 20, 7), ("z", 5, 0)):
        for _ in range(count):
            n += 1
            rows.append((n, " ".join(["w"] * (words + n % 3 * (words > 0))), source, 1))
    rows += [(None, "one two", "a", 1), (5, rows[4][1], "a", 1), (n + 1, None, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    plan = mixing.fair_queue(docs, bucket_rows=bucket).toPandas()
    assert len(plan) == len(rows)
    sizes = {None if s != s else s: int(g["size"].sum()) for s, g in plan.groupby("source", dropna=False)}
    want = brute_targets(sizes)
    largest = plan["size"].max()
    for s, g in plan.groupby("source", dropna=False):
        s = None if s != s else s
        assert g.source_size.eq(sizes[s]).all() and g.target.sub(want[s]).abs().max() < 1e-6
        assert abs(g.taken.sum() - want[s]) <= 2 * largest and (g.taken <= 3 * g["size"]).all()
    assert plan.taken.sum() <= sum(sizes.values())
    again = mixing.fair_queue(docs, bucket_rows=50_000).toPandas()
    assert sorted(again.taken) == sorted(plan.taken)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == plan.copies.sum() + (plan[plan.doc_id == 5].copies.max() * 2 - plan[plan.doc_id == 5].copies.sum())
    assert mixing.fair_queue(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0
