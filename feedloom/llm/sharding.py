"""Sharding by sampled splitters: near-equal bytes per shard, equal texts side by side.

Records are ordered by (text hash, doc_id). A size-weighted sample of the keys gives quantile
boundaries, the boundaries cut the table into ranges, ranges that come out overfull are cut again
by a sample of their own, and exact range totals turn places in a range into places in the whole
order. A shard is the n-th part of all bytes in that order. A group of equal texts lies in one
piece and is cut only where a shard is full; the cut goes by doc_id, so no group lands in one task.

Edge cases: a null text has no bytes and lies with the empty texts; null doc_ids come first in
their group; repeated rows are separate records; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import hash60, id_hash, sized
from feedloom.plans.staging import stage

# Bytes added to every record; sampled keys per range; a range above OVERFULL times its share is cut again.
RECORD_BYTES = 16
SAMPLES_PER_RANGE = 16
OVERFULL = 2.0
_NULL_ID = -(1 << 63)


def _assign(df: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Add ``range``: how many of the sorted (key, id) cuts lie at or below the record."""
    keys, ids = cuts[:, 0].copy(), cuts[:, 1].copy()

    @F.pandas_udf("long")
    def place(key: pd.Series, ident: pd.Series) -> pd.Series:
        n = len(key)
        k = np.concatenate([keys, key.to_numpy("int64")])
        i = np.concatenate([ids, ident.to_numpy("int64")])
        cut_first = np.concatenate([np.zeros(len(keys), "int8"), np.ones(n, "int8")])
        order = np.lexsort((cut_first, i, k))
        out = np.empty(len(k), "int64")
        out[order] = np.cumsum(cut_first[order] == 0)
        return pd.Series(out[len(keys):])

    return df.withColumn("range", place("key", "ident"))


def _sample(df: DataFrame, weight, seed: int) -> np.ndarray:
    """Sorted distinct (key, ident) of the records that a size-weighted draw picks.

    A record is drawn with probability size * weight, decided by a hash of its id, so the expected
    number drawn is the bound that the caller divides by.
    """
    u = id_hash(seed, "key", "ident") / F.lit(float(1 << 60))
    rows = df.filter(u < F.col("size") * weight).select("key", "ident").distinct().collect()
    return np.array(sorted((r.key, r.ident) for r in rows), dtype="int64").reshape(-1, 2)


def shard_by_bytes(
    docs: DataFrame, shards: int = 40, range_rows: int = 200_000, seed: int = 5, rounds: int = 4
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards 0 .. shards-1 of near-equal bytes, slots gapless from 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    records = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            hash60(text).alias("key"),
            F.coalesce(F.col("doc_id"), F.lit(_NULL_ID)).alias("ident"),
        ),
        "shard-records",
    )
    counted = records.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    total = counted.bytes or 0
    ranges = max(4 * shards, counted.n // range_rows)
    share = total / ranges if total else 1.0
    drawn = _sample(records, F.lit(SAMPLES_PER_RANGE / share), seed)
    cuts = drawn[SAMPLES_PER_RANGE // 2 :: SAMPLES_PER_RANGE]
    for again in range(rounds):
        totals = _assign(records, cuts).groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        overfull = totals.filter((F.col("bytes") > OVERFULL * share) & (F.col("n") > 1)).collect()
        if not overfull:
            break
        # Cut each overfull range by a sample of its own, several keys per share of bytes it holds.
        inside = _assign(records, cuts).join(F.broadcast(records.sparkSession.createDataFrame([(r["range"],) for r in overfull], "range long")), "range")
        drawn = _sample(inside, F.lit(SAMPLES_PER_RANGE / share), seed + 1 + again)
        finer = drawn[SAMPLES_PER_RANGE // 4 :: SAMPLES_PER_RANGE // 2]
        cuts = np.unique(np.concatenate([cuts, finer]), axis=0)
    ranged = _assign(records, cuts)
    totals = stage(ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-ranges")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
    )
    inside = Window.partitionBy("range").orderBy("key", "ident", "size")
    here = inside.rowsBetween(Window.unboundedPreceding, 0)
    # A record belongs to the part of all bytes in which its last byte lies.
    placed = stage(
        ranged.join(sized(offsets), "range")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.sum("size").over(here) + F.col("bytes_before")).alias("end"),
            (F.row_number().over(inside) + F.col("rows_before") - 1).alias("place"),
        )
        .withColumn("shard", F.expr(f"cast(((`end` - 1) * {shards}) div {total or 1} as int)")),
        "shard-placed",
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )
