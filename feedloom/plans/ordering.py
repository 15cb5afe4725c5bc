"""Positions and running aggregates over groups of any size.

A plain window puts a whole group into one task. The helpers here range-partition the rows
first, so that one hot group spreads over many tasks, summarise each (group, block) and add
the summary of the earlier blocks of the same group back to every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.plans.staging import stage

_ROW_IN_BLOCK = (1 << 33) - 1


def _blocks(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows sorted over range partitions, with the partition and the place in it frozen on disk."""
    keys = [F.col(g) for g in groups]
    laid_out = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return stage(
        laid_out.withColumn("_blk", F.spark_partition_id()).withColumn(
            "_idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_BLOCK))
        ),
        "blocks",
    )


def grouped_position(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row in its group; ``order`` must be total."""
    laid_out = _blocks(df, groups, order)
    counted = laid_out.groupBy(*groups, "_blk").agg(
        F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # One row per block a group touches: the window holds at most as many rows as there are blocks.
    earlier = Window.partitionBy(*groups).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    return _rejoin(laid_out, offsets, groups).select(
        *[F.col(c) for c in df.columns],
        (F.col("_idx") - F.col("_first") + F.col("_before") + 1).alias(name),
    )


def grouped_running(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    xors: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums, maxima and exclusive ors per group, in a total order."""
    sums, maxima, xors = sums or {}, maxima or {}, xors or {}
    laid_out = _blocks(df, groups, order)
    totals = laid_out.groupBy(*groups, "_blk").agg(
        *[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()],
        *[F.max(e).alias(f"_t_{n}") for n, e in maxima.items()],
        *[F.bit_xor(e).alias(f"_t_{n}") for n, e in xors.items()],
    )
    earlier = Window.partitionBy(*groups).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *groups,
        "_blk",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in maxima],
        *[F.coalesce(F.bit_xor(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in xors],
    )
    here = Window.partitionBy(*groups, "_blk").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    return _rejoin(laid_out, before, groups).select(
        *[F.col(c) for c in df.columns],
        *[(F.sum(e).over(here) + F.col(f"_b_{n}")).alias(n) for n, e in sums.items()],
        *[F.greatest(F.max(e).over(here), F.col(f"_b_{n}")).alias(n) for n, e in maxima.items()],
        *[F.bit_xor(e).over(here).bitwiseXOR(F.col(f"_b_{n}")).alias(n) for n, e in xors.items()],
    )


def _rejoin(rows: DataFrame, blocks: DataFrame, groups: Sequence[str]) -> DataFrame:
    if not groups:
        # As many rows as there are partitions.
        blocks = F.broadcast(blocks)
    condition = rows["_blk"] == blocks["_blk"]
    for g in groups:
        condition = condition & rows[g].eqNullSafe(blocks[g])
    return rows.join(blocks, condition).drop(blocks["_blk"], *[blocks[g] for g in groups])


def seeded_hash(seed: int, *ids: Column | str) -> Column:
    """A reproducible shuffle key: md5 of ``seed:id``, equal on every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") if isinstance(i, str) else i for i in ids]))


def seeded_position(
    df: DataFrame,
    groups: Sequence[str],
    ids: Sequence[str],
    seed: int = 42,
    limit: int | Column | None = None,
    name: str = "position",
    bucket_rows: int = 50_000,
) -> DataFrame:
    """1-based position of each row in the seeded shuffle of its group.

    The hash is uniform, so its first hex digits cut every group, hot or not, into even buckets;
    as many digits are used as keep a bucket of the whole table below ``bucket_rows``. Bucket counts
    give the offset and only a bucket is sorted in one task. With ``limit`` (a number or an expression on the group columns and ``_size``), buckets
    that start past it are dropped before the rows are shuffled, and the answer stays exact.
    """
    rows, digits = df.count(), 1
    while rows > bucket_rows * 16**digits:
        digits += 1
    hashed = df.withColumn("_h", seeded_hash(seed, *ids)).withColumn("_b", F.substring("_h", 1, digits))
    counts = hashed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_rows"))
    by_group = Window.partitionBy(*groups)
    earlier = by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *groups,
        "_b",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(by_group).alias("_size"),
    )
    if limit is not None:
        limit = F.lit(limit) if isinstance(limit, int) else limit
        offsets = offsets.filter(F.col("_before") < limit)
    condition = hashed["_b"] == offsets["_b"]
    for g in groups:
        condition = condition & hashed[g].eqNullSafe(offsets[g])
    joined = hashed.join(offsets, condition).drop(offsets["_b"], *[offsets[g] for g in groups])
    in_bucket = Window.partitionBy(*groups, "_b").orderBy("_h", *ids)
    placed = joined.withColumn(name, F.row_number().over(in_bucket) + F.col("_before"))
    if limit is not None:
        placed = placed.filter(F.col(name) <= limit)
    return placed.drop("_h", "_b", "_before").withColumnRenamed("_size", f"{name}_of")
