"""Spreading rows of inputs that cannot be split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Narrow rows (a few numbers each) up to which a table is sent to every executor: some tens of MB.
BROADCAST_ROWS = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores when the scan has fewer partitions than cores, else leave it alone.

    A file of a single row group is read by one task; text work on it would run on one core. Large
    tables arrive in many partitions and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``df``, cheap to count and narrow, marked for broadcast; None if it has more than ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None


def common_part(df: DataFrame, level: Column, size: Column | None = None, rows: int = BROADCAST_ROWS) -> Column:
    """The condition on ``df`` that holds at its highest whole-numbered levels, as many as have ``rows`` rows at most.

    Where the level follows how often a key occurs, few keys stand for most occurrences: these can be sent out, and only
    the others are left to meet by shuffle. ``size`` is how many rows a row of ``df`` stands for.
    """
    found = df.groupBy(level.alias("level")).agg(F.sum(F.lit(1) if size is None else size).alias("n")).filter("level is not null")
    lowest, taken = None, 0
    for row in sorted(found.collect(), reverse=True):
        taken += row.n
        if taken > rows:
            break
        lowest = row.level
    return F.lit(False) if lowest is None else F.coalesce(level >= lowest, F.lit(False))
