"""One row per key, chosen by an order, without carrying whole rows through an aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.plans.layout import small_side
from feedloom.plans.staging import stage

# The columns of a key's digest.
KEY = ("_key_a", "_key_b")


def digest(*keys: Column) -> list[Column]:
    """Two 64-bit hashes that stand for the key; a null differs from every value."""
    parts = [p for key in keys for p in (key.isNull(), key)]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in enumerate(KEY)]


def one_per_key(df: DataFrame, keys: Sequence[Column], order: Sequence[str], last: bool = False) -> DataFrame:
    """The first (or last) row of every key in ``order``; rows that tie by input place. Adds the key's digest.

    The rows are written once. A hash aggregate over the digests finds the keys that occur more than once; only
    their rows are ordered, without their payload, and only what their winners are is joined back. So wide rows are neither
    sorted nor, while few keys repeat, shuffled, and a key with a third of all rows is one row of the joined side.
    """
    place = F.monotonically_increasing_id().alias("_place")
    rows = stage(df.select("*", *digest(*keys), place), "rows-by-key", "zstd")
    counts = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    repeated = stage(counts.filter("_n > 1").select(*KEY), "repeated-keys")
    side = small_side(repeated)
    narrow = rows.select(*KEY, F.struct(*order, "_place").alias("_order"))
    ordered = narrow.join(repeated if side is None else side, list(KEY), "left_semi").groupBy(*KEY)
    best = ordered.agg((F.max if last else F.min)("_order").alias("_best")).select(*KEY, F.col("_best._place").alias("_best"))
    winners = stage(best, "winners")
    side = small_side(winners)
    joined = rows.join(winners if side is None else side, list(KEY), "left")
    return joined.filter("_best is null or _best = _place").select(*df.columns, *KEY)
