"""Reproducible samples: stratified sample, label queue, folds, random rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.plans.ordering import seeded_hash, seeded_position

# Default sizes, strata and seed.
SAMPLE_SIZE = 300
QUEUE_SIZE = 500
STRATA = ("app_id", "rating")
SEED = 42
QUEUE_COLUMNS = ["id", "app_id", "app_name", "rating", "cleaned_text"]


def stratum_sizes(df: DataFrame, strata: Sequence[str] = STRATA) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(
    df: DataFrame, size: int = SAMPLE_SIZE, strata: Sequence[str] = STRATA, key: str = "id", seed: int = SEED
) -> DataFrame:
    """An equal quota per stratum, at most ``size`` rows overall; short strata are not topped up.

    Only ids, strata and hashes are ranked; the chosen ids then pick the full rows.
    """
    usable = df
    for name in strata:
        usable = usable.filter(F.col(name).isNotNull())
    slim = usable.select(key, *strata)
    n_strata = slim.select(*strata).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    quota = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(size) / n_strata).cast("bigint"))
    picked = seeded_position(slim, strata, [key], seed, limit=quota)
    # At most max(size, number of strata) rows are left here.
    final = picked.select(key, seeded_hash(seed, key).alias("_h")).orderBy("_h", key).limit(size)
    return df.join(final.select(key), key, "left_semi")


def label_queue(df: DataFrame, size: int = QUEUE_SIZE, seed: int = SEED) -> DataFrame:
    """The fixed set of reviews to label: same rows on every run."""
    return stratified_sample(df, size, seed=seed).select(*QUEUE_COLUMNS)


def random_rows(df: DataFrame, n: int = 5, seed: int | None = None) -> DataFrame:
    """n random rows."""
    return df.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(n)


def kfold_assign(df: DataFrame, key: str = "review_id", n_folds: int = 5, seed: int = SEED) -> DataFrame:
    """Add ``fold``: a seeded shuffle dealt into min(n_folds, rows) even folds."""
    placed = seeded_position(df, [], [key], seed, name="_place")
    return placed.withColumn(
        "fold", ((F.col("_place") - 1) % F.least(F.lit(n_folds), F.col("_place_of"))).cast("int")
    ).drop("_place", "_place_of")
