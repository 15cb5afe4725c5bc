"""Keyed merges of a batch into a stored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.plans.winners import one_per_key


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order``; of rows that tie, the one that comes first in the input."""
    return one_per_key(df, [F.col(k) for k in keys], order).select(df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in ``order``."""
    return one_per_key(df, [F.col(k) for k in keys], order, last=True).select(df.columns)


def new_rows(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str], required: Sequence[str] = ()
) -> DataFrame:
    """Rows of ``incoming`` to append under first-wins: valid, first in the batch, key not stored."""
    valid = incoming
    for name in required:
        valid = valid.filter(F.col(name).isNotNull())
    return first_per_key(valid, keys, order).join(existing.select(*keys), list(keys), "left_anti").select(*incoming.columns)


def upsert_ignore(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str], required: Sequence[str] = ()
) -> DataFrame:
    """The table after an insert that skips stored keys and rows missing a required value."""
    fresh = new_rows(existing, incoming, keys, order, required)
    return existing.unionByName(fresh.select(*existing.columns))


def upsert_replace(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table after an insert that replaces stored keys; the last row of the batch wins.

    Stored rows only meet the distinct keys of the batch, so a small batch is a broadcast
    anti join and the stored table is not shuffled.
    """
    latest = last_per_key(incoming, keys, order)
    untouched = existing.join(latest.select(*keys), list(keys), "left_anti")
    return untouched.unionByName(latest.select(*existing.columns), allowMissingColumns=True)


def delete_keys(existing: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def replace_slice(existing: DataFrame, incoming: DataFrame, **slice_keys: str) -> DataFrame:
    """The table after deleting every row of one slice and inserting ``incoming``, which may be empty."""
    inside = F.lit(True)
    for name, value in slice_keys.items():
        inside = inside & F.col(name).eqNullSafe(F.lit(value))
    return existing.filter(~inside).unionByName(incoming.select(*existing.columns))


def evolve(df: DataFrame, schema) -> DataFrame:
    """Old records read with today's schema: absent columns become typed nulls."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def snapshot_subset(
    reviews: DataFrame, classifications: DataFrame, pain_points: DataFrame, sample: DataFrame
) -> dict[str, DataFrame]:
    """A self-contained subset: sampled reviews, their classifications, pain points of their apps."""
    ids = sample.select("id").distinct()
    apps = sample.select("app_id").distinct()
    return {
        "reviews": reviews.join(ids, "id", "left_semi"),
        "classifications": classifications.join(
            ids.withColumnRenamed("id", "review_id"), "review_id", "left_semi"
        ),
        "pain_points": pain_points.join(apps, "app_id", "left_semi"),
    }
