"""Runs that end in stored tables: ingest, classification and pain points, each one commit of a store."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import classify, painpoints
from feedloom.operators.cleaning import KEEP_LANGUAGES, clean_and_filter
from feedloom.plans.staging import stage, stage_counting
from feedloom.schemas import (
    CLASSIFICATIONS,
    MODEL_CACHE,
    PAIN_POINT_MEMBERS,
    PAIN_POINTS,
    RETRIEVALS,
    REVIEWS,
)
from feedloom.sources.readers import INPUT_ORDER, read_mapped_csv
from feedloom.sources.store import Store
from feedloom.sources.tables import SLICE

REVIEW_KEYS = ["app_id", "review_id"]
RESULT_KEYS = ["review_id", "prompt_version"]


def ingest_csv(
    store: Store,
    path: str,
    mapping: dict[str, str],
    app_id: str,
    app_name: str,
    profile: DataFrame | None = None,
    keep_languages: Sequence[str] = KEEP_LANGUAGES,
    **reading,
) -> int:
    """Map, clean and store a CSV in one call; returns how many reviews are new."""
    raw = read_mapped_csv(store.spark, path, mapping, app_id, app_name, **reading)
    cleaned = clean_and_filter(raw, list(INPUT_ORDER), keep_languages, profile)
    added = store.insert("reviews", cleaned, REVIEWS, REVIEW_KEYS, list(INPUT_ORDER))
    store.commit()
    return added


def classify_and_store(
    store: Store,
    reviews: DataFrame,
    prompt_version: str,
    scorer: classify.Scorer,
    retriever: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, int]:
    """Classify reviews from the store's cache and a scorer, and store results, answers and retrievals in one commit.

    Returns the counts total, hits, misses, invalid (reviews whose scoring failed validation), cached and stored. A
    second run over the same reviews finds every valid answer cached; a run that dies before its commit leaves the store as it was.
    """
    counts: dict[str, int] = {}
    out = classify.classify_reviews(reviews, store.read("cache", MODEL_CACHE), prompt_version, scorer, retriever, counts.update)
    # Written first: every table below is made from one pass over the scorer.
    answers = stage(out["new_cache"], "answers")
    results = stage(out["results"], "results")
    _, counts["invalid"] = stage_counting(out["rejected"], "rejected")
    counts["cached"] = store.insert("cache", answers, MODEL_CACHE, ["cache_key"], ["cache_key"])
    # One answer per review and run.
    rows = classify.classification_rows(results, prompt_version)
    counts["stored"] = store.replace("classifications", rows, CLASSIFICATIONS, RESULT_KEYS, ["raw_response"])
    if "retrievals" in out:
        store.replace("retrievals", stage(out["retrievals"], "retrievals"), RETRIEVALS, RESULT_KEYS, ["review_id"])
    store.commit()
    return counts


def store_pain_points(store: Store, points: DataFrame, members: DataFrame, slices: DataFrame) -> None:
    """Put pain points and their members in place of those of the given (app_id, prompt_version) slices, in one commit.

    A slice without points is cleared.
    """
    store.replace_slices("pain_points", slices, points, PAIN_POINTS, SLICE)
    store.replace_slices("pain_point_members", slices, members, PAIN_POINT_MEMBERS, SLICE)
    store.commit()


def load_pain_points(store: Store, app_id: str, prompt_version: str) -> DataFrame:
    """The stored pain points of one app and version."""
    inside = (F.col("app_id") == app_id) & (F.col("prompt_version") == prompt_version)
    return store.read("pain_points", PAIN_POINTS).filter(inside)


def build_and_store(store: Store, reviews: DataFrame, **options) -> None:
    """Pain points and members of every app and version from the stored classifications, in place of the old ones."""
    classified = store.read("classifications", CLASSIFICATIONS)
    points, members = painpoints.build_pain_points(classified, reviews, **options)
    apps = reviews.select(F.col("id").alias("review_id"), "app_id")
    slices = classified.select("review_id", "prompt_version").join(apps, "review_id").select(*SLICE).distinct()
    store_pain_points(store, points, members, slices)
