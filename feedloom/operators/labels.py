"""Human labels and reviewer rankings as keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.upsert import delete_keys, upsert_replace

LABEL_KEY = ["review_id"]
RANKING_KEY = ["reviewer", "app_id", "pain_point"]


def save_labels(labels: DataFrame, batch: DataFrame, order: tuple[str, ...] = ("labeled_at", "labeler")) -> DataFrame:
    """Labels after a batch of new ones; a re-label replaces the earlier label."""
    return upsert_replace(labels, batch, LABEL_KEY, order)


def delete_labels(labels: DataFrame, gone: DataFrame) -> DataFrame:
    return delete_keys(labels, gone, LABEL_KEY)


def save_rankings(rankings: DataFrame, batch: DataFrame, order: tuple[str, ...] = ("ranked_at", "rank")) -> DataFrame:
    """Rankings after a batch of new ones, one per reviewer, app and pain point."""
    return upsert_replace(rankings, batch, RANKING_KEY, order)


def label_progress(queue: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows out of the queue."""
    marked = queue.select(F.col("id").alias("review_id")).join(
        labels.select("review_id").distinct().withColumn("_done", F.lit(True)), "review_id", "left"
    )
    return marked.agg(F.count_if(F.col("_done")).alias("labelled"), F.count(F.lit(1)).alias("queued"))
