"""Dashboard numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.prioritize import score_pain_points


def review_counts_by_app(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("app_id", "app_name").agg(F.count(F.lit(1)).alias("review_count"))


def app_summary(reviews: DataFrame) -> DataFrame:
    """Reviews and mean rating per app, most reviews first."""
    return (
        reviews.groupBy("app_id", "app_name")
        .agg(F.count("id").alias("reviews"), F.avg(F.col("rating").cast("double")).alias("avg_rating"))
        .orderBy(F.col("reviews").desc(), "app_id")
    )


def headline_metrics(reviews: DataFrame, pain_points: DataFrame, accuracies: DataFrame) -> DataFrame:
    """(metric, value): total reviews, total pain points, best theme accuracy in percent."""
    best = accuracies.filter(F.col("field") == "theme").agg(F.max("accuracy").alias("a"))
    return (
        reviews.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("reviews").alias("metric"), "value")
        .unionByName(
            pain_points.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
                F.lit("pain_points").alias("metric"), "value"
            )
        )
        .unionByName(
            best.select(F.lit("best_theme_accuracy").alias("metric"), F.round(F.col("a") * 100.0, 1).alias("value"))
        )
    )


def theme_sentiment_breakdown(classified: DataFrame) -> DataFrame:
    """Counts per app, theme and sentiment with subtotals.

    ``level`` is how many of the columns are summed over (0 to 3), so a null theme and a subtotal
    over themes stay apart.
    """
    return classified.rollup("app_id", "theme", "sentiment").agg(
        F.count(F.lit(1)).alias("n"), F.bit_count(F.grouping_id()).cast("int").alias("level")
    )


def class_distribution(classified: DataFrame) -> DataFrame:
    """Value counts of theme and of sentiment, most frequent first."""
    values = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("theme", "sentiment")]
    )
    return (
        classified.select(F.inline(values))
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("field", F.col("n").desc(), "value")
    )


def backlog_view(pain_points: DataFrame, app_id: str, prompt_version: str = "v1", **params) -> DataFrame:
    """One app's scored pain points, best first."""
    chosen = pain_points.filter((F.col("app_id") == app_id) & (F.col("prompt_version") == prompt_version))
    return score_pain_points(chosen, **params).orderBy(
        F.col("priority_score").desc_nulls_last(), "theme", "cluster_label"
    )
