"""Priority Score: four 0-100 components and their weighted mean, per app and prompt version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.plans.ordering import grouped_position

# Default weights.
DEFAULT_WEIGHTS = {"frequency": 0.3, "severity": 0.3, "trend": 0.2, "reach": 0.2}
SCOPE = ("app_id", "prompt_version")


def min_max_scale(df: DataFrame, columns: dict[str, str], scope: Sequence[str] = SCOPE) -> DataFrame:
    """Add 100 * (x - lo) / (hi - lo) per scope for each source -> target; a flat column scales to 100.

    Extremes come from a partially aggregated group-by, joined back, so no scope sits in one task.
    """
    if not scope:
        return min_max_scale(df.withColumn("_all", F.lit(0)), columns, ("_all",)).drop("_all")
    extremes = df.groupBy(*scope).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns]
    )
    joined = df.join(extremes, list(scope))

    def scaled(c: str) -> Column:
        span = (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")).cast("double")
        return F.when(span == 0, 100.0).otherwise(F.try_divide(100.0 * (F.col(c) - F.col(f"_lo_{c}")), span))

    return joined.select(*df.columns, *[scaled(c).alias(target) for c, target in columns.items()])


def severity_score(weighted_severity: Column) -> Column:
    return (weighted_severity - 1.0) / 4.0 * 100.0


def trend_score(last: Column, prev: Column) -> Column:
    """Percent change against at least one earlier mention, clipped to +/-100 and mapped to 0..100."""
    pct = (last - prev).cast("double") / F.greatest(prev, F.lit(1)).cast("double") * 100.0
    return (F.greatest(F.lit(-100.0), F.least(F.lit(100.0), pct)) + 100.0) / 2.0


def weighted_mean(weights: dict[str, float]) -> Column:
    total = float(sum(weights.values())) or 1.0
    summed = sum((F.lit(float(w)) * F.col(f"{name}_score") for name, w in weights.items()), F.lit(0.0))
    return summed / F.lit(total)


def component_scores(pain_points: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Frequency, severity, trend and reach scores. Dividing counts by their total cancels in the scaling."""
    scaled = min_max_scale(pain_points, {"review_count": "frequency_score", "reach_sum": "reach_score"}, scope)
    return scaled.withColumn("severity_score", severity_score(F.col("weighted_severity"))).withColumn(
        "trend_score", trend_score(F.col("last_30_count"), F.col("prev_30_count"))
    )


def score_pain_points(
    pain_points: DataFrame, weights: dict[str, float] = DEFAULT_WEIGHTS, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Component scores plus priority_score; an empty input keeps all five score columns."""
    return component_scores(pain_points, scope).withColumn("priority_score", weighted_mean(weights))


def rank_backlog(
    scored: DataFrame, scope: Sequence[str] = SCOPE, ties: Sequence[str] = ("theme", "cluster_label")
) -> DataFrame:
    """Add backlog_rank: best priority first within each scope, ties by key."""
    order = [F.round("priority_score", 9).desc_nulls_last(), *[F.col(c).asc() for c in ties]]
    return grouped_position(scored, scope, order, name="backlog_rank")


def weight_scenarios(
    pain_points: DataFrame,
    scenarios: dict[str, dict[str, float]],
    scope: Sequence[str] = SCOPE,
    ties: Sequence[str] = ("theme", "cluster_label"),
) -> DataFrame:
    """Rank the backlog under several weightings at once; component scores are computed once."""
    scores = F.array(
        *[
            F.struct(F.lit(name).alias("scenario"), weighted_mean(weights).alias("priority_score"))
            for name, weights in scenarios.items()
        ]
    )
    exploded = component_scores(pain_points, scope).select("*", F.inline(scores))
    return rank_backlog(exploded, ("scenario", *scope), ties)
