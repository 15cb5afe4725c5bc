"""Agreement between reviewers who ranked the same pain points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.stats import spearman_pvalue
from feedloom.plans.ordering import grouped_position

PAIR = ["app_id", "reviewer_a", "reviewer_b"]


def common_rankings(rankings: DataFrame) -> DataFrame:
    """Per app and reviewer pair a < b, the ranks both gave to the same pain point."""
    a = rankings.select(
        "app_id", "pain_point", F.col("reviewer").alias("reviewer_a"), F.col("rank").alias("rank_a")
    )
    b = rankings.select(
        "app_id", "pain_point", F.col("reviewer").alias("reviewer_b"), F.col("rank").alias("rank_b")
    )
    return a.join(b, ["app_id", "pain_point"]).filter(F.col("reviewer_a") < F.col("reviewer_b"))


def average_rank(df: DataFrame, groups: list[str], value: str, unique: str, name: str) -> DataFrame:
    """Rank of ``value`` per group where ties share the mean of their positions."""
    placed = grouped_position(df, groups, [F.col(value), F.col(unique)], name="_place")
    shared = placed.groupBy(*groups, value).agg(F.avg(F.col("_place").cast("double")).alias(name))
    return df.join(shared, [*groups, value])


def spearman(rankings: DataFrame, min_common: int = 2) -> DataFrame:
    """Rank correlation per app and reviewer pair; null where one side gave a single rank."""
    ranked = average_rank(common_rankings(rankings), PAIR, "rank_a", "pain_point", "_ra")
    ranked = average_rank(ranked, PAIR, "rank_b", "pain_point", "_rb")
    rho = F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb"))
    # Rounding keeps full agreement at exactly 1; greatest and least would turn null into a bound.
    clipped = F.when(
        F.col("spearman_rho").isNotNull(),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round("spearman_rho", 12))),
    )
    return (
        ranked.groupBy(*PAIR)
        .agg(F.count(F.lit(1)).alias("n_common_pain_points"), rho.alias("spearman_rho"))
        .filter(F.col("n_common_pain_points") >= min_common)
        .withColumn("spearman_rho", clipped)
    )


def with_pvalue(correlations: DataFrame) -> DataFrame:
    """Add the two-sided p value; null for two common pain points."""
    return correlations.withColumn(
        "spearman_pvalue", spearman_pvalue(F.col("spearman_rho"), F.col("n_common_pain_points"))
    )


def top_lists(rankings: DataFrame, count: int = 5) -> DataFrame:
    """Each reviewer's ``count`` best-ranked pain points per app, over the reviewer's own list."""
    best = Window.partitionBy("app_id", "reviewer").orderBy("rank", "pain_point")
    return (
        rankings.select("app_id", "reviewer", "pain_point", F.row_number().over(best).alias("_n"))
        .filter(F.col("_n") <= count)
        .groupBy("app_id", "reviewer")
        .agg(F.collect_set("pain_point").alias("top"))
    )


def top_overlap(rankings: DataFrame, count: int = 5) -> DataFrame:
    """Jaccard overlap of the two top lists per app and reviewer pair."""
    lists = top_lists(rankings, count)
    a = lists.select("app_id", F.col("reviewer").alias("reviewer_a"), F.col("top").alias("_a"))
    b = lists.select("app_id", F.col("reviewer").alias("reviewer_b"), F.col("top").alias("_b"))
    return (
        a.join(b, "app_id")
        .filter(F.col("reviewer_a") < F.col("reviewer_b"))
        .select(
            *PAIR,
            (
                F.size(F.array_intersect("_a", "_b")).cast("double")
                / F.greatest(F.lit(1), F.size(F.array_union("_a", "_b"))).cast("double")
            ).alias("top5_jaccard_overlap"),
        )
    )


def agreement(rankings: DataFrame) -> DataFrame:
    """All agreement measures per app and pair; apps and pairs without two common pain points are absent."""
    reviewers = rankings.agg(F.count_distinct("reviewer").alias("n")).scalar()
    return with_pvalue(spearman(rankings)).join(top_overlap(rankings), PAIR).withColumn("n_reviewers", reviewers)
