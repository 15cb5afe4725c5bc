"""Classifier quality against human labels, for all prompt versions in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.stats import ratio_or

BY = ["prompt_version", "field"]


def eval_set(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Human labels with the text of their review."""
    return labels.join(reviews.select(F.col("id").alias("review_id"), "cleaned_text"), "review_id").select(
        F.col("review_id").alias("id"),
        "cleaned_text",
        F.col("theme").alias("true_theme"),
        F.col("sentiment").alias("true_sentiment"),
    )


def judged(evaluated: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per labelled review and prompt version that predicted it."""
    return evaluated.join(
        predictions.select(F.col("review_id").alias("id"), "prompt_version", "theme", "sentiment", "severity", "reasoning"),
        "id",
    )


def confusion_cells(judgements: DataFrame, fields: tuple[str, ...] = ("theme", "sentiment")) -> DataFrame:
    """Counts of (true, predicted) per version and field; everything else derives from this small table."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"true_{f}").alias("true_label"), F.col(f).alias("pred_label"))
            for f in fields
        ]
    )
    return (
        judgements.select("prompt_version", F.inline(pairs))
        .groupBy("prompt_version", "field", "true_label", "pred_label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def accuracy(cells: DataFrame) -> DataFrame:
    """Share of exact matches; no judgements give no row."""
    right = F.sum(F.when(F.col("true_label").eqNullSafe(F.col("pred_label")), F.col("n")).otherwise(0))
    return cells.groupBy(*BY).agg(
        F.sum("n").alias("n"), (right.cast("double") / F.sum("n").cast("double")).alias("accuracy")
    )


def class_report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class in the union of true and predicted; 0 for 0/0."""
    by_true = cells.groupBy(*BY, F.col("true_label").alias("label")).agg(F.sum("n").alias("support"))
    by_pred = cells.groupBy(*BY, F.col("pred_label").alias("label")).agg(F.sum("n").alias("predicted"))
    hits = cells.filter(F.col("true_label") == F.col("pred_label")).select(
        *BY, F.col("true_label").alias("label"), F.col("n").alias("hits")
    )
    joined = (
        by_true.join(by_pred, [*BY, "label"], "full_outer")
        .join(hits, [*BY, "label"], "left")
        .na.fill(0, ["support", "predicted", "hits"])
    )
    precision = ratio_or(F.col("hits"), F.col("predicted"), 0.0)
    recall = ratio_or(F.col("hits"), F.col("support"), 0.0)
    return joined.select(
        *BY,
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        ratio_or(2.0 * F.col("hits"), F.col("predicted") + F.col("support"), 0.0).alias("f1"),
        "support",
    )


def report_averages(report: DataFrame) -> DataFrame:
    """Macro (plain) and weighted (by support) means of the class report."""
    macro = report.groupBy(*BY).agg(
        F.lit("macro").alias("average"),
        *[F.avg(m).alias(m) for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )
    weighted = report.groupBy(*BY).agg(
        F.lit("weighted").alias("average"),
        *[ratio_or(F.sum(F.col(m) * F.col("support")), F.sum("support"), 0.0).alias(m) for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )
    return macro.unionByName(weighted)


def confusion_matrix(cells: DataFrame) -> DataFrame:
    """Counts over all label pairs per version and field, zeros included, in long form."""
    labels = (
        cells.select(*BY, F.explode(F.array("true_label", "pred_label")).alias("label"))
        .groupBy(*BY)
        .agg(F.sort_array(F.collect_set("label")).alias("labels"))
    )
    grid = labels.select(*BY, "labels", F.explode("labels").alias("true_label")).select(
        *BY, "true_label", F.explode("labels").alias("pred_label")
    )
    return grid.join(cells, [*BY, "true_label", "pred_label"], "left").na.fill(0, ["n"])


def misclassified(judgements: DataFrame) -> DataFrame:
    """Rows wrong in theme or in sentiment."""
    return judgements.filter(
        (F.col("theme") != F.col("true_theme")) | (F.col("sentiment") != F.col("true_sentiment"))
    ).select(
        "prompt_version", "id", "cleaned_text", "true_theme", "theme", "true_sentiment", "sentiment", "reasoning"
    )


def compare_versions(judgements: DataFrame) -> DataFrame:
    """Accuracy and macro F1 per version and field, flagging the best theme accuracy."""
    cells = confusion_cells(judgements)
    macro = report_averages(class_report(cells)).filter(F.col("average") == "macro")
    scored = accuracy(cells).join(macro.select(*BY, F.col("f1").alias("macro_f1")), BY)
    best = scored.filter(F.col("field") == "theme").groupBy("field").agg(F.max("accuracy").alias("_best"))
    return scored.join(best, "field", "left").select(
        *BY, "n", "accuracy", "macro_f1", F.coalesce(F.col("accuracy") == F.col("_best"), F.lit(False)).alias("best")
    )
