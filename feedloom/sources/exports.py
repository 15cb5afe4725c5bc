"""Exports: backlog to CSV and Markdown, evaluation results to JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Markdown table header of the backlog.
MARKDOWN_HEADER = ["| Rank | Theme | Pain point | Priority | Reviews |", "|---|---|---|---|---|"]


def backlog_markdown(ranked: DataFrame) -> DataFrame:
    """One Markdown table row per ranked pain point, as column ``line``."""
    safe_title = F.regexp_replace(F.coalesce(F.col("title"), F.lit("")), r"[|\r\n]+", " ")
    line = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ",
            F.col("backlog_rank").cast("string"),
            F.col("theme"),
            safe_title,
            F.format_string("%.1f", F.round("priority_score", 1)),
            F.col("review_count").cast("string"),
        ),
        F.lit(" |"),
    )
    return ranked.withColumn("line", line)


def write_backlog_markdown(ranked: DataFrame, path: str) -> None:
    """A folder of Markdown text per app, rows in rank order; each app starts with its own header.

    Rows are range-partitioned by app and rank, so a large backlog is written by many tasks.
    """
    header = ranked.select("app_id").distinct().select(
        "app_id", F.posexplode(F.array(*[F.lit(h) for h in MARKDOWN_HEADER])).alias("pos", "value")
    ).select("app_id", (F.col("pos") - len(MARKDOWN_HEADER)).cast("bigint").alias("place"), "value")
    rows = backlog_markdown(ranked).select(
        "app_id", F.col("backlog_rank").cast("bigint").alias("place"), F.col("line").alias("value")
    )
    (
        header.unionByName(rows)
        .repartitionByRange("app_id", "place")
        .sortWithinPartitions("app_id", "place")
        .select("app_id", "value")
        .write.mode("overwrite")
        .partitionBy("app_id")
        .text(path)
    )


def write_backlog_csv(ranked: DataFrame, path: str) -> None:
    """The ranked backlog as CSV; list columns become JSON text."""
    flat = ranked.select(
        *[
            F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
            for f in ranked.schema.fields
        ]
    )
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def evaluation_results(
    comparison: DataFrame, report: DataFrame, matrix: DataFrame, agreement: DataFrame | None = None
) -> DataFrame:
    """All evaluation tables as (kind, record) JSON rows with the time they were made."""
    parts = {"comparison": comparison, "class_report": report, "confusion_matrix": matrix}
    if agreement is not None:
        parts["agreement"] = agreement
    rows = None
    for kind, df in parts.items():
        part = df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("record"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("generated_at", F.current_timestamp())


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
