"""Following pointers to their end by repeated doubling: a logarithmic number of joins for any forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.plans.staging import stage, stage_counting


def follow(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, parent) of a forest whose roots point to themselves -> (node, root).

    Two doublings per written step; the second one also tells whether anything still moves. Many
    nodes may share a parent; the joined side has one row per node, so a hot parent is a skewed
    probe side of a join that is written at once, which adaptive execution splits.
    """
    current = stage(links.select("node", "parent"), name)
    while True:
        once = _jump(current)
        twice = _jump(once.select("node", "parent"))
        current, moved = stage_counting(twice, name, F.col("moved"))
        current = current.select("node", "parent")
        if moved == 0:
            return current.withColumnRenamed("parent", "root")


def _jump(links: DataFrame) -> DataFrame:
    up = links.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
    return links.join(up, "parent").select(
        "node", F.col("_up").alias("parent"), (F.col("_up") != F.col("parent")).alias("moved")
    )


def topmost(links: DataFrame, name: str = "topmost") -> DataFrame:
    """(node, parent or null, label or null) -> (node, label): the label found nearest the root.

    Each node's own label applies when none above it has one.
    """
    unfinished = F.col("parent").isNotNull()
    current, open_links = stage_counting(links.select("node", "parent", "label"), name, unfinished)
    while open_links:
        up = current.select(F.col("node").alias("parent"), F.col("parent").alias("_up"), F.col("label").alias("_label"))
        current, open_links = stage_counting(
            current.join(up, "parent", "left").select(
                "node", F.col("_up").alias("parent"), F.coalesce("_label", "label").alias("label")
            ),
            name,
            unfinished,
        )
    return current.select("node", "label")
