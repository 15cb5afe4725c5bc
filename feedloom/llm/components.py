"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.plans.links import follow
from feedloom.plans.staging import stage, stage_counting


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Links between long ids -> (node, root): root is the smallest id reachable. Unlinked ids do not occur.

    Every round each node hooks to its smallest neighbour, pointers are followed to their roots by
    doubling, and links are contracted to roots; rounds and doublings are logarithmic. A hub that
    holds a third of all links is folded by partial aggregation and joined as the probe side.
    """
    x, y = F.greatest(a, b).alias("x"), F.least(a, b).alias("y")
    links, open_links = stage_counting(edges.select(x, y).filter("x != y").distinct(), "links")
    labels = None
    while open_links:
        hooks = links.select(F.col("x").alias("node"), F.col("y").alias("parent")).union(links.select("y", "y"))
        roots = follow(hooks.groupBy("node").agg(F.min("parent").alias("parent")), "roots")
        if labels is None:
            labels = roots
        else:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            labels = stage(labels.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")), "labels")
        of_x = roots.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        of_y = roots.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        merged = links.join(of_x, "x").join(of_y, "y").filter("rx != ry")
        links, open_links = stage_counting(
            merged.select(F.greatest("rx", "ry").alias("x"), F.least("rx", "ry").alias("y")).distinct(), "links"
        )
    if labels is None:
        return links.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return labels
