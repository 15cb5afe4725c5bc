"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.llm.common import table
from feedloom.llm.hash_forest import nearest
from feedloom.llm.registry import query


@query("op8_hash_prefix_forest")
def op8_hash_prefix_forest(spark, sf_dir):
    """The 10 nearest neighbours found for every hundredth vector, among all others."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
