"""Queries of the operators that find repeated content."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.llm.common import table
from feedloom.llm.lines import without_repeats
from feedloom.llm.registry import query
from feedloom.llm.simhash import near_duplicates
from feedloom.llm.suffixes import digest_without_repeats


@query("op3_simhash_anchor_covering")
def op3_simhash_anchor_covering(spark, sf_dir):
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op6_fuzzy_lines")
def op6_fuzzy_lines(spark, sf_dir):
    """Every document with the lines taken out that an earlier similar line makes redundant."""
    kept = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), blocks=True)
    return kept.select(
        "doc_id",
        F.col("_lines_out").alias("n_removed_lines"),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_kept_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_kept_chars"),
    )


@query("op10_suffix_merge_sort")
def op10_suffix_merge_sort(spark, sf_dir):
    """Every document without the bytes that an earlier equal string of 100 bytes covers."""
    return digest_without_repeats(table(spark, sf_dir, "documents"))
