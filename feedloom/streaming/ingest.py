"""Incremental ingest: new dump files are cleaned and only unseen reviews are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.functions.dates import parse_date
from feedloom.operators.cleaning import add_cleaned_text
from feedloom.schemas import REVIEWS
from feedloom.sources.readers import DUMP_SCHEMA, normalize_dump
from feedloom.sources.store import Store
from feedloom.sources.tables import insert_new

KEYS = ["app_id", "review_id"]


def append_new(batch: DataFrame, table_path: str) -> int:
    """Append the rows whose (app_id, review_id) is not stored; first in the batch wins.

    A repeated batch finds its own rows stored and adds nothing.
    """
    return insert_new(batch.sparkSession, table_path, batch, REVIEWS, KEYS, ["_row"])


def store_batch(batch: DataFrame, number: int, root: str, stream: str, clean: Callable[[DataFrame], DataFrame]) -> int:
    """Clean and store one batch of a stream exactly once; returns how many rows are new."""
    target = Store(batch.sparkSession, root)
    if target.seen(stream, number):
        return 0
    added = target.insert("reviews", clean(batch), REVIEWS, KEYS, ["_row"])
    target.commit(**{stream: number})
    return added


def normalize_only(batch: DataFrame) -> DataFrame:
    """Cleaned text and typed dates, no rows dropped."""
    return add_cleaned_text(batch).withColumn("review_date", parse_date(F.col("review_date")))


def ingest_stream(
    spark: SparkSession,
    dump_path: str,
    table_path: str,
    progress_path: str,
    app_id: str,
    app_name: str,
    clean: Callable[[DataFrame], DataFrame] | None = None,
    max_files: int | None = None,
    into_store: bool = False,
) -> StreamingQuery:
    """Process every dump file not seen before, then stop; run it again for later files.

    ``clean`` is applied to each micro-batch, whose input order is the column ``_row``: older files
    first, then by path and place in the file. Without it texts and dates are only normalised.

    With ``into_store`` the folder ``table_path`` is a store: rows and the number of the batch become visible in one
    commit, so a batch delivered again after a failure adds nothing and is not even cleaned again. The
    stream is known in the ledger by its progress folder.
    """
    source = spark.readStream.schema(DUMP_SCHEMA)
    if max_files is not None:
        source = source.option("maxFilesPerTrigger", max_files)
    read = source.json(dump_path)
    placed = F.struct(
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    raw = normalize_dump(read.withColumn("_place", placed), app_id, app_name, ["_place"])

    def store(batch: DataFrame, number: int) -> None:
        # Row numbers grow within a block; between blocks the file decides, however Spark packs its tasks.
        ordered = batch.withColumn(
            "_row", F.struct("_place.time", "_place.file", "_place.start", F.monotonically_increasing_id().alias("row"))
        ).drop("_place")
        if into_store:
            store_batch(ordered, number, table_path, progress_path, clean or normalize_only)
        else:
            append_new((clean or normalize_only)(ordered), table_path)

    return (
        raw.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", progress_path)
        .foreachBatch(store)
        .start()
    )
