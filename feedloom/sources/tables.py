"""Stored tables: partitioned pain points, keyed tables written as new versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.operators.upsert import evolve, new_rows
from feedloom.plans.ordering import grouped_position
from feedloom.plans.staging import stage_counting
from feedloom.schemas import PAIN_POINTS
from feedloom.sources.readers import path_exists

SLICE = ("app_id", "prompt_version")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table in today's schema; columns older files lack read as null, no table reads as empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return spark.read.schema(nullable).parquet(path)


def next_ids(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``fresh`` with ``id`` going on from the largest stored one, in key order: dense, and never shared."""
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).scalar()
    placed = grouped_position(fresh, [], [F.col(k) for k in keys], name="_place")
    return placed.withColumn("id", F.col("_place") + last).drop("_place")


def insert_new(
    spark: SparkSession, path: str, batch: DataFrame, schema: T.StructType, keys: list[str], order: list[str]
) -> int:
    """Append the rows of ``batch`` whose key is not stored, first in ``order`` wins; returns how many.

    Rows that miss a required value are skipped; a column ``id`` of the schema is numbered on. Reads
    only the key columns of the table, which has one writer at a time.
    """
    required = [f.name for f in schema.fields if not f.nullable]
    numbered = "id" in schema.names and "id" not in keys
    stored = read_table(spark, path, T.StructType([schema[k] for k in ([*keys, "id"] if numbered else keys)]))
    fresh = new_rows(stored, batch, keys, order, required)
    if numbered:
        fresh = next_ids(stored, fresh.drop("id"), keys)
    ready, inserted = stage_counting(evolve(fresh, schema), "insert")
    if inserted:
        ready.write.mode("append").parquet(path)
    return inserted


def write_version(df: DataFrame, root: str) -> str:
    """Write a merged table as a new folder under ``root`` and return its path.

    A merge reads the old version, so it never overwrites what it reads, and a failed job leaves
    the old version whole.
    """
    path = f"{root.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def create_pain_point_table(spark: SparkSession, name: str, path: str) -> None:
    """A catalog table over ``path``, partitioned by app and prompt version."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in PAIN_POINTS.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({', '.join(SLICE)}) LOCATION '{path}'"
    )


def store_pain_points(spark: SparkSession, name: str, pain_points: DataFrame, app_id: str, prompt_version: str) -> None:
    """Replace the stored pain points of one app and version; an empty input clears them.

    Overwriting a fully named partition touches no other one, and needs no rows to take effect.
    """
    columns = [f.name for f in PAIN_POINTS.fields if f.name not in SLICE]
    inside = (F.col("app_id") == app_id) & (F.col("prompt_version") == prompt_version)
    quoted = [v.replace("\\", "\\\\").replace("'", "\\'") for v in (app_id, prompt_version)]
    spark.sql(
        f"INSERT OVERWRITE {name} PARTITION (app_id = '{quoted[0]}', prompt_version = '{quoted[1]}')"
        f" SELECT {', '.join(columns)} FROM {{rows}}",
        rows=pain_points.filter(inside),
    )


def load_pain_points(spark: SparkSession, name: str, app_id: str, prompt_version: str) -> DataFrame:
    """The stored pain points of one app and version; only that partition is read."""
    return spark.table(name).filter((F.col("app_id") == app_id) & (F.col("prompt_version") == prompt_version))
