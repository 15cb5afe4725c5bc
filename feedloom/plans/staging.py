"""Cutting lineage through a table written to shared storage.

Iterative operators and operators that read the same non-repeatable layout twice write
their intermediate result to the folder the cluster names in ``spark.checkpoint.dir``
and go on from the files, so a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def staging_root(spark: SparkSession) -> str:
    """The shared folder from the session; a temporary one only for a local session."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder all executors can reach")
    # One machine is driver and executor here; the folder goes when the process ends.
    root = tempfile.mkdtemp(prefix="feedloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set(_SETTING, root)
    return root


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path under the staging root."""
    return f"{staging_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a new table under the staging root and return a scan of it; ``codec`` for tables of texts."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counting(df: DataFrame, name: str, condition: Column | None = None) -> tuple[DataFrame, int]:
    """As ``stage``, with the number of rows (where ``condition`` holds) counted during the write."""
    counted = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    seen = Observation()
    staged = stage(df.observe(seen, counted.alias("n")), name)
    try:
        return staged, seen.get["n"]
    except Py4JJavaError:
        # A plan that is empty by construction may lose its observer.
        return staged, staged.agg(counted.alias("n")).first()["n"]
