"""Small helpers the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What separates words (space, tab to carriage return), as used in every contract here.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = r"[\x20\x09-\x0D]+"
# Rows of a narrow table (a few numbers each) up to which it is sent to every executor: some tens of MB.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast only if it is counted to hold at most ``rows`` narrow rows.

    ``df`` must be cheap to count (a written table). Beyond the bound the join shuffles; the rows
    that come out are the same.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def id_hash(seed: int, *columns: Column | str) -> Column:
    """60 uniform bits from md5 of ``seed:value:...`` as a long; equal on every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])
    return hash60(text)


def hash60(text: Column) -> Column:
    """The first 60 bits of md5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
