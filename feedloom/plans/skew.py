"""Joining one summary row per key onto rows whose keys may be very uneven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: into how many parts a key is dealt.
SALTS = 16


def attach(
    rows: DataFrame, summary: DataFrame, on: Sequence[str], by: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """``rows`` joined with ``summary``, which has one row per key.

    Each key is dealt into ``salts`` parts by the hash of the ``by`` columns and the summary is
    repeated per part, so a key that holds a third of all rows is joined by many tasks, and a
    following group-by on the key starts with a partial aggregation of its own.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    repeated = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
