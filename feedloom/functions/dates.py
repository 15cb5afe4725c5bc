"""Date parsing and trailing windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the stored date format.
ISO = ("yyyy-MM-dd",)


def parse_date(text: Column, formats: Sequence[str] = ISO) -> Column:
    """First format that parses, else null; never raises."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def in_window(day: Column, as_of: Column, newest: int, oldest: int) -> Column:
    """True inside (as_of - oldest, as_of - newest]."""
    return (day > F.date_sub(as_of, oldest)) & (day <= F.date_sub(as_of, newest))
