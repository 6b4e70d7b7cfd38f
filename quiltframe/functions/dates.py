"""Times as text and their age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The time that an ISO text tells; the first of all times if it tells none."""
    return F.coalesce(F.try_to_timestamp(text).cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def recent(at: Column, now: Column, days: int) -> Column:
    """Whether ``at`` is at most ``days`` days before ``now``."""
    return at >= now - F.make_dt_interval(F.lit(days))
