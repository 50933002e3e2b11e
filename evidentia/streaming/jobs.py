"""Job states over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_states(events: DataFrame, job: str, kind: str, ts: str) -> DataFrame:
    """Last status, number of events and last change of every job; for update or complete mode."""
    return events.groupBy(job).agg(F.max_by(kind, ts).alias("status"), F.count("*").alias("events"), F.max(ts).alias("updated_at"))


def windowed_counts(events: DataFrame, ts: str, kind: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by kind and window; late ones within the watermark count."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))
