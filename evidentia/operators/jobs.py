"""Job states from events: fold, retention, and batch reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_events(events: DataFrame, job: str, seq: str, kind: str, ts: str, keep: int = 40) -> DataFrame:
    """Per job: last status, first and last time, number of events and the latest ``keep`` of their kinds, oldest first.

    The tails are kept by a window of ``keep`` rows, so a job of any number of events needs no long list."""
    from pyspark.sql import Window

    w = Window.partitionBy(job).orderBy(F.desc(seq))
    tail = events.select(job, seq, kind, F.row_number().over(w).alias("_i")).where(F.col("_i") <= keep)
    tail = tail.groupBy(job).agg(F.transform(F.sort_array(F.collect_list(F.struct(seq, kind))), lambda x: x[kind]).alias("tail"))
    state = events.groupBy(job).agg(F.max_by(kind, seq).alias("status"), F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"), F.count("*").alias("events"))
    return state.join(tail, job)


def expired(states: DataFrame, updated: str, now: str, hours: int) -> DataFrame:
    """States whose last change is over so many hours before now."""
    return states.where(F.col(updated) < F.to_timestamp(F.lit(now)) - F.make_interval(hours=F.lit(hours)))


def report(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Counts, share of all (4 digits), mean and greatest value by class."""
    from pyspark.sql import Window

    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(value), 2).alias("mean_value"), F.max(value).alias("max_value"))
    # the window holds a row for each class
    return out.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))
