"""A job queue as a table: claims, completion, failure with retries, and states.

Jobs: id, status (queued, processing, completed, failed), attempts, max_attempts, backoff_ms, available_at, updated_at,
worker, error and next_retry_at.  Every step maps the table to the next one, so a batch that is repeated gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.dates import retry_delay_ms

STATUSES = ("queued", "processing", "completed", "failed")
JOB = "id string, status string, attempts int, max_attempts int, backoff_ms long, available_at timestamp, updated_at timestamp, worker string, error string, next_retry_at timestamp"


def enqueue(requests: DataFrame, now: Column, max_attempts: int = 3, backoff_ms: int = 5000) -> DataFrame:
    """Jobs for requests (id)."""
    values = {"status": F.lit("queued"), "attempts": F.lit(0), "max_attempts": F.lit(max_attempts), "backoff_ms": F.lit(backoff_ms).cast("long"), "available_at": now, "updated_at": now, "worker": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "next_retry_at": F.lit(None).cast("timestamp")}
    return requests.select(F.col("id").cast("string").alias("id"), *[v.alias(k) for k, v in values.items()])


def claim(jobs: DataFrame, now: Column, worker: str, most: int = 1) -> DataFrame:
    """jobs with the first ``most`` (by id) that are queued and due taken by the worker."""
    due = jobs.where((F.col("status") == "queued") & (F.coalesce("available_at", now) <= now)).select("id").orderBy("id").limit(most)
    rows = jobs.join(due.withColumn("_due", F.lit(True)), "id", "left")
    taken = F.col("_due").isNotNull()
    return rows.select(
        "id", F.when(taken, "processing").otherwise(F.col("status")).alias("status"), (F.col("attempts") + taken.cast("int")).alias("attempts"), "max_attempts", "backoff_ms", "available_at",
        F.when(taken, now).otherwise(F.col("updated_at")).alias("updated_at"), F.when(taken, F.lit(worker)).otherwise(F.col("worker")).alias("worker"), "error", "next_retry_at",
    )


def settle(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """jobs after outcomes (id, error: null for success) of those in work: completed, queued again after a delay, or failed for good."""
    rows = jobs.join(outcomes.select("id", F.col("error").alias("_error"), F.lit(True).alias("_done")), "id", "left")
    done = F.coalesce("_done", F.lit(False)) & (F.col("status") == "processing")
    good = done & F.col("_error").isNull()
    again = done & ~good & (F.col("attempts") < F.col("max_attempts"))
    wait = now + F.make_dt_interval(secs=retry_delay_ms(F.greatest(F.col("attempts"), F.lit(1)), 1000) * F.greatest(F.col("backoff_ms"), F.lit(1000)) / 1000 / 1000)
    status = F.when(good, "completed").when(again, "queued").when(done, "failed").otherwise(F.col("status"))
    return rows.select(
        "id", status.alias("status"), "attempts", "max_attempts", "backoff_ms", F.when(again, wait).otherwise(F.col("available_at")).alias("available_at"), F.when(done, now).otherwise(F.col("updated_at")).alias("updated_at"), "worker",
        F.when(good, None).when(done, F.col("_error")).otherwise(F.col("error")).alias("error"), F.when(again, wait).otherwise(F.col("next_retry_at")).alias("next_retry_at"),
    )


def located(stores: DataFrame, order: tuple[str, ...] = STATUSES) -> DataFrame:
    """One row an id of those in several status stores: the first status in order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    return stores.where(place > 0).groupBy("id").agg(F.min_by(F.struct(*stores.columns), place).alias("r")).select("r.*")


def with_queue(states: DataFrame, jobs: DataFrame) -> DataFrame:
    """States with what the queue knows of them, if anything."""
    return states.join(jobs.select(F.col("id").alias("job_id"), F.col("status").alias("queue_status"), "attempts", "available_at"), "job_id", "left")


def merged(patches: DataFrame, job: str, seq: str, kept: list[str], nested: list[str]) -> DataFrame:
    """States from patches in order.  Each patch has a map ``given`` of the names that it holds: a name that is absent changes nothing, one
    that is null clears ``kept`` columns; ``nested`` maps are merged a key at a time."""
    last = lambda c: F.max_by(F.col(c), F.when(F.array_contains("given", c), F.col(seq)))
    rows = patches.groupBy(job).agg(*[last(c).alias(c) for c in kept], F.count("*").alias("patches"))
    for c in nested:
        entries = patches.select(job, seq, F.explode(c).alias("k", "v")).groupBy(job, "k").agg(F.max_by("v", seq).alias("v"))
        whole = entries.groupBy(job).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(c))
        rows = rows.join(whole, job, "left")
    return rows


def error_payload(error: Column, message: Column, name: Column) -> Column:
    """(message, name) of an error, which may be a text alone; null without any."""
    plain = F.coalesce(error, F.lit("")) != ""
    other = message.isNotNull() | name.isNotNull()
    # fixed values: what stands for a missing message and name
    whole = F.struct(F.when(plain, error).otherwise(F.coalesce(F.nullif(message, F.lit("")), F.lit("Erro desconhecido."))).alias("message"), F.when(~plain, F.coalesce(F.nullif(name, F.lit("")), F.lit("Error"))).alias("name"))
    return F.when(plain | other, whole)


def due_maintenance(last_run: Column, now: Column, interval_ms: int) -> Column:
    """Whether the interval since the last run has passed; never run: yes."""
    return last_run.isNull() | (F.unix_millis(now) - F.unix_millis(last_run) >= interval_ms)


def progress(events: DataFrame, job: str, seq: str, stages: list[str]) -> DataFrame:
    """Of each job: the last status of every stage (pending without any), how many are completed, and the stage in work."""
    last = [F.coalesce(F.max_by(F.when(F.col("stage") == s, F.col("status")), F.when(F.col("stage") == s, F.col(seq))), F.lit("pending")).alias(s) for s in stages]
    rows = events.groupBy(job).agg(*last)
    done = sum(((F.col(s) == "completed").cast("int") for s in stages), F.lit(0))
    running = F.get(F.array_compact(F.array(*[F.when(F.col(s) == "running", s) for s in stages])), F.lit(0))
    return rows.withColumns({"completed_stages": done, "running_stage": running})
