"""Streams of requests, messages and jobs: ingest, consumption, state tables and reports.

Each batch writes under its own number, and overwrites what an attempt before left there, so a batch that runs again after a
failure leaves the same tables.  Tables of states are versions, each made from the one before and the batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidentia.operators import queue, requests

REQUEST = "request string, company_id string, source string, document_type string, request_id string, source_hint string, headers map<string,string>, metadata string, image_url string, content binary"
MESSAGE = "id string, chat string, chat_name string, from_me boolean, has_media boolean, body string, ts timestamp"


def request_stream(spark: SparkSession, path: str, schema: str = REQUEST) -> DataFrame:
    """Requests that arrive as JSON files."""
    return spark.readStream.schema(schema).json(path)


def message_stream(spark: SparkSession, path: str, ids: list[str], names: list[str], prefix: str = "!recibo") -> DataFrame:
    """Messages of allowed groups that arrive as JSON files, with their route."""
    return requests.incoming(spark.readStream.schema(MESSAGE).json(path), ids, names, prefix)


def consume(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "1500 milliseconds") -> StreamingQuery:
    """Handle batches: all that is there and end, or as it arrives."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def ingest(spark: SparkSession, folder: str, now: Callable[[], Column], valid: Column) -> Callable[[DataFrame, int], None]:
    """A handler that stores requests' assets, states and jobs.  The jobs come last: a request has a job only once the others are there; what isn't valid is rejected."""

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"id": F.substring(F.sha2(F.concat_ws(":", F.lit(number), "request"), 256), 1, 16), "ok": F.coalesce(valid, F.lit(False))})
        part = f"batch={number:012d}"
        good = rows.where("ok")
        good.select("id", "company_id", "document_type", "source", "content").write.mode("overwrite").parquet(f"{folder}/assets/{part}")
        rows.select("id", "request", F.when(F.col("ok"), "queued").otherwise("rejected").alias("status"), now().alias("updated_at")).write.mode("overwrite").parquet(f"{folder}/states/{part}")
        queue.enqueue(good.select("id"), now()).write.mode("overwrite").parquet(f"{folder}/jobs/{part}")

    return handle


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath() for s in system.listStatus(path)]
    done = [p for p in names if p.getName().startswith("version=") and system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def latest(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest whole version of a table (before a batch), empty without any."""
    have = [v for v in _versions(spark, folder) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{folder}/version={have[-1]}") if have else spark.createDataFrame([], schema)


def upsert(spark: SparkSession, folder: str, schema: str, key: str, order: str, keep: int = 3) -> Callable[[DataFrame, int], None]:
    """A handler that keeps the last row (by order) of every key in versions of a table; old versions go."""

    def handle(batch: DataFrame, number: int) -> None:
        old = latest(spark, folder, schema, number)
        both = old.unionByName(batch.select(*old.columns))
        rows = both.groupBy(key).agg(F.max_by(F.struct(*old.columns), order).alias("r")).select("r.*")
        rows.write.mode("overwrite").parquet(f"{folder}/version={number}")
        system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for v in _versions(spark, folder)[:-keep]:
            system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={v}"), True)

    return handle


def progress_events(events: DataFrame, stages: list[str]) -> DataFrame:
    """Events that tell a stage's start or end, as they arrive."""
    return events.where(F.col("stage").isin(stages) & F.col("status").isin("running", "completed")).select("job", "stage", "status", "ts")


@dataclass
class Driver:
    """What a queue, state or storage driver offers: functions by name."""

    id: str
    calls: dict[str, Callable] = field(default_factory=dict)

    def __getattr__(self, name: str) -> Callable:
        try:
            return self.__dict__["calls"][name]
        except KeyError:
            raise AttributeError(f"driver {self.__dict__.get('id')} offers no {name}") from None


class Registry:
    """Named makers of drivers and providers; each is made when first asked for."""

    def __init__(self):
        self.makers: dict[str, Callable[[], object]] = {}
        self.made: dict[str, object] = {}

    def register(self, name: str, maker: Callable[[], object]) -> None:
        self.makers[name] = maker
        self.made.pop(name, None)

    def get(self, name: str) -> object:
        if name not in self.makers:
            raise ValueError(f"not registered: {name}")
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]


@dataclass(frozen=True)
class Provider:
    """An extraction provider: whether it is available, and rows (doc) to attempts (doc, status, reason, recognised, extracted)."""

    id: str
    available: Callable[[], bool]
    extract: Callable[[DataFrame], DataFrame]


def run_providers(docs: DataFrame, providers: list[Provider], accept: Column) -> DataFrame:
    """Attempts of all documents: each provider sees those that none before it settled.  accept: over an attempt's columns."""
    left, out = docs, None
    for order, p in enumerate(providers):
        if not p.available():
            got = left.select("doc", F.lit("unavailable").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("recognised"), F.lit(None).cast("string").alias("extracted"))
        else:
            got = p.extract(left).select("doc", F.coalesce("status", F.lit("unknown")).alias("status"), "reason", "recognised", "extracted")
        got = got.withColumns({"provider": F.lit(p.id), "ord": F.lit(order)})
        out = got if out is None else out.unionByName(got)
        left = left.join(got.where(F.coalesce(accept, F.lit(False))).select("doc"), "doc", "left_anti")
    return out
