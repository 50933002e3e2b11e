"""Shared pieces of the training-data operators: words, shared folder, checkpoints."""

from __future__ import annotations

import gc
import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions sent to executors carry their code, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules["evidentia.llm"])

#: ASCII white space, which separates words.
SPACE = r"[\x20\x09-\x0D]"
SPACES = SPACE + "+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text as a string, '' for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACES, -1), "")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).  Only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found else found if found.startswith("hdfs:") else "file://" + found if found.startswith("/") else found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that written() made and that is no longer needed."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more, before more are made."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _worker() -> dict:
    """What lives as long as the Python worker, whatever task it serves."""
    return sys.modules.setdefault("_evidentia_worker", types.ModuleType("_evidentia_worker")).__dict__


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, until a task of another operator calls lean_worker()."""
    return _worker().setdefault("caches", {}).setdefault(name, {})


def lean_worker(name: str) -> None:
    """At a task's start: a worker that served another operator forgets the caches of that one, and gives memory that is free back to the system.

    Executors keep their Python workers from stage to stage, and what these hold counts beside the heap."""
    if _worker().get("serves") == name:
        return
    _worker()["serves"] = name
    for other, cache in _worker().get("caches", {}).items():
        if other != name:
            cache.clear()
    gc.collect()
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def spread(spark: SparkSession) -> int:
    """Partitions for numbered repartitions: the session's setting for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
