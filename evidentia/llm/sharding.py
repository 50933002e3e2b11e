"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly by seeded hashes: a record's shard is the highest of the rendezvous hashes of
(seed, doc_id, shard), so one more shard only takes records into itself (the law ``key``); within a shard a second
seeded hash, of doc_id and text, gives a bucket of about ``bucket_bytes``, so that a bucket fits in memory at every size
and rows of one doc_id, or without any, are dealt out too.  Pass two puts
a bucket in a fixed order, applies a seeded Fisher-Yates shuffle (Spark's ``shuffle``) and writes it.  Slots number
a shard's buckets one after the other.  Both passes are DataFrame code.

Defined results: a null text has size 1 and crc32 of '' (0); repeated rows get slots of their own; a null doc_id is hashed as the
empty key; a very long text is a record like any other; an empty table gives no rows; other columns are carried into
the shards unchanged (names that begin with '_s_' are reserved), and ``shard`` returns them but for those named like its
results, which give way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import fresh_path, text_of

SHARDS, SEED, BUCKET_BYTES = 16, 20240607, 8 << 20
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hash: the shard with the highest hash of (seed, key, shard)."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    return F.greatest(*[F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)])["s"]


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write docs under path (Parquet, folders by shard) and return what was written with shard, bucket and place."""
    sizes = docs.select((F.octet_length(text_of()) + 1).cast("long").alias("b")).agg(F.sum("b"), F.count("*"), F.max("b")).first()
    total, rows = sizes[0] or 0, sizes[1] or 0
    buckets = max(1, math.ceil(total / shards / bucket_bytes))
    own = [c for c in docs.columns]
    record = F.struct(*[F.col(c) for c in own])
    place = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    scattered = docs.select(
        shard_of(F.col("doc_id"), shards, seed).alias("_s_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), place, text_of()), F.lit(buckets)).cast("int").alias("_s_bucket"),
        F.struct(F.xxhash64(F.lit(seed + 2), place).alias("o"), F.xxhash64(text_of()).alias("t"), record.alias("r")).alias("_s_row"),
    ).repartition(max(1, shards * buckets), "_s_shard", "_s_bucket")
    # the hash of the place in front gives the fixed order that the seeded shuffle starts from
    held = scattered.groupBy("_s_shard", "_s_bucket").agg(F.sort_array(F.collect_list("_s_row")).alias("_s_rows"))
    held = held.sortWithinPartitions("_s_shard", "_s_bucket").select("_s_shard", "_s_bucket", F.shuffle("_s_rows", F.lit(seed)).alias("_s_rows"))
    flat = held.select("_s_shard", "_s_bucket", F.posexplode("_s_rows").alias("_s_place", "_s_row"))
    flat.select("_s_shard", "_s_bucket", "_s_place", "_s_row.r.*").write.partitionBy("_s_shard").parquet(path)
    from pyspark.sql.types import IntegerType, StructField, StructType

    head = [StructField(c, IntegerType()) for c in ("_s_bucket", "_s_place")]
    schema = StructType([*head, *docs.schema.fields, StructField("_s_shard", IntegerType())])
    return docs.sparkSession.read.schema(schema).parquet(path)


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """The written records with size, text_crc32, law, shard, slot and grown_shard."""
    from pyspark.sql import Window

    back = write_shards(docs, path or fresh_path(docs.sparkSession, "shards"), shards, seed, bucket_bytes)
    counts = back.groupBy("_s_shard", "_s_bucket").agg(F.count("*").alias("_s_n"))
    before = F.sum("_s_n").over(Window.partitionBy("_s_shard").orderBy("_s_bucket")) - F.col("_s_n")
    counts = counts.select("_s_shard", "_s_bucket", before.alias("_s_before"))
    # before the join, so that a caller who needs no text moves none
    back = back.withColumns({"_s_size": (F.octet_length(text_of()) + 1).cast("long"), "_s_crc": F.crc32(text_of().cast("binary")).cast("long")})
    out = back.join(counts, ["_s_shard", "_s_bucket"])
    return out.select(
        *[c for c in docs.columns if c.lower() not in RESULTS],
        F.col("_s_size").alias("size"),
        F.col("_s_crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_s_shard").alias("shard"),
        (F.col("_s_before") + F.col("_s_place")).cast("long").alias("slot"),
        shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
    )
