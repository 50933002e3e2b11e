"""Business keys: candidates from text, consensus over evidence, lookup and rescue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidates(evidence: DataFrame, doc: str, text: str, digits: int = 7) -> DataFrame:
    """A row for every run of exactly so many digits in a text: key and its order."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(?<![0-9])([0-9]{{{digits}}})(?![0-9])"), F.lit(1))
    return evidence.select("*", F.posexplode(found).alias("ord", "key"))


def consensus(found: DataFrame, doc: str) -> DataFrame:
    """Per document and key: greatest confidence, evidence count, distinct sources, and the rank: confidence and support falling, key rising."""
    keys = found.groupBy(doc, "key").agg(F.max("confidence").alias("confidence"), F.count("*").alias("support"), F.count_distinct("source").alias("sources"))
    w = Window.partitionBy(doc).orderBy(F.desc("confidence"), F.desc("sources"), F.desc("support"), "key")
    return keys.withColumn("rank", F.row_number().over(w))


def lookup(keys: DataFrame, reference: DataFrame, key: str = "key") -> DataFrame:
    """Left join with a reason: missing key, found or not found.  The reference has one row a key."""
    out = keys.join(reference, key, "left")
    reason = F.when(F.coalesce(F.col(key), F.lit("")) == "", "missing_invoice_number").when(F.col("found"), "invoice_found").otherwise("invoice_not_found")
    return out.withColumn("reason", reason).withColumn("found", F.coalesce("found", F.lit(False)))


def neighbours(key: Column, digits: int = 7) -> Column:
    """Distinct keys one adjacent swap, or one 8 for 5 or 5 for 8, away."""
    at = lambda i: F.substring(key, i, 1)
    around = lambda i, n, mid: F.concat(F.substring(key, 1, i - 1), mid, F.substring(key, i + n, digits))
    swaps = [around(i, 2, F.concat(at(i + 1), at(i))) for i in range(1, digits)]
    mixed = [around(i, 1, F.translate(at(i), "85", "58")) for i in range(1, digits + 1)]
    return F.array_except(F.array(*swaps, *mixed), F.array(key))


def unique_rescue(missing: DataFrame, reference: DataFrame, doc: str, digits: int = 7) -> DataFrame:
    """doc and rescued key where exactly one neighbour of its keys is in the reference."""
    near = missing.select(doc, F.explode(neighbours(F.col("key"), digits)).alias("key")).distinct()
    hits = near.join(reference.select("key"), "key", "left_semi")
    return hits.groupBy(doc).agg(F.count("*").alias("n"), F.min("key").alias("rescued")).where("n = 1").drop("n")


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row a key, the first in the order.  Each task keeps one row a key before the shuffle (Spark's limit of window groups), so a hot key is no load."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_i = 1").drop("_i")


def unseen(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: the rows whose key isn't in the report yet."""
    return rows.join(done.select(key), key, "left_anti")


def deduplicate_open(alerts: DataFrame, key: str, *order: Column) -> DataFrame:
    """One alert a non-empty dedupe key, and all without one."""
    some = F.coalesce(F.col(key), F.lit("")) != ""
    return latest(alerts.where(some), [key], *order).unionByName(alerts.where(~some))
