"""A training corpus from documents: quality rules, near duplicates, benchmark overlap, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; its result is written and read again as the
next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, decontaminate, jaccard_join, pii, quality_rules
from evidentia.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio, with the columns that they had, whatever their names.

    The row number keeps the filter above the projection: pushed into it, the whole score would be computed anew for each of its uses."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    judged = quality_rules.quality_rules(rows, table(spark, sf_dir, "labels")).withColumn("number", F.monotonically_increasing_id())
    return judged.where("kept and number >= 0").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return jaccard_join.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, and n_chars of the new text."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and hashes of the ids and of their decoded text."""
    import public_tokenizers

    return bpe.digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("jaccard_join", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("pii", mask_personal),
    ("bpe", tokens),
]

#: Seeded 64-bit hashes and heap-merged BPE ids have no SQL form; tests hold run() against plain steps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
