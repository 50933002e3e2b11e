"""The register of queries, and pieces of SQL that several share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noise(x: str) -> str:
    """Noise repaired, in SQL."""
    return f"trim(regexp_replace(translate({x}, '“”‘’`´–—[]{{}}|¦•·º°', '\"\"''''''''--1111II..oo'), '\\s+', ' ', 'g'))"


def search(x: str) -> str:
    """The searchable text, in SQL."""
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({noise(x)})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def r2(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"


def r4(x: str) -> str:
    return f"(floor(({x}) * 10000 + 0.5) / 10000)"
