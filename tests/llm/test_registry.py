"""Registered queries on the driver's small table: SQL where there is some, counts and planted cases elsewhere."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import connect, same  # noqa: E402

from evidentia.llm import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], connect(SF))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"op9_decontaminate"}))
def test_one_row_each(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = registry.QUERIES[name](spark, SF).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pipeline(spark):
    import corpus_pipeline

    from evidentia.llm import jaccard_join, quality_rules
    from evidentia.llm.common import table

    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    good = {r.doc_id for r in quality_rules.quality_rules(docs, table(spark, SF, "labels")).where("kept").collect()}
    assert set(got) <= good
    kept = docs.where(docs.doc_id.isin(list(good)))
    groups = {}
    for r in jaccard_join.join_components(kept).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    leaks = {r.doc_id for r in registry.decontaminate.overlaps(kept, table(spark, SF, "benchmark")).collect()}
    assert set(got) == set(groups) - leaks
