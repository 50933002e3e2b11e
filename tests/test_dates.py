"""Digits of dates against their SQL and plain Python."""

from oracle import connect, same
from pyspark.sql import functions as F

from evidentia.functions import dates
from evidentia.plans import catalog


def test_artifact_variants(spark):
    """The digits themselves stay, all ones too."""

    def drop(d):
        return {d[:i] + d[i + 1 :] for i, c in enumerate(d) if c == "1"}

    said = ["1" * n for n in range(9)] + ["2010326", "1010111", "1112131", "9999999", "0", "11a1"]
    for r in spark.createDataFrame([(d,) for d in said], "d string").select("d", dates.artifact_variants(F.col("d")).alias("v")).collect():
        want = {r.d} | drop(r.d) | {z for y in drop(r.d) for z in drop(y)}
        assert sorted(r.v) == sorted(want - {""})
    got = spark.createDataFrame([("111111",), ("11111111",), ("11111",), (None,)], "d string").select(dates.looks_like_date(F.col("d"), F.lit("")).alias("x")).collect()
    assert [r.x for r in got] == [True, True, False, False]


def test_date_like_digits_of_ones(spark, tmp_path):
    """3331369 * 7919 ends in 1111111."""
    spark.sql("SELECT explode(sequence(3331360L, 3331380L)) AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    con = connect("/root/testdata/sf0.01")
    con.execute(f"create or replace view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    df = catalog.QUERIES["date_like_digits"](spark, str(tmp_path))
    same(df, catalog.ORACLE_SQL["date_like_digits"], con)
    assert df.where("o_orderkey = 3331369").first()["variants"] == 3
