"""Queries of date functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import dates
from evidentia.plans.base import query, table

_SAID = "CASE o_orderkey % 5 WHEN 0 THEN epoch(o_orderdate)::BIGINT::VARCHAR WHEN 1 THEN epoch_ms(o_orderdate)::VARCHAR WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE 'not a date' END"


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 5 IN (2, 3) THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') END AS iso,
  strftime(o_orderdate - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time, (o_orderdate - INTERVAL 3 HOUR)::DATE = DATE '1998-10-02' AS on_day, strftime(o_orderdate, '%Y/%m/%d') AS key_parts FROM orders""")
def dates_of_many_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of epochs and texts, ISO, local times (three hours behind), keys."""
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("timestamp")
    said = F.when(k == 0, F.unix_seconds(d).cast("string")).when(k == 1, F.unix_millis(d).cast("string")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).when(k == 3, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).otherwise("not a date")
    zone = "GMT-03:00"
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.date_only(said).alias("day"), dates.iso_date(said).alias("iso"), dates.local_date_time(d, zone).alias("local_time"), dates.on_local_date(d, "1998-10-02", zone).alias("on_day"), dates.key_parts(d).alias("key_parts"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, (l_partkey % 35)::VARCHAR AS d, (l_suppkey % 14)::VARCHAR AS m, CASE WHEN l_linenumber % 2 = 0 THEN '26' ELSE '2025' END AS y FROM lineitem),
v AS (SELECT *, try_cast(CASE WHEN y = '26' THEN '2026' ELSE y END || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS day FROM d)
SELECT l_orderkey, l_linenumber, d || '/' || m || '-' || y AS raw, strftime(day, '%d/%m/%Y') AS date, strftime(day, '%Y-%m-%d') AS iso FROM v""")
def brazilian_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with mixed separators and short years; what is no date is null."""
    y = F.when(F.col("l_linenumber") % 2 == 0, "26").otherwise("2025")
    raw = F.concat((F.col("l_partkey") % 35).cast("string"), F.lit("/"), (F.col("l_suppkey") % 14).cast("string"), F.lit("-"), y)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return rows.withColumn("d", dates.brazilian_date(F.col("raw"))).select("l_orderkey", "l_linenumber", "raw", "d.date", "d.iso")


@query("""WITH k AS (SELECT o_orderkey, lpad((o_orderkey * 7919 % 10000000)::VARCHAR, 7, '0') AS x FROM orders),
one AS (SELECT DISTINCT o_orderkey, x, unnest(list_concat([x], list_filter(list_transform(range(1, 8), lambda i: CASE WHEN x[i] = '1' THEN x[1:i - 1] || x[i + 1:] END), lambda y: y IS NOT NULL))) AS y FROM k),
two AS (SELECT DISTINCT o_orderkey, unnest(list_concat([y], list_filter(list_transform(range(1, len(y) + 1), lambda i: CASE WHEN y[i] = '1' THEN y[1:i - 1] || y[i + 1:] END), lambda z: z IS NOT NULL))) AS z FROM one)
SELECT o_orderkey, count(*) AS variants, bool_or(len(z) = 6 AND (try_cast('20' || z[5:6] || '-' || z[3:4] || '-' || z[1:2] AS DATE) IS NOT NULL OR try_cast('20' || z[1:2] || '-' || z[3:4] || '-' || z[5:6] AS DATE) IS NOT NULL)) AS date_like FROM two GROUP BY o_orderkey""")
def date_like_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits that are a date once ones read from separators go."""
    x = F.lpad((F.col("o_orderkey") * 7919 % 10000000).cast("string"), 7, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(dates.artifact_variants(x)).cast("long").alias("variants"), dates.looks_like_date(x, F.lit("")).alias("date_like"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey AS preprocess, l_suppkey AS ocr, (l_partkey + l_suppkey) AS total, epoch_ms(l_shipdate) AS ms,
  'job-' || strftime(l_shipdate, '%Y%m%d%H%M%S') || '000-' || substr(sha256(l_orderkey || ':' || l_linenumber), 1, 8) AS id FROM lineitem""")
def timings_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds of stages between marks, and ids that a repeated run gives again."""
    at = F.col("l_shipdate").cast("timestamp")
    ms = F.unix_millis(at)
    marks = {"preprocess": ms, "ocr": ms + F.col("l_partkey"), "end": ms + F.col("l_partkey") + F.col("l_suppkey")}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", dates.stage_timings(marks).alias("s"), ms.alias("ms"), dates.stamped_id("job", at, F.col("l_orderkey"), F.col("l_linenumber")).alias("id"))
    return rows.select("l_orderkey", "l_linenumber", "s.preprocess", "s.ocr", "s.total", "ms", "id")
