"""Queries of reports, evaluation, queues and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import queue, reports
from evidentia.plans.base import query, r2, table

_K = "o_orderkey"
#: Results made from orders.
_RESULT = {
    "status": f"CASE {_K} % 7 WHEN 0 THEN 'error' WHEN 1 THEN NULL ELSE 'processed' END", "number": f"CASE WHEN {_K} % 5 <> 0 THEN lpad(CAST({_K} AS STRING), 7, '0') END", "lookup_found": f"CASE {_K} % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END",
    "class": f"CASE {_K} % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'review' WHEN 2 THEN 'invalid' END", "used_fallback": f"{_K} % 6 = 0", "confidence": f"({_K} % 101) / 100.0e0", "total_ms": f"CASE WHEN {_K} % 9 <> 0 THEN {_K} * 7919 % 100003 END",
    "origin": f"CASE WHEN {_K} % 2 = 0 THEN 'roi' ELSE 'support' END", "on_day": f"{_K} % 8 <> 0", "has_media": f"{_K} % 3 <> 1",
}
_R = "r AS (SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in _RESULT.items()) + " FROM orders)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("*", *[F.expr(sql).alias(name) for name, sql in _RESULT.items()])


def _c(holds: str) -> str:
    return f"count(*) FILTER ({holds})"


_DONE = "status = 'processed'"


@query(f"""WITH {_R}, g AS (SELECT o_orderpriority, count(*) AS total, {_c(_DONE)} AS processed, {_c("status = 'error'")} AS errors, {_c(_DONE + ' AND number IS NOT NULL')} AS detected, {_c(_DONE + ' AND lookup_found')} AS lookup_found, {_c(_DONE + ' AND NOT lookup_found')} AS lookup_missing,
  {_c(_DONE + " AND class = 'valid'")} AS valid, {_c(_DONE + " AND class = 'review'")} AS review, {_c(_DONE + " AND class = 'invalid'")} AS invalid, {_c(_DONE + " AND (number IS NULL OR coalesce(NOT lookup_found, false) OR coalesce(class, '') <> 'valid')")} AS legacy_candidates, {_c(_DONE + ' AND used_fallback')} AS fallback_used FROM r GROUP BY 1)
SELECT *, round(processed / total, 4) AS completion_rate, round(detected / processed, 4) AS detection_rate FROM g""")
def pass_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates of a pass over results."""
    return reports.report(results(spark, sf_dir), ["o_orderpriority"])


@query(f"""WITH {_R} SELECT o_orderstatus, count(*) AS total, {_c(_DONE)} AS processed, {_c("status = 'error'")} AS error FROM r GROUP BY 1""")
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(results(spark, sf_dir), ["processed", "error"], ["o_orderstatus"])


_SEEN = "on_day AND has_media"


@query(f"""WITH {_R}, m AS (SELECT *, CASE {_K} % 4 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'analyzed' WHEN 2 THEN 'analysis_failed' ELSE 'ignored_non_image_or_download_failed' END AS st FROM r)
SELECT o_orderpriority, count(*) AS fetched, {_c('on_day')} AS of_day, {_c(_SEEN)} AS images, {_c(_SEEN + f' AND {_K} % 4 < 3')} AS downloaded, {_c(_SEEN + f' AND {_K} % 4 = 1')} AS analyzed, {_c(_SEEN + f' AND {_K} % 4 = 2')} AS analysis_failed, {_c(_SEEN + f' AND {_K} % 4 = 3')} AS ignored,
  {_c(_SEEN + ' AND number IS NOT NULL')} AS detected, {_c(_SEEN + f' AND {_K} % 4 = 0')} AS valid, {_c(_SEEN + f' AND {_K} % 4 = 1')} AS review, {_c(_SEEN + f' AND {_K} % 4 = 2')} AS invalid FROM m GROUP BY 1""")
def recovery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of a day's messages."""
    k = F.col(_K) % 4
    status = F.when(k == 0, "downloaded").when(k == 1, "analyzed").when(k == 2, "analysis_failed").otherwise("ignored_non_image_or_download_failed")
    return reports.recovery_report(results(spark, sf_dir).withColumn("status", status), ["o_orderpriority"])


_OK = f"{_K} % 5 <> 3"


@query(f"""WITH {_R}, i AS (SELECT *, 'img' || {_K} AS name, {_OK} AS ok, CASE {_K} % 3 WHEN 0 THEN NULL ELSE {_K} % 3 = 1 END AS matches, CASE WHEN {_OK} AND coalesce(total_ms, 0) > 0 THEN total_ms END AS ms FROM r)
SELECT o_orderpriority, count(*) AS total, {_c('ok')} AS succeeded, {_c('NOT ok')} AS failed, {_c("class = 'valid'")} AS valid, {_c("class = 'review'")} AS review, {_c("class = 'invalid'")} AS invalid, {_c('number IS NOT NULL')} AS detected, {_c('coalesce(matches, true) AND number IS NOT NULL')} AS matched, {_c('NOT matches')} AS mismatched,
  {_c("number IS NOT NULL AND origin = 'roi'")} AS from_region, {_c('number IS NOT NULL AND used_fallback')} AS from_fallback, {_c('lookup_found')} AS confirmed, {_c('has_media')} AS template_matched, coalesce(floor(avg(ms) + 0.5), 0)::BIGINT AS mean_ms, max(ms) AS slowest_ms, round({_c('number IS NOT NULL')} / count(*), 4) AS detection_rate FROM i GROUP BY 1""")
def run_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over files with expected numbers."""
    k = F.col(_K)
    rows = results(spark, sf_dir).withColumns({"name": F.concat(F.lit("img"), k), "status": F.when(k % 5 != 3, "stage_10_completed").otherwise("failed"), "matches": F.when(k % 3 != 0, k % 3 == 1), "confirmed": F.col("lookup_found"), "template_matched": F.col("has_media")})
    return reports.run_report(rows, ["o_orderpriority"]).drop("slowest")


@query(f"""WITH {_R}, m AS (SELECT o_custkey, max(total_ms) AS slowest_ms FROM r WHERE total_ms > 0 GROUP BY 1) SELECT o_custkey, slowest_ms, list_contains(list({_K}), 0) AND false AS never FROM m JOIN r USING (o_custkey) WHERE total_ms = slowest_ms GROUP BY ALL""")
def slowest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slowest of each customer's items; that it has that time is checked here, since equals may differ."""
    rows = results(spark, sf_dir).withColumns({"name": F.col(_K).cast("string"), "status": F.lit("stage_10_completed"), "matches": F.lit(None).cast("boolean"), "confirmed": F.lit(False), "template_matched": F.lit(False)})
    slow = reports.run_report(rows, ["o_custkey"]).where("slowest is not null").select("o_custkey", "slowest_ms", "slowest")
    back = rows.select(F.col("name").alias("slowest"), F.col("total_ms").alias("_ms"))
    return slow.join(back, "slowest").select("o_custkey", "slowest_ms", (F.col("_ms") != F.col("slowest_ms")).alias("never"))


@query(f"""WITH o AS (SELECT lpad(({_K} % 1000)::VARCHAR, 7, '0') AS file, CASE WHEN {_K} % 2 = 0 THEN lpad(({_K} % 1000)::VARCHAR, 7, '0') ELSE '1' END AS number, {_K} FROM orders)
SELECT {_K}, CASE {_K} % 3 WHEN 0 THEN NULL ELSE {_K} % 2 = 0 END AS matches FROM o""")
def expected_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether numbers are what the files' names expect."""
    k = F.col(_K)
    key = F.lpad((k % 1000).cast("string"), 7, "0")
    return table(spark, sf_dir, "orders").select(_K, reports.matches_expected(F.when(k % 3 == 0, "x.jpg").otherwise(F.concat(key, F.lit(".jpg"))), F.when(k % 2 == 0, key).otherwise("1")).alias("matches"))


@query(f"""WITH {_R}, k AS (SELECT *, CASE {_K} % 4 WHEN 0 THEN '' WHEN 1 THEN 'f' || o_custkey ELSE 'm' || o_custkey END AS key FROM r),
n AS (SELECT key, max({_K}) AS v FROM k WHERE {_K} % 2 = 1 AND key <> '' GROUP BY key), o AS (SELECT key, min({_K}) AS v FROM k WHERE {_K} % 2 = 0 AND key <> '' GROUP BY key)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE key NOT IN (SELECT key FROM n)""")
def upserted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New results over old ones by message or file; those without a key go."""
    k = F.col(_K)
    rows = results(spark, sf_dir).withColumn("key", reports.result_key(F.when(k % 4 > 1, F.concat(F.lit("m"), "o_custkey")), F.when(k % 4 == 1, F.concat(F.lit(" f"), "o_custkey"))))
    new, old = rows.where(k % 2 == 1).groupBy("key").agg(F.max(k).alias("v")), rows.where(k % 2 == 0).groupBy("key").agg(F.min(k).alias("v"))
    return reports.keep_last(old, new, "key")


@query(f"""WITH {_R} SELECT {_K}, number, CASE WHEN number IN (SELECT lpad(l_orderkey::VARCHAR, 7, '0') FROM lineitem WHERE l_returnflag = 'R') THEN 'already_exists' ELSE 'imported' END AS outcome FROM r WHERE {_DONE} AND number IS NOT NULL AND lookup_found AND confidence >= 0.5""")
def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results sure enough to import, and which are there already."""
    have = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.lpad(F.col("l_orderkey").cast("string"), 7, "0").alias("number"))
    return reports.imported(reports.importable(results(spark, sf_dir), 0.5), have).select(_K, "number", "outcome")


@query(f"""WITH a AS (SELECT l_orderkey, list(l_discount * 10 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS cs, count(*) AS n, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS fs FROM lineitem GROUP BY 1)
SELECT l_orderkey, {r2('list_reduce(cs, lambda x, y: x + y) / n')} AS mean, n > 1 AS fallback_used, n AS attempts, array_to_string(fs[1:2], ',') AS first_reasons, array_to_string(list_filter(list_concat(fs, ['A', 'Z']), lambda x, i: list_position(list_concat(fs, ['A', 'Z']), x) = i), ',') AS reasons FROM a""")
def result_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of lines, attempts, and distinct reasons in order."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag"))).alias("r"))
    flags = F.transform("r", lambda x: x["l_returnflag"])
    s = reports.result_summary(F.col("r"), flags, 2)
    rows = rows.select("l_orderkey", reports.mean_confidence(F.transform("r", lambda x: x["l_discount"] * 10)).alias("mean"), s.alias("s"), reports.reasons_union(flags, F.array(F.lit("A"), F.lit("Z"), F.lit(""))).alias("u"))
    return rows.select("l_orderkey", "mean", "s.fallback_used", F.col("s.attempts").cast("long").alias("attempts"), F.array_join("s.reasons", ",").alias("first_reasons"), F.array_join("u", ",").alias("reasons"))


@query(f"""SELECT {_K}, CASE WHEN {_K} % 3 = 0 OR {_K} % 2 = 0 THEN {r2(f'(0e0 + ({_K} % 101) / 100e0 + ({_K} * 3 % 101) / 100e0) / 2')} ELSE 0e0 END AS average,
  {_K} % 11 <> 0 AND ({_K} % 5 = 0 OR {_K} % 7 = 0 OR {_K} % 4 = 0) AS retry, CASE WHEN {_K} % 6 = 0 THEN 'first' WHEN {_K} % 6 = 1 THEN 'again' WHEN {_K} * 3 % 101 > {_K} % 101 THEN 'again' ELSE 'first' END AS preferred FROM orders""")
def second_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of fields, who is analysed again, and which analysis counts."""
    k = F.col(_K)
    a, b = (k % 101) / 100, (k * 3 % 101) / 100
    first, again = (F.struct(F.lit(i).alias("name"), nf.alias("nf"), c.alias("score")) for i, nf, c in (("first", F.lit("x"), a), ("again", F.when(k % 6 == 1, "y"), b)))
    number, found = F.when(k % 5 != 0, "n"), F.when(k % 7 != 0, F.lit(True))
    return table(spark, sf_dir, "orders").select(_K, reports.field_average({"x": (k % 3 == 0, a), "y": (k % 2 == 0, b)}).alias("average"), reports.should_retry(number, found, k % 4 == 0, k % 11 == 0).alias("retry"), reports.preferred(first, F.when(k % 6 != 0, again))["name"].alias("preferred"))


@query("""WITH e AS (SELECT l_orderkey AS doc, 'o' || (l_suppkey % 4) AS orientation, max(l_tax) > 0.05 AS matched, max(l_quantity) AS score, max(l_discount) AS nf_conf FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY matched DESC, score DESC, nf_conf DESC, orientation) AS rank FROM e) SELECT * FROM r WHERE rank <= 2""")
def orientation_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best orientations of each document."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.concat(F.lit("o"), F.col("l_suppkey") % 4).alias("orientation")).agg((F.max("l_tax") > 0.05).alias("matched"), F.max("l_quantity").alias("score"), F.max("l_discount").alias("nf_conf"))
    return reports.top_orientations(rows, "doc", 2)


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS ord, 's' || l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'upright' ELSE 'left' END AS orientation FROM lineitem)
SELECT doc, orientation, string_agg(id, ',' ORDER BY ord) AS ids, count(*) AS n FROM e GROUP BY ALL""")
def orientation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by orientation; without one it is unknown."""
    i = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), i.alias("ord"), F.concat(F.lit("s"), i).alias("id"), F.when(i % 3 == 1, "upright").when(i % 3 == 2, "left").otherwise(" ").alias("orientation")).distinct()
    return reports.grouped_evidence(rows, "doc").withColumn("ids", F.array_join("ids", ",")).withColumn("n", F.col("n").cast("long"))


@query("""WITH a AS (SELECT l_orderkey AS doc, l_linenumber AS ord, 'i' || (l_partkey % 3) AS id, l_returnflag AS text, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS b FROM lineitem)
SELECT doc, id, text, min(b * 100 + ord) % 100 AS ord FROM a GROUP BY doc, id, text""")
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches of evidence, each text of an id once, the first."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("i"), F.col("l_partkey") % 3).alias("id"), F.col("l_returnflag").alias("text"), "l_linestatus")
    branches = [rows.where("l_linestatus = 'O'").drop("l_linestatus"), rows.where("l_linestatus <> 'O'").drop("l_linestatus")]
    return reports.united(branches, "doc", "id", "text").select("doc", "id", "text", "ord")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS line_no, (l_linenumber * 37 % 50)::DOUBLE AS top, (l_linenumber * 11 % 7)::DOUBLE AS left_of FROM lineitem)
SELECT doc, line_no, row_number() OVER (PARTITION BY doc ORDER BY round_even(top / 10, 0), left_of, line_no) AS place, row_number() OVER (PARTITION BY doc ORDER BY left_of DESC, line_no) AS rank FROM l""")
def reading_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in reading order, and by score."""
    i = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), i.alias("line_no"), (i * 37 % 50).cast("double").alias("top"), (i * 11 % 7).cast("double").alias("left")).distinct()
    rows = reports.reading_order(rows, "doc").withColumns({"score": F.col("left"), "ord": F.col("line_no")})
    return reports.ranked_results(rows, "doc").select("doc", "line_no", "place", "rank")


@query("""WITH r AS (SELECT p_partkey, unnest([1, 2, 3]) AS read FROM part) SELECT p_partkey, read, CASE WHEN read = 1 THEN 't' || p_partkey ELSE 't' || p_partkey || '__read' || read END AS read_id,
  round(least(0.99e0, (p_size / 50) * 0.48e0 + CASE WHEN p_partkey % 2 = 0 THEN 0.28e0 ELSE 0e0 END + CASE WHEN p_partkey % 3 = 0 THEN 0.2e0 ELSE 0e0 END + CASE WHEN p_partkey % 5 > 1 THEN 0.08e0 ELSE 0e0 END + CASE WHEN p_partkey % 5 IN (0, 2) THEN 0.12e0 ELSE 0e0 END), 4) AS score,
  round(least(0.99e0, (p_size / 50) * 0.7e0 + CASE WHEN p_partkey % 3 = 0 THEN 0.2e0 ELSE 0e0 END), 4) AS confidence,
  round((p_size / 50) * 0.48e0 + least(1e0, (p_partkey % 7) / 4) * 0.22e0 + CASE WHEN p_partkey % 2 = 0 THEN 0.11e0 ELSE 0e0 END + CASE WHEN p_partkey % 3 = 0 THEN 0.11e0 ELSE 0e0 END + ((p_partkey % 11) / 10) * 0.05e0 + least(1e0, (p_partkey % 13) / 10) * 0.03e0, 4) AS orientation FROM r JOIN part USING (p_partkey)""")
def script_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated reads, and scores of the plain recogniser's numbers and orientations."""
    from pyspark.sql import Column

    k, c = F.col("p_partkey"), F.col("p_size") / 50
    source: Column = F.when(k % 5 == 0, "Nota Fiscal de venda 1234567 emitida").when(k % 5 == 1, "total 1234567 desta pagina aqui").when(k % 5 == 2, "NF 1234567").otherwise("1234567")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("t"), k).alias("id"), reports.script_candidate_score(c, k % 2 == 0, k % 3 == 0, source).alias("s"), reports.script_orientation_score(c, k % 7, k % 2 == 0, k % 3 == 0, (k % 11) / 10, (k % 13) / 10).alias("orientation"))
    return reports.repeated_reads(rows).select("p_partkey", "read", "read_id", "s.score", "s.confidence", "orientation")


_NOW = "TIMESTAMP '2024-02-01 00:00:00'"
_JOBS = f"j AS (SELECT lpad(CAST({_K} AS STRING), 8, '0') AS id, CASE {_K} % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, CAST({_K} % 4 AS INT) AS attempts, {_K} % 8 >= 4 AS late FROM orders)"


def jobs_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, now = F.col(_K), F.expr(_NOW).cast("timestamp")
    rows = queue.enqueue(table(spark, sf_dir, "orders").select(F.lpad(k.cast("string"), 8, "0").alias("id")), now)
    n = F.col("id").cast("long")
    return rows.withColumns({"status": F.get(F.array(*map(F.lit, queue.STATUSES)), (n % 4).cast("int")), "attempts": (n % 4).cast("int"), "available_at": F.when(n % 8 >= 4, now + F.expr("INTERVAL 1 DAY")).otherwise(now), "error": F.when(n % 4 == 3, "old")})


@query(f"""WITH {_JOBS}, d AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM j WHERE status = 'queued' AND NOT late), c AS (SELECT j.*, coalesce(i <= 500, false) AS taken FROM j LEFT JOIN d USING (id))
SELECT id, CASE WHEN taken THEN 'processing' ELSE status END AS status, attempts + taken::INT AS attempts, CASE WHEN taken THEN 'w1' END AS worker FROM c""")
def job_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first due jobs, taken by a worker."""
    return queue.claim(jobs_of_orders(spark, sf_dir), F.expr(_NOW).cast("timestamp"), "w1", 500).select("id", "status", "attempts", "worker")


@query(f"""WITH {_JOBS}, o AS (SELECT *, status = 'processing' AS done, id::BIGINT % 8 = 1 AS good, id::BIGINT % 3 AS tries FROM j)
SELECT id, CASE WHEN NOT done THEN status WHEN good THEN 'completed' WHEN tries + 1 < 3 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN done AND NOT good THEN 'boom' WHEN done THEN NULL WHEN status = 'failed' THEN 'old' END AS error,
  CASE WHEN done AND NOT good AND tries + 1 < 3 THEN epoch_ms({_NOW}) + 5000 * pow(2, tries)::BIGINT END AS retry_ms FROM o""")
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed, queued again after a doubling delay, or failed."""
    n = F.col("id").cast("long")
    jobs = jobs_of_orders(spark, sf_dir).withColumn("attempts", (n % 3 + 1).cast("int"))
    outcomes = jobs.where(n % 4 < 2).select("id", F.when(n % 8 != 1, "boom").alias("error"))
    return queue.settle(jobs, outcomes, F.expr(_NOW).cast("timestamp")).select("id", "status", "error", F.unix_millis("next_retry_at").alias("retry_ms"))


@query(f"""WITH {_JOBS}, s AS (SELECT (id::BIGINT // 2)::VARCHAR AS id, min(CASE status WHEN 'queued' THEN 1 WHEN 'processing' THEN 2 WHEN 'completed' THEN 3 ELSE 4 END) AS i FROM j GROUP BY 1)
SELECT c_custkey::VARCHAR AS job_id, ['queued', 'processing', 'completed', 'failed'][i] AS queue_status FROM customer LEFT JOIN s ON s.id = c_custkey::VARCHAR""")
def job_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first store that has each job, beside the states."""
    stores = jobs_of_orders(spark, sf_dir).withColumn("id", F.floor(F.col("id").cast("long") / 2).cast("string"))
    states = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("job_id"))
    return queue.with_queue(states, queue.located(stores)).select("job_id", "queue_status")


@query("""WITH p AS (SELECT user_id, event_id, event_type, value, event_id % 3 = 0 AS has_asset FROM events), a AS (SELECT user_id, arg_max(coalesce(v, -1), event_id) AS asset FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN value END AS v FROM p WHERE has_asset) GROUP BY user_id),
q AS (SELECT user_id, event_type, max(event_id) AS last FROM p GROUP BY ALL), g AS (SELECT user_id, string_agg(event_type || ':' || last, ',' ORDER BY event_type) AS queue FROM q GROUP BY user_id), s AS (SELECT user_id, arg_max(event_type, event_id) AS status, count(*) AS patches FROM p GROUP BY user_id)
SELECT s.user_id, status, nullif(asset, -1) AS asset, queue, patches FROM s LEFT JOIN a USING (user_id) JOIN g USING (user_id)""")
def state_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States merged from patches: absent names change nothing, null ones clear, nested maps merge."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("status"), F.when(i % 2 == 0, F.col("value")).alias("asset"), F.when(i % 3 == 0, F.array(F.lit("status"), F.lit("asset"))).otherwise(F.array(F.lit("status"))).alias("given"), F.create_map("event_type", i.cast("string")).alias("queue"))
    out = queue.merged(rows, "user_id", "event_id", ["status", "asset"], ["queue"])
    return out.withColumn("queue", F.array_join(F.transform(F.map_entries("queue"), lambda e: F.concat_ws(":", e["key"], e["value"])), ","))


@query("""WITH e AS (SELECT user_id, event_id, ['ocr', 'detect', 'sync'][(event_id % 3 + 1)::INT] AS stage, CASE WHEN event_id % 5 < 3 THEN 'completed' ELSE 'running' END AS status FROM events), l AS (SELECT user_id, arg_max(status, event_id) FILTER (stage = 'ocr') AS ocr, arg_max(status, event_id) FILTER (stage = 'detect') AS detect, arg_max(status, event_id) FILTER (stage = 'sync') AS sync FROM e GROUP BY user_id),
c AS (SELECT user_id, coalesce(ocr, 'pending') AS ocr, coalesce(detect, 'pending') AS detect, coalesce(sync, 'pending') AS sync FROM l)
SELECT *, (ocr = 'completed')::INT + (detect = 'completed')::INT + (sync = 'completed')::INT AS completed_stages, CASE WHEN ocr = 'running' THEN 'ocr' WHEN detect = 'running' THEN 'detect' WHEN sync = 'running' THEN 'sync' END AS running_stage FROM c""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of each job by their last events."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.get(F.array(F.lit("ocr"), F.lit("detect"), F.lit("sync")), (i % 3).cast("int")).alias("stage"), F.when(i % 5 < 3, "completed").otherwise("running").alias("status"))
    return queue.progress(rows, "user_id", "event_id", ["ocr", "detect", "sync"])


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN 'Erro desconhecido.' END AS message, CASE event_id % 4 WHEN 1 THEN 'Error' WHEN 2 THEN 'TypeError' END AS name,
  event_id % 7 = 0 OR epoch_ms(TIMESTAMP '2024-01-20 00:00:00') - epoch_ms(ts) >= 86400000 AS due FROM events""")
def errors_and_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in one shape, and whether maintenance is due a day after the last run."""
    i, none = F.col("event_id"), F.lit(None).cast("string")
    at = lambda n, c: F.when(i % 4 == n, c)
    rows = table(spark, sf_dir, "events").select("event_id", queue.error_payload(at(0, F.col("event_type")), F.coalesce(at(1, F.col("event_type")), at(2, F.lit(""))), at(2, F.lit("TypeError"))).alias("e"), queue.due_maintenance(F.when(i % 7 != 0, F.col("ts").cast("timestamp")), F.expr("TIMESTAMP '2024-01-20 00:00:00'").cast("timestamp"), 86400000).alias("due"), none.alias("_"))
    return rows.select("event_id", "e.message", "e.name", "due")
