"""Queries of what is written back, and of orientations, phases and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import sync
from evidentia.plans.base import query, table

_REF = "ref AS (SELECT lpad(CAST(p_partkey AS STRING), 7, '0') AS key FROM part WHERE p_partkey % 3 = 0)"
_NF = "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '12' ELSE lpad(CAST(o_orderkey % 2000 AS STRING), 7, '0') END"
_CLASS = "CASE o_orderkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'review' WHEN 2 THEN 'invalid' ELSE 'review' END"
_CAPTION = "CASE WHEN o_orderkey % 5 = 0 THEN 'nota ' || lpad(CAST(o_orderkey % 1700 AS STRING), 7, '0') ELSE '' END"
_DOCS = f"""{_REF}, del AS (SELECT lpad(CAST(l_partkey AS STRING), 7, '0') AS key, arg_max(CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey ELSE 0 END, l_shipdate::VARCHAR || lpad(l_orderkey::VARCHAR, 9, '0')) AS trip_id FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey AS doc, {_NF} AS nf, {_CLASS} AS class, {_CAPTION} AS caption, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'm' || (o_orderkey % 3000) END AS message_id FROM orders),
l AS (SELECT *, CASE WHEN nf IS NOT NULL THEN nf IN (SELECT key FROM ref) END AS found, regexp_extract(caption, '([0-9]{{7}})', 1) AS named FROM d),
s AS (SELECT *, NOT (coalesce(found, false) AND class = 'valid') AND named <> '' AND named <> coalesce(nf, '') AND named IN (SELECT key FROM ref) AS rescued FROM l),
r AS (SELECT doc, message_id, CASE WHEN rescued THEN named ELSE nf END AS nf, CASE WHEN rescued THEN CASE WHEN class = 'valid' OR doc % 7 <> 0 THEN 'valid' ELSE 'review' END ELSE class END AS class, rescued, rescued OR found AS found FROM s),
p AS (SELECT r.*, coalesce(trip_id, 0) <> 0 AS routed, CASE WHEN class = 'review' AND coalesce(found, false) AND coalesce(trip_id, 0) <> 0 AND len(nf) = 7 THEN 'matched_route_assignment' END AS promotion FROM r LEFT JOIN del ON del.key = r.nf),
c AS (SELECT *, CASE WHEN promotion IS NOT NULL THEN 'valid' ELSE class END AS cls FROM p),
a AS (SELECT *, CASE WHEN nf IS NOT NULL AND len(nf) <> 7 THEN 'ignored_non_operational_invoice' WHEN nf IS NULL THEN 'missing_nf' WHEN NOT found THEN 'invoice_not_found' WHEN cls = 'review' THEN 'manual_review_required' WHEN cls <> 'valid' THEN 'invalid_receipt' WHEN NOT routed THEN 'missing_route_assignment' ELSE 'upload_and_mark_delivered' END AS reason FROM c),
f AS (SELECT *, CASE reason WHEN 'ignored_non_operational_invoice' THEN 'none' WHEN 'upload_and_mark_delivered' THEN 'mark_delivered' ELSE 'alert' END AS type FROM a)"""


def done(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(
        k.alias("doc"), F.expr(_NF).alias("nf"), F.expr(_CLASS).alias("class"), F.expr(_CAPTION).alias("caption"), F.lit("line").alias("method"), F.array(F.lit("old")).alias("reasons"), (k % 7 != 0).alias("date_found"), F.lit(True).alias("header_found"),
        F.array(F.lit("number")).alias("missing"), F.lit(0.9).alias("average"), F.when(k % 6 != 0, F.concat(F.lit("m"), k % 3000)).otherwise("").alias("message_id"), F.lit("grupo").alias("source_label"),
    )
    reference = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("key"))
    deliveries = table(spark, sf_dir, "lineitem").select(F.lpad(F.col("l_partkey").cast("string"), 7, "0").alias("key"), F.when(F.col("l_orderkey") % 2 == 0, F.col("l_orderkey")).otherwise(F.lit(0)).alias("trip_id"), F.lit(None).cast("long").alias("trip_note_id"), F.lit(None).cast("long").alias("driver_id"), F.struct("l_shipdate", "l_orderkey").alias("updated_at"))
    return sync.synchronised(docs, reference, deliveries, ["caption"], F.lit("full"))


@query(f"WITH {_DOCS} SELECT doc, nf, cls AS class, rescued, promotion, type, reason, type = 'mark_delivered' AS upload FROM f")
def sync_orchestration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup, caption rescue, gate, promotion and action, one after the other."""
    return done(spark, sf_dir).select("doc", "nf", "class", "rescued", "promotion", "type", "reason", "upload")


_CODE = "CASE WHEN reason = 'missing_route_assignment' THEN 'RECEIPT_MANUAL_REVIEW_REQUIRED' WHEN nf IS NULL THEN 'RECEIPT_UNREADABLE_IMAGE' WHEN NOT found THEN 'NF_NOT_FOUND_UPLOAD_ATTEMPT' WHEN cls = 'review' THEN 'RECEIPT_MANUAL_REVIEW_REQUIRED' ELSE 'RECEIPT_UNREADABLE_IMAGE' END"


@query(f"""WITH {_DOCS}, x AS (SELECT *, {_CODE} AS code FROM f WHERE type = 'alert'), k AS (SELECT *, CASE WHEN message_id = '' THEN '' ELSE 'receipt-whatsapp:' || code || ':' || message_id END AS dedupe_key FROM x)
SELECT min(doc) AS doc, code, CASE WHEN code LIKE 'NF_NOT%' THEN 'CRITICAL' ELSE 'WARNING' END AS severity, dedupe_key FROM k GROUP BY code, dedupe_key, CASE WHEN dedupe_key = '' THEN doc END""")
def sync_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts, one a dedupe key."""
    return sync.alerts(done(spark, sf_dir)).select("doc", "code", "severity", "dedupe_key")


@query(f"WITH {_DOCS} SELECT nf AS key, 'delivered' AS status, count(*) AS activities, count(promotion) AS promoted FROM f WHERE type = 'mark_delivered' GROUP BY 1")
def sync_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status updates, and the activities behind them."""
    rows = done(spark, sf_dir)
    acts = sync.activities(rows).groupBy(F.col("nf").alias("key")).agg(F.count("*").alias("activities"), F.count_if("promoted").alias("promoted"))
    return sync.status_updates(rows).join(acts, "key")


_EVAL = "SELECT l_orderkey AS doc, 'o' || (l_suppkey % 4) AS orientation, max(l_quantity) * {by} AS score, max(l_tax) > 0.05 AS matched, max(l_discount) * 8 AS nf_conf FROM lineitem GROUP BY 1, 2"


@query(f"""WITH a AS ({_EVAL.format(by='1.6e0')}), b AS ({_EVAL.format(by='2.2e0')}), r AS (SELECT *, row_number() OVER w AS i, score - lead(score) OVER w AS gap FROM a WINDOW w AS (PARTITION BY doc ORDER BY matched DESC, score DESC, nf_conf DESC, orientation)),
weak AS (SELECT doc FROM r WHERE i = 1 AND (score < 62 OR NOT matched OR coalesce(gap < 6, false))), u AS (SELECT a.doc, a.orientation, CASE WHEN w.doc IS NOT NULL AND r.i <= 2 THEN b.score ELSE a.score END AS score, a.matched, a.nf_conf, w.doc IS NOT NULL AS probed_again FROM a JOIN b USING (doc, orientation) JOIN r USING (doc, orientation) LEFT JOIN weak w USING (doc))
SELECT DISTINCT ON (doc) doc, orientation, score, matched, nf_conf, probed_again FROM u ORDER BY doc, matched DESC, score DESC, nf_conf DESC, orientation""")
def orientation_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best orientation, after a second probe of the two best where the first was weak."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.concat(F.lit("o"), F.col("l_suppkey") % 4).alias("orientation")).agg((F.max("l_quantity") * 1.6).alias("score"), (F.max("l_tax") > 0.05).alias("matched"), (F.max("l_discount") * 8).alias("nf_conf"), F.max("l_quantity").alias("q"))
    return sync.best_orientations(rows.drop("q"), rows.withColumn("score", F.col("q") * 2.2).drop("q"))


@query("""WITH r AS (SELECT l_orderkey AS doc, lpad(l_partkey::VARCHAR, 7, '0') AS nf, l_discount AS confidence, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS p FROM lineitem)
SELECT doc, count(DISTINCT p) AS phases, count(*) AS results, first(nf ORDER BY confidence DESC, p, nf) AS nf, max(confidence) AS confidence FROM r GROUP BY doc""")
def phase_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of phases in one, with the best."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lpad(F.col("l_partkey").cast("string"), 7, "0").alias("nf"), F.col("l_discount").alias("confidence"), "l_returnflag")
    return sync.merged_phases([rows.where(F.col("l_returnflag") == flag) for flag in ("A", "N", "R")])


@query("""WITH d AS (SELECT o_orderkey, o_orderkey % 10 = 0 AS rej, o_orderkey % 2 = 0 AS tm, (o_orderkey % 100) / 100e0 AS g, o_orderkey % 3 <> 0 AS dt, o_orderkey % 4 <> 0 AS hd, o_orderkey % 5 <> 0 AS nfe, o_orderkey % 6 <> 0 AS nf, o_orderkey % 7 < 3 AS lk, o_orderkey % 8 < 4 AS ok FROM orders)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN rej THEN 'geometry' END, CASE WHEN NOT dt THEN 'date' END, CASE WHEN NOT hd AND NOT lk THEN 'header' END, CASE WHEN NOT nfe THEN 'nfe' END, CASE WHEN NOT nf THEN 'number' END], lambda x: x IS NOT NULL), ',') AS failed,
  array_to_string(list_filter([CASE WHEN rej THEN 'geometry' END, CASE WHEN NOT nfe THEN 'nfe' END, CASE WHEN NOT nf THEN 'number' END], lambda x: x IS NOT NULL), ',') AS blocking, CASE WHEN ok THEN CASE WHEN tm AND hd THEN 'template' WHEN lk THEN 'lookup' ELSE 'fields' END END AS basis,
  array_to_string([CASE WHEN tm THEN 'success' ELSE 'warning' END, CASE WHEN nf THEN 'success' ELSE 'warning' END, CASE WHEN lk THEN 'success' ELSE 'info' END, CASE WHEN dt THEN 'success' ELSE 'warning' END, CASE WHEN ok THEN 'success' ELSE 'info' END], ',') AS levels FROM d""")
def checkpoint_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed and blocking checkpoints, what an approval rests on, and levels of the log."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k, (k % 10 == 0).alias("hard_reject"), (k % 2 == 0).alias("template_matched"), ((k % 100) / 100).alias("geometry_score"), (k % 3 != 0).alias("date_found"), (k % 4 != 0).alias("header_found"), (k % 5 != 0).alias("nfe_found"),
        F.when(k % 6 != 0, "1").alias("nf"), (k % 7 < 3).alias("lookup_found"), F.when(k % 8 < 4, "valid").otherwise("review").alias("class"), F.when(k % 3 == 0, F.array(F.lit("date"))).alias("missing"),
    )
    rows = rows.select("o_orderkey", sync.checkpoints().alias("c"), sync.debug_log().alias("l"))
    return rows.select("o_orderkey", F.array_join("c.failed", ",").alias("failed"), F.array_join("c.blocking", ",").alias("blocking"), "c.basis", F.array_join(F.transform("l", lambda x: x["level"]), ",").alias("levels"))
