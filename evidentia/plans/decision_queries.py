"""Queries of scores and decisions, over documents made from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import decisions as d
from evidentia.plans.base import query, r2, table

_SHARE = {"date_conf": 7, "header_conf": 13, "nfe_conf": 17, "nf_conf": 19, "geometry_score": 23, "alignment_quality": 31, "dark_ratio": 37, "row_coverage": 41, "column_coverage": 43, "number_conf": 47, "average": 53}
_K = "o_orderkey"
#: Columns of the documents, in words that both engines understand.
_COLUMNS = {
    "date_found": f"{_K} % 3 <> 0", "header_found": f"{_K} % 4 <> 1", "nfe_found": f"{_K} % 5 <> 2", "number_found": f"{_K} % 6 <> 0",
    "nf": f"CASE WHEN {_K} % 6 = 0 THEN NULL WHEN {_K} % 11 = 0 THEN '12345' ELSE lpad(CAST({_K} AS STRING), 7, '0') END",
    "support_count": f"{_K} % 4", "template_matched": f"{_K} % 2 = 0", "template_score": f"{_K} * 11 % 101", "ocr_conf": f"{_K} * 29 % 101",
    "lookup_found": f"CASE WHEN {_K} % 7 = 0 THEN NULL ELSE {_K} % 7 < 5 END", "lookup_reason": f"CASE WHEN {_K} % 7 < 5 THEN 'invoice_found' ELSE 'invoice_not_found' END",
    "class": f"CASE {_K} % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'Review' WHEN 2 THEN 'review' WHEN 3 THEN 'invalid' ELSE NULL END",
    "mode": f"CASE {_K} % 9 WHEN 0 THEN 'disabled' WHEN 1 THEN 'alerts_only' WHEN 2 THEN NULL WHEN 3 THEN ' Status_Only ' ELSE 'full' END",
    "trip_id": f"CASE WHEN {_K} % 3 = 0 THEN {_K} END", "trip_note_id": f"CASE WHEN {_K} % 4 = 0 THEN {_K} END", "suspicious_warp": f"{_K} % 8 = 0",
    "message_id": f"CASE WHEN {_K} % 10 = 0 THEN ' ' ELSE 'm' || CAST({_K} AS STRING) END", "source_type": f"CASE {_K} % 3 WHEN 0 THEN 'region' WHEN 1 THEN 'nf_roi' END",
} | {name: f"({_K} * {by} % 101) / 100.0e0" for name, by in _SHARE.items()}
_DOCS = "d AS (SELECT o_orderkey, " + ", ".join(f"{sql} AS {name}" for name, sql in _COLUMNS.items()) + " FROM orders)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(sql).alias(name) for name, sql in _COLUMNS.items()])
    return rows.withColumn("source_types", F.array_compact(F.array("source_type")))


_N = "(date_found::INT + header_found::INT + nfe_found::INT)"
_T = "(template_matched OR template_score >= 58)"
_STRUCTURE = f"""CASE WHEN geometry_score < 0.4 THEN 'invalid' WHEN (date_found AND nfe_found) OR {_N} >= 2 OR ({_T} AND nfe_found) THEN 'usable'
  WHEN {_T} OR geometry_score >= 0.5 OR {_N} >= 1 OR ocr_conf >= 28 THEN 'review' ELSE 'invalid' END"""


@query(f"""WITH {_DOCS}, s AS (SELECT *, {_STRUCTURE} AS status FROM d)
SELECT o_orderkey, status, geometry_score >= 0.4 AND (status <> 'invalid' OR ({_T} AND date_found)) AS can_fall_back, geometry_score < 0.4 AS hard_reject FROM s""")
def structure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable, for review or invalid."""
    return documents(spark, sf_dir).select("o_orderkey", d.structure().alias("s")).select("o_orderkey", "s.*")


_NF = "(nf IS NOT NULL)"
_SCORE = f"""SELECT *, {r2('22 * date_conf')} AS date_points, {r2('12 * header_conf')} AS header_points, {r2('24 * nfe_conf')} AS nfe_points,
  CASE WHEN {_NF} THEN {r2('nf_conf * 34')} ELSE {r2('least(nf_conf, 0.45e0) * 10')} END AS number_points, CASE WHEN template_matched THEN 8.0e0 ELSE {r2('least(1.0e0, geometry_score) * 8')} END AS template_points,
  least(12.0e0, CASE WHEN date_found THEN 2 ELSE 0 END + CASE WHEN nfe_found THEN 2 ELSE 0 END + CASE WHEN date_found AND nfe_found THEN 2 ELSE 0 END + CASE WHEN date_found AND header_found AND nfe_found THEN 3 ELSE 0 END
    + CASE WHEN {_NF} AND support_count >= 2 THEN 2 ELSE 0 END + CASE WHEN coalesce(source_type = 'region', false) THEN 1 ELSE 0 END) AS consistency_points, {_STRUCTURE} AS status,
  {_NF} AND nf_conf >= 0.82 AS strong_nf, date_found AND header_found AND nfe_found AS all_fields, coalesce(lookup_found, false) AS looked_up FROM d"""
_FLAGS = f"""SELECT *, {r2('date_points + header_points + nfe_points + number_points + template_points + consistency_points')} AS total,
  date_found AND nfe_found AND template_matched AND date_conf >= 0.72 AND nfe_conf >= 0.72 AND strong_nf AS fallback,
  date_found AND nfe_found AND geometry_score >= 0.5 AND strong_nf AND support_count >= 2 AND looked_up AS database,
  nfe_found AND geometry_score >= 0.5 AND {_NF} AND nf_conf >= 0.6 AND looked_up AS structural FROM p"""


@query(f"WITH {_DOCS}, p AS ({_SCORE}), f AS ({_FLAGS}) SELECT o_orderkey, total, number_points, template_points, consistency_points, fallback, database, structural, all_fields, strong_nf FROM f")
def business_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of fields, number, template and consistency, and the ways to approval that are open."""
    s = documents(spark, sf_dir).select("o_orderkey", d.business_score().alias("s"))
    return s.select("o_orderkey", "s.total", F.col("s.number").alias("number_points"), F.col("s.template").alias("template_points"), F.col("s.consistency").alias("consistency_points"), *[f"s.{c}" for c in ("fallback", "database", "structural", "all_fields", "strong_nf")])


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _said(key: str) -> str:
    return _quoted(d.TEXTS[key].format(header="EMITENTE", company="ACME"))


_USABLE = "status <> 'invalid'"
_WAY = f"""CASE WHEN geometry_score < 0.4 THEN 'rejected' WHEN template_matched AND strong_nf AND (all_fields OR fallback) AND total >= 74 AND {_USABLE} THEN 'template'
  WHEN database AND strong_nf AND total >= 74 AND {_USABLE} THEN 'database' WHEN structural AND total >= 60 AND {_USABLE} THEN 'structural'
  WHEN {_USABLE} OR total >= 46 OR template_matched OR {_N} >= 1 OR {_NF} OR ocr_conf >= 35 THEN 'review' ELSE 'unreadable' END"""
_WHY = [
    ("way = 'rejected'", "dark"), ("way = 'rejected'", "geometry"), ("way = 'template' AND all_fields", "all_fields"), ("way = 'template' AND NOT all_fields", "fallback"), ("way = 'template' AND NOT all_fields", "header_partial"),
    ("way = 'database'", "database"), ("way = 'database'", "database_origin"), ("way = 'structural'", "structural"), ("way = 'structural'", "structural_geometry"),
    (f"way = 'review' AND NOT {_NF}", "review_no_nf"), (f"way = 'review' AND {_NF} AND (all_fields OR fallback)", "review_ambiguous"), (f"way = 'review' AND {_NF} AND NOT (all_fields OR fallback)", "review_weak"), ("way = 'review' AND NOT header_found", "review_header"),
    ("way = 'unreadable'", "invalid_structure"), ("way = 'unreadable'", "invalid_fields"), ("NOT date_found", "no_date"), ("NOT nfe_found", "no_nfe"), ("NOT template_matched", "no_template"), (f"NOT {_NF}", "no_nf"), (f"{_NF} AND nf_conf < 0.82", "nf_weak"),
    ("looked_up AND NOT template_matched", "origin_lookup"), (f"NOT (looked_up AND NOT template_matched) AND lookup_reason = 'invoice_not_found' AND {_NF}", "not_in_base"),
]
_REASONS = "list_filter([" + ", ".join(f"CASE WHEN {holds} THEN {_said(key)} END" for holds, key in _WHY) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {_DOCS}, p AS ({_SCORE}), f AS ({_FLAGS}), w AS (SELECT *, {_WAY} AS way FROM f)
SELECT o_orderkey, way, CASE WHEN way IN ('template', 'database', 'structural') THEN 'valid' WHEN way = 'review' THEN 'review' ELSE 'invalid' END AS class, array_to_string({_REASONS}, '|') AS reasons,
  CASE WHEN way IN ('template', 'database', 'structural') THEN 'seguir_para_integracao_api' WHEN way = 'review' THEN 'revisar_manual,avaliar_nova_foto' WHEN way = 'rejected' THEN 'solicitar_fundo_escuro,responder_no_whatsapp' ELSE 'solicitar_novo_envio,responder_no_whatsapp' END AS actions FROM w""")
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, way, reasons and actions."""
    rows = documents(spark, sf_dir).withColumns({"s": d.structure(), "score": d.business_score()}).select("*", "s.status", "s.hard_reject")
    return rows.select("o_orderkey", d.classify("EMITENTE", "ACME").alias("c")).select("o_orderkey", "c.way", "c.class", F.array_join("c.reasons", "|").alias("reasons"), F.array_join("c.actions", ",").alias("actions"))


_MISSING = "((NOT number_found)::INT + (NOT date_found)::INT + (NOT header_found)::INT)"
_SOFT = f"({_MISSING} = 1 AND number_found AND average >= 0.74 AND number_conf >= 0.78 AND CASE WHEN NOT date_found THEN header_found AND header_conf >= 0.78 ELSE date_found AND date_conf >= 0.78 END)"


@query(f"""WITH {_DOCS}, c AS (SELECT *, {_SOFT} AS soft, CASE WHEN ({_MISSING} = 0 AND average >= 0.82 AND header_found) OR {_SOFT} THEN 'valid' WHEN {_MISSING} >= 2 THEN 'invalid' ELSE 'review' END AS class_of FROM d)
SELECT o_orderkey, class_of AS class, soft, NOT number_found OR NOT date_found OR average < 0.72 AS trigger,
  array_to_string(list_filter([CASE WHEN NOT number_found THEN 'Campo obrigatorio ausente: NF-e.' END, CASE WHEN NOT date_found THEN 'Campo obrigatorio ausente: Data.' END, CASE WHEN NOT header_found THEN 'Campo obrigatorio ausente: Emitente.' END,
    CASE WHEN class_of = 'review' AND average < 0.58 THEN {_said('low_average')} END, CASE WHEN soft THEN {_said('soft')} END], lambda x: x IS NOT NULL), '|') AS reasons FROM c""")
def operational_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision on parsed fields, with the soft approval and what asks for another provider."""
    rows = documents(spark, sf_dir).select("o_orderkey", d.operational({"number": "NF-e", "date": "Data", "header": "Emitente"}).alias("o"))
    return rows.select("o_orderkey", "o.class", "o.soft", "o.trigger", F.array_join("o.reasons", "|").alias("reasons"))


_KEY = "coalesce(regexp_replace(nf, '[^0-9]+', '', 'g'), '')"
_MODE = "coalesce(nullif(lower(trim(mode)), ''), 'mock')"
_SYNC = f"""CASE WHEN {_MODE} = 'disabled' THEN 'sync_disabled' WHEN {_KEY} = '' THEN 'missing_nf' WHEN lookup_found = false THEN 'invoice_not_found' WHEN lower(class) = 'review' THEN 'manual_review_required'
  WHEN coalesce(lower(class), 'invalid') <> 'valid' THEN 'invalid_receipt' WHEN {_MODE} = 'alerts_only' THEN 'valid_without_backend_update' WHEN {_MODE} = 'full' THEN 'upload_and_mark_delivered' ELSE 'mark_delivered_only' END"""
_CODE = f"CASE WHEN {_KEY} = '' THEN 'RECEIPT_UNREADABLE_IMAGE' WHEN lookup_found = false THEN 'NF_NOT_FOUND_UPLOAD_ATTEMPT' WHEN lower(class) = 'review' THEN 'RECEIPT_MANUAL_REVIEW_REQUIRED' ELSE 'RECEIPT_UNREADABLE_IMAGE' END"


@query(f"""WITH {_DOCS}, c AS (SELECT *, {_SYNC} AS reason, {_CODE} AS code, {_KEY} AS k FROM d)
SELECT o_orderkey, CASE WHEN reason IN ('sync_disabled', 'valid_without_backend_update') THEN 'none' WHEN reason IN ('upload_and_mark_delivered', 'mark_delivered_only') THEN 'mark_delivered' ELSE 'alert' END AS type, reason, reason = 'upload_and_mark_delivered' AS upload,
  code, CASE WHEN code LIKE 'NF_NOT%' THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  CASE WHEN k = '' THEN 'O bot recebeu uma imagem em grupo, mas nao conseguiu identificar a NF.' WHEN code LIKE 'NF_NOT%' THEN 'A NF ' || k || ' foi lida em grupo, mas nao existe na base operacional da empresa.'
    WHEN code LIKE '%MANUAL%' THEN 'O bot leu a NF ' || k || ' em grupo, mas a imagem ainda exige revisao manual.' ELSE 'O bot recebeu uma imagem em grupo, mas nao conseguiu validar o canhoto com seguranca.' END AS message,
  CASE WHEN trim(message_id) = '' THEN '' ELSE 'receipt-whatsapp:' || code || ':' || message_id END AS dedupe_key FROM c""")
def sync_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written back for each document, its alert, and the alert's dedupe key."""
    rows = documents(spark, sf_dir).select("o_orderkey", "message_id", d.sync_action(F.col("mode")).alias("s"), d.alert(F.lit("grupo")).alias("a"))
    return rows.select("o_orderkey", "s.type", "s.reason", "s.upload", "a.code", "a.severity", "a.message", d.dedupe_key(F.col("a.code"), F.col("message_id")).alias("dedupe_key"))


_WHYS = ["Campo obrigatorio ausente: DATA DE RECEBIMENTO.", " " + d.TEXTS["review_weak"], "other"]


@query(f"""WITH {_DOCS} SELECT o_orderkey, CASE WHEN lower(class) = 'review' AND coalesce(lookup_found, false) AND (coalesce(trip_id, 0) <> 0 OR coalesce(trip_note_id, 0) <> 0) AND len({_KEY}) = 7
  THEN CASE WHEN o_orderkey % 3 = 0 THEN 'missing_receipt_date_only' ELSE 'matched_route_assignment' END END AS promotion,
  coalesce(lower(class) = 'valid', false) OR (date_found AND header_found AND o_orderkey % 3 <> 1 AND average >= 0.82) AS caption_approves, o_orderkey % 3 = 0 AS date_only FROM d""")
def review_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents for review become valid, and which a caption's key approves."""
    k = F.col("o_orderkey") % 3
    why = F.when(k == 0, F.array(*map(F.lit, _WHYS[:2]))).when(k == 1, F.array(*map(F.lit, _WHYS))).otherwise(F.array(F.lit(_WHYS[1])))
    rows = documents(spark, sf_dir).withColumns({"reasons": why, "missing": F.when(k == 1, F.array(F.lit("number"), F.lit("date"))).when(k == 2, F.array(F.lit("number")))})
    return rows.select("o_orderkey", d.promotion().alias("promotion"), F.coalesce(d.caption_approves(), F.lit(False)).alias("caption_approves"), d.missing_date_only(F.col("reasons")).alias("date_only"))


_TEMPLATE = r2("geometry_score * 38 + header_conf * 22 + date_conf * 18 + nfe_conf * 22 + CASE WHEN nfe_found THEN 6.0e0 ELSE 0.0e0 END")
_MARKED = "dark_ratio >= 0.78 AND row_coverage >= 0.88 AND column_coverage >= 0.9"


@query(f"""WITH {_DOCS}, s AS (SELECT *, {_TEMPLATE} AS template, (geometry_score >= 0.52 AND nfe_conf >= 0.55) OR ({_TEMPLATE} >= 58 AND geometry_score >= 0.5) OR (geometry_score >= 0.56 AND header_conf >= 0.48 AND date_conf >= 0.42) AS matched FROM d)
SELECT o_orderkey, template, matched, {r2(f"template + nf_conf * 6 + {r2('alignment_quality * 16')} - CASE WHEN suspicious_warp THEN 8.0e0 ELSE 0.0e0 END - CASE WHEN {_MARKED} THEN 6.0e0 ELSE 0.0e0 END")} AS score,
  template < 62 OR NOT matched AS second_probe, template < 54 OR (NOT matched AND nf_conf < 0.7) AS second_probe_fast FROM s""")
def template_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template and orientation scores, and who needs a second probe."""
    rows = documents(spark, sf_dir).withColumn("t", d.template_score())
    best = F.struct(F.col("t.score").alias("score"), F.col("t.matched").alias("matched"), F.col("nf_conf").alias("nf_conf"))
    none = F.lit(None).cast("struct<score:double>")
    return rows.select("o_orderkey", F.col("t.score").alias("template"), "t.matched", d.orientation_score(F.col("t.score")).alias("score"), d.second_probe(best, none).alias("second_probe"), d.second_probe(best, none, fast=True).alias("second_probe_fast"))


_ATTEMPTS = """CASE l_linenumber WHEN 1 THEN 'primary' WHEN 2 THEN 'fallback' WHEN 3 THEN 'fallback' ELSE 'legacy' END AS kind, 'p' || l_linenumber AS provider,
  CASE WHEN l_quantity > 30 THEN 'error' ELSE 'success' END AS status, CASE l_returnflag WHEN 'A' THEN 'valid' WHEN 'N' THEN 'review' ELSE 'invalid' END AS class, l_linestatus = 'O' AS trigger"""


@query(f"""WITH a AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber AS i, {_ATTEMPTS} FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_extendedprice),
r AS (SELECT *, CASE WHEN kind = 'primary' AND status = 'success' AND NOT trigger AND class = 'valid' THEN 1 WHEN kind = 'fallback' AND status = 'success' AND class <> 'invalid' THEN 2 WHEN kind = 'legacy' AND status = 'success' THEN 3 WHEN status = 'success' THEN 4 ELSE 5 END AS rank FROM a)
SELECT l_orderkey, first(provider ORDER BY rank, CASE WHEN rank = 5 THEN -i ELSE i END) AS provider, first(status ORDER BY rank, CASE WHEN rank = 5 THEN -i ELSE i END) AS status FROM r GROUP BY l_orderkey""")
def provider_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt that counts, of providers in the order they ran."""
    from evidentia.operators import keys

    lines = keys.latest(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], *[F.asc(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_extendedprice")])
    kind = F.when(F.col("l_linenumber") == 1, "primary").when(F.col("l_linenumber") <= 3, "fallback").otherwise("legacy")
    name = F.when(F.col("l_returnflag") == "A", "valid").when(F.col("l_returnflag") == "N", "review").otherwise("invalid")
    attempt = F.struct("l_linenumber", kind.alias("kind"), F.concat(F.lit("p"), "l_linenumber").alias("provider"), F.when(F.col("l_quantity") > 30, "error").otherwise("success").alias("status"), name.alias("class"), (F.col("l_linestatus") == "O").alias("trigger"))
    rows = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(attempt)).alias("a"))
    return rows.select("l_orderkey", d.provider_chain(F.col("a")).alias("p")).select("l_orderkey", "p.provider", "p.status")
