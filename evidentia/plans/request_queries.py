"""Queries of requests, messages, provider results and evidence in one shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import requests as rq
from evidentia.plans.base import noise, query, search, table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query("""WITH e AS (SELECT o_orderkey AS request, 'c' || (o_orderkey % 5) AS ten FROM orders)
SELECT request, CASE request % 5 WHEN 0 THEN 'payload' WHEN 1 THEN 'head' WHEN 2 THEN 'meta' WHEN 3 THEN CASE WHEN request % 2 = 0 THEN 'beta' ELSE 'alpha' END ELSE 'acme' END AS company_id,
  CASE request % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'hint' WHEN 2 THEN 'web' ELSE 'whatsapp' END AS source, CASE request % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'slip' ELSE 'delivery_receipt' END AS document_type,
  CASE request % 6 WHEN 0 THEN 'r' || request WHEN 1 THEN 'x' || request END AS request_id, CASE WHEN request % 5 = 2 THEN 'meta' END AS meta FROM e""")
def canonical_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests coalesced from payload, headers, metadata, credentials and defaults."""
    key = F.col("o_orderkey")
    lit, s = F.lit, lambda p: F.concat(F.lit(p), key)
    pair = lambda n, of, k, v: F.struct(F.when(key % n == of, k).alias("key"), v.alias("value"))
    token = F.when(key % 2 == 0, lit("Bearer  t2 ")).otherwise(lit("bearer t1"))
    head = F.filter(F.array(pair(5, 1, "X-Company", lit("head")), pair(5, 3, "Authorization", token), pair(4, 2, "x-source-id", lit("old")), pair(4, 2, "X-Source-Id", lit("web")), pair(3, 1, "x-document-type", lit("slip")), pair(6, 1, "X-Request-Id", s(" x"))), lambda e: e["key"].isNotNull())
    rows = _orders(spark, sf_dir).select(
        key.alias("request"), F.when(key % 5 == 0, " payload ").alias("company_id"), F.when(key % 4 == 0, "api").alias("source"), F.when(key % 3 == 0, "invoice").alias("document_type"), F.when(key % 6 == 0, s("r")).alias("request_id"),
        F.when(key % 4 == 1, "hint").alias("source_hint"), F.map_from_entries(head).alias("headers"), F.when(key % 5 == 2, '{"companyId": "meta"}').when(key % 5 == 1, "[1]").otherwise("no json").alias("metadata"),
    )
    tokens = spark.createDataFrame([("alpha", 0, "t1"), ("beta", 1, " t2 "), ("gamma", 2, "t1")], "company string, ord int, token string")
    out = rq.canonical(rows, tokens, "acme", "whatsapp", "delivery_receipt")
    return out.select("request", "company_id", "source", "document_type", "request_id", F.try_element_at("metadata", F.lit("companyId")).alias("meta"))


_COMPANIES = [{"id": "acme", "sources": ["web", "api"], "default": "slip", "bindings": {"slip": {"profile": "p", "validation": {"least": 0.9}, "fields": {"number": {"label": "NF"}}}}}, {"id": "beta", "sources": ["web"], "bindings": {"slip": {"profile": "p"}}}]
_DOCUMENTS = {"p": {"fields": {"number": {"label": "No", "needed": True}, "date": {"label": "D"}}, "validation": {"least": 0.8, "most": 1}}}


@query("""SELECT o_orderkey AS request, CASE WHEN o_orderkey % 3 = 2 THEN 'company' WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 1 THEN 'source' WHEN o_orderkey % 5 = 0 THEN 'document' END AS problem,
  CASE WHEN o_orderkey % 3 = 2 OR (o_orderkey % 3 = 1 AND o_orderkey % 2 = 1) OR o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 0.9e0 ELSE 0.8e0 END AS least, CASE WHEN o_orderkey % 3 = 2 OR (o_orderkey % 3 = 1 AND o_orderkey % 2 = 1) OR o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'NF' ELSE 'No' END AS label FROM orders""")
def request_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved profile of each request, or what of it isn't configured."""
    key = F.col("o_orderkey")
    found = rq.resolved_profiles(_COMPANIES, ["web", "api"], _DOCUMENTS)
    profiles = spark.createDataFrame([(p["company"], p["source"], p["document_type"], p["default"], p["validation"]["least"], p["fields"]["number"]["label"]) for p in found], "company string, source string, document_type string, `default` boolean, least double, label string")
    rows = _orders(spark, sf_dir).select(key.alias("request"), F.when(key % 3 == 0, "acme").when(key % 3 == 1, "beta").otherwise("none").alias("company_id"), F.when(key % 2 == 0, "web").otherwise("api").alias("source"), F.when(key % 5 == 0, "other").otherwise("slip").alias("document_type"))
    return rq.with_profile(rows, profiles).select("request", "problem", "least", "label")


_SAID = "CASE o_orderkey % 8 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'OFF' WHEN 2 THEN '7' WHEN 3 THEN '-3.9' WHEN 4 THEN '5, 7.8 ,x,-1' WHEN 5 THEN NULL WHEN 6 THEN '' ELSE 'on,' END"


@query(f"""WITH s AS (SELECT o_orderkey, {_SAID} AS x FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN true ELSE false END AS flag, CASE o_orderkey % 8 WHEN 2 THEN 7 WHEN 3 THEN -3 WHEN 6 THEN 0 ELSE 9 END AS number,
  CASE o_orderkey % 8 WHEN 0 THEN 'Yes' WHEN 1 THEN 'OFF' WHEN 2 THEN '7' WHEN 3 THEN '-3.9' WHEN 4 THEN '5|7.8|x|-1' WHEN 7 THEN 'on' ELSE 'a|b' END AS items, CASE o_orderkey % 8 WHEN 4 THEN '5|7' ELSE '7' END AS lengths FROM s""")
def typed_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, numbers, lists and lengths of settings, with their fallbacks."""
    x = F.expr(_SAID)
    return _orders(spark, sf_dir).select("o_orderkey", rq.parse_boolean(x).alias("flag"), rq.parse_integer(x, 9).alias("number"), F.array_join(rq.parse_list(x, ["a", "b"]), "|").alias("items"), F.array_join(rq.parse_lengths(x).cast("array<string>"), "|").alias("lengths"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'media' WHEN event_id % 4 = 1 THEN 'command' ELSE 'ignored' END AS route FROM events WHERE event_id % 7 <> 0 AND event_id % 3 <> 0 AND (user_id % 5 = 1 OR user_id % 5 = 2)""")
def incoming_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of allowed groups, by route."""
    i, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf_dir, "events").select("event_id", (i % 7 == 0).alias("from_me"), F.concat(u % 5, F.when(i % 3 == 0, "@c.us").otherwise("@g.us")).alias("chat"), F.when(u % 5 == 2, " Team ").otherwise("x").alias("chat_name"), (F.col("event_type") == "error").alias("has_media"), F.when(i % 4 == 1, "!recibo status").otherwise("hello").alias("body"))
    return rq.incoming(rows, ["1@g.us"], ["TEAM"], "!recibo").select("event_id", "route")


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) SELECT event_id, user_id FROM m WHERE i <= 60 AND ts::DATE = (SELECT max(ts)::DATE FROM events) AND event_id % 2 = 0""")
def messages_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group's last messages, those of the last day with media."""
    events = table(spark, sf_dir, "events").withColumns({"id": F.col("event_id"), "has_media": F.col("event_id") % 2 == 0})
    day = events.agg(F.to_date(F.max("ts")).alias("d")).first()["d"]
    return rq.of_day(events, "user_id", 60, F.lit(day)).select("event_id", "user_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'own' WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 40)::VARCHAR END AS scope, o_orderkey % 7 <> 0 AND o_orderkey % 4 <> 1 AND o_orderkey % 9 <> 0 AND o_orderkey % 2 = 0 AS found,
  CASE WHEN o_orderkey % 4 = 1 THEN 'disabled' WHEN o_orderkey % 7 = 0 THEN 'none' WHEN o_orderkey % 4 = 2 THEN 'mock' ELSE 'auto' END AS mode,
  CASE WHEN o_orderkey % 7 = 0 THEN 'missing_invoice_number' WHEN o_orderkey % 4 = 1 THEN 'lookup_disabled' WHEN o_orderkey % 9 = 0 THEN 'lookup_error' WHEN o_orderkey % 2 = 0 THEN 'invoice_found' ELSE 'invoice_not_found' END AS reason FROM orders""")
def lookup_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company scopes, and outcomes of lookups by mode."""
    key = F.col("o_orderkey")
    rows = _orders(spark, sf_dir).select("o_orderkey", F.when(key % 3 == 0, "own").alias("company_id"), F.when(key % 3 == 1, F.concat(F.lit(" C"), key % 40)).when(key % 3 == 2, "none").alias("company_code"))
    companies = table(spark, sf_dir, "customer").where("c_custkey < 40").select(F.col("c_custkey").alias("id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("code"))
    out = rq.lookup_outcome(F.when(key % 4 == 1, "Disabled").when(key % 4 == 2, "mock"), F.when(key % 7 != 0, "NF 12"), key % 2 == 0, F.when(key % 9 == 0, "boom"))
    return rq.company_scope(rows, companies).select("o_orderkey", "scope", out.alias("l")).select("o_orderkey", "scope", "l.*")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN lpad(o_orderkey::VARCHAR, 7, '0') END AS number, CASE WHEN o_orderkey % 4 = 0 THEN '01/02/2026' END AS date, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 4 = 0 END AS header_detected, CASE o_orderkey % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 0.25e0 WHEN 2 THEN 0e0 END AS confidence,
  CASE o_orderkey % 5 WHEN 0 THEN 'Nao foi possivel analisar a imagem enviada.' WHEN 2 THEN CASE o_orderkey % 3 WHEN 0 THEN 'Nao consegui confirmar a DATA DE RECEBIMENTO. Reenvie uma foto mais nitida dessa parte do canhoto.' WHEN 1 THEN 'Nao consegui confirmar o bloco NF-e. Reenvie uma foto mais centralizada e sem cortes.' ELSE 'Nao consegui validar o canhoto com seguranca. Reenvie uma foto mais nitida e centralizada.' END
    WHEN 3 THEN 'A imagem nao trouxe os campos minimos do canhoto. Reenvie uma foto com DATA DE RECEBIMENTO, EMITENTE e NF-e visiveis.' WHEN 4 THEN 'Fundo muito claro. Por favor, coloque o canhoto sobre uma superficie escura e envie outra foto.' END AS reply,
  CASE WHEN o_orderkey % 6 = 0 THEN 'extracted' WHEN o_orderkey % 6 < 4 THEN 'parsed' ELSE 'none' END AS way, CASE WHEN o_orderkey % 2 = 0 THEN 'success' ELSE 'unknown' END AS status FROM orders""")
def provider_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of models' replies, messages to senders, and what providers' results are taken as."""
    key = F.col("o_orderkey")
    number = F.lpad(key.cast("string"), 7, "0")
    reply = F.when(key % 4 == 0, F.format_string('```json\n{"invoiceNumber": "NF %s", "receiptDate": " 01/02/2026", "issuerHeaderDetected": true, "confidence": 3}\n```', number)).when(key % 4 == 1, F.format_string('{"invoiceNumber": "%s", "confidence": 0.25}', number)).when(key % 4 == 2, '{"notes": "x"}').otherwise("sorry")
    name = F.when(key % 5 == 1, "valid").when(key % 5 == 2, "review").when(key % 5 > 2, "invalid")
    why = F.when(key % 5 == 4, F.array(F.lit("Fundo muito claro."))).when(key % 3 == 0, F.array(F.lit("x"), F.lit("DATA DE RECEBIMENTO nao"))).when(key % 3 == 1, F.array(F.lit("Campo NF-e nao")))
    rows = _orders(spark, sf_dir).select("o_orderkey", rq.reply_payload(reply).alias("p"), rq.reply_message(name, why, "EMITENTE").alias("reply"), rq.attempt(F.when(key % 2 == 0, "success"), F.lit(None).cast("string"), F.when(key % 6 == 0, "d"), F.when(key % 6 < 4, "o")).alias("a"))
    return rows.select("o_orderkey", "p.number", "p.date", "p.header_detected", "p.confidence", "reply", "a.way", "a.status")


_USE = "(o_orderkey % 2 = 1 AND o_orderkey % 7 <> 0 AND (o_orderkey % 3 = 0 OR ((o_orderkey % 101) / 100e0 >= 0.64 AND o_orderkey % 5 = 0)))"


@query(f"""SELECT o_orderkey, o_orderkey % 2 = 0 OR {_USE} AS found, CASE WHEN {_USE} THEN 'fuzzy__fallback' ELSE 'own' END AS method, CASE WHEN {_USE} THEN (o_orderkey % 101) / 100e0 ELSE 0.5e0 END AS confidence, CASE WHEN {_USE} THEN 'orientation_probe_fallback' END AS source,
  CASE WHEN {_USE} THEN CASE WHEN o_orderkey % 5 = 0 THEN 'regiao_esperada,' ELSE 'x,' END || 'fallback_probe_orientacao' END AS reasons FROM orders""")
def probe_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that only the orientation probe saw."""
    key = F.col("o_orderkey")
    probe = F.when(key % 7 != 0, F.struct((key % 3 == 0).alias("found"), F.lit("fuzzy").alias("method"), ((key % 101) / 100).alias("confidence"), F.array(F.when(key % 5 == 0, "regiao_esperada").otherwise("x")).alias("reasons")))
    rows = _orders(spark, sf_dir).select("o_orderkey", rq.with_probe(key % 2 == 0, F.lit("own"), F.lit(0.5), probe, "nfe").alias("f"))
    return rows.select("o_orderkey", "f.found", "f.method", "f.confidence", "f.source", F.array_join("f.reasons", ",").alias("reasons"))


_TEXT = "CASE WHEN turn % 3 = 0 THEN '' ELSE text END"


@query(f"""WITH e AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN text ELSE '' END AS normal, CASE WHEN turn % 3 = 0 THEN text ELSE text END AS raw FROM conversations), n AS (SELECT *, {noise('raw')} AS clean FROM e)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'i' || turn ELSE 'full_' || turn END AS id, CASE WHEN turn % 5 = 0 THEN 'L' WHEN turn % 2 = 0 THEN 'i' || turn ELSE 'full_' || turn END AS label, md5(clean) AS normal_md5, md5({search('clean')}) AS search_md5,
  CASE WHEN len(clean) > 220 THEN trim(left(clean, 220)) || '...' ELSE clean END AS preview, len(list_filter(string_split_regex(raw, '\\r?\\n'), lambda x: {noise('x')} <> '')) AS lines, CASE WHEN turn % 4 = 0 THEN 'meta' WHEN turn % 4 = 1 THEN 'own' END AS region FROM n""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in one shape."""
    k = F.col("turn")
    s = lambda n, of, v: F.when(k % n == of, v)
    e = rq.evidence_row(s(2, 0, F.concat(F.lit("i"), k)), F.lit(None).cast("string"), F.concat(F.lit("full_"), k), s(5, 0, F.lit("L")), F.lit(None).cast("double"), F.expr(_TEXT), s(3, 0, F.col("text")), s(4, 1, F.lit("own")), s(4, 0, F.lit("meta")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", e.alias("e"))
    return rows.select("conv_id", "turn", "e.id", "e.label", F.md5(F.col("e.normal").cast("binary")).alias("normal_md5"), F.md5(F.col("e.searchable").cast("binary")).alias("search_md5"), "e.preview", F.size("e.lines").cast("long").alias("lines"), "e.region")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'given:0.5' ELSE 'a ' || o_orderkey || ':' || CASE WHEN o_orderkey % 2 = 0 THEN '0.8' ELSE '0.45' END || '|b:' || CASE WHEN o_orderkey % 2 = 0 THEN '0.8' ELSE '0.45' END END AS lines,
  'NF ' || o_orderkey || ':' || CASE WHEN o_orderkey % 2 = 0 THEN '0.7' ELSE '0.75' END AS words, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS points, 'x:' || CASE WHEN o_orderkey % 5 = 0 THEN '1.0' ELSE '0.0' END AS tuples FROM orders""")
def recognised_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, words, polygons and tuples of recognisers, in one shape each."""
    key = F.col("o_orderkey")
    none = F.array().cast("array<struct<text:string,confidence:double>>")
    told = lambda rows: F.array_join(F.transform(rows, lambda r: F.concat(r["text"], F.lit(":"), F.round(r["confidence"], 4).cast("string"))), "|")
    given = F.when(key % 3 == 0, F.array(F.struct(F.lit("given").alias("text"), F.lit(0.5).alias("confidence")))).otherwise(none)
    lines = rq.recognised_lines(given, F.concat(F.lit("a  "), key, F.lit("\r\n\nb")), F.when(key % 2 == 0, 80.0))
    word = lambda c, *x: F.struct(F.array(*x).alias("symbols"), c.alias("confidence"))
    words = rq.paragraph_lines(F.array(F.array(word(F.lit(0.9), F.lit("N"), F.lit("F")), word(F.when(key % 2 == 0, 0.5), F.lit(""), key.cast("string")), word(F.lit(0.1), F.lit(""))), F.array(word(F.lit(0.1), F.lit("")))))
    point = lambda x: F.struct(x.alias("x"), F.lit(1.0).alias("y"))
    empty = F.array().cast("array<struct<x:double,y:double>>")
    pts = rq.polygon(F.when(key % 4 == 0, F.array(point(F.lit(1.0)), point(F.lit(2.0)))).otherwise(empty), F.when(key % 4 == 1, F.array(point(F.lit(1.0)), point(F.lit(float("nan"))))), F.when(key % 4 == 2, F.array(point(F.lit(3.0)))))
    tuples = rq.recognised_tuples(F.array(F.array(F.lit("box"), F.lit(" x "), F.when(key % 5 == 0, "7").otherwise("-1")), F.array(F.lit("box"), F.lit("short")), F.array(F.lit("b"), F.lit(" "), F.lit("1"))))
    return _orders(spark, sf_dir).select("o_orderkey", told(lines).alias("lines"), told(words).alias("words"), F.size(pts).cast("long").alias("points"), told(tuples).alias("tuples"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'g' || o_orderkey WHEN 1 THEN 'c' || o_orderkey END AS group_id, CASE o_orderkey % 4 WHEN 0 THEN 't' WHEN 1 THEN 'k' WHEN 2 THEN 'b' END AS text, CASE WHEN o_orderkey % 5 = 0 THEN 'base' ELSE 'cand' END AS nf, CASE WHEN o_orderkey % 5 = 0 THEN 'roi' WHEN o_orderkey % 2 = 0 THEN 'roi' ELSE 'support' END AS origin,
  CASE o_orderkey % 3 WHEN 0 THEN lpad((o_orderkey % 999999)::VARCHAR, 6, '1') || ',' || lpad((o_orderkey % 9999999)::VARCHAR, 7, '2') WHEN 1 THEN lpad((o_orderkey % 9999999)::VARCHAR, 7, '2') ELSE '' END AS numbers FROM orders""")
def aliases_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata under one name, extractions with a candidate over them, numbers of plain texts."""
    key = F.col("o_orderkey")
    entry = lambda n, of, k, v: F.struct(F.when(key % n == of, k).alias("key"), v.alias("value"))
    meta = F.map_from_entries(F.filter(F.array(entry(3, 0, "groupId", F.concat(F.lit("g"), key)), entry(3, 1, "chatId", F.concat(F.lit(" c"), key)), entry(4, 0, "text", F.lit("t")), entry(4, 1, "caption", F.lit("k ")), entry(4, 2, "body", F.lit("b"))), lambda e: e["key"].isNotNull()))
    row = lambda nf, origin: F.struct(F.lit(nf).alias("nf"), F.lit(0.5).alias("confidence"), F.lit("m").alias("method"), origin.alias("origin"))
    own, other = row("base", F.lit("roi")), F.when(key % 5 != 0, row("cand", F.when(key % 2 != 0, "support")))
    six, seven = F.lpad((key % 999999).cast("string"), 6, "1"), F.lpad((key % 9999999).cast("string"), 7, "2")
    text = F.when(key % 3 == 0, F.concat(seven, F.lit(" e a NF-e: "), six)).when(key % 3 == 1, F.concat(F.lit("12345 "), seven, F.lit(" 1234567890"))).otherwise("none 12")
    rows = _orders(spark, sf_dir).select("o_orderkey", rq.aliased(meta).alias("m"), rq.hydrated(own, other).alias("h"), F.array_join(rq.script_numbers(text), ",").alias("numbers"))
    return rows.select("o_orderkey", "m.group_id", "m.text", "h.nf", "h.origin", "numbers")


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS q, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, list_sum(q) / n AS mean, q[floor((n - 1) * 0.5e0 + 0.5)::INT + 1] AS median, q[floor((n - 1) * 0.9e0 + 0.5)::INT + 1] AS p90 FROM s""")
def shapes_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and places of small sets of numbers."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return rows.select("l_orderkey", rq.shape(F.col("q")).alias("s")).select("l_orderkey", "s.*")
