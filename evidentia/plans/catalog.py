"""Queries of the library over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import dates, scoring
from evidentia.functions import text as t
from evidentia.operators import fields, jobs, keys, ranking, rules, windows
from evidentia.plans.base import ORACLE_SQL, QUERIES, noise, query, search
from evidentia.plans.base import table as _table

@query(f"SELECT doc_id, md5({search('text')}) AS searchable_md5, len({search('text')}) AS n FROM documents")
def text_searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise repair, accents, case and punctuation."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", t.searchable(F.col("text")).alias("s"))
    return docs.select("doc_id", F.md5(F.col("s").cast("binary")).alias("searchable_md5"), F.length("s").cast("long").alias("n"))


@query("SELECT doc_id, regexp_replace(text, '[^0-9]+', '', 'g') AS digits, coalesce(nullif(regexp_replace(text, '[^0-9]+', '', 'g'), ''), trim(text)) AS business_key FROM documents")
def text_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits, and the key of each text: its digits, else itself."""
    return _table(spark, sf_dir, "documents").select("doc_id", t.digits_only(F.col("text")).alias("digits"), t.business_key(F.col("text")).alias("business_key"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words, len(regexp_replace(text, '\\s', '', 'g')) AS chars, left(text, 320) AS preview FROM documents")
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t.statistics(F.col("text"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return rows.select("doc_id", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("lines", "words", "chars")], F.col("s.preview").alias("preview"))


_A, _B = search("p_name"), search("p_brand || ' ' || p_type")


@query(f"SELECT p_partkey, levenshtein({_A}, {_B}) AS distance, round(1 - levenshtein({_A}, {_B}) / greatest(len({_A}), len({_B}))::DOUBLE, 4) AS similarity FROM part")
def fuzzy_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance and similarity of each part's name and its brand and type."""
    a, b = F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type")
    return _table(spark, sf_dir, "part").select("p_partkey", F.levenshtein(t.searchable(a), t.searchable(b)).cast("long").alias("distance"), scoring.similarity(a, b).alias("similarity"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence made from orders: their key in a text, every fifth key with its fourth and fifth digit swapped."""
    k = F.lpad(F.col("o_orderkey").cast("string"), 7, "0")
    swapped = F.concat(F.substring(k, 1, 3), F.substring(k, 5, 1), F.substring(k, 4, 1), F.substring(k, 6, 2))
    k = F.when(F.col("o_orderkey") % 5 == 0, swapped).otherwise(k)
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("NF-e "), k, F.lit(" SERIE 1")).alias("text"), F.col("o_orderpriority").alias("source"), (F.col("o_totalprice") / 1000000).alias("confidence"))
    return rows


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 7, "0").alias("key"), F.col("o_orderstatus").alias("status"), F.lit(True).alias("found"))


_EVIDENCE = """e AS (SELECT o_orderkey AS doc, 'NF-e ' || CASE WHEN o_orderkey % 5 = 0 THEN k[1:3] || k[5] || k[4] || k[6:7] ELSE k END || ' SERIE 1' AS text,
  o_orderpriority AS source, o_totalprice / 1000000 AS confidence, o_orderstatus FROM (SELECT *, lpad(o_orderkey::VARCHAR, 7, '0') AS k FROM orders)),
c AS (SELECT doc, regexp_extract(text, '([0-9]{7})', 1) AS key, source, confidence FROM e),
ref AS (SELECT lpad(o_orderkey::VARCHAR, 7, '0') AS key, o_orderstatus AS status FROM orders)"""


@query(f"WITH {_EVIDENCE} SELECT c.doc, c.key, ref.status, ref.key IS NOT NULL AS found, CASE WHEN ref.key IS NULL THEN 'invoice_not_found' ELSE 'invoice_found' END AS reason FROM c LEFT JOIN ref ON ref.key = c.key")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from text, looked up in bulk."""
    found = keys.candidates(_evidence(spark, sf_dir), "doc", "text").select("doc", "key")
    return keys.lookup(found, _reference(spark, sf_dir)).select("doc", "key", "status", "found", "reason")


@query(f"""WITH {_EVIDENCE},
m AS (SELECT doc, key FROM c WHERE key NOT IN (SELECT key FROM ref)),
n AS (SELECT DISTINCT doc, CASE WHEN i <= 6 THEN key[1:i - 1] || key[i + 1] || key[i] || key[i + 2:7] ELSE key[1:i - 7] || translate(key[i - 6], '85', '58') || key[i - 5:7] END AS near, key FROM m, range(1, 14) r(i)),
h AS (SELECT n.doc, n.near FROM n JOIN ref ON ref.key = n.near WHERE n.near <> n.key)
SELECT doc, min(near) AS rescued FROM h GROUP BY doc HAVING count(*) = 1""")
def key_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys not found, with exactly one neighbour that is."""
    found = keys.candidates(_evidence(spark, sf_dir), "doc", "text").select("doc", "key")
    reference = _reference(spark, sf_dir)
    return keys.unique_rescue(found.join(reference, "key", "left_anti"), reference, "doc")


@query("""WITH f AS (SELECT l_orderkey AS doc, lpad(l_partkey::VARCHAR, 7, '0') AS key, l_discount AS confidence, l_returnflag AS source FROM lineitem),
g AS (SELECT doc, key, max(confidence) AS confidence, count(*) AS support, count(DISTINCT source) AS sources FROM f GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY doc ORDER BY confidence DESC, sources DESC, support DESC, key) AS rank FROM g""")
def key_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus over evidence, ranked."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lpad(F.col("l_partkey").cast("string"), 7, "0").alias("key"), F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("source"))
    return keys.consensus(rows, "doc")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders) WHERE i = 1")
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.latest(_table(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no returned line reports yet."""
    done = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return keys.unseen(_table(spark, sf_dir, "orders"), done, "o_orderkey").select("o_orderkey", "o_custkey")


@query("""SELECT user_id, arg_max(event_type, event_id) AS status, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS events,
  array_to_string(list_reverse(list(event_type ORDER BY event_id DESC)[1:40]), ',') AS tail FROM events GROUP BY user_id""")
def job_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States from events, with the latest 40 of them."""
    return jobs.fold_events(_table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "ts").withColumn("tail", F.array_join("tail", ","))


@query("SELECT user_id FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-02-02 00:00:00' - INTERVAL 72 HOUR")
def job_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    return jobs.expired(states, "updated_at", "2024-02-02 00:00:00", 72).select("user_id")


@query("SELECT event_type, count(*) AS n, round(avg(value), 2) AS mean_value, max(value) AS max_value, round(count(*) / sum(count(*)) OVER (), 4) AS rate FROM events GROUP BY event_type")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.report(_table(spark, sf_dir, "events"), "event_type", "value")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'valid' WHEN o_orderstatus = 'P' OR o_totalprice > 150000 THEN 'review' ELSE 'invalid' END AS class,
  array_to_string(list_filter([CASE WHEN o_totalprice <= 300000 THEN 'low_total' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders""")
def rule_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by the first rule that holds, and all reasons."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    cls = rules.ladder((price > 300000, "valid"), ((status == "P") | (price > 150000), "review"), default="invalid")
    why = rules.reasons((price <= 300000, "low_total"), (status == "P", "pending"), (F.startswith("o_orderpriority", F.lit("1")), "urgent"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", cls.alias("class"), F.array_join(why, ",").alias("reasons"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, (1000 * pow(2, (json_extract_string(props, '$.k')::BIGINT % 5)))::BIGINT AS delay_ms FROM events")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return _table(spark, sf_dir, "events").select("event_id", k.alias("k"), dates.retry_delay_ms(k % 5 + 1, 500).alias("delay_ms"))


_DAY = "try_cast({y} || '-' || {m} || '-' || {d} AS DATE) IS NOT NULL"
_SIX = "(" + _DAY.format(y="'20' || {x}[5:6]", m="{x}[3:4]", d="{x}[1:2]") + " OR " + _DAY.format(y="'20' || {x}[1:2]", m="{x}[3:4]", d="{x}[5:6]") + ")"
_EIGHT = "(" + _DAY.format(y="{x}[5:8]", m="{x}[3:4]", d="{x}[1:2]") + " OR " + _DAY.format(y="{x}[1:4]", m="{x}[5:6]", d="{x}[7:8]") + ")"


@query(f"""WITH d AS (SELECT o_orderkey, lpad((o_orderkey * 7919 % 1000000)::VARCHAR, 6, '0') AS a, lpad((o_orderkey * 104729 % 40000000)::VARCHAR, 8, '0') AS b FROM orders)
SELECT o_orderkey, {_SIX.format(x='a')} AS six, {_EIGHT.format(x='b')} AS eight FROM d""")
def compact_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which digit runs can be dates."""
    run = lambda by, over, n: F.lpad((F.col("o_orderkey") * by % over).cast("string"), n, "0")
    return _table(spark, sf_dir, "orders").select("o_orderkey", dates.is_compact_date(run(7919, 1000000, 6)).alias("six"), dates.is_compact_date(run(104729, 40000000, 8)).alias("eight"))


@query("SELECT l_suppkey, count(*) AS n, list_sort(list(l_quantity))[greatest(1, ceil(count(*) * 0.9)::INT)] AS p90 FROM lineitem GROUP BY l_suppkey")
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rank among each supplier's quantities, from their counts."""
    return ranking.nearest_rank(_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", 0.9).select("l_suppkey", "n", F.col("value").alias("p90"))


@query("SELECT DISTINCT ON (user_id, event_type) event_id, user_id, event_type FROM events ORDER BY user_id, event_type, event_id")
def alert_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").withColumn("dedupe_key", F.concat_ws(":", "user_id", "event_type"))
    return keys.deduplicate_open(rows, "dedupe_key", F.col("event_id")).select("event_id", "user_id", "event_type")


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: {noise('x')}), lambda x: x <> '') AS ls, {noise('text')} AS whole FROM documents),
w AS (SELECT DISTINCT doc_id, unnest(list_concat(flatten(list_transform(range(1, len(ls) + 1), lambda i: [ls[i], array_to_string(ls[i:i + 1], ' '), array_to_string(ls[greatest(i - 1, 1):i], ' '), array_to_string(ls[greatest(i - 1, 1):i + 1], ' ')])), [whole])) AS raw FROM l),
s AS (SELECT doc_id, raw, {search('raw')} AS searchable FROM w)
SELECT doc_id, count(*) AS n, md5(array_to_string(list(md5(raw || chr(9) || searchable) ORDER BY md5(raw || chr(9) || searchable)), '')) AS windows_md5 FROM s WHERE searchable <> '' GROUP BY doc_id""")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each document's windows of lines, what they show and what is searchable of them."""
    hashed = F.transform("w", lambda w: F.md5(F.concat_ws("\t", w["raw"], w["searchable"]).cast("binary")))
    rows = _table(spark, sf_dir, "documents").select("doc_id", windows.line_windows(F.col("text")).alias("w")).where(F.size("w") > 0)
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join(F.array_sort(hashed), "").cast("binary")).alias("windows_md5"))


@query(f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all({noise('text')}, '[0-9]{{8,11}}')) AS r FROM documents),
d AS (SELECT doc_id, unnest(list_transform(range(1, len(r) - 5), lambda i: substr(r, i, 7))) AS digits FROM r)
SELECT doc_id, digits, count(*) AS n FROM d GROUP BY ALL""")
def digit_runs_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of seven digits of longer runs."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(windows.sliding_digits(F.col("text"))).alias("digits"))
    return rows.groupBy("doc_id", "digits").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_orderkey, l_quantity::DOUBLE AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS i FROM lineitem)
SELECT l_orderkey, max(q) AS best, max(q) - max(q) FILTER (i = 2) AS gap FROM r WHERE i <= 2 GROUP BY l_orderkey""")
def tie_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead of the best over the runner-up."""
    return ranking.tie_gap(_table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("q")), "l_orderkey", "q")


@query("""WITH g AS (SELECT l_orderkey, l_partkey, max(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY ALL)
SELECT *, EXISTS (SELECT 1 FROM g b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey <> a.l_partkey AND b.q >= a.q - 5) AS competes FROM g a""")
def competing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with another one close behind or ahead."""
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max(F.col("l_quantity").cast("double")).alias("q"))
    return ranking.competing(rows, "l_orderkey", "l_partkey", "q", 5)


@query(f"SELECT page_id, array_to_string(list_filter(['data', 'the', 'page', 'recebimento'], lambda w: contains({search('html')}, w)), ',') AS words FROM pages")
def html_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each page holds."""
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(fields.markers(F.col("html"), ("data", "the", "page", "recebimento")), ",").alias("words"))


from evidentia.plans import date_queries, decision_queries, evidence_queries, lookup_queries, pixel_queries, region_queries, report_queries, request_queries, sync_queries, text_queries  # noqa: E402, F401  their queries register themselves


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of extracted keys, and rescue of those that aren't found."""
    return key_lookup(spark, sf_dir).join(key_rescue(spark, sf_dir), "doc", "left")
