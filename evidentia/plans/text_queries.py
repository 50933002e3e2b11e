"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as t
from evidentia.plans.base import noise, query, search, table

_URL = search("url")


@query(f"""SELECT page_id, upper({_URL}) AS upper_text, array_to_string(string_split({_URL}, ' '), '|') AS tokens,
  CASE WHEN len({noise('url')}) > 30 THEN trim(left({noise('url')}, 30)) || '...' ELSE {noise('url')} END AS short,
  coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[\\\\/]+', '__', 'g'), '\\.[^.]*$', ''), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'image') AS stem,
  coalesce(nullif(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'none') AS segment,
  coalesce(nullif(regexp_replace(url, '[^0-9]+', '', 'g'), ''), trim(url)) AS business_key FROM pages""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper case, tokens, truncation, file stems and segments of addresses."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", t.upper_searchable(u).alias("upper_text"), F.array_join(t.search_tokens(u), "|").alias("tokens"), t.truncate_text(u, 30).alias("short"), t.file_stem(u).alias("stem"), t.segment(u, "none").alias("segment"), t.business_key(u).alias("business_key"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN value / 100 WHEN 2 THEN NULL WHEN 3 THEN -value ELSE 'nan'::DOUBLE END AS x FROM events)
SELECT event_id, CASE WHEN x IS NULL OR isnan(x) THEN 0.45 WHEN x > 1 THEN greatest(0.0, least(1.0, x / 100)) ELSE greatest(0.0, least(1.0, x)) END AS confidence FROM v""")
def unit_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares, percentages, nulls, negatives and what is no number."""
    k, v = F.col("event_id") % 5, F.col("value")
    x = F.when(k == 0, v).when(k == 1, v / 100).when(k == 3, -v).when(k == 4, F.lit(float("nan")))
    return table(spark, sf_dir, "events").select("event_id", t.unit_confidence(x, 0.45).alias("confidence"))


_CHAT = "CASE c_custkey % 4 WHEN 0 THEN c_custkey || '@c.us' WHEN 1 THEN c_custkey || '-7@g.us' WHEN 2 THEN c_custkey::STRING ELSE c_name END"
_BODY = "CASE c_custkey % 5 WHEN 0 THEN ' !Recibo  STATUS ' || c_custkey || '  now' WHEN 1 THEN '!recibo' WHEN 2 THEN c_name ELSE '!recibox ' || c_mktsegment END"
_FILE = "CASE c_custkey % 3 WHEN 0 THEN lpad(c_custkey::STRING, 7, '0') || '.JPG' WHEN 1 THEN lpad(c_custkey::STRING, 7, '1') ELSE c_name || '.png' END"


@query(f"""WITH m AS (SELECT c_custkey, {_CHAT} AS chat, trim({_BODY}) AS body, {_FILE} AS file, c_mktsegment FROM customer),
p AS (SELECT *, list_filter(string_split_regex(trim(substr(body, 8)), '\\s+'), lambda x: x <> '') AS words FROM m)
SELECT c_custkey, nullif(regexp_extract(chat, '^([0-9]+)(@|$)', 1), '') AS phone, suffix(trim(chat), '@g.us') AS is_group,
  CASE WHEN starts_with(lower(body), '!recibo') THEN coalesce(lower(words[1]), 'help') END AS command, CASE WHEN starts_with(lower(body), '!recibo') THEN array_to_string(words[2:], ',') END AS args,
  nullif(regexp_extract(lower(file), '^([0-9]{{7}})(\\.[a-z0-9]+)?$', 1), '') AS expected_key, starts_with(lower(c_mktsegment), 'image/') AS is_image FROM p""")
def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers, groups, commands and expected keys of messages made from customers."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_CHAT).alias("chat"), F.expr(_BODY).alias("body"), F.expr(_FILE).alias("file"), "c_mktsegment")
    c = t.command(F.col("body"), "!recibo")
    return rows.select("c_custkey", t.phone_digits(F.col("chat")).alias("phone"), t.is_group(F.col("chat")).alias("is_group"), c["name"].alias("command"), F.array_join(c["args"], ",").alias("args"), t.expected_key(F.col("file")).alias("expected_key"), t.is_image_type(F.col("c_mktsegment")).alias("is_image"))


_ORIGINAL = "CASE p_partkey % 4 WHEN 0 THEN 'dir.x/' || p_name || '.PNG' WHEN 1 THEN '.hidden' WHEN 2 THEN NULL ELSE p_type || '.tar.gz' END"
_TYPE = "CASE p_partkey % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'IMAGE/TIFF' WHEN 2 THEN 'image/heic' WHEN 3 THEN 'image/webp' WHEN 4 THEN NULL ELSE 'text/html' END"


@query(f"""WITH m AS (SELECT p_partkey, {_ORIGINAL} AS original, {_TYPE} AS type, p_name FROM part),
e AS (SELECT *, CASE WHEN p_partkey % 4 IN (0, 3) THEN lower(regexp_extract(original, '(\\.[^.]*)$', 1)) ELSE '' END AS ext FROM m)
SELECT p_partkey, CASE WHEN ext <> '' THEN ext WHEN lower(type) = 'image/png' THEN '.png' WHEN lower(type) = 'image/tiff' THEN '.tiff' WHEN type = 'image/webp' THEN '.webp' ELSE '.jpg' END AS extension,
  CASE ext WHEN '.png' THEN 'image/png' ELSE 'image/jpeg' END AS media_type,
  CASE p_partkey % 4 WHEN 0 THEN p_name || '.PNG' WHEN 1 THEN '.hidden' WHEN 3 THEN original ELSE regexp_replace(p_name, '[^a-zA-Z0-9_-]+', '_', 'g') || CASE type WHEN 'image/png' THEN '.png' WHEN 'image/heic' THEN '.heic' WHEN 'image/webp' THEN '.webp' ELSE '.jpg' END END AS file_name,
  CASE WHEN p_partkey % 6 IN (0, 1, 2, 3) THEN true ELSE false END AS is_image FROM e""")
def media_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions, media types and file names of parts' pictures."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_ORIGINAL).alias("o"), F.expr(_TYPE).alias("m"), "p_name")
    return rows.select("p_partkey", t.guess_extension(F.lit(None).cast("string"), F.col("o"), F.col("m")).alias("extension"), t.guess_media_type(F.col("o")).alias("media_type"), t.media_file_name(F.col("m"), F.col("o"), F.col("p_name"), F.lit(0)).alias("file_name"), t.is_image_type(F.col("m")).alias("is_image"))


_FENCED = "CASE conv_id % 4 WHEN 0 THEN '```JSON\n{' || text || '}\n```' WHEN 1 THEN '```\n' || text || '\n```' WHEN 2 THEN text ELSE '' END"


@query(f"""WITH m AS (SELECT conv_id, turn, text, {_FENCED} AS fenced FROM conversations)
SELECT conv_id, turn, md5(CASE conv_id % 4 WHEN 0 THEN '{{' || text || '}}' WHEN 1 THEN trim(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) WHEN 2 THEN trim(text) ELSE '' END) AS plain_md5,
  md5(CASE WHEN turn % 2 = 0 AND trim(text) <> '' THEN trim(text) ELSE array_to_string(list_filter([trim(text), 'b', 'c'], lambda x: x <> ''), chr(10)) END) AS output_md5 FROM m""")
def reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies without fences, and the text of nested outputs."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.expr(_FENCED).alias("fenced"))
    parts = F.array(F.array(F.col("text"), F.lit(" b ")), F.array(F.lit(" "), F.lit("c")))
    direct = F.when(F.col("turn") % 2 == 0, F.col("text"))
    return rows.select("conv_id", "turn", F.md5(t.strip_fences(F.col("fenced")).cast("binary")).alias("plain_md5"), F.md5(t.output_text(direct, parts).cast("binary")).alias("output_md5"))


@query("""SELECT page_id, array_to_string(list_transform(string_split(url || '/a b+c(d)!~*''é', '/'), lambda s: replace(replace(replace(replace(replace(replace(url_encode(s), '%21', '!'), '%2A', '*'), '%27', ''''), '%28', '('), '%29', ')'), '%7E', '~')), '/') AS path,
  trim(coalesce(nullif(CASE WHEN page_id % 2 = 0 THEN '' ELSE 'bot' END, ''), 'chat')) || CASE WHEN page_id % 3 = 0 THEN '' ELSE ':g' || page_id END AS label,
  CASE WHEN page_id % 3 = 0 THEN 'invalid' ELSE 'review' END AS class, CASE page_id % 3 WHEN 0 THEN 'r' || page_id WHEN 1 THEN 'f' || page_id ELSE 'job' || page_id END AS correlation,
  CASE page_id % 4 WHEN 0 THEN 'c' || page_id WHEN 1 THEN 'p' || page_id WHEN 2 THEN 'n' || page_id ELSE 'i' || page_id END AS sender,
  CASE page_id % 3 WHEN 0 THEN 'b' || page_id WHEN 1 THEN 'k' || page_id ELSE '' END AS said,
  'receipt-state:' || page_id AS state_key, '/jobs/queued/' || page_id || '.json' AS job_file, CASE WHEN page_id % 2 = 0 THEN 'http://x/' || page_id END AS link FROM pages""")
def names_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded paths, source labels, classes, ids, senders and store keys."""
    k = F.col("page_id")
    some = lambda n, of, prefix: F.when(k % n == of, F.concat(F.lit(prefix), k.cast("string")))
    blank = F.lit("  ")
    return table(spark, sf_dir, "pages").select(
        "page_id", t.url_path(F.concat("url", F.lit("/a b+c(d)!~*'é"))).alias("path"),
        t.source_label(F.when(k % 2 == 1, "bot"), F.lit("chat"), F.when(k % 3 != 0, F.concat(F.lit("g"), k.cast("string")))).alias("label"), t.class_name(F.when(k % 3 != 0, " Review ")).alias("class"),
        t.correlation_id(some(3, 0, " r"), some(3, 1, "f"), F.concat(F.lit("job"), k.cast("string"))).alias("correlation"),
        t.sender(F.coalesce(some(4, 0, "c"), blank), some(4, 1, "p"), some(4, 2, "n"), F.concat(F.lit("i"), k.cast("string"))).alias("sender"), t.message_text(some(3, 0, "b"), some(3, 1, "k "[:1]), F.lit(None)).alias("said"),
        t.state_key(k.cast("string")).alias("state_key"), t.job_path("/jobs/", F.lit("queued"), k.cast("string")).alias("job_file"), t.public_url(F.when(k % 2 == 0, "http://x//"), k.cast("string")).alias("link"),
    )


@query("""WITH m AS (SELECT o_orderkey, 'nota ' || lpad(o_orderkey::STRING, 7, '0') AS a, lpad((o_orderkey * 3)::STRING, 7, '0') || ' e ' || lpad(o_orderkey::STRING, 7, '0') || ' 12345' AS b FROM orders),
d AS (SELECT o_orderkey, list_filter(regexp_extract_all(a || ' | ' || b, '[0-9]+'), lambda x: len(x) = 7) AS found FROM m)
SELECT o_orderkey, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') AS groups FROM d""")
def message_digit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys in a message's texts, in order."""
    k = F.col("o_orderkey")
    pad = lambda x: F.lpad(x.cast("string"), 7, "0")
    found = t.digit_groups([F.concat(F.lit("nota "), pad(k)), F.concat_ws(" e ", pad(k * 3), F.concat(pad(k), F.lit(" 12345"))), F.lit(None)])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ",").alias("groups"))
