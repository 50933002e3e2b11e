"""Queries of lookups: confirmation, rescue, rerank, captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import rerank
from evidentia.plans.base import query, table

_CANDIDATES = """c0 AS (SELECT l_orderkey AS doc, lpad(CAST(l_partkey AS STRING), 7, '0') AS nf, max(l_discount * 9.9e0) AS confidence, max(l_linenumber) % 3 AS support_count, max(l_suppkey) % 3 AS roi_support_count, max(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS precision_score,
  max(l_quantity) > 25 AS found_nfe, max(l_extendedprice) > 60000 AS found_number, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 AS clean, max(l_linestatus) = 'O' AS roi FROM lineitem GROUP BY l_orderkey, l_partkey),
c AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY confidence DESC, nf) AS rank FROM c0)"""
_REFERENCE = "ref AS (SELECT lpad(CAST(p_partkey AS STRING), 7, '0') AS key FROM part WHERE p_partkey % 3 = 0)"
_CURRENT = "cur AS (SELECT doc, CASE WHEN doc % 4 = 0 THEN NULL ELSE nf END AS nf, CASE WHEN doc % 4 = 0 THEN NULL ELSE confidence END AS confidence FROM c WHERE rank = 1)"
_CONTEXT = "(found_nfe OR found_number)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.lpad(F.col("l_partkey").cast("string"), 7, "0").alias("nf")).agg(
        F.max(F.col("l_discount") * 9.9).alias("confidence"), (F.max("l_linenumber") % 3).alias("support_count"), (F.max("l_suppkey") % 3).alias("roi_support_count"), F.max((F.col("l_tax") > 0.07).cast("int")).alias("precision_score"),
        (F.max("l_quantity") > 25).alias("found_nfe"), (F.max("l_extendedprice") > 60000).alias("found_number"), F.array(F.max(F.when(F.col("l_returnflag") == "A", "up__document_ink_clean").otherwise("gray"))).alias("variants"),
        F.array(F.lit("full")).alias("source_types"), F.when(F.max("l_linestatus") == "O", "roi").otherwise("support").alias("origin"), F.lit("window_context").alias("method"), F.array(F.lit("padrao_direto")).alias("reasons"),
    )
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("confidence"), "nf")))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("key"))


_RESCUE = f"""w AS (SELECT * FROM c WHERE rank <= 6), m AS (SELECT doc, max(confidence) AS best FROM w GROUP BY doc), e AS (SELECT w.*, {_CONTEXT} AS context FROM w JOIN m USING (doc) WHERE confidence >= greatest(0.35e0, best - 0.15e0) AND roi AND (clean OR NOT {_CONTEXT})),
n AS (SELECT DISTINCT ON (doc, near) doc, near, confidence, nf FROM (SELECT *, unnest(list_concat(list_transform(range(1, 8), lambda i: CASE WHEN nf[i] IN ('5', '8') THEN nf[1:i - 1] || translate(nf[i], '58', '85') || nf[i + 1:] END),
  list_transform(range(1, 7), lambda i: CASE WHEN confidence < 0.82 AND NOT context AND nf[i] <> nf[i + 1] THEN nf[1:i - 1] || nf[i + 1] || nf[i] || nf[i + 2:] END))) AS near FROM e) WHERE near IS NOT NULL ORDER BY doc, near, rank),
r AS (SELECT doc, any_value(near) AS nf, any_value(greatest(0.45e0, confidence - 0.04e0)) AS confidence FROM n JOIN ref ON near = key GROUP BY doc HAVING count(*) = 1)"""


@query(f"WITH {_CANDIDATES}, {_REFERENCE}, {_RESCUE} SELECT doc, nf, confidence, 'db_fuzzy_rescue' AS method, 'padrao_direto,fuzzy_rescue_confirmado_no_banco' AS reasons FROM r")
def fuzzy_rescues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents one of whose candidates' neighbours is known."""
    return rerank.fuzzy_rescue(candidates(spark, sf_dir).where("rank <= 6"), reference(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


_CONFIRMED = f"k AS (SELECT DISTINCT ON (doc) doc, nf, confidence, confidence >= 0.55 OR support_count >= 2 OR roi_support_count >= 2 OR precision_score > 0 OR {_CONTEXT} AS strong FROM c JOIN ref ON nf = key WHERE rank <= 6 ORDER BY doc, clean DESC, confidence DESC, support_count DESC, roi_support_count DESC, nf)"


@query(f"WITH {_CANDIDATES}, {_REFERENCE}, {_CONFIRMED} SELECT * FROM k")
def confirmed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best known candidate of each document."""
    return rerank.confirmed(candidates(spark, sf_dir).where("rank <= 6"), reference(spark, sf_dir)).select("doc", "nf", "confidence", "strong")


@query(f"""WITH {_CANDIDATES}, {_REFERENCE}, {_CURRENT}, {_CONFIRMED}, {_RESCUE}, v AS (SELECT cur.doc, bool_or(coalesce(c.nf <> cur.nf AND c.confidence >= cur.confidence - 0.05e0, false)) AS rival FROM cur JOIN c USING (doc) GROUP BY ALL),
j AS (SELECT cur.doc, cur.nf, cur.confidence, coalesce(cur.confidence, 0) AS conf, cur.nf IN (SELECT key FROM ref) AND cur.nf IS NOT NULL AS found, rival, k.nf AS knf, k.confidence AS kc, strong, r.nf AS rnf, r.confidence AS rc FROM cur JOIN v USING (doc) LEFT JOIN k USING (doc) LEFT JOIN r USING (doc)),
w2 AS (SELECT *, CASE WHEN found AND conf >= 0.9 AND NOT rival THEN 'kept' WHEN rnf IS NOT NULL AND (knf IS NULL OR (kc < 0.5 AND rc >= kc + 0.04e0)) THEN 'rescued' WHEN knf IS NOT NULL AND knf <> coalesce(nf, '') AND CASE WHEN found THEN kc >= conf - 0.04e0 ELSE nf IS NULL OR kc >= conf - 0.08e0 OR (kc >= conf - 0.16e0 AND strong) END THEN 'confirmed' ELSE 'kept' END AS way FROM j)
SELECT doc, CASE way WHEN 'rescued' THEN rnf WHEN 'confirmed' THEN knf ELSE nf END AS nf, CASE way WHEN 'rescued' THEN rc WHEN 'confirmed' THEN kc ELSE confidence END AS confidence, CASE way WHEN 'rescued' THEN 'db_fuzzy_rescue' WHEN 'confirmed' THEN 'window_context' ELSE 'best' END AS method, way, way <> 'kept' OR coalesce(found, false) AS found FROM w2""")
def lookup_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reference makes of each document's key."""
    rows = candidates(spark, sf_dir)
    own = F.col("doc") % 4 != 0
    current = rows.where("rank = 1").select("doc", F.when(own, F.col("nf")).alias("nf"), F.when(own, F.col("confidence")).alias("confidence"), F.lit("best").alias("method"))
    return rerank.rerank(current, rows, reference(spark, sf_dir))


_CAPTION = "CASE WHEN o_orderkey % 2 = 0 THEN 'nota ' || lpad(CAST(o_orderkey % 3000 AS STRING), 7, '0') ELSE '' END"
_BODY = "lpad(CAST(o_custkey AS STRING), 7, '0') || ' e 99'"


@query(f"""WITH {_REFERENCE}, d AS (SELECT o_orderkey AS doc, lpad(CAST(o_orderkey % 2000 AS STRING), 7, '0') AS nf, {_CAPTION} AS a, {_BODY} AS b, CASE o_orderkey % 3 WHEN 0 THEN 'valid' ELSE 'review' END AS class FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, NULL, {_CAPTION}, {_BODY}, 'invalid' FROM orders WHERE o_orderkey % 5 = 0),
l AS (SELECT *, nf IN (SELECT key FROM ref) AND nf IS NOT NULL AS found FROM d), x AS (SELECT *, list_filter(regexp_extract_all(a || '|' || b, '[0-9]+'), lambda v: len(v) = 7) AS named FROM l WHERE NOT (coalesce(found, false) AND class = 'valid')),
u AS (SELECT DISTINCT doc, unnest(named) AS key FROM x), h AS (SELECT x.doc, any_value(u.key) AS key FROM x JOIN u USING (doc) JOIN ref ON ref.key = u.key WHERE u.key <> coalesce(x.nf, '') GROUP BY x.doc HAVING count(*) = 1),
f AS (SELECT x.*, key, class = 'valid' OR (doc % 7 <> 0 AND doc % 3 <> 1) AS approved FROM x JOIN h USING (doc))
SELECT doc, key AS nf, nf AS original_nf, CASE WHEN nf IS NULL THEN 'message_text_rescue' ELSE 'line+message_text_rescue' END AS method, CASE WHEN approved THEN 'valid' ELSE 'review' END AS class, len(list_distinct(named)) AS named,
  'old|NF ' || key || ' recuperada pela legenda da mensagem.' || CASE WHEN nf IS NULL THEN '' ELSE ' OCR original leu ' || nf || '.' END || CASE WHEN approved THEN '|NF recuperada pela legenda da mensagem com os demais campos validados na imagem.' ELSE '' END AS reasons FROM f""")
def caption_rescues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose captions name exactly one other known key."""
    k = F.col("o_orderkey")
    none = k % 5 == 0
    rows = table(spark, sf_dir, "orders").select(
        k.alias("doc"), F.when(~none, F.lpad((k % 2000).cast("string"), 7, "0")).alias("nf"), F.expr(_CAPTION).alias("a"), F.expr(_BODY).alias("b"), F.when(none, "invalid").when(k % 3 == 0, "Valid").otherwise("review").alias("class"),
        F.when(~none, "line").alias("method"), F.array(F.lit("old")).alias("reasons"), (k % 7 != 0).alias("date_found"), F.lit(True).alias("header_found"), F.when(k % 3 == 1, F.array(F.lit("date"))).otherwise(F.array(F.lit("number"))).alias("missing"), F.lit(0.9).alias("average"),
    )
    ref = reference(spark, sf_dir)
    rows = rows.join(ref.select(F.col("key").alias("nf"), F.lit(True).alias("lookup_found")), "nf", "left")
    out = rerank.caption_rescue(rows, ref, ["a", "b"])
    return out.select("doc", "nf", "original_nf", "method", "class", "named", F.array_join("reasons", "|").alias("reasons"))
