"""Ranked keys against a reference: confirmation, fuzzy rescue, rerank and caption rescue.

Candidates have a row for each document and key: doc, rank, nf, confidence, support_count, roi_support_count,
precision_score, found_nfe, found_number, variants, source_types, origin, method and reasons.  The reference has one
row a key.  All lookups are joins on the key; what is grouped by document is at most TOP candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as t
from evidentia.operators.decisions import caption_approves

# Candidates that are looked up, and margins of confidence.
TOP, VALID, SURE, NEAR, STEP, PROMOTE, PROMOTE_STRONG = 6, 0.82, 0.9, 0.05, 0.04, 0.08, 0.16
# The least confidence for a rescue, how far behind the best it may be, the rescued key's least confidence, and a confirmed key too weak to stand against one.
RESCUE_LEAST, RESCUE_BEHIND, RESCUED_LEAST, CONFIRMED_WEAK, STRONG = 0.35, 0.15, 0.45, 0.5, 0.55
RESCUE_METHOD, RESCUE_REASON, CAPTION_METHOD = "db_fuzzy_rescue", "fuzzy_rescue_confirmado_no_banco", "message_text_rescue"
CLEAN_VARIANTS = "ink_clean_rescue|document_ink_clean"


def _clean() -> Column:
    return F.coalesce(F.exists("variants", lambda v: v.rlike(CLEAN_VARIANTS)), F.lit(False))


def _context() -> Column:
    return F.coalesce(F.col("found_nfe"), F.lit(False)) | F.coalesce(F.col("found_number"), F.lit(False))


def eligible(candidates: DataFrame) -> DataFrame:
    """Candidates whose neighbours may be looked up: near the best, from a region, and of a clean variant or without context."""
    best = candidates.groupBy("doc").agg(F.max("confidence").alias("_best"))
    regional = (F.col("origin") == "roi") | F.coalesce(F.exists("source_types", lambda s: F.contains(s, F.lit("nf_roi"))), F.lit(False))
    near = F.col("confidence") >= F.greatest(F.lit(RESCUE_LEAST), F.col("_best") - RESCUE_BEHIND)
    return candidates.join(best, "doc").where(near & F.coalesce(regional, F.lit(False)) & (_clean() | ~_context())).drop("_best")


def tight_neighbours(key: Column, confidence: Column, context: Column) -> Column:
    """Keys one 8 for 5 or 5 for 8 away, and, of a weak key without context, one swap of different neighbours; in order."""
    n = F.length(key)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    at = lambda i: F.substring(key, i, F.lit(1))
    around = lambda i, k, mid: F.concat(F.substring(key, F.lit(1), i - 1), mid, F.substring(key, i + k, n))
    mixed = F.transform(places, lambda i: F.when(at(i).isin("5", "8"), around(i, 1, F.translate(at(i), "58", "85"))))
    swapped = F.transform(places, lambda i: F.when((i < n) & (at(i) != at(i + 1)), around(i, 2, F.concat(at(i + 1), at(i)))))
    weak = (confidence < VALID) & ~context
    return F.array_distinct(F.array_compact(F.concat(mixed, F.when(weak, swapped).otherwise(F.array().cast("array<string>")))))


def fuzzy_rescue(candidates: DataFrame, reference: DataFrame, key: str = "key") -> DataFrame:
    """The candidate with its neighbour's key, where exactly one neighbour of a document's candidates is known; the first owner of a neighbour counts."""
    rows = eligible(candidates).select("*", F.posexplode(tight_neighbours(F.col("nf"), F.col("confidence"), _context())).alias("_i", "_near"))
    owned = rows.groupBy("doc", "_near").agg(F.min_by(F.struct(*[c for c in candidates.columns if c != "doc"]), F.struct("rank", "_i")).alias("c"))
    hits = owned.join(reference.select(F.col(key).alias("_near")), "_near", "left_semi")
    one = hits.groupBy("doc").agg(F.count("*").alias("_n"), F.first("_near").alias("_near"), F.first("c").alias("c")).where("_n = 1")
    sure = F.greatest(F.lit(RESCUED_LEAST), F.col("c.confidence") - STEP)
    reasons = F.concat(F.coalesce(F.col("c.reasons"), F.array().cast("array<string>")), F.array(F.lit(RESCUE_REASON)))
    return one.select("doc", F.col("_near").alias("nf"), sure.alias("confidence"), F.lit(RESCUE_METHOD).alias("method"), reasons.alias("reasons"))


def confirmed(candidates: DataFrame, reference: DataFrame, key: str = "key") -> DataFrame:
    """The best known candidate of each document: clean variants first, then confidence, support, regions, and the least key."""
    known = candidates.join(reference.select(F.col(key).alias("nf")), "nf", "left_semi")
    order = F.struct((~_clean()).alias("c"), (-F.col("confidence")).alias("s"), (-F.col("support_count")).alias("n"), (-F.col("roi_support_count")).alias("r"), "nf")
    strong = (F.col("confidence") >= STRONG) | (F.col("support_count") >= 2) | (F.col("roi_support_count") >= 2) | (F.col("precision_score") > 0) | _context()
    best = known.groupBy("doc").agg(F.min_by(F.struct("nf", "confidence", "method", "reasons", strong.alias("strong")), order).alias("b"))
    return best.select("doc", "b.*")


def rerank(current: DataFrame, candidates: DataFrame, reference: DataFrame, key: str = "key") -> DataFrame:
    """(doc, nf, confidence, method, way, found): what each document's key becomes; way: kept, confirmed or rescued.

    current: doc, nf, confidence, method.  A known, sure key without a competitor stays; else the best known candidate may replace
    it, or, where none is known or it is weak, the one known neighbour."""
    known = reference.select(F.col(key).alias("nf")).distinct()
    few = candidates.where(F.col("rank") <= TOP)
    pairs = current.select("doc", F.col("nf").alias("_nf"), F.col("confidence").alias("_c")).join(candidates, "doc")
    rival = (F.col("nf") != F.col("_nf")) & (F.col("confidence") >= F.col("_c") - NEAR)
    rivals = pairs.groupBy("doc").agg(F.bool_or(F.coalesce(rival, F.lit(False))).alias("rival"))
    own = current.join(known.withColumn("found", F.lit(True)), "nf", "left").join(rivals, "doc", "left")
    prefixed = lambda df, p: df.select("doc", *[F.col(c).alias(p + c) for c in df.columns if c != "doc"])
    rows = own.join(prefixed(confirmed(few, known, "nf"), "c_"), "doc", "left").join(prefixed(fuzzy_rescue(few, known, "nf"), "r_"), "doc", "left")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    found, conf, nf = is_(F.col("found")), F.coalesce("confidence", F.lit(0.0)), F.coalesce("nf", F.lit(""))
    stands = F.col("rival").isNull() | (found & (conf >= SURE) & ~is_(F.col("rival")))
    better = is_((F.col("c_confidence") < CONFIRMED_WEAK) & (F.col("r_confidence") >= F.col("c_confidence") + STEP))
    rescued = F.col("r_nf").isNotNull() & (F.col("c_nf").isNull() | better)
    promoted = (nf == "") | (F.col("c_confidence") >= conf - PROMOTE) | ((F.col("c_confidence") >= conf - PROMOTE_STRONG) & F.col("c_strong"))
    replaced = F.col("c_nf").isNotNull() & (F.col("c_nf") != nf) & is_(F.when(found, F.col("c_confidence") >= conf - STEP).otherwise(promoted))
    way = F.when(stands, "kept").when(rescued, "rescued").when(replaced, "confirmed").otherwise("kept")
    of = lambda c: F.when(F.col("way") == "rescued", F.col("r_" + c)).when(F.col("way") == "confirmed", F.col("c_" + c)).otherwise(F.col(c))
    return rows.withColumn("way", way).select("doc", of("nf").alias("nf"), of("confidence").alias("confidence"), of("method").alias("method"), "way", ((F.col("way") != "kept") | found).alias("found"))


def caption_rescue(docs: DataFrame, reference: DataFrame, texts: list[str], key: str = "key", lengths: tuple[int, ...] = (7,)) -> DataFrame:
    """docs whose captions name exactly one known key other than their own, with nf, original_nf, method, reasons and class rewritten.

    docs: doc, nf, lookup_found, class, method, reasons, date_found, header_found, missing, average and the texts.  Valid documents with a known key are left out."""
    own = t.business_key(F.col("nf"))
    settled = (own != "") & F.coalesce(F.col("lookup_found"), F.lit(False)) & (t.class_name(F.col("class")) == "valid")
    named = t.digit_groups([F.col(c) for c in texts], lengths)
    rows = docs.where(~settled).withColumns({"_own": own, "_named": named})
    hits = rows.select("doc", F.explode(F.array_except("_named", F.array("_own"))).alias("_key")).join(reference.select(F.col(key).alias("_key")).distinct(), "_key", "left_semi")
    one = hits.groupBy("doc").agg(F.count("*").alias("_n"), F.first("_key").alias("_key")).where("_n = 1").drop("_n")
    rows = rows.join(one, "doc")
    other = (F.col("_own") != "") & (F.col("_own") != F.col("_key"))
    # fixed values: what the rewritten document says
    why = F.concat(F.format_string("NF %s recuperada pela legenda da mensagem.", "_key"), F.when(other, F.format_string(" OCR original leu %s.", "_own")).otherwise(""))
    approved = F.coalesce(caption_approves(), F.lit(False))
    reasons = F.array_compact(F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.array(why, F.when(approved, "NF recuperada pela legenda da mensagem com os demais campos validados na imagem."))))
    method = F.coalesce(F.concat(t.some(F.col("method")), F.lit("+" + CAPTION_METHOD)), F.lit(CAPTION_METHOD))
    return rows.select("doc", F.col("_key").alias("nf"), F.nullif("_own", F.lit("")).alias("original_nf"), method.alias("method"), F.array_distinct(reasons).alias("reasons"), F.when(approved, "valid").otherwise("review").alias("class"), F.size("_named").alias("named"))
