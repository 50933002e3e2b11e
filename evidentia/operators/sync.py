"""From analysed documents to what is written back: lookup, caption rescue, gate, promotion, action, and the tables that follow from it.

Documents: doc, nf, class, method, reasons, date_found, header_found, missing, average, the captions' texts, message_id and
source_label.  The reference has one row a key; deliveries have (key, trip_id, trip_note_id, driver_id, updated_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as t
from evidentia.operators import decisions as d
from evidentia.operators.reports import top_orientations
from evidentia.operators.rerank import caption_rescue

# Reasons of what is left alone, and of a document without a route.
NOT_OPERATIONAL, NO_ROUTE, ROUTED = "ignored_non_operational_invoice", "missing_route_assignment", "matched_route_assignment"
NO_ROUTE_TEXT = "A NF foi identificada, mas ainda nao esta vinculada a uma entrega/rota para validacao automatica."


def delivery_context(deliveries: DataFrame) -> DataFrame:
    """The latest delivery of each key."""
    best = F.max_by(F.struct("trip_id", "trip_note_id", "driver_id"), F.struct("updated_at", "trip_id"))
    return deliveries.groupBy(F.col("key").alias("_key")).agg(best.alias("_d")).select("_key", "_d.*")


def synchronised(docs: DataFrame, reference: DataFrame, deliveries: DataFrame, texts: list[str], mode: Column, lengths: tuple[int, ...] = (7,)) -> DataFrame:
    """docs with nf, class, method, reasons and lookup_found as they end, trip, promotion, and type, reason and upload of what is done."""
    known = reference.select(F.col("key").alias("_key"), F.lit(True).alias("_known"))
    rows = docs.withColumn("_key", t.business_key(F.col("nf")))
    rows = rows.join(known, "_key", "left").withColumn("lookup_found", F.when(F.col("_key") != "", F.coalesce("_known", F.lit(False)))).drop("_key", "_known")
    saved = caption_rescue(rows, reference, texts, lengths=lengths).select("doc", *[F.col(c).alias(f"_{c}") for c in ("nf", "class", "method", "reasons")])
    rows = rows.join(saved, "doc", "left")
    rescued = F.col("_nf").isNotNull()
    rows = rows.select("*", rescued.alias("rescued")).withColumns({**{c: F.when(rescued, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("nf", "class", "method", "reasons")}, "lookup_found": F.when(rescued, True).otherwise(F.col("lookup_found"))}).drop("_nf", "_class", "_method", "_reasons")
    rows = rows.withColumn("_key", t.business_key(F.col("nf"))).join(delivery_context(deliveries), "_key", "left")
    promoted = d.promotion(lengths)
    rows = rows.withColumn("promotion", promoted).withColumn("class", F.when(F.col("promotion").isNotNull(), "valid").otherwise(F.col("class")))
    rows = rows.withColumn("_s", d.sync_action(mode))
    odd = (F.col("_key") != "") & ~F.length("_key").isin(*lengths)
    routed = (F.coalesce("trip_id", F.lit(0)) != 0) | (F.coalesce("trip_note_id", F.lit(0)) != 0)
    delivered = F.col("_s.type") == "mark_delivered"
    kind = F.when(odd, "none").when(delivered & ~routed, "alert").otherwise(F.col("_s.type"))
    reason = F.when(odd, NOT_OPERATIONAL).when(delivered & ~routed, NO_ROUTE).otherwise(F.col("_s.reason"))
    more = F.when(delivered & ~routed & ~odd, F.array_distinct(F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.array(F.lit(NO_ROUTE_TEXT))))).otherwise(F.col("reasons"))
    return rows.withColumns({"type": kind, "reason": reason, "upload": F.col("_s.upload") & (kind == "mark_delivered"), "reasons": more}).drop("_s", "_key")


def status_updates(done: DataFrame) -> DataFrame:
    """(key, status): one row a key that is delivered."""
    return done.where("type = 'mark_delivered'").select(t.business_key(F.col("nf")).alias("key"), F.lit("delivered").alias("status")).distinct()


def alerts(done: DataFrame) -> DataFrame:
    """Alerts of documents that ask for one: one a dedupe key (the first document's), and all without one."""
    rows = done.where("type = 'alert'").withColumn("_a", d.alert(F.col("source_label")))
    unrouted = F.col("reason") == NO_ROUTE
    key = t.business_key(F.col("nf"))
    rows = rows.select(
        "doc", key.alias("nf"), F.when(unrouted, "RECEIPT_MANUAL_REVIEW_REQUIRED").otherwise(F.col("_a.code")).alias("code"), F.when(unrouted, "WARNING").otherwise(F.col("_a.severity")).alias("severity"),
        F.when(unrouted, F.concat(F.lit(NO_ROUTE_TEXT + " Grupo: "), "source_label", F.lit("."))).otherwise(F.col("_a.message")).alias("message"), "message_id",
    )
    rows = rows.withColumn("dedupe_key", d.dedupe_key(F.col("code"), F.col("message_id")))
    some = F.col("dedupe_key") != ""
    first = rows.where(some).groupBy("dedupe_key").agg(F.min_by(F.struct(*rows.columns), "doc").alias("r")).select("r.*")
    return first.unionByName(rows.where(~some))


def activities(done: DataFrame) -> DataFrame:
    """An activity for every delivered document."""
    return done.where("type = 'mark_delivered'").select("doc", t.business_key(F.col("nf")).alias("nf"), "message_id", "trip_id", "trip_note_id", "driver_id", F.col("class"), F.col("promotion").isNotNull().alias("promoted"), F.lit("mark_invoice_delivered").alias("action"))


def best_orientations(first: DataFrame, second: DataFrame, fast: bool = False) -> DataFrame:
    """The best orientation of each document: of the first probe's evaluations, or, where that is weak, of those of both probes.

    Evaluations: doc, orientation, score, matched, nf_conf; the second probe's replace the first's for their orientation."""
    ranked = top_orientations(first, "doc", 2)
    two = ranked.groupBy("doc").agg(*[F.max_by(F.struct("score", "matched", "nf_conf"), F.when(F.col("rank") == k, 1)).alias(f"_{k}") for k in (1, 2)])
    weak = two.where(d.second_probe(F.col("_1"), F.col("_2"), fast)).select("doc")
    tops = ranked.join(weak, "doc", "left_semi").select("doc", "orientation")
    again = second.join(tops, ["doc", "orientation"], "left_semi")
    both = first.join(again.select("doc", "orientation"), ["doc", "orientation"], "left_anti").unionByName(again.select(*first.columns))
    return top_orientations(both, "doc", 1).drop("rank").join(weak.withColumn("probed_again", F.lit(True)), "doc", "left").withColumn("probed_again", F.coalesce("probed_again", F.lit(False)))


def merged_phases(phases: list[DataFrame]) -> DataFrame:
    """Results of phases (doc, nf, confidence) by document: how many phases gave any, the number of results, and the best (of equals the earlier phase's, then the lesser number)."""
    rows = None
    for k, p in enumerate(phases):
        part = p.select("doc", "nf", "confidence", F.lit(k).alias("_p"))
        rows = part if rows is None else rows.unionByName(part)
    best = F.min_by("nf", F.struct((-F.col("confidence")).alias("c"), "_p", "nf"))
    return rows.groupBy("doc").agg(F.count_distinct("_p").alias("phases"), F.count("*").alias("results"), best.alias("nf"), F.max("confidence").alias("confidence"))


def checkpoints(header: str = "header") -> Column:
    """(failed, blocking, basis): checkpoints of a document that failed, of them those that block, and what an approval rests on."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    geometry = F.when(yes("hard_reject"), "failed").when(yes("template_matched") | (F.coalesce("geometry_score", F.lit(0.0)) >= 0.5), "passed").otherwise("warning")
    status = {
        "geometry": geometry, "date": F.when(yes("date_found"), "passed").otherwise("failed"), header: F.when(yes(f"{header}_found"), "passed").when(yes("lookup_found"), "fallback").otherwise("failed"),
        "nfe": F.when(yes("nfe_found"), "passed").otherwise("failed"), "number": F.when(F.coalesce("nf", F.lit("")) != "", "passed").otherwise("failed"), "lookup": F.when(yes("lookup_found"), "passed").otherwise("warning"),
    }
    of = lambda *kinds: F.array_compact(F.array(*[F.when(s.isin(*kinds), k) for k, s in status.items()]))
    blocking = F.array_compact(F.array(*[F.when(status[k] == "failed", k) for k in ("geometry", "nfe", "number")]))
    basis = F.when(F.coalesce(F.col("class") == "valid", F.lit(False)), F.when(yes("template_matched") & yes(f"{header}_found"), "template").when(yes("lookup_found"), "lookup").otherwise("fields"))
    return F.struct(of("failed").alias("failed"), blocking.alias("blocking"), basis.alias("basis"))


def debug_log() -> Column:
    """(level, message) of a document's steps, for a log: template, number, lookup, fields, class (fixed texts)."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    has = F.coalesce("nf", F.lit("")) != ""
    line = lambda level, message: F.struct(level.alias("level"), message.alias("message"))
    missing = F.coalesce(F.array_join("missing", ", "), F.lit(""))
    return F.array(
        line(F.when(yes("template_matched"), "success").otherwise("warning"), F.when(yes("template_matched"), "Template confirmado na imagem alinhada.").otherwise("Template ainda esta ambiguo ou parcialmente cortado.")),
        line(F.when(has, "success").otherwise("warning"), F.when(has, F.concat(F.lit("NF candidata extraida: "), "nf")).otherwise("Nenhuma NF confiavel foi extraida.")),
        line(F.when(yes("lookup_found"), "success").otherwise("info"), F.when(yes("lookup_found"), "NF confirmada no banco.").otherwise("NF nao confirmada no banco.")),
        line(F.when(missing != "", "warning").otherwise("success"), F.when(missing != "", F.concat(F.lit("Campos ausentes ou fracos: "), missing, F.lit("."))).otherwise("Todos os campos obrigatorios foram identificados.")),
        line(F.when(F.coalesce(F.col("class") == "valid", F.lit(False)), "success").otherwise("info"), F.concat(F.lit("Classificacao final: "), F.coalesce("class", F.lit("indefinida")), F.lit("."))),
    )
