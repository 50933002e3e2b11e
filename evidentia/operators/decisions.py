"""Scores and decisions on documents: structure, class, operational decision, provider chain, sync and alerts.

All are expressions over a row; columns of a document: date_found, date_conf, header_found, header_conf, nfe_found,
nfe_conf, nf, nf_conf, support_count, source_types, template_matched, geometry_score, lookup_found, lookup_reason, ocr_conf.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions import text as t
from evidentia.functions.scoring import r2
from evidentia.operators.rules import ladder, reasons

# Thresholds.
VALID_SCORE, REVIEW_SCORE, VALID_NF, FALLBACK_FIELD = 74, 46, 0.82, 0.72
GEOMETRY, TEMPLATE_SCORE, HARD_REJECT, RETRY_SCORE, TIE_GAP = 0.5, 58, 0.4, 62, 6
# Weights of the date, the header and the number's label.
WEIGHTS = {"date": 22, "header": 12, "nfe": 24}
# Messages; {header} and {company} are the profile's.
TEXTS = {
    "dark": "Fundo muito claro. Por favor, coloque o canhoto sobre uma superficie escura.",
    "geometry": "A geometria do canhoto ficou abaixo do minimo para seguir com OCR confiavel.",
    "all_fields": "Os tres campos estruturais foram localizados e a NF foi extraida com confianca suficiente.",
    "fallback": "Fallback aplicado: DATA DE RECEBIMENTO e NF-e estavam legiveis, com NF extraida de forma confiavel.",
    "header_partial": "{header} ficou parcial ou encoberto, mas a estrutura restante sustentou a aprovacao.",
    "database": "{header} ficou parcial ou encoberto, mas a NF extraida existe na base de {company}.",
    "database_origin": "A origem do canhoto foi confirmada pela consulta da NF no banco, mantendo DATA DE RECEBIMENTO e NF-e como ancoras estruturais.",
    "structural": "A NF extraida foi confirmada na base de {company} e o bloco NF-e ficou legivel o bastante para fechamento automatico.",
    "structural_geometry": "O canhoto manteve geometria util, mesmo sem todos os labels textuais fecharem por OCR.",
    "review_no_nf": "A estrutura do canhoto apareceu parcialmente, mas a NF nao foi extraida com seguranca suficiente.",
    "review_ambiguous": "A NF foi localizada, mas ainda ha ambiguidade residual na leitura estrutural da imagem.",
    "review_weak": "Ha indicios estruturais bons, mas falta confianca para aprovar automaticamente o canhoto.",
    "review_header": "O campo {header} nao ficou legivel o bastante para fechar a aprovacao automatica.",
    "invalid_structure": "A foto nao apresentou estrutura suficiente do canhoto para leitura confiavel.",
    "invalid_fields": "Os campos principais e a NF nao atingiram o minimo de confianca exigido.",
    "no_date": "DATA DE RECEBIMENTO nao foi localizada com seguranca.",
    "no_nfe": "Campo NF-e nao foi localizado com seguranca.",
    "no_template": "O template fixo do canhoto nao foi confirmado com seguranca suficiente.",
    "no_nf": "A rotina de extracao da NF nao encontrou um numero plausivel e consistente.",
    "nf_weak": "A NF encontrada ainda esta abaixo da confianca desejada para aprovacao automatica.",
    "origin_lookup": "A consulta no banco confirmou que a NF pertence a {company}, mesmo com o cabecalho parcialmente coberto.",
    "not_in_base": "A NF extraida nao foi encontrada na base de {company} para servir como confirmacao adicional.",
    "low_average": "Confianca media abaixo do minimo para aprovacao automatica.",
    "header_allowed": "Cabecalho ausente, mas permitido pela politica do documento.",
    "soft": "Aprovado com um unico campo textual ausente porque os demais campos vieram fortes na imagem.",
}
# Reasons that a lone missing date gives, and reasons that don't stand against it.
MISSING_DATE = ("campo obrigatorio ausente: data de recebimento.", "data de recebimento nao foi localizada com seguranca.")
HARMLESS = (TEXTS["review_weak"].lower(), TEXTS["review_ambiguous"].lower())


def _is(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _num(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _unit(c: str) -> Column:
    return t.unit_confidence(F.col(c))


def _has_nf() -> Column:
    return F.coalesce("nf", F.lit("")) != ""


def structure() -> Column:
    """(status, can_fall_back, hard_reject): whether a document's structure is usable, for review or invalid."""
    n = sum((_is(f"{k}_found").cast("int") for k in WEIGHTS), F.lit(0))
    template, geometry = _is("template_matched") | (_num("template_score") >= TEMPLATE_SCORE), _num("geometry_score")
    reject = geometry < HARD_REJECT
    usable = (_is("date_found") & _is("nfe_found")) | (n >= 2) | (template & _is("nfe_found"))
    status = ladder((reject, "invalid"), (usable, "usable"), (template | (geometry >= GEOMETRY) | (n >= 1) | (_num("ocr_conf") >= 28), "review"), default="invalid")
    return F.struct(status.alias("status"), (~reject & ((status != "invalid") | (template & _is("date_found")))).alias("can_fall_back"), reject.alias("hard_reject"))


def business_score() -> Column:
    """Total and its parts, and which ways to approval are open."""
    date, header, nfe, nf_conf = _is("date_found"), _is("header_found"), _is("nfe_found"), _unit("nf_conf")
    # fixed values: points of the number, the template and of what agrees
    parts = {k: r2(F.lit(float(w)) * _unit(f"{k}_conf")) for k, w in WEIGHTS.items()}
    parts["number"] = F.when(_has_nf(), r2(nf_conf * 34)).otherwise(r2(F.least(nf_conf, F.lit(0.45)) * 10))
    parts["template"] = F.when(_is("template_matched"), 8.0).otherwise(r2(F.least(F.lit(1.0), _num("geometry_score")) * 8))
    regional = F.coalesce(F.exists("source_types", lambda x: x.isin("field_region", "region")), F.lit(False))
    points = ((date, 2), (nfe, 2), (date & nfe, 2), (date & header & nfe, 3), (_has_nf() & (_num("support_count") >= 2), 2), (regional, 1))
    parts["consistency"] = F.least(F.lit(12.0), sum((F.when(h, float(p)).otherwise(0.0) for h, p in points), F.lit(0.0)))
    total = r2(sum(parts.values(), F.lit(0.0)))
    solid, geometry, looked_up = _has_nf() & (nf_conf >= VALID_NF), _num("geometry_score") >= GEOMETRY, _is("lookup_found")
    fallback = date & nfe & _is("template_matched") & (_unit("date_conf") >= FALLBACK_FIELD) & (_unit("nfe_conf") >= FALLBACK_FIELD) & solid
    database = date & nfe & geometry & solid & (_num("support_count") >= 2) & looked_up
    structural = nfe & geometry & _has_nf() & (nf_conf >= 0.6) & looked_up
    return F.struct(total.alias("total"), *[v.alias(k) for k, v in parts.items()], fallback.alias("fallback"), database.alias("database"), structural.alias("structural"), (date & header & nfe).alias("all_fields"), solid.alias("strong_nf"))


def classify(header: str, company: str, score: str = "score", status: str = "status", hard_reject: str = "hard_reject") -> Column:
    """(class, way, reasons, actions, reply) from the document's columns, its business_score() and structure()."""
    s = lambda k: F.col(f"{score}.{k}")
    says = lambda k: TEXTS[k].format(header=header, company=company)
    usable, total, n = F.col(status) != "invalid", s("total"), sum((_is(f"{k}_found").cast("int") for k in WEIGHTS), F.lit(0))
    template = _is("template_matched")
    way = ladder(
        (_is(hard_reject), "rejected"),
        (template & s("strong_nf") & (s("all_fields") | s("fallback")) & (total >= VALID_SCORE) & usable, "template"),
        (s("database") & s("strong_nf") & (total >= VALID_SCORE) & usable, "database"),
        (s("structural") & (total >= max(60, REVIEW_SCORE)) & usable, "structural"),
        (usable | (total >= REVIEW_SCORE) | template | (n >= 1) | _has_nf() | (_num("ocr_conf") >= 35), "review"),
        default="unreadable",
    )
    name = F.when(way.isin("template", "database", "structural"), "valid").when(way == "review", "review").otherwise("invalid")
    sure = s("all_fields") | s("fallback")
    why = reasons(
        (way == "rejected", says("dark")), (way == "rejected", says("geometry")),
        ((way == "template") & s("all_fields"), says("all_fields")), ((way == "template") & ~s("all_fields"), says("fallback")), ((way == "template") & ~s("all_fields"), says("header_partial")),
        (way == "database", says("database")), (way == "database", says("database_origin")), (way == "structural", says("structural")), (way == "structural", says("structural_geometry")),
        ((way == "review") & ~_has_nf(), says("review_no_nf")), ((way == "review") & _has_nf() & sure, says("review_ambiguous")), ((way == "review") & _has_nf() & ~sure, says("review_weak")),
        ((way == "review") & ~_is("header_found"), says("review_header")), (way == "unreadable", says("invalid_structure")), (way == "unreadable", says("invalid_fields")),
        (~_is("date_found"), says("no_date")), (~_is("nfe_found"), says("no_nfe")), (~template, says("no_template")), (~_has_nf(), says("no_nf")),
        (_has_nf() & (_unit("nf_conf") < VALID_NF), says("nf_weak")), (_is("lookup_found") & ~template, says("origin_lookup")),
        (~(_is("lookup_found") & ~template) & (F.col("lookup_reason") == "invoice_not_found") & _has_nf(), says("not_in_base")),
    )
    # fixed values: names of actions
    actions = F.when(name == "valid", F.array(F.lit("seguir_para_integracao_api"))).when(way == "review", F.array(F.lit("revisar_manual"), F.lit("avaliar_nova_foto")))
    actions = actions.when(way == "rejected", F.array(F.lit("solicitar_fundo_escuro"), F.lit("responder_no_whatsapp"))).otherwise(F.array(F.lit("solicitar_novo_envio"), F.lit("responder_no_whatsapp")))
    return F.struct(name.alias("class"), way.alias("way"), why.alias("reasons"), actions.alias("actions"), (name != "valid").alias("reply"))


def operational(fields: dict[str, str], valid: float = 0.82, review: float = 0.58, invalid_from: int = 2, one_missing: bool = True, field_least: float = 0.78, average_least: float = 0.74, headless: bool = False, trigger: tuple[str, ...] = ("number", "date"), trigger_below: float = 0.72) -> Column:
    """(class, reasons, soft, trigger) of parsed fields number, date and header, given by their labels.

    Columns: <field>_found, <field>_conf and average."""
    found = {k: _is(f"{k}_found") for k in fields}
    average = _unit("average")
    needed = [k for k in fields if not (k == "header" and headless)]
    missing = sum(((~found[k]).cast("int") for k in needed), F.lit(0))
    strong = lambda k: found[k] & (_unit(f"{k}_conf") >= field_least)
    alone = sum(((~found[k]).cast("int") for k in fields), F.lit(0)) == 1
    other = F.when(~found["date"], strong("header")).otherwise(strong("date"))
    soft = F.lit(one_missing) & alone & found["number"] & (average >= average_least) & strong("number") & other
    good = ((missing == 0) & (average >= valid) & (found["header"] | F.lit(headless))) | soft
    name = ladder((good, "valid"), (missing >= invalid_from, "invalid"), default="review")
    # fixed values: the reason for a missing field
    why = [(~found[k], f"Campo obrigatorio ausente: {fields[k]}.") for k in needed]
    why += [((name == "review") & (average < review), TEXTS["low_average"]), (~found["header"] & F.lit(headless), TEXTS["header_allowed"]), (soft, TEXTS["soft"])]
    lacking = F.lit(False)
    for k in trigger:
        lacking = lacking | ~found[k]
    return F.struct(name.alias("class"), reasons(*why).alias("reasons"), soft.alias("soft"), (lacking | (average < trigger_below)).alias("trigger"))


def provider_chain(attempts: Column, legacy: bool = True) -> Column:
    """The attempt that counts, of an array of (kind, provider, status, class, trigger) in the order they would run; kinds: primary, fallback, legacy.

    The primary stands if nothing triggers a fallback and it is valid (or no legacy way is open); else the first fallback that isn't invalid, the first
    legacy success, the first success at all, the last attempt."""
    won = lambda a, kind: (a["kind"] == kind) & (a["status"] == "success")
    allowed = attempts if legacy else F.filter(attempts, lambda a: a["kind"] != "legacy")
    first = lambda keep: F.get(F.filter(allowed, keep), F.lit(0))
    stands = first(lambda a: won(a, "primary") & ~a["trigger"] & ((a["class"] == "valid") | F.lit(not legacy)))
    return F.coalesce(stands, first(lambda a: won(a, "fallback") & (a["class"] != "invalid")), first(lambda a: won(a, "legacy")), first(lambda a: a["status"] == "success"), F.try_element_at(allowed, F.lit(-1)))


def sync_action(mode: Column) -> Column:
    """(type, reason, upload) from nf, class and lookup_found (null: not looked up)."""
    m = F.coalesce(F.nullif(F.lower(F.trim(mode)), F.lit("")), F.lit("mock"))
    key, cls = t.business_key(F.col("nf")), F.coalesce(F.nullif(F.lower(F.trim("class")), F.lit("")), F.lit("invalid"))
    reason = ladder(
        (m == "disabled", "sync_disabled"), (key == "", "missing_nf"), (F.col("lookup_found") == F.lit(False), "invoice_not_found"), (cls == "review", "manual_review_required"),
        (cls != "valid", "invalid_receipt"), (m == "alerts_only", "valid_without_backend_update"), (m == "full", "upload_and_mark_delivered"), default="mark_delivered_only",
    )
    kind = F.when(reason.isin("sync_disabled", "valid_without_backend_update"), "none").when(reason.isin("upload_and_mark_delivered", "mark_delivered_only"), "mark_delivered").otherwise("alert")
    return F.struct(kind.alias("type"), reason.alias("reason"), (reason == "upload_and_mark_delivered").alias("upload"))


def alert(source_label: Column) -> Column:
    """(code, severity, message) for a document that isn't delivered."""
    key = t.business_key(F.col("nf"))
    code = ladder((key == "", "RECEIPT_UNREADABLE_IMAGE"), (F.col("lookup_found") == F.lit(False), "NF_NOT_FOUND_UPLOAD_ATTEMPT"), (F.lower("class") == "review", "RECEIPT_MANUAL_REVIEW_REQUIRED"), default="RECEIPT_UNREADABLE_IMAGE")
    # fixed values: alerts' messages
    message = (
        F.when(key == "", F.format_string("O bot recebeu uma imagem em %s, mas nao conseguiu identificar a NF.", source_label))
        .when(code == "NF_NOT_FOUND_UPLOAD_ATTEMPT", F.format_string("A NF %s foi lida em %s, mas nao existe na base operacional da empresa.", key, source_label))
        .when(code == "RECEIPT_MANUAL_REVIEW_REQUIRED", F.format_string("O bot leu a NF %s em %s, mas a imagem ainda exige revisao manual.", key, source_label))
        .otherwise(F.format_string("O bot recebeu uma imagem em %s, mas nao conseguiu validar o canhoto com seguranca.", source_label))
    )
    return F.struct(code.alias("code"), F.when(code == "NF_NOT_FOUND_UPLOAD_ATTEMPT", "CRITICAL").otherwise("WARNING").alias("severity"), message.alias("message"))


def dedupe_key(code: Column, message_id: Column) -> Column:
    """'' unless both are given."""
    c, m = F.upper(F.trim(t.text(code))), F.trim(t.text(message_id))
    return F.when((c == "") | (m == ""), "").otherwise(F.concat_ws(":", F.lit("receipt-whatsapp"), c, m))


def missing_date_only(why: Column) -> Column:
    """Whether reasons speak of a missing date and else of nothing that matters."""
    said = F.filter(F.transform(why, lambda r: F.lower(F.trim(r))), lambda r: r != "")
    return F.coalesce(F.forall(said, lambda r: r.isin(*MISSING_DATE, *HARMLESS)) & F.exists(said, lambda r: r.isin(*MISSING_DATE)), F.lit(False))


def promotion(lengths: tuple[int, ...] = (7,)) -> Column:
    """Why a document for review becomes valid (class, reasons, nf, lookup_found, trip_id, trip_note_id), or null."""
    routed = (_num("trip_id") != 0) | (_num("trip_note_id") != 0)
    open_ = (F.lower("class") == "review") & _is("lookup_found") & routed & F.length(t.business_key(F.col("nf"))).isin(*lengths)
    return F.when(open_, F.when(missing_date_only(F.col("reasons")), "missing_receipt_date_only").otherwise("matched_route_assignment"))


def caption_approves() -> Column:
    """Whether a key found in the caption makes a document valid: it is already, or only the key was missing."""
    only = F.forall(F.coalesce("missing", F.array().cast("array<string>")), lambda k: k == "number")
    return (F.lower("class") == "valid") | (_is("date_found") & _is("header_found") & only & (_num("average") >= 0.82))


def template_score() -> Column:
    """(score, matched) from geometry_score, header_conf, date_conf, nfe_conf and nfe_found."""
    g, h, d, n = (_num(c) for c in ("geometry_score", "header_conf", "date_conf", "nfe_conf"))
    # fixed values: weights and what matches
    score = r2(g * 38 + h * 22 + d * 18 + n * 22 + F.when(_is("nfe_found"), 6.0).otherwise(0.0))
    matched = ((g >= 0.52) & (n >= 0.55)) | ((score >= 58) & (g >= 0.5)) | ((g >= 0.56) & (h >= 0.48) & (d >= 0.42))
    return F.struct(score.alias("score"), matched.alias("matched"))


def orientation_score(template: Column) -> Column:
    """The template's score with those of the key, the alignment and suspicions."""
    marked = (_num("dark_ratio") >= 0.78) & (_num("row_coverage") >= 0.88) & (_num("column_coverage") >= 0.9)
    return r2(template + _num("nf_conf") * 6 + r2(_num("alignment_quality") * 16) - F.when(_is("suspicious_warp"), 8.0).otherwise(0.0) - F.when(marked, 6.0).otherwise(0.0))


def second_probe(best: Column, runner_up: Column, fast: bool = False) -> Column:
    """Whether the best orientation (score, matched, nf_conf), or null, needs another probe."""
    if fast:
        needs = (best["score"] < RETRY_SCORE - 8) | (~best["matched"] & (best["nf_conf"] < 0.7))
    else:
        needs = (best["score"] < RETRY_SCORE) | ~best["matched"] | F.coalesce(best["score"] - runner_up["score"] < TIE_GAP, F.lit(False))
    return best.isNull() | F.coalesce(needs, F.lit(True))
