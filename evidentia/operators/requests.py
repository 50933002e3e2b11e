"""Requests, messages and provider results as columns: coalescing by precedence, typed parsing, routing, and evidence in one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as t
from evidentia.operators.rules import ladder

# Headers that name a company, a source and a type, that carry a credential, and that identify a request.
COMPANY_HEADERS, SOURCE_HEADERS, TYPE_HEADERS = ("x-company-id", "x-company"), ("x-source-id", "x-source"), ("x-document-type",)
TOKEN_HEADERS, REQUEST_HEADERS = ("x-ingest-token", "x-api-key", "x-company-token"), ("x-request-id", "x-correlation-id")
TRUE, FALSE = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")
# Least confidence of a field that an orientation probe saw where it was expected, and what says that it came from there.
PROBE_LEAST = {"date": 0.55, "header": 0.58, "nfe": 0.64}
PROBE_REASON, PROBE_SOURCE = "fallback_probe_orientacao", "orientation_probe_fallback"


def metadata(x: Column) -> Column:
    """A JSON object as a map, an empty one for anything else."""
    return F.coalesce(F.when(F.startswith(F.trim(t.text(x)), F.lit("{")), F.from_json(x, "map<string,string>")), F.create_map().cast("map<string,string>"))


def headers(x: Column) -> Column:
    """Names in lower case; of names that then are equal the last one's value counts."""
    entries = F.map_entries(x)
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    kept = F.filter(F.transform(entries, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(names, e["i"] + 2, F.size(names)), e["key"]))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))


def _first(values: list[Column]) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def credentials(head: Column) -> Column:
    """Tokens of a request in order: the bearer's, then the headers'."""
    of = lambda k: F.trim(t.text(F.try_element_at(head, F.lit(k))))
    bearer = F.when(F.startswith(F.lower(of("authorization")), F.lit("bearer ")), F.trim(F.substring(of("authorization"), 8, 1 << 20))).otherwise("")
    return F.filter(F.array(bearer, *map(of, TOKEN_HEADERS)), lambda c: c != "")


def tenants(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """(request, company) of the first credential that any company has; companies in their order (ord).  tokens: company, ord, token."""
    asked = requests.select("request", F.posexplode(credentials(F.col("headers"))).alias("i", "token"))
    hits = asked.join(tokens.select(F.trim("token").alias("token"), "company", "ord"), "token")
    return hits.groupBy("request").agg(F.min_by("company", F.struct("i", "ord")).alias("tenant"))


def canonical(requests: DataFrame, tokens: DataFrame, company: str, source: str, kind: str) -> DataFrame:
    """Requests in one shape: payload before headers, metadata, credential and default.

    requests: request, company_id, source, document_type, request_id, source_hint, headers (map) and metadata (JSON)."""
    rows = requests.withColumns({"headers": headers(F.col("headers")), "metadata": metadata(F.col("metadata"))})
    rows = rows.join(tenants(rows, tokens), "request", "left")
    head = lambda names: [F.try_element_at("headers", F.lit(k)) for k in names]
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    return rows.select(
        "request", F.trim(_first([F.col("company_id"), *head(COMPANY_HEADERS), meta("companyId"), F.col("tenant"), F.lit(company)])).alias("company_id"),
        F.trim(_first([F.col("source"), F.col("source_hint"), *head(SOURCE_HEADERS), meta("source"), F.lit(source)])).alias("source"),
        F.trim(_first([F.col("document_type"), *head(TYPE_HEADERS), meta("documentType"), F.lit(kind)])).alias("document_type"), t.some(_first([F.col("request_id"), *head(REQUEST_HEADERS)])).alias("request_id"), "metadata",
    )


def resolved_profiles(companies: list[dict], sources: list[str], documents: dict[str, dict]) -> list[dict]:
    """Every (company, source, document type) that is configured, with the sections of its document overlaid by the company's binding.

    companies: id, sources, default, bindings {type: {profile, fields, <section>}}; documents {profile: {fields: {name: {..}}, <section>: {..}}}."""
    out = []
    for c in companies:
        for kind, binding in c["bindings"].items():
            base = documents.get(binding["profile"])
            if base is None:
                raise ValueError(f"{c['id']}: {kind} names no document profile")
            whole = {k: {**v, **binding.get(k, {})} for k, v in base.items() if k != "fields"}
            fields = {k: {**v, **binding.get("fields", {}).get(k, {})} for k, v in base["fields"].items()}
            out += [{"company": c["id"], "source": s, "document_type": kind, "default": kind == c.get("default"), "fields": fields, **whole} for s in sources if s in c["sources"]]
    return out


def with_profile(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests joined with the resolved profiles (company, source, document_type, ..); ``problem`` says what isn't configured.  There is a row for each configured triple, so the table is broadcast."""
    known = lambda *c: profiles.select(*c).distinct().withColumn(f"_{c[-1]}", F.lit(True))
    rows = requests.withColumnRenamed("company_id", "company")
    rows = rows.join(F.broadcast(known("company")), "company", "left").join(F.broadcast(known("company", "source")), ["company", "source"], "left").join(F.broadcast(profiles), ["company", "source", "document_type"], "left")
    problem = F.when(F.col("_company").isNull(), "company").when(F.col("_source").isNull(), "source").when(F.col("default").isNull(), "document")
    return rows.withColumn("problem", problem).drop("_company", "_source")


def parse_boolean(x: Column, fallback: bool = False) -> Column:
    s = F.lower(F.trim(t.text(x)))
    return F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False).otherwise(fallback)


def parse_integer(x: Column, fallback: int = 0) -> Column:
    """Truncated; '' counts as 0, as numbers' parsing elsewhere has it."""
    n = F.when(F.trim(t.text(x)) == "", 0.0).otherwise(F.trim(x).try_cast("double"))
    ok = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")) & x.isNotNull()
    return F.when(ok, F.when(n < 0, F.ceil(n)).otherwise(F.floor(n))).otherwise(fallback).cast("long")


def parse_list(x: Column, fallback: list[str]) -> Column:
    parts = F.filter(F.transform(F.split(t.text(x), ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(*map(F.lit, fallback)))


def parse_lengths(x: Column, fallback: tuple[int, ...] = (7,)) -> Column:
    numbers = F.filter(F.transform(F.split(t.text(x), ","), lambda s: F.trim(s).try_cast("double")), lambda n: F.coalesce(n > 0, F.lit(False)) & (n < 1e9))
    whole = F.transform(numbers, lambda n: F.floor(n).cast("int"))
    return F.when(F.size(whole) > 0, whole).otherwise(F.array(*map(F.lit, fallback)))


def allowed(chat: Column, name: Column, ids: list[str], names: list[str]) -> Column:
    """Whether a group is on a list by id or name; two empty lists allow all."""
    if not ids and not names:
        return F.lit(True)
    return F.coalesce(F.trim(t.text(chat)).isin(*ids) if ids else F.lit(False), F.lit(False)) | (F.lower(F.trim(t.text(name))).isin(*[n.lower() for n in names]) if names else F.lit(False))


def incoming(messages: DataFrame, ids: list[str], names: list[str], prefix: str) -> DataFrame:
    """Messages of allowed groups from others, with their route: media, command or ignored.  Works on streams, too."""
    rows = messages.where(~F.coalesce("from_me", F.lit(False)) & t.is_group(F.col("chat")) & allowed(F.col("chat"), F.col("chat_name"), ids, names))
    route = F.when(F.coalesce("has_media", F.lit(False)), "media").when(t.command(F.col("body"), prefix).isNotNull(), "command").otherwise("ignored")
    return rows.withColumn("route", route)


def of_day(messages: DataFrame, group: str, fetched: int, day: Column) -> DataFrame:
    """Of the last ``fetched`` messages of each group (50 at least), those of the day with media, in order of time.  The cut comes first, as a fetch does."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(F.desc("ts"), F.desc("id"))
    rows = messages.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= max(50, fetched)).drop("_i")
    return rows.where((F.to_date("ts") == day) & F.coalesce("has_media", F.lit(False)))


def company_scope(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """rows (company_id, company_code) with ``scope``: the id, else that of the code's company, else null: unscoped.  companies: id, code, one row a code."""
    known = companies.select(F.col("id").alias("_id"), F.lower(F.trim("code")).alias("_code"))
    out = rows.withColumn("_code", F.lower(t.some(F.col("company_code")))).join(known, "_code", "left")
    return out.withColumn("scope", F.coalesce(t.some(F.col("company_id")), F.col("_id").cast("string"))).drop("_id", "_code")


def lookup_outcome(mode: Column, number: Column, found: Column, error: Column) -> Column:
    """(found, mode, reason) of a lookup that may be disabled or fail."""
    key, m = t.business_key(number), F.coalesce(t.some(F.lower(mode)), F.lit("auto"))
    reason = ladder((key == "", "missing_invoice_number"), (m == "disabled", "lookup_disabled"), (error.isNotNull(), "lookup_error"), (found, "invoice_found"), default="invoice_not_found")
    return F.struct((reason == "invoice_found").alias("found"), F.when((key == "") & (m != "disabled"), "none").otherwise(m).alias("mode"), reason.alias("reason"))


def reply_payload(x: Column) -> Column:
    """(number, date, header_detected, header_text, confidence, notes) of a model's JSON reply, fenced or not; null where it is none."""
    raw = F.from_json(t.strip_fences(x), "struct<invoiceNumber:string,receiptDate:string,issuerHeaderDetected:string,issuerHeaderText:string,confidence:double,notes:string>")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw["confidence"], F.lit(0.0))))
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.trim(c))
    out = F.struct(F.when(F.coalesce(raw["invoiceNumber"], F.lit("")) != "", t.digits_only(raw["invoiceNumber"])).alias("number"), some(raw["receiptDate"]).alias("date"), F.coalesce(raw["issuerHeaderDetected"] == "true", F.lit(False)).alias("header_detected"), some(raw["issuerHeaderText"]).alias("header_text"), sure.alias("confidence"), some(raw["notes"]).alias("notes"))
    return F.when(F.startswith(t.strip_fences(x), F.lit("{")) & raw.isNotNull(), out)


def reply_message(name: Column, reasons: Column, header: str) -> Column:
    """What the sender is told; null for valid documents (fixed texts)."""
    says = lambda part: F.coalesce(F.exists(reasons, lambda r: F.contains(r, F.lit(part))), F.lit(False))
    return (
        F.when(name.isNull(), "Nao foi possivel analisar a imagem enviada.").when(name == "valid", None).when(says("Fundo muito claro"), "Fundo muito claro. Por favor, coloque o canhoto sobre uma superficie escura e envie outra foto.")
        .when((name == "review") & says("DATA DE RECEBIMENTO"), "Nao consegui confirmar a DATA DE RECEBIMENTO. Reenvie uma foto mais nitida dessa parte do canhoto.")
        .when((name == "review") & says("Campo NF-e"), "Nao consegui confirmar o bloco NF-e. Reenvie uma foto mais centralizada e sem cortes.")
        .when(name == "review", "Nao consegui validar o canhoto com seguranca. Reenvie uma foto mais nitida e centralizada.")
        .otherwise(f"A imagem nao trouxe os campos minimos do canhoto. Reenvie uma foto com DATA DE RECEBIMENTO, {header} e NF-e visiveis.")
    )


def attempt(status: Column, reason: Column, extracted: Column, recognised: Column) -> Column:
    """(status, reason, way): what a provider's result is taken as: a document as it is, text to parse, or nothing."""
    way = F.when(extracted.isNotNull(), "extracted").when(recognised.isNotNull(), "parsed").otherwise("none")
    return F.struct(F.coalesce(t.some(status), F.lit("unknown")).alias("status"), reason.alias("reason"), way.alias("way"))


def with_probe(found: Column, method: Column, confidence: Column, probe: Column, field: str) -> Column:
    """A field (found, method, confidence, source, reasons) that isn't found, from what the orientation probe saw (struct of found, confidence, method and reasons)."""
    seen = F.coalesce(probe["found"], F.lit(False)) | (F.coalesce(probe["confidence"] >= PROBE_LEAST[field], F.lit(False)) & F.coalesce(F.array_contains(probe["reasons"], "regiao_esperada"), F.lit(False)))
    use = ~F.coalesce(found, F.lit(False)) & probe.isNotNull() & seen
    why = F.concat(F.coalesce(probe["reasons"], F.array().cast("array<string>")), F.array(F.lit(PROBE_REASON)))
    return F.struct((use | F.coalesce(found, F.lit(False))).alias("found"), F.when(use, F.concat(F.coalesce(t.some(probe["method"]), F.lit("orientation_probe")), F.lit("__fallback"))).otherwise(method).alias("method"), F.when(use, probe["confidence"]).otherwise(confidence).alias("confidence"), F.when(use, PROBE_SOURCE).alias("source"), F.when(use, why).alias("reasons"))


def evidence_row(id_: Column, target: Column, fallback: Column, label: Column, confidence: Column, raw: Column, normal: Column, region: Column, meta_region: Column) -> Column:
    """Evidence in one shape: id, label, texts, lines, preview and region, with their fallbacks."""
    name = F.coalesce(F.nullif(id_, F.lit("")), F.nullif(target, F.lit("")), fallback)
    text = F.coalesce(F.nullif(raw, F.lit("")), F.nullif(normal, F.lit("")), F.lit(""))
    clean = t.normalize_noise(F.coalesce(F.nullif(normal, F.lit("")), text))
    return F.struct(
        name.alias("id"), F.coalesce(F.nullif(label, F.lit("")), F.nullif(id_, F.lit("")), fallback).alias("label"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"), text.alias("raw"), clean.alias("normal"),
        t.searchable(clean).alias("searchable"), t.normalized_lines(text).alias("lines"), t.truncate_text(clean, 220).alias("preview"), F.coalesce(F.nullif(meta_region, F.lit("")), F.nullif(region, F.lit(""))).alias("region"),
    )


def recognised_lines(lines: Column, full: Column, base: Column, fallback: float = 0.45) -> Column:
    """Lines as given (text, confidence), else those of the whole text with the base confidence."""
    sure = t.unit_confidence(base, fallback)
    split = F.transform(t.normalized_lines(full), lambda x: F.struct(x.alias("text"), sure.alias("confidence")))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, lines).otherwise(split)


def paragraph_lines(paragraphs: Column, missing: float = 0.6) -> Column:
    """Lines of paragraphs (arrays of words: symbols, confidence): symbols joined, words by spaces, mean confidence; empty ones go."""
    word = lambda w: F.array_join(w["symbols"], "")

    def line(words: Column) -> Column:
        kept = F.filter(words, lambda w: word(w) != "")
        total = F.aggregate(kept, F.lit(0.0), lambda s, w: s + t.unit_confidence(w["confidence"], missing))
        return F.struct(F.array_join(F.transform(kept, word), " ").alias("text"), (total / F.greatest(F.size(kept), F.lit(1))).alias("confidence"))

    return F.filter(F.transform(paragraphs, line), lambda x: x["text"] != "")


def polygon(vertices: Column, normalised: Column, bare: Column) -> Column:
    """Points (x, y) of the first form that is there; points that are no numbers go."""
    points = F.coalesce(F.when(F.size(vertices) > 0, vertices), F.when(F.size(normalised) > 0, normalised), bare, F.array().cast("array<struct<x:double,y:double>>"))
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.filter(points, lambda p: good(p["x"]) & good(p["y"]))


def recognised_tuples(items: Column) -> Column:
    """(text, confidence) of plain tuples (arrays of box, text, confidence): short ones and empty texts go, confidence is cut to 0..1."""
    good = F.filter(items, lambda i: F.size(i) >= 3)
    rows = F.transform(good, lambda i: F.struct(F.trim(F.element_at(i, 2)).alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.element_at(i, 3).try_cast("double"), F.lit(0.0)))).alias("confidence")))
    return F.filter(rows, lambda r: F.coalesce(r["text"], F.lit("")) != "")


# Names of one thing in messages' metadata, the first that is given counts.
ALIASES = {"group_id": ("groupId", "chatId"), "text": ("text", "caption", "body"), "sender": ("senderName", "sender"), "message_id": ("messageId", "id")}


def aliased(meta: Column) -> Column:
    """Metadata under one name each, null where no alias is given."""
    of = lambda names: _first([F.trim(t.text(F.try_element_at(meta, F.lit(k)))) for k in names])
    return F.struct(*[of(names).alias(k) for k, names in ALIASES.items()])


def hydrated(extraction: Column, candidate: Column, kept: tuple[str, ...] = ("origin",)) -> Column:
    """An extraction with a candidate's values over its own (structs with equal fields); without candidate as it is.  ``kept`` values stay where the candidate has none."""
    names = ("nf", "confidence", "method", *kept)
    return F.struct(*[F.when(candidate.isNull(), extraction[k]).otherwise(F.coalesce(candidate[k], extraction[k]) if k in kept else candidate[k]).alias(k) for k in names])


# Contexts of a number in plain recognised text.
SCRIPT_CONTEXTS = (r"(?:nf|nfe|nota fiscal)[^0-9]{0,24}([0-9]{6,9})", r"(?:numero|no|nro)[^0-9]{0,12}([0-9]{6,9})")


def script_numbers(text: Column) -> Column:
    """Numbers of 6 to 9 digits of a text: those in a context, then bare ones, each once."""
    s = t.searchable(text)
    found = [F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in SCRIPT_CONTEXTS]
    bare = F.regexp_extract_all(t.text(text), F.lit(r"(?<![0-9])([0-9]{6,9})(?![0-9])"), F.lit(1))
    return F.array_distinct(F.concat(*found, bare))


def shape(points: Column) -> Column:
    """(mean, median, p90) of an array of numbers by nearest rank among places; zeros of nothing."""
    s = F.sort_array(points)
    n = F.size(points)
    at = lambda share: F.get(s, F.floor((n - 1) * share + 0.5).cast("int"))
    mean = F.aggregate(points, F.lit(0.0), lambda a, x: a + x) / n
    zero = lambda c: F.when(F.coalesce(n, F.lit(0)) > 0, c).otherwise(0.0)
    return F.struct(zero(mean).alias("mean"), zero(at(0.5)).alias("median"), zero(at(0.9)).alias("p90"))
