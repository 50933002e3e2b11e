"""Fields of documents: alias matching, detection over evidence, and parsing of recognised lines with boxes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import boxes, dates
from evidentia.functions import text as t
from evidentia.functions.scoring import r2, r4
from evidentia.operators.windows import bound, token_windows


def _alike(a: Column, b: Column) -> Column:
    """Similarity of two searchable texts, 4 digits."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(r4(1 - F.levenshtein(a, b) / longer))


def _coverage(wanted: list[str], have: Column, least: float = 0.72) -> Column:
    """Share of the wanted tokens that one of the tokens equals or nearly equals."""
    near = lambda w: lambda c: (c == w) | (_alike(c, F.lit(w)) >= least)
    hits = sum((F.exists(have, near(w)).cast("int") for w in wanted), F.lit(0))
    return r4(hits / max(1, len(wanted)))


def alias_match(text: Column, targets: list[str], token_weight: float = 0.82, text_weight: float = 0.18) -> Column:
    """(confidence, method, target, matched): the first target that the text holds, else the best of targets by the text, its lines and runs of its tokens.

    Targets are searchable texts.  Ties go to the first target, then to the first candidate."""
    shape = "struct<confidence:double,method:string,target:string,matched:string>"
    none = F.struct(F.lit(0.0).alias("confidence"), F.lit("no_match").alias("method"), F.lit(None).cast("string").alias("target"), F.lit("").alias("matched")).cast(shape)
    if not targets:
        return none

    def result(confidence, method, target, matched) -> Column:
        return F.struct(confidence.alias("confidence"), F.lit(method).alias("method"), target.alias("target"), matched.alias("matched")).cast(shape)

    def best(searchable: Column) -> Column:
        lines = F.transform(t.normalized_lines(text), t.searchable)
        tokens = F.array_remove(F.split(searchable, " ", -1), "")
        runs = [token_windows(tokens, k) for k in dict.fromkeys(len(x.split()) for x in targets)]
        found = F.array_remove(F.array_distinct(F.concat(F.array(searchable), lines, *runs)), "")

        def scored(k: int, target: str):
            def score(c: Column, i: Column) -> Column:
                s = _alike(c, F.lit(target))
                mixed = (_coverage(target.split(), F.split(c, " ")) * token_weight + s * text_weight) / max(0.01, token_weight + text_weight)
                return F.struct(r4(F.greatest(s, F.least(F.lit(1.0), mixed))).alias("confidence"), F.lit(-k).alias("k"), (-i).alias("i"), F.lit(target).alias("target"), c.alias("matched"))

            return score

        def top(have: Column) -> Column:
            return F.array_max(F.concat(*[F.transform(have, scored(k, x)) for k, x in enumerate(targets)]))

        return bound(bound(found, top), lambda b: F.when(b["confidence"] > 0, result(b["confidence"], "token_fuzzy", b["target"], b["matched"])).otherwise(none))

    def chosen(searchable: Column) -> Column:
        out = F.when(searchable == "", F.struct(F.lit(0.0), F.lit("empty_text"), F.lit(None).cast("string"), F.lit("")).cast(shape))
        for x in targets:
            out = out.when(F.contains(searchable, F.lit(x)), result(F.lit(1.0), "exact_inclusion", F.lit(x), F.lit(x)))
        return out.otherwise(best(searchable))

    return bound(t.searchable(text), chosen)


@dataclass(frozen=True)
class FieldSpec:
    """How a field is told: its aliases, the regions it is expected in, hints in roles, and the least confidence."""

    aliases: list[str]
    regions: list[str] = field(default_factory=list)
    hints: list[str] = field(default_factory=list)
    threshold: float = 0.6
    dated: bool = False


# A day and month, with or without year.
DATE_VALUE = r"\b\d{1,2}[/.-]\d{1,2}(?:[/.-]\d{2,4})?\b"


def _detected(key: str, s: FieldSpec) -> Column:
    """What a text says of a field: confidence, order, method, target, matched, id and reasons; null if nothing."""
    expected = F.coalesce(F.col("region_id").isin(*s.regions), F.lit(False)) if s.regions else F.lit(False)
    region = F.when(expected, 0.14).when(F.coalesce("region_id", F.lit("")) != "", -0.05).otherwise(0.02)
    focus = F.coalesce(F.array_contains("field_keys", key), F.lit(False))
    role = F.coalesce(F.col("target_role").rlike("|".join(s.hints)), F.lit(False)) if s.hints else F.lit(False)
    date = F.lit(s.dated) & F.coalesce("text", F.lit("")).rlike(DATE_VALUE)
    ocr = F.coalesce("confidence", F.lit(0.0))
    if_ = lambda holds, value: F.when(holds, value).otherwise(0.0)

    def scored(m: Column) -> Column:
        exact = m["method"] == "exact_inclusion"
        fuzzy = F.lit(s.dated) & ~exact
        score = m["confidence"] * 0.72 + region + if_(focus, 0.1) + if_(role, 0.05) + if_(exact, 0.08) + if_(fuzzy, 0.03) + if_(date, 0.08) + F.least(F.lit(0.12), ocr / 1000)
        why = ((expected, "regiao_esperada"), (focus, "recorte_especifico"), (exact, "texto_exato"), (fuzzy, "fuzzy_label_data"), (date, "data_manuscrita_detectada"), (ocr >= 55, "ocr_estavel"))
        told = F.struct(r2(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("confidence"), (-F.col("ord")).alias("o"), m["method"].alias("method"), m["target"].alias("target"), t.truncate_text(m["matched"], 180).alias("matched"), F.col("id").alias("id"), F.array_compact(F.array(*[F.when(h, r) for h, r in why])).alias("reasons"))
        return F.when((m["confidence"] > 0) | (m["matched"] != ""), told)

    return bound(alias_match(F.col("text"), s.aliases, *((0.58, 0.42) if s.dated else (0.82, 0.18))), scored)


def detect(evidence: DataFrame, specs: dict[str, FieldSpec]) -> DataFrame:
    """A row for every document with a struct for each field (found, confidence, method, target, matched, id, reasons), detected_count and missing fields.

    evidence: doc, ord, id, text, confidence (per cent), region_id, target_role, field_keys (array).  The best text wins, the first of equals."""
    best = [F.max(_detected(key, s)).alias(f"_{key}") for key, s in specs.items()]
    rows = evidence.groupBy("doc").agg(F.count("*").alias("documents_considered"), *best)
    out = rows.select("doc", "documents_considered", *[
        F.struct((F.coalesce(F.col(f"_{k}.confidence"), F.lit(0.0)) >= s.threshold).alias("found"), F.coalesce(F.col(f"_{k}.confidence"), F.lit(0.0)).alias("confidence"), F.coalesce(F.col(f"_{k}.method"), F.lit("no_match")).alias("method"), *[F.col(f"_{k}.{c}").alias(c) for c in ("target", "matched", "id", "reasons")]).alias(k)
        for k, s in specs.items()
    ])
    missing = F.array_compact(F.array(*[F.when(~F.col(f"{k}.found"), k) for k in specs]))
    return out.withColumns({"detected_count": F.lit(len(specs)) - F.size(missing), "missing_fields": missing})


@dataclass(frozen=True)
class ValueSpec:
    """A field whose values a pattern finds; keyed ones use regions and nearby aliases."""

    pattern: str
    aliases: list[str]
    regions: list[tuple[float, float, float, float]] = field(default_factory=list)
    keyed: bool = False


def page_boxes(lines: DataFrame) -> DataFrame:
    """lines with ``norm``: box in units of its page, whose size is given or else what the boxes span."""
    w = Window.partitionBy("doc")
    given = (F.coalesce("page_width", F.lit(0.0)) > 0) & (F.coalesce("page_height", F.lit(0.0)) > 0)
    span = lambda at, size: F.coalesce(F.nullif(F.max(F.col(f"box.{at}") + F.col(f"box.{size}")).over(w), F.lit(0.0)), F.lit(1.0))
    rows = lines.withColumns({"_pw": F.when(given, F.col("page_width")).otherwise(span("x", "width")), "_ph": F.when(given, F.col("page_height")).otherwise(span("y", "height"))})
    unit = lambda c, by: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"box.{c}") / F.col(by)))
    norm = boxes.box(unit("x", "_pw"), unit("y", "_ph"), unit("width", "_pw"), unit("height", "_ph"))
    return rows.withColumn("norm", F.when(F.col("box").isNotNull(), norm)).drop("_pw", "_ph")


def region_score(norm: Column, regions: list[tuple[float, float, float, float]]) -> Column:
    """Best cover of a box by the padded regions; a centre inside counts 0.72 or more."""
    scores = [F.lit(0.0), F.lit(0.0)]
    for r in regions:
        e = boxes.expanded(boxes.box(*map(F.lit, r)))
        cx, cy = norm["x"] + norm["width"] / 2, norm["y"] + norm["height"] / 2
        inside = (cx >= e["x"]) & (cx <= e["x"] + e["width"]) & (cy >= e["y"]) & (cy <= e["y"] + e["height"])
        share = boxes.overlap_share(norm, e)
        scores.append(F.when(F.coalesce(inside, F.lit(False)), F.greatest(share, F.lit(0.72))).otherwise(share))
    return F.greatest(*scores)


def nearby_alias(lines: DataFrame, gap: float = 0.18, cover: float = 0.35) -> DataFrame:
    """(doc, line_no, near): greatest alias confidence of other lines close above or below; lines meet only in neighbouring bands of ``gap``."""
    band = F.floor(F.col("norm.y") / gap).cast("int")
    have = lines.where("norm is not null")
    mine = have.where("wanted").select("doc", "line_no", F.col("norm").alias("a"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    other = have.where("alias > 0").select("doc", band.alias("band"), F.col("line_no").alias("_o"), F.col("norm").alias("b"), "alias")
    rows = mine.join(other, ["doc", "band"]).where(F.col("line_no") != F.col("_o"))
    shared = boxes.axis_overlap(F.col("a.x"), F.col("a.x") + F.col("a.width"), F.col("b.x"), F.col("b.x") + F.col("b.width"))
    close = (F.abs(F.col("b.y") - F.col("a.y")) <= gap) & (shared / F.greatest(F.lit(0.0001), F.least("a.width", "b.width")) >= cover)
    return rows.where(close).groupBy("doc", "line_no").agg(F.max("alias").alias("near"))


def parse_values(lines: DataFrame, spec: ValueSpec) -> DataFrame:
    """(doc, value, confidence, source): the best value of a field.

    lines: doc, line_no, text, confidence and provider_confidence (0..1), box, page_width, page_height.  A field that isn't keyed also takes the
    whole text's values; a keyed one only where no line has any.  Of equals the first line's first value wins."""
    alias = alias_match(F.col("text"), spec.aliases)["confidence"]
    values = lambda c: F.filter(F.transform(F.regexp_extract_all(c, F.lit(f"({spec.pattern})"), F.lit(1)), lambda v: F.trim(v)), lambda v: v != "")
    unit = lambda c, other: t.unit_confidence(F.col(c), other)
    rows = page_boxes(lines).withColumns({"alias": alias, "values": values(F.col("text"))}).withColumn("wanted", F.size("values") > 0)
    line, whole, label, region = (0.46, 0.14, 0.22, 0.18) if spec.keyed else (0.58, 0.22, 0.2, 0.0)
    if spec.keyed:
        rows = rows.join(nearby_alias(rows), ["doc", "line_no"], "left").withColumns({"label": F.greatest("alias", F.coalesce("near", F.lit(0.0))), "region": region_score(F.col("norm"), spec.regions)})
    else:
        rows = rows.withColumns({"label": F.col("alias"), "region": F.lit(0.0)})
    base = lambda own: F.least(F.lit(1.0), own * line + unit("provider_confidence", 0.45) * whole + F.col("label") * label + F.col("region") * region)
    score = base(unit("confidence", 0.45))
    if spec.keyed:
        weak, strong = (F.col("region") < 0.08) & (F.col("label") < 0.3), (F.col("region") >= 0.2) | (F.col("label") >= 0.6)
        score = F.when(weak, score * 0.52).when(strong, F.least(F.lit(1.0), score + 0.08)).otherwise(score)
    kept = ("doc", "at", "i", "value", "score", "region", "label", "source")
    found = rows.where("wanted").select("doc", F.col("line_no").alias("at"), r2(score).alias("score"), r2(F.col("region")).alias("region"), r2(F.col("label")).alias("label"), F.posexplode("values").alias("i", "value"), F.lit("line").alias("source")).select(*kept)
    text = lines.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"), F.max("provider_confidence").alias("provider_confidence"))
    if spec.keyed:
        text = text.join(found.select("doc").distinct(), "doc", "left_anti")
    text = text.withColumns({"label": alias, "region": F.lit(0.0)})
    score = base(unit("provider_confidence", 0.45))
    if spec.keyed:
        score = score * F.when(F.col("label") >= 0.45, 0.55).otherwise(0.28)
    of_text = text.select("doc", F.lit(1 << 30).alias("at"), r2(score).alias("score"), "region", r2(F.col("label")).alias("label"), F.posexplode(values(F.col("text"))).alias("i", "value"), F.lit("document").alias("source")).select(*kept)
    best = found.unionByName(of_text).groupBy("doc").agg(F.max_by(F.struct("value", F.col("score").alias("confidence"), "source"), F.struct("score", "region", "label", -F.col("at"), -F.col("i"))).alias("b"))
    return best.select("doc", "b.*")


def header(text: Column, aliases: list[str], provider: Column, hinted: Column) -> Column:
    """(found, confidence) of a heading: alias and provider, or a hint."""
    match = alias_match(text, aliases)["confidence"]
    score = r2(F.greatest(F.least(F.lit(1.0), match * 0.78 + t.unit_confidence(provider, 0.4) * 0.22), F.when(F.coalesce(hinted, F.lit(False)), 0.68).otherwise(0.0)))
    return F.struct((score >= 0.62).alias("found"), score.alias("confidence"))


def with_hint(found: Column, value: Column, confidence: Column, hint: Column, hint_confidence: Column) -> Column:
    """A hint replaces what isn't found or is less sure."""
    sure = t.unit_confidence(hint_confidence, 0.65)
    use = F.coalesce(hint, F.lit("")) != ""
    use = use & (~F.coalesce(found, F.lit(False)) | (sure >= confidence))
    return F.struct((use | F.coalesce(found, F.lit(False))).alias("found"), F.when(use, hint).otherwise(value).alias("value"), r2(F.when(use, F.greatest(confidence, sure)).otherwise(confidence)).alias("confidence"))


def summary(fields: dict[str, tuple[Column, Column]]) -> Column:
    """(found_count, missing, average) of fields' (found, confidence)."""
    found = {k: F.coalesce(f, F.lit(False)) for k, (f, _) in fields.items()}
    n = sum((f.cast("int") for f in found.values()), F.lit(0))
    total = sum((F.when(found[k], c).otherwise(0.0) for k, (_, c) in fields.items()), F.lit(0.0))
    missing = F.array_compact(F.array(*[F.when(~f, k) for k, f in found.items()]))
    return F.struct(n.alias("found_count"), missing.alias("missing"), F.when(n > 0, r2(total / n)).otherwise(0.0).alias("average"))


# Words that tell receipts and signatures.
RECEIPT_WORDS = ("recebemos", "data de recebimento", "assinatura", "recebedor", "recebedora", "canhoto")
SIGNATURE_WORDS = ("assinatura", "recebedor", "recebedora")


def markers(text: Column, words: tuple[str, ...] = RECEIPT_WORDS) -> Column:
    """The words that the searchable text holds."""
    return bound(t.searchable(text), lambda s: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(s, w)))


def best_date(lines: DataFrame) -> DataFrame:
    """(doc, date, iso, confidence): the surest date of a document's lines, surer beside its label; the first of equals."""
    found = F.regexp_extract_all("text", F.lit(r"\b([0-3]?\d[/\-.][01]?\d[/\-.](?:19|20)?\d{2})\b"), F.lit(1))
    labelled = t.searchable(F.col("text")).rlike("data|recebimento")
    sure = F.when(labelled, F.least(F.lit(0.99), F.col("confidence") + 0.15)).otherwise(F.col("confidence"))
    rows = lines.select("doc", "line_no", r4(sure).alias("confidence"), F.posexplode(found).alias("i", "raw")).withColumn("d", dates.brazilian_date(F.col("raw"))).where("d.iso is not null")
    best = rows.groupBy("doc").agg(F.max_by(F.struct("d.date", "d.iso", "confidence"), F.struct("confidence", -F.col("line_no"), -F.col("i"))).alias("b"))
    return best.select("doc", "b.*")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One line for each searchable text and band of 14 pixels: the surest, the first of equals."""
    rows = lines.withColumns({"_s": t.searchable(F.col("text")), "_b": F.bround(F.col("top") / 14).cast("int")})
    w = Window.partitionBy("doc", "_s", "_b").orderBy(F.desc("confidence"), "line_no")
    return rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i", "_s", "_b")


def weighted_confidence(lines: DataFrame) -> DataFrame:
    """Mean confidence by document; a line weighs as many as its characters, four at least."""
    weight = F.greatest(F.lit(4), F.length(F.trim("text")))
    return lines.groupBy("doc").agg(F.round(F.sum(F.col("confidence") * weight) / F.sum(weight), 4).alias("confidence"))
