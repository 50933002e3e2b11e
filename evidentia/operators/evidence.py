"""Business keys from recognised evidence: contexts, candidates and their scores, consensus and ranking.

Evidence has a row for every recognised text of a document: doc, ord (its order), id, source_type, confidence (per cent),
target_role, roi, region_id, variant, profile, phase and text.  Candidates are found by an Arrow batch function, since they
need the places of matches; only windows with two digits go there.  Scores, consensus and ranks are column expressions.
"""

from __future__ import annotations

import re
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import dates
from evidentia.functions import text as t
from evidentia.functions.scoring import is_repdigit, r2
from evidentia.operators import windows

# Markers in searchable text.
NF_MARK = r"\b(?:nf\s*e|nfe|nota fiscal(?: eletronica)?)\b"
NUMBER_MARK = r"\b(?:numero|n\s*o|nro|no)\b"
SERIES_MARK = r"\b(?:ser(?:ie|1e|le))\b"
SERIES_ONE = r"\b(?:ser(?:ie|1e|le))\s*(?:1|i)\b"
# Letters that are read for digits; A is 1 at a token's end, else 0, and N is 0 between such characters.
LETTERS = {"B": "8", "D": "0", "G": "6", "I": "1", "L": "1", "O": "0", "Q": "0", "S": "5", "T": "7", "Z": "2"}
# Regions whose text may hold the field's anchors, and bonuses of regions, roles and profiles.
ANCHOR_ROIS = ("nf_header", "nf_series_line", "nf_block", "nf_block_wide", "nf_number_line", "nf_number_tight")
ROI_BONUS = {"nf_number_tight": 0.36, "nf_number_line": 0.28, "nf_block": 0.18, "nf_block_wide": 0.1}
REGION_BONUS = {"roi_nf_number_line": 0.18, "roi_nf_block": 0.1}
ROLE_BONUS = (("isolated|tight", 0.24), ("line", 0.17), ("digits", 0.12), ("context", 0.08))
CLEAN_PROFILES = ("document_ink_clean", "document_ink_clean_rescue", "document_ink_clean_rescue_sharp")
# Names of reasons.
REASONS = (
    "contexto_nfe", "marcador_numero", "contexto_serie_1", "marcador_serie", "apoio_nfe_mesma_regiao", "apoio_serie_mesma_regiao",
    "campo_nf_ancorado", "sem_ancoras_completas_do_campo_nf", "linha_curta", "comprimento_esperado", "comprimento_fora_do_padrao",
    "padrao_direto", "sequencia_ocr_fuzzy", "sequencia_maior_recortada", "digitos_improvaveis", "sequencia_semelhante_a_data",
)
#: Distinct sources from which a consensus is strong.
STRONG_SOURCES = 3
FOUND = "array<struct<nf:string,method:string,evidence:string,raw:string,searchable:string,win:int,mapped:int,dropped:int,nf_gap:int,number_gap:int>>"


def contexts(searchable: Column) -> Column:
    """Which markers a searchable text has."""
    marks = {"nfe": NF_MARK, "number": NUMBER_MARK, "series": SERIES_MARK, "series_one": SERIES_ONE}
    return F.struct(*[F.coalesce(searchable.rlike(p), F.lit(False)).alias(k) for k, p in marks.items()])


def fuzzy_digits(token: str) -> tuple[str, int, int, int]:
    """Digits read from an upper-case token; letters mapped, characters dropped, true digits."""
    alike = lambda c: c.isdigit() or c in "AN" or c in LETTERS
    digits, mapped, dropped, true = [], 0, 0, 0
    for i, c in enumerate(token):
        if "0" <= c <= "9":
            digits.append(c)
            true += 1
            continue
        if c in " -.,:":
            continue
        read = LETTERS.get(c)
        if c == "A":
            read = "1" if i + 1 == len(token) else "0"
        elif c == "N" and 0 < i < len(token) - 1 and alike(token[i - 1]) and alike(token[i + 1]):
            read = "0"
        if read is None:
            dropped += 1
        else:
            digits.append(read)
            mapped += 1
    return "".join(digits), mapped, dropped, true


def subsequences(digits: str, size: int) -> list[str]:
    """Distinct subsequences of so many digits, leftmost first; callers give at most two digits more, so 36 of seven out of nine."""
    return list(dict.fromkeys(map("".join, combinations(digits, size))))


class Finder:
    """Candidates in the windows of one text, each once: the first window wins."""

    def __init__(self, sizes: tuple[int, ...]):
        self.sizes, self.longest = sizes, max(sizes)
        some = "|".join(rf"\d{{{n}}}" for n in sizes)
        flags = re.ASCII | re.IGNORECASE | re.DOTALL
        self.nf, self.number = re.compile(NF_MARK, flags), re.compile(NUMBER_MARK, flags)
        number = rf"(?<!\d)({some})(?!\d)"
        self.direct = [
            ("nf_context_number", re.compile(rf"{NF_MARK}.{{0,28}}?(?:{NUMBER_MARK}.{{0,8}}?)?{number}", flags), False),
            ("number_context_nf", re.compile(rf"{NUMBER_MARK}.{{0,8}}?{number}", flags), True),
        ]
        self.groups = re.compile(rf"\b(?:{some})\b", flags)
        self.tokens = re.compile("[0-9A-Z!]+", flags)
        self.runs = re.compile(rf"\d{{{self.longest + 1},{self.longest + 4}}}", flags)

    def __call__(self, wins, roi_source: bool, rescue: bool, overflow: bool) -> list[dict]:
        out: dict[tuple, dict] = {}
        for k, w in enumerate(wins):
            raw, text = w["raw"], w["searchable"]
            nf_at, number_at = ([m.start() for m in p.finditer(text)] for p in (self.nf, self.number))
            groups = [(m.group(), m.start()) for m in self.groups.finditer(text)]

            def add(key: tuple, nf: str, method: str, evidence: str, mapped: int = 0, dropped: int = 0) -> None:
                if key not in out:
                    at = next((i for g, i in groups if g == nf), groups[0][1] if groups else 0)
                    gap = lambda marks: min((abs(at - i) for i in marks), default=None)
                    out[key] = {"nf": nf, "method": method, "evidence": evidence, "raw": raw, "searchable": text, "win": k, "mapped": mapped, "dropped": dropped, "nf_gap": gap(nf_at), "number_gap": gap(number_at)}

            for name, pattern, needs_nf in self.direct:
                if not needs_nf or nf_at or roi_source:
                    for m in pattern.finditer(text):
                        add((name, m.group(1)), m.group(1), name, m.group())
            if not (nf_at or number_at or roi_source):
                continue
            for g, i in groups:
                add(("window", g, i), g, "window_context", g)
            read = [(m.group(), m.start(), *fuzzy_digits(m.group())) for m in self.tokens.finditer(raw.upper())]
            for token, i, digits, mapped, dropped, true in read:
                if len(digits) in self.sizes and true >= 2 and (true >= 4 or mapped >= 2) and dropped <= 2:
                    add(("fuzzy", digits, i), digits, "window_context_fuzzy", token, mapped, dropped)
            if rescue:
                for token, i, digits, mapped, dropped, _ in read:
                    if self.longest < len(digits) <= self.longest + 2:
                        for size in self.sizes:
                            for s in subsequences(digits, size):
                                add(("fuzzy-overflow", s, i), s, "window_context_fuzzy_overflow", token, mapped, dropped)
            if overflow:
                for m in self.runs.finditer(text):
                    for size in self.sizes:
                        for i in range(len(m.group()) - size + 1):
                            s = m.group()[i : i + size]
                            add(("overflow", s, m.start() + i), s, "window_context_overflow", m.group())
        return list(out.values())


def _has(x: str, part: str) -> Column:
    return F.coalesce(F.contains(F.col(x), F.lit(part)), F.lit(False))


def _sum(*parts) -> Column:
    """Parts added one after the other."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _if(holds: Column, value, other=0.0) -> Column:
    return F.when(holds, value).otherwise(F.lit(other))


def source_bonus() -> Column:
    """What a text's region, role and kind add to a score."""
    roi = F.lit(0.0)
    for k, v in reversed([*[(F.col("roi") == k, v) for k, v in ROI_BONUS.items()], *[(F.col("region_id") == k, v) for k, v in REGION_BONUS.items()]]):
        roi = F.when(F.coalesce(k, F.lit(False)), v).otherwise(roi)
    role = F.lit(0.0)
    for k, v in reversed(ROLE_BONUS):
        role = F.when(F.coalesce(F.col("target_role"), F.lit("")).rlike(k), v).otherwise(role)
    clean = _has("target_role", "clean_rescue") | _has("target_role", "ink_clean")
    return _sum(roi, role, _if(F.col("source_type").isin("nf_roi", "nf_roi_fallback"), 0.12), _if(clean, 0.18))


def distance_bonus(gap: Column, near: float, mid: float) -> Column:
    return F.when(gap <= 8, near).when(gap <= 20, mid).when(gap <= 36, mid / 2).otherwise(0.0)


def anchor_support(evidence: DataFrame) -> DataFrame:
    """Markers that the anchor regions of a document's variant show, and those regions."""
    rows = evidence.where(_has("source_type", "nf_roi") & (F.coalesce("roi", F.lit("")).isin("", *ANCHOR_ROIS)) & (F.coalesce("variant", F.lit("")) != ""))
    rows = rows.select("doc", "variant", "roi", contexts(t.searchable(F.col("text"))).alias("c")).where("c.nfe or c.series or c.series_one")
    return rows.groupBy("doc", "variant").agg(*[F.bool_or(f"c.{k}").alias(f"a_{k}") for k in ("nfe", "series", "series_one")], F.sort_array(F.collect_set("roi")).alias("anchor_rois"))


def candidates(evidence: DataFrame, sizes: tuple[int, ...] = (7,)) -> DataFrame:
    """A row for every candidate of every text, with its score and reasons."""
    finder = Finder(sizes)

    @F.pandas_udf(FOUND)
    def find(wins: pd.Series, roi_source: pd.Series, rescue: pd.Series, overflow: pd.Series) -> pd.Series:
        return pd.Series([finder(*row) for row in zip(wins, roi_source, rescue, overflow)], dtype=object)

    wins = F.filter(windows.line_windows(F.col("text")), lambda w: w["raw"].rlike("[0-9].*[0-9]"))
    rescue = _has("target_role", "clean_rescue")
    overflow = rescue | F.coalesce(F.col("profile").isin(*CLEAN_PROFILES), F.lit(False))
    rows = evidence.select("*", wins.alias("_w")).where(F.size("_w") > 0)
    rows = rows.select("*", F.inline(find("_w", _has("source_type", "nf_roi"), rescue, overflow))).drop("_w", "text")
    rows = rows.join(anchor_support(evidence), ["doc", "variant"], "left").withColumn("b", contexts(F.col("searchable")))
    return _scored(rows, sizes)


def _scored(rows: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    near = lambda k: F.coalesce(f"a_{k}", F.lit(False))
    both = lambda k: F.col(f"b.{k}") | near(k)
    rows = rows.select("*", both("nfe").alias("found_nfe"), F.col("b.number").alias("found_number"), both("series").alias("found_series"), both("series_one").alias("found_series_one"))
    rows = rows.withColumn("anchored", F.col("found_nfe") & F.col("found_series_one"))
    nfe, number, one, anchored, nf = F.col("found_nfe"), F.col("found_number"), F.col("found_series_one"), F.col("anchored"), F.col("nf")
    rows = rows.withColumn("date_like", ~(nfe | number | one) & dates.looks_like_date(nf, F.col("raw")))
    size = F.length(nf)
    direct, fuzzy, over = F.col("method").isin("nf_context_number", "number_context_nf"), _has("method", "fuzzy"), _has("method", "overflow")
    inherited_nf, inherited_one = ~F.col("b.nfe") & near("nfe"), ~F.col("b.series_one") & near("series_one")
    short, expected = F.length("searchable") <= 44, size.isin(*sizes)
    # fixed values: points of a candidate's score, in the order in which they are added
    score = _sum(
        F.coalesce("confidence", F.lit(0.0)) / 100 * 0.22, source_bonus(), _if(nfe, 0.14), _if(number, 0.12),
        F.when(one, 0.16).when(F.col("found_series"), 0.07).otherwise(0.0), _if(inherited_nf, 0.05), _if(inherited_one, 0.07),
        _if(anchored, 0.16, -0.34), _if(short, 0.08), distance_bonus(F.col("nf_gap"), 0.14, 0.08), distance_bonus(F.col("number_gap"), 0.1, 0.06),
        F.when(size.isin(7, 8), 0.08).when(size == 6, 0.04).when(size == 5, 0.01).otherwise(0.0), _if(expected, 0.04, -0.2),
        _if(direct, 0.12), _if(fuzzy, -0.04), _if(over, -0.06), -F.least(F.lit(0.08), F.col("mapped") * 0.02), -F.least(F.lit(0.06), F.col("dropped") * 0.02),
        _if(is_repdigit(nf), -0.25), _if(F.col("date_like"), -0.24),
    )
    holds = (nfe, number, one, F.col("found_series") & ~one, inherited_nf, inherited_one, anchored, ~anchored, short, expected, ~expected, direct, fuzzy, over, is_repdigit(nf), F.col("date_like"))
    reasons = F.array_compact(F.array(*[F.when(h, r) for h, r in zip(holds, REASONS)]))
    out = rows.withColumns({"score": r2(F.greatest(F.lit(0.0), F.least(F.lit(0.99), score))), "reasons": reasons, "shown": t.truncate_text(F.col("evidence"), 180)})
    return out.select("doc", "ord", "win", "id", "source_type", "target_role", "roi", "variant", "phase", "confidence", "nf", "method", "evidence", "shown", "score", "found_nfe", "found_number", "found_series", "found_series_one", "anchored", "date_like", "reasons")


def digit_dominant() -> Column:
    """Whether a candidate's own text in the block region is nearly nothing but its digits."""
    compact = F.regexp_replace(t.normalize_noise(F.col("evidence")), r"[\s.,:;_-]+", "")
    digits = t.digits_only(F.col("evidence"))
    clean = (digits == F.col("nf")) & (F.length(compact) <= F.length(digits) + 2) & (F.length(F.regexp_replace(compact, "[0-9]", "")) <= 1)
    return F.coalesce((F.col("roi") == "nf_block") & _has("source_type", "nf_roi") & clean & (F.coalesce("confidence", F.lit(0.0)) >= 15), F.lit(False))


def consensus(found: DataFrame, texts: int = 6) -> DataFrame:
    """A row for every document and key: score by consensus, support, contexts, ordered reasons, the best texts, and rank.

    Only the first ``texts`` texts and one place for each reason are held of a key, however much evidence it has."""
    rows = found.withColumn("dominant", digit_dominant())
    w = Window.partitionBy("doc", "nf").orderBy(F.desc("score"), "ord", "win", "method", "evidence")
    rows = rows.withColumn("_i", F.row_number().over(w))
    precise = F.coalesce("target_role", F.lit("")).rlike("isolated|tight|confirm")
    named = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    place = lambda r: F.min(F.when(F.array_contains("reasons", r), F.col("_i") * 100 + F.array_position("reasons", r)))
    flags = ("found_nfe", "found_number", "found_series", "found_series_one", "date_like", "dominant")
    g = rows.groupBy("doc", "nf").agg(
        F.max("score").alias("top"), F.count_distinct("id").alias("support_count"), F.sort_array(F.collect_set(named("roi"))).alias("rois"), F.sort_array(F.collect_set(named("variant"))).alias("variants"),
        F.sort_array(F.collect_set("source_type")).alias("source_types"), F.max(precise.cast("int")).alias("precision_score"), *[F.bool_or(f).alias(f) for f in flags], F.min_by("method", "_i").alias("method"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("_i") <= texts, F.struct("_i", "shown")))), lambda x: x["shown"]).alias("texts"),
        F.bool_or(F.coalesce(F.col("phase") == "fallback", F.lit(False))).alias("used_fallback"), F.array(*[F.struct(place(r).alias("at"), F.lit(r).alias("reason")) for r in REASONS]).alias("_r"),
    )
    reasons = F.transform(F.sort_array(F.filter("_r", lambda x: x["at"].isNotNull())), lambda x: x["reason"])
    has = lambda r: F.array_contains("rois", r)
    g = g.withColumns({"reasons": reasons, "roi_support_count": F.size("rois"), "variant_support_count": F.size("variants"), "anchored": F.col("found_nfe") & F.col("found_series_one")})
    nfe, number, one, anchored, dominant = (F.col(c) for c in ("found_nfe", "found_number", "found_series_one", "anchored", "dominant"))
    precise = has("nf_number_tight") | has("nf_number_line")
    strong = (F.col("support_count") >= STRONG_SOURCES) & (F.col("roi_support_count") >= 2)
    more = lambda c, step, most: F.least(F.lit(most), F.greatest(F.lit(0), F.col(c) - 1) * step)
    contextless = ~(nfe | number | one)
    # fixed values: points that a consensus adds, in order
    score = _sum(
        F.col("top"), more("support_count", 0.05, 0.15), more("roi_support_count", 0.05, 0.15), more("variant_support_count", 0.04, 0.12),
        F.when(anchored, 0.14).when(nfe & number, 0.06).when(nfe | one, 0.03).otherwise(0.0), _if(dominant, 0.12),
        F.when(precise & anchored, 0.08).when(precise, 0.03).otherwise(0.0), _if(~anchored, -0.42),
        F.when(~contextless, 0.0).when(dominant, -0.06).when(precise, -0.05).otherwise(-0.28),
        _if(contextless & ~precise & (F.col("rois") == F.array(F.lit("nf_block"))), -0.06),
        F.when(~F.col("date_like") | anchored, 0.0).when(precise, -0.08).otherwise(-0.18), _if((F.length("nf") <= 6) & ~anchored, -0.06),
    )
    score = r2(F.greatest(F.lit(0.0), F.least(F.lit(0.99), score)))
    floor = F.when(strong & has("nf_number_tight") & anchored, 0.99).when(strong & has("nf_number_line") & anchored, 0.96).otherwise(0.0)
    origin = F.when(F.exists("source_types", lambda x: F.contains(x, F.lit("nf_roi"))), "roi").otherwise("support")
    g = g.withColumns({"confidence": F.greatest(score, floor), "origin": origin})
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("confidence"), F.desc("precision_score"), F.desc("roi_support_count"), F.desc("support_count"), "nf"))
    return g.withColumn("rank", rank).drop("top", "_r", "date_like", "dominant")


def best_validated(ranked: DataFrame) -> DataFrame:
    """The first key of each document, in the order of ranks, whose field is anchored."""
    return ranked.where("anchored").groupBy("doc").agg(F.min_by(F.struct("nf", "confidence", "method", "rank"), "rank").alias("b")).select("doc", "b.*")


def phases_needed(best: Column, precision: Column, can_fall_back: Column, valid: float = 0.82) -> Column:
    """Which further passes a document's best validated key (struct of confidence and anchored, or null) asks for."""
    weak = F.coalesce(best["confidence"] < valid, F.lit(True))
    return F.struct(
        (weak | ~F.coalesce(best["anchored"], F.lit(False))).alias("retry"), F.coalesce(precision == 0, F.lit(True)).alias("confirm"), (can_fall_back & weak).alias("fallback")
    )
