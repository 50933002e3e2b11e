"""Queries of evidence: candidates with scores, consensus, aliases and values of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import boxes, scoring
from evidentia.functions import text as t
from evidentia.operators import evidence as ev
from evidentia.operators import fields as f
from evidentia.plans.base import query, r2, r4, search, table

_KEY = "lpad(CAST(CAST(floor(o_orderkey / 4) AS BIGINT) * 2 + CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END AS STRING), 7, '0')"
#: Evidence made from orders, four texts a document, in words that both engines understand.
_EVIDENCE = {
    "doc": "CAST(floor(o_orderkey / 4) AS BIGINT)", "ord": "CAST(o_orderkey % 4 AS INT)", "id": "'s' || CAST(o_orderkey % 4 AS STRING)",
    "source_type": "CASE o_orderkey % 3 WHEN 0 THEN 'nf_roi' WHEN 1 THEN 'nf_roi_fallback' ELSE 'full' END", "confidence": "CAST(o_orderkey * 7 % 101 AS DOUBLE)",
    "target_role": "CASE o_orderkey % 5 WHEN 0 THEN 'nf_digits_isolated' WHEN 1 THEN 'nf_line' WHEN 2 THEN 'nf_block_context' ELSE NULL END",
    "roi": "CASE o_orderkey % 6 WHEN 0 THEN 'nf_number_tight' WHEN 1 THEN 'nf_number_line' WHEN 2 THEN 'nf_block' WHEN 3 THEN 'nf_header' ELSE NULL END", "region_id": "CASE WHEN o_orderkey % 6 = 4 THEN 'roi_nf_block' END",
    "variant": "CASE WHEN o_orderkey % 2 = 0 THEN 'up' ELSE 'down' END", "profile": "CAST(NULL AS STRING)", "phase": "CASE WHEN o_orderkey % 8 = 7 THEN 'fallback' END",
    "text": f"CASE (CAST(floor(o_orderkey / 4) AS BIGINT) + o_orderkey) % 4 WHEN 0 THEN 'NF-e No ' || {_KEY} || ' SERIE 1' WHEN 1 THEN 'Numero ' || {_KEY} WHEN 2 THEN {_KEY} || ' SÉRIE I' ELSE {_KEY} END",
}


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*[F.expr(sql).alias(name) for name, sql in _EVIDENCE.items()])


_RAW = "e AS (SELECT *, " + search("text") + " AS s FROM (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in _EVIDENCE.items()) + f", {_KEY} AS nf FROM orders))"
_MARKS = ", ".join(f"regexp_matches(s, '{p}') AS {k}" for k, p in (("nfe", ev.NF_MARK), ("number", ev.NUMBER_MARK), ("series", ev.SERIES_MARK), ("series_one", ev.SERIES_ONE)))


@query(f"WITH {_RAW}, m AS (SELECT *, {_MARKS} FROM e) SELECT doc, ord, nfe, number, series, series_one FROM m")
def evidence_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which markers a text has."""
    return evidence(spark, sf_dir).select("doc", "ord", ev.contexts(t.searchable(F.col("text"))).alias("c")).select("doc", "ord", "c.*")


_DATE = "(len(z) = 6 AND (try_cast('20' || z[5:6] || '-' || z[3:4] || '-' || z[1:2] AS DATE) IS NOT NULL OR try_cast('20' || z[1:2] || '-' || z[3:4] || '-' || z[5:6] AS DATE) IS NOT NULL))"
_DROPPED = "list_concat([{x}], list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN {x}[i] = '1' THEN {x}[1:i - 1] || {x}[i + 1:] END), lambda v: v IS NOT NULL))"
_ROI = "CASE roi WHEN 'nf_number_tight' THEN 0.36e0 WHEN 'nf_number_line' THEN 0.28e0 WHEN 'nf_block' THEN 0.18e0 ELSE CASE WHEN region_id = 'roi_nf_block' THEN 0.1e0 ELSE 0e0 END END"
_ROLE = "CASE target_role WHEN 'nf_digits_isolated' THEN 0.24e0 WHEN 'nf_line' THEN 0.17e0 WHEN 'nf_block_context' THEN 0.08e0 ELSE 0e0 END"
_IF = "CASE WHEN {} THEN {}e0 ELSE {}e0 END"


def _if(holds: str, value: float, other: float = 0) -> str:
    return _IF.format(holds, value, other)


_POINTS = " + ".join([
    "confidence / 100 * 0.22e0", f"({_ROI} + {_ROLE} + {_if('roi_source', 0.12)} + 0e0)", _if("found_nfe", 0.14), _if("number", 0.12), "CASE WHEN found_one THEN 0.16e0 WHEN found_series THEN 0.07e0 ELSE 0e0 END",
    _if("NOT nfe AND a_nfe", 0.05), _if("NOT series_one AND a_one", 0.07), _if("anchored", 0.16, -0.34), _if("len(s) <= 44", 0.08),
    "CASE WHEN nf_gap <= 8 THEN 0.14e0 WHEN nf_gap <= 20 THEN 0.08e0 WHEN nf_gap <= 36 THEN 0.04e0 ELSE 0e0 END", "CASE WHEN number_gap <= 8 THEN 0.1e0 WHEN number_gap <= 20 THEN 0.06e0 WHEN number_gap <= 36 THEN 0.03e0 ELSE 0e0 END",
    "0.08e0", "0.04e0", _if("method IN ('nf_context_number', 'number_context_nf')", 0.12), _if("method = 'window_context_fuzzy'", -0.04), "0e0", "-0e0", "-0e0", _if("nf = repeat(nf[1], 7)", -0.25), _if("date_like", -0.24),
])
_HOLDS = ["found_nfe", "number", "found_one", "found_series AND NOT found_one", "NOT nfe AND a_nfe", "NOT series_one AND a_one", "anchored", "NOT anchored", "len(s) <= 44", "true", "false", "method IN ('nf_context_number', 'number_context_nf')", "method = 'window_context_fuzzy'", "false", "nf = repeat(nf[1], 7)", "date_like"]
_WHY = "list_filter([" + ", ".join(f"CASE WHEN {h} THEN '{r}' END" for h, r in zip(_HOLDS, ev.REASONS)) + "], lambda x: x IS NOT NULL)"
_FOUND = f"""{_RAW}, m AS (SELECT *, starts_with(source_type, 'nf_roi') AS roi_source, {_MARKS} FROM e),
a AS (SELECT doc, variant, bool_or(nfe) AS a_nfe, bool_or(series) AS a_series, bool_or(series_one) AS a_one FROM m WHERE roi_source AND coalesce(roi, '') IN ('', 'nf_header', 'nf_series_line', 'nf_block', 'nf_block_wide', 'nf_number_line', 'nf_number_tight') AND (nfe OR series OR series_one) GROUP BY ALL),
one AS (SELECT DISTINCT nf, unnest({_DROPPED.format(x='nf')}) AS y FROM e), two AS (SELECT DISTINCT nf, unnest({_DROPPED.format(x='y')}) AS z FROM one), dates AS (SELECT nf, bool_or({_DATE}) AS looks FROM two GROUP BY nf),
f AS (SELECT m.*, unnest(list_filter([CASE WHEN regexp_matches(s, '(nf e|nfe|nota fiscal).{{0,28}}?\\b[0-9]{{7}}\\b') THEN 'nf_context_number' END, CASE WHEN (nfe OR roi_source) AND regexp_matches(s, '\\b(numero|no)\\b.{{0,8}}?\\b[0-9]{{7}}\\b') THEN 'number_context_nf' END,
  CASE WHEN nfe OR number OR roi_source THEN 'window_context' END, CASE WHEN nfe OR number OR roi_source THEN 'window_context_fuzzy' END], lambda x: x IS NOT NULL)) AS method,
  CASE WHEN nfe THEN strpos(s, nf) - strpos(s, 'nf e') END AS nf_gap, CASE WHEN number THEN strpos(s, nf) - greatest(strpos(s, 'numero'), strpos(s, ' no ') + 1) END AS number_gap FROM m),
g AS (SELECT f.*, coalesce(a_nfe, false) AS a_nfe, coalesce(a_one, false) AS a_one, nfe OR coalesce(a_nfe, false) AS found_nfe, series OR coalesce(a_series, false) AS found_series, series_one OR coalesce(a_one, false) AS found_one, looks FROM f LEFT JOIN a USING (doc, variant) JOIN dates USING (nf)),
h AS (SELECT *, found_nfe AND found_one AS anchored, NOT (found_nfe OR number OR found_one) AND looks AS date_like FROM g),
c AS (SELECT *, {r2(f'greatest(0e0, least(0.99e0, {_POINTS}))')} AS score, {_WHY} AS reasons FROM h)"""


@query(f"WITH {_FOUND} SELECT doc, ord, nf, method, score, found_nfe, number AS found_number, found_series, found_one AS found_series_one, anchored, date_like, array_to_string(reasons, ',') AS reasons FROM c")
def evidence_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all texts by all methods, with scores and reasons."""
    rows = ev.candidates(evidence(spark, sf_dir))
    return rows.select("doc", "ord", "nf", "method", "score", "found_nfe", "found_number", "found_series", "found_series_one", "anchored", "date_like", F.array_join("reasons", ",").alias("reasons"))


_DOMINANT = "coalesce(roi = 'nf_block' AND roi_source AND method LIKE 'window%' AND confidence >= 15, false)"
_AGREED = f"""{_FOUND}, i AS (SELECT *, row_number() OVER (PARTITION BY doc, nf ORDER BY score DESC, ord, method) AS i, {_DOMINANT} AS dominant FROM c),
g1 AS (SELECT doc, nf, max(score) AS top, count(DISTINCT id) AS support_count, count(DISTINCT roi) AS roi_support_count, count(DISTINCT variant) AS variant_support_count, max(coalesce(regexp_matches(target_role, 'isolated|tight|confirm'), false)::INT) AS precision_score,
  bool_or(found_nfe) AS nfe, bool_or(number) AS number, bool_or(found_one) AS one, bool_or(date_like) AS date_like, bool_or(dominant) AS dominant, arg_min(method, i) AS method, bool_or(coalesce(phase = 'fallback', false)) AS used_fallback,
  coalesce(bool_or(roi = 'nf_number_tight'), false) AS tight, coalesce(bool_or(roi = 'nf_number_line'), false) AS line, coalesce(list_sort(list(DISTINCT roi) FILTER (roi IS NOT NULL)), []) AS rois, bool_or(roi_source) AS of_roi FROM i GROUP BY doc, nf),
w1 AS (SELECT doc, nf, unnest(reasons) AS reason, i * 100 + unnest(range(1, len(reasons) + 1)) AS place FROM i), w2 AS (SELECT doc, nf, reason, min(place) AS place FROM w1 GROUP BY ALL), w3 AS (SELECT doc, nf, string_agg(reason, ',' ORDER BY place) AS reasons FROM w2 GROUP BY ALL),
g2 AS (SELECT *, nfe AND one AS anchored, tight OR line AS precise, NOT (nfe OR number OR one) AS bare, support_count >= 3 AND roi_support_count >= 2 AS strong FROM g1),
g3 AS (SELECT *, top + least(0.15e0, greatest(0, support_count - 1) * 0.05e0) + least(0.15e0, greatest(0, roi_support_count - 1) * 0.05e0) + least(0.12e0, greatest(0, variant_support_count - 1) * 0.04e0)
  + CASE WHEN anchored THEN 0.14e0 WHEN nfe AND number THEN 0.06e0 WHEN nfe OR one THEN 0.03e0 ELSE 0e0 END + {_if('dominant', 0.12)} + CASE WHEN precise AND anchored THEN 0.08e0 WHEN precise THEN 0.03e0 ELSE 0e0 END + {_if('NOT anchored', -0.42)}
  + CASE WHEN NOT bare THEN 0e0 WHEN dominant THEN -0.06e0 WHEN precise THEN -0.05e0 ELSE -0.28e0 END + {_if("bare AND NOT precise AND rois = ['nf_block']", -0.06)} + CASE WHEN NOT date_like OR anchored THEN 0e0 WHEN precise THEN -0.08e0 ELSE -0.18e0 END + 0e0 AS raw FROM g2),
g4 AS (SELECT *, greatest({r2('greatest(0e0, least(0.99e0, raw))')}, CASE WHEN strong AND tight AND anchored THEN 0.99e0 WHEN strong AND line AND anchored THEN 0.96e0 ELSE 0e0 END) AS conf FROM g3),
g5 AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY conf DESC, precision_score DESC, roi_support_count DESC, support_count DESC, nf) AS rank FROM g4)"""


@query(f"WITH {_AGREED} SELECT doc, nf, conf AS confidence, rank, support_count, roi_support_count, variant_support_count, precision_score, anchored, method, used_fallback, CASE WHEN of_roi THEN 'roi' ELSE 'support' END AS origin, array_to_string(rois, ',') AS rois, reasons FROM g5 LEFT JOIN w3 USING (doc, nf)")
def evidence_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by consensus of their evidence, ranked."""
    rows = ev.consensus(ev.candidates(evidence(spark, sf_dir)))
    return rows.select("doc", "nf", "confidence", "rank", "support_count", "roi_support_count", "variant_support_count", F.col("precision_score").cast("long").alias("precision_score"), "anchored", "method", "used_fallback", "origin", F.array_join("rois", ",").alias("rois"), F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_AGREED}, b AS (SELECT DISTINCT ON (doc) doc, nf, conf, precision_score FROM g5 WHERE anchored ORDER BY doc, rank)
SELECT d.doc, nf, coalesce(conf < 0.82, true) AS retry, coalesce(precision_score = 0, true) AS confirm, d.doc % 2 = 0 AND coalesce(conf < 0.82, true) AS fallback FROM (SELECT DISTINCT doc FROM g5) d LEFT JOIN b USING (doc)""")
def evidence_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best validated key of each document, and the passes that it still asks for."""
    ranked = ev.consensus(ev.candidates(evidence(spark, sf_dir)))
    best = ranked.where("anchored").groupBy("doc").agg(F.min_by(F.struct("nf", "confidence", "anchored", "precision_score"), "rank").alias("b"))
    rows = ranked.select("doc").distinct().join(best, "doc", "left")
    return rows.select("doc", "b.nf", ev.phases_needed(F.col("b"), F.col("b.precision_score"), F.col("doc") % 2 == 0).alias("p")).select("doc", "nf", "p.*")


_NOISY = "CASE p_partkey % 5 WHEN 0 THEN 'DATA DE RECEBIMEN10 ' || p_name WHEN 1 THEN p_name || ' dta d recebimento' WHEN 2 THEN 'Data de Recebimento ' || p_name WHEN 3 THEN p_name ELSE '' END"
_TOKENS = "['data', 'de', 'recebimento']"
_NEAR = "lambda w: len(list_filter(string_split(c, ' '), lambda x: x = w OR {} >= 0.72)) > 0".format(r4("1 - levenshtein(x, w) / greatest(len(x), len(w))::DOUBLE"))


@query(f"""WITH x AS (SELECT p_partkey, {_NOISY} AS text FROM part), s AS (SELECT p_partkey, {search('text')} AS s FROM x), k AS (SELECT *, list_filter(string_split(s, ' '), lambda x: x <> '') AS w FROM s),
l AS (SELECT p_partkey, s, list_concat([s], flatten(list_transform([2, 3, 4, 5], lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))))) AS cs FROM k),
c AS (SELECT p_partkey, unnest(list_filter(cs, lambda x: x <> '')) AS c, unnest(range(len(list_filter(cs, lambda x: x <> '')))) AS i FROM l WHERE NOT contains(s, 'data de recebimento') AND s <> ''),
v AS (SELECT *, {r4("1 - levenshtein(c, 'data de recebimento') / greatest(len(c), 19)::DOUBLE")} AS sim, {r4(f"len(list_filter({_TOKENS}, {_NEAR})) / 3::DOUBLE")} AS cov FROM c),
r AS (SELECT *, {r4('greatest(sim, least(1e0, (cov * 0.82e0 + sim * 0.18e0) / 1e0))')} AS conf FROM v), b AS (SELECT DISTINCT ON (p_partkey) p_partkey, conf, c FROM r ORDER BY p_partkey, conf DESC, i)
SELECT p_partkey, CASE WHEN s = '' THEN 0e0 WHEN contains(s, 'data de recebimento') THEN 1e0 ELSE coalesce(conf, 0) END AS confidence, CASE WHEN s = '' THEN 'empty_text' WHEN contains(s, 'data de recebimento') THEN 'exact_inclusion' WHEN conf > 0 THEN 'token_fuzzy' ELSE 'no_match' END AS method,
  CASE WHEN contains(s, 'data de recebimento') THEN 'data de recebimento' WHEN conf > 0 THEN c ELSE '' END AS matched FROM s LEFT JOIN b USING (p_partkey)""")
def alias_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well noisy texts hold an alias."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_NOISY).alias("text"))
    return rows.select("p_partkey", f.alias_match(F.col("text"), ["data de recebimento"]).alias("m")).select("p_partkey", "m.confidence", "m.method", "m.matched")


_P, _Q = search("p_name"), search("p_type || ' ' || p_name || 's'")


@query(f"""WITH s AS (SELECT p_partkey, {_P} AS a, {_Q} AS b FROM part), v AS (SELECT *, round(1 - levenshtein(a, b) / greatest(len(a), len(b))::DOUBLE, 4) AS similarity,
  round(len(list_filter(string_split(a, ' '), lambda w: len(list_filter(string_split(b, ' '), lambda x: x = w OR 1 - levenshtein(w, x) / greatest(len(w), len(x))::DOUBLE >= 0.72)) > 0)) / len(string_split(a, ' '))::DOUBLE, 4) AS coverage FROM s)
SELECT p_partkey, coverage, greatest(similarity, least(1e0, (coverage * 0.82e0 + similarity * 0.18e0) / 1e0)) AS confidence FROM v""")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a name's words in another text, and the alias confidence."""
    a, b = F.col("p_name"), F.concat("p_type", F.lit(" "), "p_name", F.lit("s"))
    return table(spark, sf_dir, "part").select("p_partkey", scoring.token_coverage(a, b).alias("coverage"), scoring.alias_confidence(a, b).alias("confidence"))


#: Lines with boxes, made from line items.
_BOX = {"x": "l_partkey % 70 * 10", "y": "l_linenumber * 60", "width": "100 + l_suppkey % 40", "height": "30 + l_partkey % 20"}
_LINE = "CASE l_linenumber % 3 WHEN 0 THEN 'NF-e ' || lpad(CAST(l_partkey AS STRING), 7, '0') WHEN 1 THEN 'nota fiscal' ELSE lpad(CAST(l_suppkey AS STRING), 6, '1') || ' / ' || lpad(CAST(l_partkey AS STRING), 6, '2') END"
_FIRST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.operators import keys

    rows = keys.latest(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], *map(F.asc, _FIRST))
    box = boxes.box(*[F.expr(x).cast("double") for x in _BOX.values()])
    unknown = F.col("l_orderkey") % 5 == 0
    return rows.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line_no"), F.expr(_LINE).alias("text"), (F.col("l_quantity") / 50).alias("confidence"), (F.col("l_discount") * 9).alias("provider_confidence"),
        F.when(F.col("l_orderkey") % 7 != 0, box).alias("box"), F.when(~unknown, F.lit(1000.0)).alias("page_width"), F.when(~unknown, F.lit(600.0)).alias("page_height"), F.col("l_quantity").alias("top"),
    )


_LINES = f"""l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS doc, l_linenumber AS line_no, {_LINE} AS text, l_quantity / 50 AS confidence, l_discount * 9 AS provider, l_quantity AS top,
  CASE WHEN l_orderkey % 7 <> 0 THEN ({_BOX['x']})::DOUBLE END AS x, ({_BOX['y']})::DOUBLE AS y, ({_BOX['width']})::DOUBLE AS w, ({_BOX['height']})::DOUBLE AS h, l_orderkey % 5 = 0 AS unknown FROM lineitem ORDER BY l_orderkey, l_linenumber, {', '.join(_FIRST)})"""
_UNIT = "greatest(0e0, least(1e0, {} / {}))"
_NORM = f"""{_LINES}, p AS (SELECT *, CASE WHEN unknown THEN coalesce(nullif(max(CASE WHEN x IS NOT NULL THEN x + w END) OVER (PARTITION BY doc), 0), 1) ELSE 1000 END AS pw, CASE WHEN unknown THEN coalesce(nullif(max(CASE WHEN x IS NOT NULL THEN y + h END) OVER (PARTITION BY doc), 0), 1) ELSE 600 END AS ph FROM l),
n AS (SELECT doc, line_no, text, confidence, provider, {_UNIT.format('x', 'pw')} AS nx, {_UNIT.format('y', 'ph')} AS ny, {_UNIT.format('w', 'pw')} AS nw, {_UNIT.format('h', 'ph')} AS nh, x IS NOT NULL AS boxed FROM p)"""
_REGIONS = [(0.6, 0.05, 0.3, 0.3), (0.1, 0.4, 0.2, 0.2)]


def _region(r: tuple[float, ...]) -> str:
    ex, ey = f"greatest(0e0, {r[0]}e0 - 0.02e0)", f"greatest(0e0, {r[1]}e0 - 0.03e0)"
    ew, eh = f"least(1e0, {r[2]}e0 + 0.04e0)", f"least(1e0, {r[3]}e0 + 0.06e0)"
    side = lambda a, aw, b, bw: f"greatest(0e0, least({a} + {aw}, {b} + {bw}) - greatest({a}, {b}))"
    share = f"least(1e0, {side('nx', 'nw', ex, ew)} * {side('ny', 'nh', ey, eh)} / greatest(0.0001e0, nw * nh))"
    inside = f"(nx + nw / 2 >= {ex} AND nx + nw / 2 <= {ex} + {ew} AND ny + nh / 2 >= {ey} AND ny + nh / 2 <= {ey} + {eh})"
    return f"CASE WHEN {inside} THEN greatest({share}, 0.72e0) ELSE {share} END"


@query(f"""WITH {_NORM} SELECT doc, line_no, CASE WHEN boxed THEN nx END AS x, CASE WHEN boxed THEN ny END AS y, CASE WHEN boxed THEN nw END AS width, CASE WHEN boxed THEN nh END AS height, CASE WHEN boxed THEN greatest(0e0, {', '.join(map(_region, _REGIONS))}) ELSE 0e0 END AS region FROM n""")
def region_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in units of their pages, and how expected regions cover them."""
    rows = f.page_boxes(lines(spark, sf_dir))
    return rows.select("doc", "line_no", "norm.*", f.region_score(F.col("norm"), _REGIONS).alias("region"))


@query(f"""WITH {_NORM}, m AS (SELECT *, CASE WHEN contains(text, 'nota fiscal') THEN 0.8e0 WHEN contains(text, 'NF-e') THEN 0.5e0 ELSE 0e0 END AS alias FROM n WHERE boxed)
SELECT a.doc, a.line_no, max(b.alias) AS near FROM m a JOIN m b ON a.doc = b.doc AND a.line_no <> b.line_no AND b.alias > 0 AND regexp_matches(a.text, '[0-9]{{6}}') AND abs(b.ny - a.ny) <= 0.18
  AND greatest(0e0, least(a.nx + a.nw, b.nx + b.nw) - greatest(a.nx, b.nx)) / greatest(0.0001e0, least(a.nw, b.nw)) >= 0.35 GROUP BY ALL""")
def nearby_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best alias just above or below a line with digits."""
    rows = f.page_boxes(lines(spark, sf_dir)).withColumns({"wanted": F.col("text").rlike("[0-9]{6}"), "alias": F.when(F.contains("text", F.lit("nota fiscal")), 0.8).when(F.contains("text", F.lit("NF-e")), 0.5).otherwise(0.0)})
    return f.nearby_alias(rows)


_VALUES = "regexp_extract_all(text, '\\b[0-9]{6,7}\\b')"


@query(f"""WITH {_LINES}, v AS (SELECT *, {_VALUES} AS vs FROM l WHERE len({_VALUES}) > 0), u AS (SELECT *, greatest(0e0, least(1e0, confidence)) AS c, greatest(0e0, least(1e0, provider)) AS p FROM v),
o AS (SELECT DISTINCT ON (doc) doc, vs[1] AS value, {r2('least(1e0, c * 0.58e0 + p * 0.22e0 + 0e0 * 0.2e0 + 0e0 * 0e0)')} AS score FROM u ORDER BY doc, score DESC, line_no),
g AS (SELECT doc, greatest(0e0, least(1e0, max(provider))) AS p FROM l GROUP BY doc), f AS (SELECT doc, arg_min(vs[1], line_no) AS value FROM u GROUP BY doc),
w AS (SELECT doc, value, {r2('least(1e0, p * 0.58e0 + p * 0.22e0 + 0e0 * 0.2e0 + 0e0 * 0e0)')} AS score FROM f JOIN g USING (doc))
SELECT doc, CASE WHEN w.score > o.score THEN w.value ELSE o.value END AS value, greatest(w.score, o.score) AS confidence, CASE WHEN w.score > o.score THEN 'document' ELSE 'line' END AS source FROM o JOIN w USING (doc)""")
def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best value of a field that a pattern tells, from lines or the whole text."""
    spec = f.ValueSpec(r"\b[0-9]{6,7}\b", [])
    return f.parse_values(lines(spark, sf_dir), spec)


@query(f"""WITH {_LINES} SELECT doc, round(sum(top * greatest(4, len(trim(text)))) / sum(greatest(4, len(trim(text)))), 4) AS confidence FROM l GROUP BY doc""")
def weighted_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence by document, by length."""
    return f.weighted_confidence(lines(spark, sf_dir).withColumn("confidence", F.col("top")))


@query(f"""WITH {_LINES}, s AS (SELECT *, {search('text')} AS s, round_even(top / 14, 0) AS b FROM l) SELECT DISTINCT ON (doc, s, b) doc, line_no, text, confidence FROM s ORDER BY doc, s, b, confidence DESC, line_no""")
def distinct_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest of equal lines in one band of a page."""
    return f.distinct_lines(lines(spark, sf_dir)).select("doc", "line_no", "text", "confidence")


_DATED = "CASE l_linenumber % 3 WHEN 0 THEN 'data de recebimento ' ELSE 'total ' END || CAST(l_partkey % 40 AS STRING) || '/' || CAST(l_suppkey % 14 AS STRING) || '/20' || CAST(20 + l_linenumber AS STRING)"


@query(f"""WITH l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS doc, l_linenumber AS line_no, l_quantity / 100 AS c, {_DATED} AS text, CAST(l_partkey % 40 AS STRING) AS d, CAST(l_suppkey % 14 AS STRING) AS m, '20' || CAST(20 + l_linenumber AS STRING) AS y FROM lineitem ORDER BY l_orderkey, l_linenumber, {', '.join(_FIRST)}),
v AS (SELECT doc, line_no, {r4("CASE WHEN text LIKE 'data%' THEN least(0.99e0, c + 0.15e0) ELSE c END")} AS confidence, try_cast(y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS day FROM l WHERE regexp_matches(text, '\\b([0-3]?[0-9]/[01]?[0-9]/20[0-9][0-9])\\b'))
SELECT DISTINCT ON (doc) doc, strftime(day, '%d/%m/%Y') AS date, strftime(day, '%Y-%m-%d') AS iso, confidence FROM v WHERE day IS NOT NULL ORDER BY doc, confidence DESC, line_no""")
def best_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest date of a document's lines; one with its label is surer."""
    from evidentia.operators import keys

    rows = keys.latest(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], *map(F.asc, _FIRST))
    rows = rows.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line_no"), (F.col("l_quantity") / 100).alias("confidence"), F.expr(_DATED).alias("text"))
    return f.best_date(rows)


@query(f"""WITH d AS (SELECT o_orderkey, o_orderkey % 3 <> 0 AS found, (o_orderkey * 7 % 101) / 100e0 AS c, CASE WHEN o_orderkey % 4 = 0 THEN 'hint' END AS hint, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE (o_orderkey * 13 % 101) / 100e0 END AS hc FROM orders),
u AS (SELECT *, hint IS NOT NULL AND (NOT found OR coalesce(hc, 0.65e0) >= c) AS use FROM d)
SELECT o_orderkey, use OR found AS found, CASE WHEN use THEN hint ELSE 'value' END AS value, {r2('CASE WHEN use THEN greatest(c, coalesce(hc, 0.65e0)) ELSE c END')} AS confidence,
  found::INT + (o_orderkey % 2 = 0)::INT AS found_count, array_to_string(list_filter([CASE WHEN NOT found THEN 'number' END, CASE WHEN o_orderkey % 2 <> 0 THEN 'date' END], lambda x: x IS NOT NULL), ',') AS missing,
  CASE WHEN found OR o_orderkey % 2 = 0 THEN {r2('(CASE WHEN found THEN c ELSE 0e0 END + CASE WHEN o_orderkey % 2 = 0 THEN coalesce(hc, 0e0) ELSE 0e0 END) / (found::INT + (o_orderkey % 2 = 0)::INT)')} ELSE 0e0 END AS average FROM u""")
def hints_and_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints over values, and counts and mean of what is found."""
    k = F.col("o_orderkey")
    found, c = k % 3 != 0, (k * 7 % 101) / 100
    hint, hc = F.when(k % 4 == 0, "hint"), F.when(k % 8 != 0, (k * 13 % 101) / 100)
    other = F.coalesce(hc, F.lit(0.0))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", f.with_hint(found, F.lit("value"), c, hint, hc).alias("h"), f.summary({"number": (found, c), "date": (k % 2 == 0, other)}).alias("s"))
    return rows.select("o_orderkey", "h.*", "s.found_count", F.array_join("s.missing", ",").alias("missing"), "s.average")
