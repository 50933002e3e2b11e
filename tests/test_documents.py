"""Evidence, fields and decisions against the fixtures."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import dates
from evidentia.operators import decisions as d
from evidentia.operators import evidence as ev
from evidentia.operators import fields as f

SCHEMA = "doc int, ord int, id string, source_type string, confidence double, target_role string, roi string, region_id string, variant string, profile string, phase string, text string"
UG, UB, RLG, RRG = "upright__document_gray", "upright__document_binary", "rotate_left__document_gray", "rotate_right__document_gray"


def anchors(v):
    return [("nf_header", "nf_header_anchor", 76, v, "NF-e"), ("nf_series_line", "nf_series_anchor", 76, v, "SÉRIE 1")]


CASES = {
    1: [("nf_block", "nf_block_context", 88, UG, "NF-e\nN° 1711762\nSÉRIE 1")],
    2: [*anchors(UG), ("nf_number_line", "nf_digits_line", 75, UG, "1711762"), ("nf_number_tight", "nf_digits_isolated_confirm", 81, UG, "1711762")],
    3: [("nf_block", "nf_block_context_adaptive", 44, RLG, "NF-e\nNº 1TIOS3A\nSÉRIE 1")],
    4: [("nf_number_line", "nf_digits_line", 48, RRG, "DO NF-e No 1TINS31 SERIE I")],
    5: [("nf_number_line", "nf_digits_line", 0, RRG, "NF-e No 1710554 SERIE 1"), ("nf_block_wide", "nf_block_context", 0, RRG, "140651 1"), ("nf_block", "nf_block_context", 0, RRG, "140651 1")],
    6: [("nf_block", "nf_block_context", 65, RRG, "DO NF-e No 1710821 SERIE I"), ("nf_block_wide", "nf_block_wide_context", 40, RRG, "No 1710821"), ("nf_number_tight", "nf_digits_isolated_confirm", 83, RRG, "NF-e Nº 1710521 SERIE I")],
    7: [*anchors(UG), ("nf_number_tight", "nf_digits_isolated_confirm", 78, UG, "1710496"), ("nf_number_line", "nf_digits_line_confirm", 82, UB, "1710496"), ("nf_number_line", "nf_digits_line", 79, RRG, "1710496")],
    8: [("nf_block", "nf_block_context", 90, UG, "NF-e N° 16171762 SERIE 1")],
    9: [("nf_block", "nf_block_context", 19, RRG, "1714164 1")],
    10: [("nf_block", "nf_block_context", 70, UG, "20/03/26 1")],
    11: [("nf_block", "nf_block_context", 72, UG, "2010326"), *anchors(UB), ("nf_number_line", "nf_digits_line", 72, UB, "1721772")],
    12: [("nf_block", "nf_block_context", 84, UG, "261672")],
    13: [(None, None, None, None, None), ("", "", 0, "", "")],
}


@pytest.fixture(scope="module")
def ranked(spark):
    rows = [(c, i, f"s{i}", "nf_roi", None if r[2] is None else float(r[2]), r[1], r[0], None, r[3], None, None, r[4]) for c, rs in CASES.items() for i, r in enumerate(rs)]
    return ev.consensus(ev.candidates(spark.createDataFrame(rows, SCHEMA))).cache()


def test_best(ranked):
    got = {r["doc"]: r for r in ev.best_validated(ranked).collect()}
    want = {1: "1711762", 2: "1711762", 3: "1710531", 4: "1710531", 5: "1710554", 6: "1710521", 7: "1710496", 11: "1721772"}
    assert {k: r["nf"] for k, r in got.items()} == want
    for k, least in {1: 0.78, 2: 0.82, 3: 0.65, 4: 0.6, 7: 0.96}.items():
        assert got[k]["confidence"] >= least


def test_consensus(ranked):
    rows = {(r["doc"], r["nf"]): r for r in ranked.collect()}
    r = rows[2, "1711762"]
    assert r["support_count"] == 2 == r["roi_support_count"] and r["origin"] == "roi" and r["reasons"] and r["texts"]
    assert rows[11, "2010326"]["confidence"] <= 0.35 and rows[7, "1710496"]["roi_support_count"] == 2
    assert not any(k[0] in (8, 10, 12, 13) for k in rows)


def test_digits(spark):
    assert ev.fuzzy_digits("1TIOS3A") == ("1710531", 5, 0, 2) and ev.fuzzy_digits("N1!") == ("1", 0, 2, 1)
    assert ev.subsequences("1123", 3) == ["112", "113", "123"]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(F.sort_array(dates.artifact_variants(F.lit("211")))) == ["2", "21", "211"]
    assert one(dates.looks_like_date(F.lit("2010326"), F.lit(""))) and not one(dates.looks_like_date(F.lit("9999999"), F.lit("x")))
    assert one(dates.brazilian_date(F.lit("1.2.26"))).asDict() == {"date": "01/02/2026", "iso": "2026-02-01"} and one(dates.brazilian_date(F.lit("31/02/2026")))["iso"] is None


SPECS = {
    "date": f.FieldSpec(["data de recebimento", "recebimento"], ["roi_date_label"], ["data"], 0.6, True),
    "header": f.FieldSpec(["recebemos de acme"], ["roi_header"], ["header"], 0.6),
    "nfe": f.FieldSpec(["nf e", "nfe"], ["roi_nf_block"], ["nf"], 0.6),
}


def test_detect(spark):
    texts = ["DATA DE RECEBIMENTO\nRECEBEMOS DE ACME\nNF-e\nN° 16171762\nSÉRIE 1", "DATA DE RECEBIMEN10\nRECEBEM0S DE ACM3\nNFe", "", None]
    rows = spark.createDataFrame([(i, 0, "a", x, 70.0, None, None, None) for i, x in enumerate(texts)], "doc int, ord int, id string, text string, confidence double, region_id string, target_role string, field_keys array<string>")
    got = {r["doc"]: r for r in f.detect(rows, SPECS).collect()}
    assert [got[i]["detected_count"] for i in range(4)] == [3, 3, 0, 0] and got[3]["missing_fields"] == ["date", "header", "nfe"]
    assert got[0]["date"]["method"] == "exact_inclusion" and "ocr_estavel" in got[0]["date"]["reasons"]


def test_parse(spark):
    schema = "doc int, line_no int, text string, confidence double, provider_confidence double, box struct<x:double,y:double,width:double,height:double>, page_width double, page_height double"
    box = lambda a, b, c, e: (float(a), float(b), float(c - a), float(e - b))
    rows = [
        (1, 0, "RECEBEMOS DE ACME", 0.95, 0.93, None, None, None), (1, 1, "DATA DE RECEBIMENTO 10/03/2026", 0.92, 0.93, None, None, None), (1, 2, "NF-e 1710500", 0.91, 0.93, None, None, None),
        (2, 0, "RECEBEMOS DE ACME", 0.95, 0.9, box(120, 30, 760, 90), 1000.0, 500.0), (2, 1, "NF-e", 0.84, 0.9, box(860, 50, 940, 95), 1000.0, 500.0),
        (2, 2, "1719844", 0.77, 0.9, box(875, 110, 965, 175), 1000.0, 500.0), (2, 3, "33621540", 0.99, 0.9, box(230, 250, 420, 300), 1000.0, 500.0), (3, 0, None, None, None, None, None, None),
    ]
    lines = spark.createDataFrame(rows, schema)
    number = f.ValueSpec(r"\b\d{6,9}\b", ["nf e", "nfe", "nota fiscal", "numero"], [(0.82, 0.05, 0.17, 0.3)], True)
    got = {r["doc"]: r["value"] for r in f.parse_values(lines, number).collect()}
    assert got == {1: "1710500", 2: "1719844"}
    date = f.parse_values(lines, f.ValueSpec(f.DATE_VALUE, ["data de recebimento"])).collect()
    assert [(r["doc"], r["value"]) for r in date] == [(1, "10/03/2026")] and date[0]["confidence"] >= 0.8
    assert f.best_date(lines.select("doc", "line_no", "text", "confidence")).collect()[0]["iso"] == "2026-03-10"


DOC = "id int, status string, template_matched boolean, geometry_score double, hard_reject boolean, date_found boolean, date_conf double, header_found boolean, header_conf double, nfe_found boolean, nfe_conf double, nf string, nf_conf double, support_count int, source_types array<string>, lookup_found boolean, ocr_conf double, lookup_reason string"


def test_classify(spark):
    rows = [
        (1, "usable", True, 0.84, False, True, 0.84, True, 0.81, True, 0.98, "16171762", 0.91, None, None, None, 78.0, None),
        (2, "usable", True, 0.8, False, True, 0.89, False, 0.41, True, 0.94, "16171762", 0.9, 2, ["field_region"], None, 73.0, None),
        (3, "usable", False, 0.78, False, True, 0.9, False, 0.2, True, 0.95, "1710496", 0.97, 3, ["field_region", "nf_roi"], True, 69.0, None),
        (4, "invalid", False, 0.12, False, False, 0.22, False, 0.18, False, 0.11, None, 0.0, None, None, None, 12.0, None),
        (5, "invalid", False, 0.31, True, True, 0.74, False, 0.22, True, 0.79, "1710496", 0.92, None, None, None, 63.0, None),
        (6, "review", True, 0.77, False, False, 0.43, False, 0.55, True, 0.69, "1714164", 0.68, 1, ["nf_roi"], True, 40.0, None),
        (7, *[None] * 17),
    ]
    got = {r["id"]: r for r in spark.createDataFrame(rows, DOC).withColumn("score", d.business_score()).withColumn("c", d.classify("HEADER", "ACME")).collect()}
    assert [got[i]["c"]["class"] for i in range(1, 8)] == ["valid"] * 3 + ["invalid"] * 2 + ["valid", "invalid"]
    assert got[1]["score"]["total"] >= 70 and not got[1]["c"]["reply"] and got[2]["score"]["fallback"] and got[3]["c"]["way"] == "database" and got[6]["c"]["way"] == "structural"
    assert any("existe na base de" in r for r in got[3]["c"]["reasons"]) and "Fundo muito claro" in got[5]["c"]["reasons"][0]


def test_structure_and_operational(spark):
    rows = [(1, None, True, 0.84, None, True, 0.82, False, 0.34, True, 0.91, *[None] * 5, 58.0, None), (2, None, False, 0.12, None, False, 0.12, False, 0.11, False, 0.1, *[None] * 5, 14.0, None)]
    got = [r["s"] for r in spark.createDataFrame(rows, DOC).withColumn("template_score", F.lit(0)).select("id", d.structure().alias("s")).orderBy("id").collect()]
    assert [(s["status"], s["can_fall_back"]) for s in got] == [("usable", True), ("invalid", False)]
    rows = [(True, 0.93, True, 0.9, False, None, 0.92), (True, 0.67, False, None, False, None, 0.67)]
    got = [r["o"] for r in spark.createDataFrame(rows, "number_found boolean, number_conf double, date_found boolean, date_conf double, header_found boolean, header_conf double, average double").select(d.operational({"number": "NF-e", "date": "Data", "header": "Cabecalho"}).alias("o")).collect()]
    assert got[0]["class"] == "valid" and got[0]["soft"] and not got[0]["trigger"] and got[1]["class"] == "invalid" and got[1]["trigger"]


def test_chain(spark):
    shape = "id int, a array<struct<kind:string,provider:string,status:string,class:string,trigger:boolean>>"
    rows = [
        (1, [("primary", "p", "success", "valid", False), ("fallback", "f", "success", "valid", False)]), (2, [("primary", "p", "success", "review", True), ("fallback", "f", "unavailable", None, None), ("legacy", "l", "success", "invalid", False)]),
        (3, [("primary", "p", "error", None, None), ("fallback", "f", "error", None, None)]), (4, []),
    ]
    df = spark.createDataFrame(rows, shape)
    pick = lambda **k: [r["p"] and r["p"]["provider"] for r in df.select("id", d.provider_chain(F.col("a"), **k).alias("p")).orderBy("id").collect()]
    assert pick() == ["p", "l", "f", None] and pick(legacy=False) == ["p", "p", "f", None]


def test_sync(spark):
    rows = [
        (1, "valid", "1710486", True, "full", None, None, None), (2, "review", "1710486", True, "status_only", [d.TEXTS["no_date"]], 62, 694), (3, "review", "1710486", False, "full", None, None, None),
        (4, "invalid", None, None, "full", None, None, None), (5, "review", "1721731", True, "full", ["x"], 65, 731), (6, "review", "12345", True, "full", ["x"], 65, 731),
    ]
    df = spark.createDataFrame(rows, "id int, class string, nf string, lookup_found boolean, mode string, reasons array<string>, trip_id int, trip_note_id int")
    got = df.select("id", d.sync_action(F.col("mode")).alias("s"), d.alert(F.lit("grupo")).alias("a"), d.promotion().alias("p"), d.dedupe_key(F.col("class"), F.col("nf")).alias("k")).orderBy("id").collect()
    assert [(r["s"]["type"], r["s"]["reason"]) for r in got[:4]] == [("mark_delivered", "upload_and_mark_delivered"), ("alert", "manual_review_required"), ("alert", "invoice_not_found"), ("alert", "missing_nf")]
    assert got[2]["a"]["code"] == "NF_NOT_FOUND_UPLOAD_ATTEMPT" and "NF" in got[2]["a"]["message"] and got[3]["k"] == ""
    assert [r["p"] for r in got] == [None, "missing_receipt_date_only", None, None, "matched_route_assignment", None]
