"""Every query against its SQL, and functions against the fixtures."""

import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from evidentia.functions import boxes, dates, scoring
from evidentia.functions import text as t
from evidentia.operators import rules, windows
from evidentia.plans import catalog
from evidentia.streaming import jobs as stream

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    same(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name], con)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    L = F.lit
    assert one(spark, t.normalize_noise(L("  NF-e   “16171762”  "))) == 'NF-e "16171762"'
    assert one(spark, t.searchable(L("SÉRIE 1 - RECEBEMOS DE MAR E RIO"))) == "serie 1 recebemos de mar e rio"
    assert one(spark, t.digits_only(L("N° 1617.1762"))) == "16171762"
    assert one(spark, t.normalize_noise(L("Nº 171056]"))) == "No 1710561"
    assert one(spark, t.command(L("!recibo status agora"), "!recibo")).asDict() == {"name": "status", "args": ["agora"]}
    assert one(spark, t.phone_digits(L("5511@c.us"))) == "5511" and one(spark, t.expected_key(L("1710486.JPG"))) == "1710486"
    assert one(spark, t.file_stem(L("a/b c.jpg"))) == "a__b_c" and one(spark, t.business_key(L("NF 1710486"))) == "1710486"
    assert one(spark, t.unit_confidence(L(81))) == 0.81 and one(spark, t.searchable(L(None))) == ""
    assert one(spark, t.normalized_lines(L("a\r\n\n b  c"))) == ["a", "b c"]


def test_scores_and_dates(spark):
    L = F.lit
    assert one(spark, scoring.similarity(L(""), L(""))) == 1.0 and one(spark, scoring.alias_confidence(L("DATA DE RECEBIMENTO"), L("DATA DE RECEBIMEN10"))) > 0.85
    assert one(spark, scoring.is_repdigit(L("7777"))) and one(spark, scoring.nearest_rank(F.array(L(3), L(1), L(2)), 0.5)) == 2
    assert one(spark, dates.is_compact_date(L("200326"))) and not one(spark, dates.is_compact_date(L("991399")))
    assert one(spark, dates.date_only(L("1710028800"))) == "2024-03-10" == one(spark, dates.date_only(L("2024-03-10")))
    got = one(spark, rules.overlay(F.create_map(L("a"), L("1"), L("b"), L("2")), F.create_map(L("b"), L("3"))))
    assert got == {"a": "1", "b": "3"}


def test_windows_and_boxes(spark):
    L = F.lit
    got = [w["raw"] for w in one(spark, windows.line_windows(L("a\n--\nb")))]
    assert got == ["a", "a --", "-- b", "a -- b", "b"]
    assert one(spark, windows.line_windows(L(None))) == [] == one(spark, windows.sliding_digits(L("")))
    assert one(spark, windows.sliding_digits(L("x 123456789"))) == ["1234567", "2345678", "3456789"]
    assert one(spark, windows.token_windows(F.array(L("a"), L("b"), L("c")), 2)) == ["a", "b", "c", "a b", "b c", "a b c"]
    a, b = (boxes.box(*map(L, v)) for v in ((0.0, 0.0, 0.5, 0.5), (0.25, 0.0, 0.5, 0.5)))
    assert one(spark, boxes.overlap_share(a, b)) == 0.5 and one(spark, boxes.overlap_share(a, L(None).cast("struct<x:double,y:double,width:double,height:double>"))) == 0.0
    assert one(spark, boxes.expanded(a, 0.25, 0.25)).asDict() == {"x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0}


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(500)
    events.write.parquet(f"{tmp_path}/in")
    rows = stream.job_states(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "user_id", "event_type", "ts")
    q = rows.writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("states").agg(F.sum("events")).first()[0] == 500
