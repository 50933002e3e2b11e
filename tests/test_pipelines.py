"""Sources, sinks, streams and drivers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.operators import queue
from evidentia.sources import files
from evidentia.streaming import pipelines as p


def put(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def test_files(spark, tmp_path):
    for name in ("b.JPG", "a.png", "sub/c.webp", "x.txt"):
        (tmp_path / "img" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / name).write_bytes(b"x")
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.select("path").collect()]
    assert names(files.images(spark, f"{tmp_path}/img")) == ["a.png", "b.JPG", "c.webp"]
    assert names(files.images(spark, f"{tmp_path}/img", recursive=False, limit=1)) == ["a.png"]
    (tmp_path / "m.json").write_text(json.dumps([{"messageId": "2", "filePath": "b", "status": "x"}, {"messageId": "1", "filePath": "a"}, {"messageId": "0"}, {"messageId": "3", "filePath": "c", "status": "bad"}]))
    schema = "messageId string, filePath string, status string"
    assert [r.filePath for r in files.manifest(spark, f"{tmp_path}/m.json", schema, ["bad"], 1).collect()] == ["a"]
    rows = spark.createDataFrame([("f", ["a", "b"], 1)], "file_name string, reasons array<string>, n int")
    done = files.write_report(rows, "both", f"{tmp_path}/r.json", ["file_name", "reasons"])
    assert [d.rsplit(".", 1)[1] for d in done] == ["json", "csv"] and spark.read.csv(done[1], header=True).collect()[0].reasons == "a, b"
    assert spark.read.json(done[0]).collect()[0].reasons == ["a", "b"]
    files.write_text(spark.createDataFrame([("a\nb",)], "x string"), f"{tmp_path}/t", "x")
    assert spark.read.text(f"{tmp_path}/t").collect()[0].value == "a b"
    with pytest.raises(ValueError):
        files.outputs("xml", "x")


def test_assets(spark, tmp_path):
    rows = spark.createDataFrame([("acme", "slip", "web", "a1", "dir/p.PNG", None, None, b"abc")], "c string, k string, s string, a string, o string, u string, m string, content binary")
    d = files.asset_descriptor(*[F.col(x) for x in "cksaoum"], now(), F.col("content"), "local", "http://x/")
    r = rows.select(d.alias("d"), "content").select("d.*", "content")
    got = r.collect()[0]
    assert got.storage_key == "acme/slip/2024/01/01/web-a1.png" and got.content_type == "image/png" and got.size_bytes == 3 and got.public_url == "http://x/" + got.storage_key and got.source.original_name == "p.PNG"
    files.write_assets(r.drop("source"), f"{tmp_path}/a", "stored_at")
    assert files.read_assets(spark, f"{tmp_path}/a", "acme", "2024-01-01").count() == 1 and files.read_assets(spark, f"{tmp_path}/a", "acme", "2024-01-02").count() == 0


def test_ingest_and_queue(spark, tmp_path):
    put(tmp_path / "in", "1.json", [{"request": "r1", "company_id": "acme"}, {"request": "r2"}])
    run = lambda: p.consume(p.request_stream(spark, f"{tmp_path}/in"), p.ingest(spark, f"{tmp_path}/out", now, F.col("company_id").isNotNull()), f"{tmp_path}/cp").awaitTermination(120)
    run()
    put(tmp_path / "in", "2.json", [{"request": "r3", "company_id": "beta"}])
    run()
    states = {r.request: r.status for r in spark.read.parquet(f"{tmp_path}/out/states").collect()}
    assert states == {"r1": "queued", "r2": "rejected", "r3": "queued"}
    jobs = spark.read.parquet(f"{tmp_path}/out/jobs").drop("batch")
    assert jobs.count() == 2 == spark.read.parquet(f"{tmp_path}/out/assets").count()
    taken = queue.claim(jobs, now(), "w")
    assert sorted(r.status for r in taken.collect()) == ["processing", "queued"]
    assert queue.claim(taken.where("status = 'processing'"), now(), "v").collect()[0].worker == "w"
    failed = queue.settle(taken, taken.where("worker = 'w'").select("id", F.lit("boom").alias("error")), now())
    late = queue.claim(failed.where("error = 'boom'"), now(), "v").collect()[0]
    assert late.status == "queued" and late.available_at.second == 5


def test_upsert_is_idempotent(spark, tmp_path):
    schema = "job string, status string, seq int"
    handle = p.upsert(spark, f"{tmp_path}/t", schema, "job", "seq")
    make = lambda *rows: spark.createDataFrame(rows, schema)
    handle(make(("a", "queued", 1), ("b", "queued", 2)), 0)
    for _ in range(2):  # a batch that runs again
        handle(make(("a", "done", 3), ("b", "old", 1)), 1)
    got = {r.job: r.status for r in p.latest(spark, f"{tmp_path}/t", schema).collect()}
    assert got == {"a": "done", "b": "queued"}
    for k in range(2, 6):
        handle(make(("a", f"s{k}", k + 5)), k)
    assert p._versions(spark, f"{tmp_path}/t") == [3, 4, 5]


def test_messages_and_progress(spark, tmp_path):
    put(tmp_path / "in", "1.json", [{"id": "1", "chat": "5@g.us", "has_media": True}, {"id": "2", "chat": "5@g.us", "from_me": True}, {"id": "3", "chat": "6@g.us"}, {"id": "4", "chat": "5@g.us", "body": "!recibo x"}])
    seen = []
    p.consume(p.message_stream(spark, f"{tmp_path}/in", ["5@g.us"], []), lambda b, _: seen.extend((r.id, r.route) for r in b.collect()), f"{tmp_path}/cp").awaitTermination(120)
    assert sorted(seen) == [("1", "media"), ("4", "command")]
    events = spark.createDataFrame([("j", "ocr", "running", 1), ("j", "ocr", "x", 2), ("j", "z", "running", 3)], "job string, stage string, status string, ts int")
    assert p.progress_events(events, ["ocr"]).count() == 1


def test_providers_and_drivers(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc int")
    told = lambda want: lambda d: d.select("doc", F.when(F.col("doc") == want, "success").otherwise("error").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit("x").alias("recognised"), F.lit(None).cast("string").alias("extracted"))
    chain = [p.Provider("off", lambda: False, None), p.Provider("one", lambda: True, told(1)), p.Provider("two", lambda: True, told(2))]
    got = sorted((r.doc, r.provider, r.status) for r in p.run_providers(docs, chain, F.col("status") == "success").collect())
    assert got == [(1, "off", "unavailable"), (1, "one", "success"), (2, "off", "unavailable"), (2, "one", "error"), (2, "two", "success"), (3, "off", "unavailable"), (3, "one", "error"), (3, "two", "error")]
    made = []
    r = p.Registry()
    r.register("q", lambda: made.append(1) or p.Driver("q", {"enqueue": lambda x: x + 1}))
    assert r.get("q").enqueue(1) == 2 and r.get("q") is r.get("q") and made == [1]
    with pytest.raises(AttributeError):
        r.get("q").drop
    with pytest.raises(ValueError):
        r.get("none")
