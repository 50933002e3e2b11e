"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: digests of payloads are grouped (partial counts first), payloads of ``revisit_bytes`` and more that occur
again refer to the row with the largest page_id, and every task writes its pages as gzip members, one a record, to
files of about ``file_bytes``.  Reading: files are cut into byte ranges; a task scans its range for gzip magic,
validates each candidate by decoding the record's header from it, owns the records that start inside its range
and reads on past its end for the last of them.

Defined results: a null html is an empty payload; a null url is written as 'urn:page:<page_id>'; repeated rows of one
page_id are records of their own, and all of them but one response revisit it when large (one row writes the response: the
first of the repeated rows in the order of their url); a null page_id sorts below all others and is written without an id, which reads back as null;
an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import fresh_path, spread, written
from evidentia.llm.files import RangeReader, size_of, write_whole

REVISIT_BYTES, FILE_BYTES, SPLIT_BYTES = 1000, 16 << 20, 4 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: A fixed date: archives written again are the same.
DATE = "2024-01-01T00:00:00Z"
#: Bytes read at a time.
STEP = 1 << 18


def plan_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages as page_id, url, payload, digest (hex SHA-1) and refers_to (null: a response)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "large": F.octet_length("payload") >= revisit_bytes})
    each = rows.where("large").groupBy("digest", "page_id", F.coalesce("url", F.lit("")).alias("u")).agg(F.count("*").alias("k"))
    marks = each.groupBy("digest").agg(F.max(F.struct("page_id", "u", "k")).alias("top"), F.sum("k").alias("n"))
    marks = written(marks.where("n > 1").select("digest", F.col("top.page_id").alias("first"), F.col("top.u").alias("first_url"), F.col("top.k").alias("k")), "warc-marks")
    repeated = marks.where("k > 1").limit(1).count() > 0
    marks = marks.drop("k")
    large = rows.where("large").join(marks, "digest", "left")
    same = F.col("page_id").eqNullSafe(F.col("first")) & (F.coalesce("url", F.lit("")) == F.col("first_url"))
    refers = F.when(F.col("first_url").isNotNull() & ~same, F.col("first"))
    # refers_to of a lone null page_id can't be told from a response's, so revisit says it
    large = large.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), (F.col("first_url").isNotNull() & ~same).alias("revisit"), (F.col("first_url").isNotNull() & same).alias("shared"))
    # rows repeated with the same page_id and url: all but one revisit
    lone = large.where(~F.col("shared")) if repeated else large
    w = Window.partitionBy("digest").orderBy(F.monotonically_increasing_id())
    tops = large.where("shared").withColumn("i", F.row_number().over(w))
    tops = tops.select("page_id", "url", "payload", "digest", F.when(F.col("i") > 1, F.col("page_id")).alias("refers_to"), (F.col("i") > 1).alias("revisit"), "shared")
    small = rows.where("not large").select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"), F.lit(False).alias("shared"))
    out = lone.unionByName(tops) if repeated else lone
    return out.unionByName(small).drop("shared")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    name = "urn:page:" + ("" if page_id is None else str(page_id))
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    uri = url.replace("\r", "%0D").replace("\n", "%0A") if url else name
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http;msgtype=response"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if revisit:
        target = "" if refers_to is None else str(refers_to)
        lines += [f"WARC-Refers-To: <urn:page:{target}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    lines.append(f"Content-Length: {len(block)}")
    raw = VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages under folder; returns a table of the archives (path, bytes, records)."""

    def write(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pd.DataFrame:
            nonlocal k, held, size
            name = f"{folder}/pages-{part:06d}-{k:06d}.warc.gz"
            write_whole(name, held)
            out = pd.DataFrame({"path": [name], "bytes": [size], "records": [len(held)]})
            k, held, size = k + 1, [], 0
            return out

        for f in frames:
            whole = lambda x: None if x is None or x != x else int(x)
            for r in f.itertuples(index=False):
                held.append(_record(whole(r.page_id), r.url, bytes(r.payload), r.digest, whole(r.refers_to), r.revisit))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    rows = plan_records(pages, revisit_bytes).select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"), "revisit")
    return written(rows.mapInPandas(write, "path string, bytes long, records long"), "warc-files")


class _Source:
    """Bytes of a file from any place on, read in steps and dropped when passed."""

    def __init__(self, reader: RangeReader, start: int):
        self.reader, self.at, self.data = reader, start, b""

    def grow(self) -> bool:
        more = self.reader.read(self.at + len(self.data), STEP)
        self.data += more
        return bool(more)

    def drop(self, n: int) -> None:
        self.at, self.data = self.at + n, self.data[n:]


def _member(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The record that starts at the offset ``at`` of the source's data and the length of its member, or None if none starts there."""
    z, out, fed = zlib.decompressobj(31), [], at
    total, checked = 0, False
    try:
        while not z.eof:
            if fed == len(source.data) and not source.grow():
                return None
            chunk = source.data[fed : fed + STEP]
            fed += len(chunk)
            out.append(z.decompress(chunk))
            total += len(out[-1])
            if not checked and total >= len(VERSION):
                if not b"".join(out).startswith(VERSION):
                    return None
                checked = True
    except zlib.error:
        return None
    return (b"".join(out), fed - at - len(z.unused_data)) if checked else None


def parse_record(raw: bytes) -> dict:
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    page = lambda name: int(x) if (x := fields[name].rpartition(":")[2].rstrip(">")) else None
    revisit = fields["WARC-Type"] == "revisit"
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload differs from its digest")
    return {"page_id": page("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To") if revisit else None, "url": fields["WARC-Target-URI"], "payload": None if revisit else payload}


def records_in(uri: str, start: int, end: int) -> Iterator[dict]:
    """Records whose members start in [start, end) of a file."""
    reader = RangeReader(uri)
    try:
        source = _Source(reader, start)
        while source.at < end:
            i = source.data.find(MAGIC)
            if i < 0:
                if not source.data or source.at + len(source.data) < end + len(MAGIC):
                    source.drop(max(0, len(source.data) - len(MAGIC) + 1))
                    if source.grow():
                        continue
                return
            if source.at + i >= end:
                return
            source.drop(i)
            if found := _member(source, 0):
                yield parse_record(found[0])
                source.drop(found[1])
            else:
                source.drop(1)
    finally:
        reader.close()


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for every record of the archives in files (path)."""

    def ranges(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                starts = range(0, size_of(path), split_bytes)
                yield pd.DataFrame({"path": path, "a": list(starts), "b": [s + split_bytes for s in starts]})

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        for f in frames:
            for r in f.itertuples(index=False):
                rows = [[x[k] for k in names] for x in records_in(r.path, r.a, r.b)]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    cuts = files.select("path").mapInPandas(ranges, "path string, a long, b long")
    cuts = cuts.repartition(spread(files.sparkSession), "path", "a")
    return cuts.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    files = write_archives(pages, folder or fresh_path(pages.sparkSession, "warc"), **settings)
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
