"""Quality rules, personal data and sharding against plain Python versions."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import pytest
import xxhash

from evidentia.llm import pii, quality_rules, sharding

TEXTS = [
    None, "", " \t\n", "word", "a b a b a b a b\nx\nx\n\n  \nx", " ".join(f"w{i % 40}" for i in range(120)), "one two three " * 80,
    "# $ mail a.b@c.de_f@g.hi, x@y @z.w +1 (017) 555-7713 card 4111 1111 1111 1111 4111-1111-1111-1112",
    "1.2.3.4.5 256.1.1.1 001.002.003.0255 10.0.0.1", "é@x.fr àà@b.c ü 9 1234567890123456789012 " + "7" * 30000, "+12345678 +1234567890123456 +(1 +1 2",
    "id: AB-1234 id: CD-9999", "4111111111111111", "𝒳 𝒴 bob@mail.example.com", "\x0b\x0c\r a b \u0000",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(3, "word", "dup", 3), (None, "null id " * 60, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, extra int")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base(t):
    w, t = words(t), t or ""
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    rep = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    out = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))
    return (*out, len(w) < 50 or 100 * len(rep) > 50 * len(w))


def test_quality_base_and_score(spark, docs):
    docs = docs.drop("n_words")
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs, labels, buckets=64).collect()
    raw, target = collections.Counter(), collections.Counter()

    def cells(w):
        first = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        signed = lambda v: v - (v >> 63 << 64)
        return [signed(v) % 64 for v in first] + [signed(xxhash.xxh64_intdigest(b.encode(), a)) % 64 for a, b in zip(first, w[1:])]

    for r in docs.collect():
        raw.update(cells(words(r.text)))
        target.update(cells(words(r.text)) if r.doc_id == 5 else [])
    share, s = sum(target.values()) / sum(raw.values()), quality_rules.SMOOTHING
    weight = [round(math.log((target[c] + s * share) / (raw[c] + s) / share), 4) for c in range(64)]
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text), r
        c = cells(words(r.text))
        score = sum(weight[x] for x in c) / len(c) if c else None
        assert (r.llr is None) == (score is None) and (score is None or abs(r.llr - score) < 1e-9)
        assert r.kept == (not r.base_failed and (score or 0) >= quality_rules.THRESHOLD)


def test_quality_empty_and_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(docs.drop("n_words").limit(0), none).count() == 0
    assert all(r.kept != r.base_failed for r in quality_rules.quality_rules(docs.drop("n_words"), none).collect())


def spans(t):
    t, out = t or "", []
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    for k, (kind, p, ok) in enumerate([
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, t) if ok(m.group())]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_pii_base(docs):
    rows = {r.doc_id: r for r in pii.digest(docs).collect()}
    for i, t in enumerate(TEXTS):
        want = spans(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, rows[i].spans, want)
        assert set(want) <= set(filter(None, rows[i].spans.split(",")))
        assert rows[i].n_email == sum(x.startswith("email") for x in want) and rows[i].n_card == sum(x.startswith("card") for x in want)


def test_pii_bootstrap_finds_unseen_and_masks(spark):
    rows = [(i, f"please reach agent at user{i}@mail.example.com today") for i in range(9)] + [(20, "please reach agent at user77@localhost today"), (21, "nothing at room 12 here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # the same context finds another shape
    got = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    assert got[20] == "email:22:38" and got[3] == "email:22:44" and got[21] == ""
    rows = [(i, f"call desk 10.0.0.{i} now") for i in range(9)] + [(30, "call desk 300.0.0.7 now"), (31, "call desk 300.0.0.7 now"), (32, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    assert got[30] == got[31] == "ip:10:19" and got[3] == "ip:10:18" and got[32] == ""
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[30] == "call desk <ip> now" and masked[32] is None
    assert pii.digest(docs.limit(0)).count() == 0


def test_pii_found_values_lift_new_patterns(spark):
    """Identifiers found in one context make another context a pattern, which finds identifiers that the first never shows."""
    rows = [(i, f"call desk 10.0.0.{i} now") for i in range(100)] + [(100 + i, f"call desk 300.0.0.{i} now") for i in range(9)]
    rows += [(200 + i, f"old host 300.0.0.{i} down") for i in range(9)] + [(300, "old host 301.9.9.9 down"), (301, "old room 301.9.9.9 down")]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[102] == "ip:10:19" and got[201] == "ip:9:18" and got[300] == "ip:9:18" and got[301] == ""


def test_pii_own_vote_does_not_count(spark):
    """A context with one seed in four confirms nothing by its own tokens."""
    rows = [(i, f"item code 10.0.0.{i} here") for i in range(3)] + [(10 + i, f"item code A{i}B{i}C{i}X here") for i in range(9)]
    assert all("," not in r.spans and (r.spans == "") == (r.doc_id >= 10) for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_pii_long_texts_are_linear(spark):
    import time

    docs = spark.createDataFrame([(0, "1.2 " + "7" * 200_000), (1, "1.1." * 50_000), (2, "a1" * 100_000 + "@")], "doc_id long, text string")
    start = time.time()
    assert len(pii.digest(docs).collect()) == 3 and time.time() - start < 60


def test_quality_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a " * 60, "x", "y", "z", None)], "doc_id long, text string, kept string, _words string, _lines string, llr string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    r = quality_rules.quality_rules(docs, labels).collect()[0]
    assert r.kept in (True, False) and r.n_words == 60 and (r["_words"], r["_lines"]) == ("y", "z")


def test_shards_deal_out_rows_without_id(spark):
    docs = spark.createDataFrame([(None, f"{i} " + "x" * 200, i, "s") for i in range(3000)], "doc_id long, text string, shard int, slot string")
    got = sharding.shard(docs, bucket_bytes=4096)
    assert got.columns == ["doc_id", "text", *sharding.RESULTS]
    rows = got.collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(3000)) and all(r["size"] == len(r.text) + 1 for r in rows)
    back = sharding.write_shards(docs, sharding.fresh_path(spark, "t"), bucket_bytes=4096)
    assert max(r["count"] for r in back.groupBy("_s_bucket").count().collect()) < 400


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 64])
def test_shards(spark, docs, bucket_bytes):
    got = sharding.shard(docs, bucket_bytes=bucket_bytes).collect()
    again = sharding.shard(docs, bucket_bytes=bucket_bytes).collect()
    key = lambda r: (r.shard, r.slot)
    assert [key(r) + (r.doc_id,) for r in sorted(got, key=key)] == [key(r) + (r.doc_id,) for r in sorted(again, key=key)]
    assert len(got) == len(TEXTS) + 2
    for s, rows in itertools.groupby(sorted(got, key=key), key=lambda r: r.shard):
        assert [r.slot for r in rows] == list(range(len([x for x in got if x.shard == s])))
    for r in got:
        b = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(b) + 1, zlib.crc32(b)) and r.grown_shard in (r.shard, 16)
    assert sharding.shard(docs.limit(0)).count() == 0
