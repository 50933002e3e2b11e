"""WARC, decontamination and the classifier."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from evidentia.llm import decontaminate, quality_classifier, warc

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    big, rows = "<p>x</p>" * 200, []
    for i in range(30):
        rows.append((i, f"http://h/{i}", "\x1f\x8b\x08 é" + str(i) * (i * 40) if i % 3 else big, i))
    rows += [(30, None, None, 0), (31, "u\r\nv", "", 0), (7, "http://h/7", "\x1f\x8b\x08 é" + "7" * 280, 0), (40, "d", "y" * 2000, 0), (40, "d", "y" * 2000, 0), (40, "c", "y" * 2000, 0), (None, "n", "y" * 2000, 0), (None, "n", "tiny", 0)]
    rnd = random.Random(1)
    rows += [(100 + i, "r", "".join(chr(rnd.randrange(32, 0x2000)) for _ in range(3000)), 0) for i in range(40)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")


@pytest.mark.parametrize("split", [257, 5000, 1 << 22])
def test_warc(pages, tmp_path, split):
    files = warc.write_archives(pages, f"file://{tmp_path}/w", file_bytes=60_000)
    got = warc.read_archives(files, split).collect()
    rows = pages.collect()
    assert len(got) == len(rows)
    digest = lambda r: hashlib.sha1((r.html or "").encode()).hexdigest()
    key = lambda r: (-1 if r[0] is None else r[0], *map(str, r[1:]))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=key) == sorted(((r.page_id, len((r.html or "").encode()), digest(r)) for r in rows), key=key)
    by = {}
    for r in rows:
        if len((r.html or "").encode()) >= 1000:
            by.setdefault(digest(r), []).append(-1 if r.page_id is None else r.page_id)
    for d, ids in by.items():
        mine = [r for r in got if r.payload_digest == d]
        top = [r for r in mine if r.record_type == "response"]
        assert [r.page_id for r in top] == [max(ids)] and all(r.refers_to == max(ids) for r in mine if r.record_type == "revisit")
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.payload_digest not in by)


def test_warc_empty(pages):
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_overlaps(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(14 + i * 3))) for i in range(12)] + [(50, "Short item, five words."), (51, None), (52, ""), (0, " ".join(text(20)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs, want = [], set()
    for i, (item, t) in enumerate(items[:13]):
        w = (t or "").split()
        docs.append((i, " ".join(text(30) + w + text(9))))
        want.add((i, item))
        if len(w) > 13:  # two substitutions apart, and a passage
            v = w[:]
            v[3] = v[9] = "other"
            docs.append((100 + i, " ".join(text(5) + v)))
            docs.append((200 + i, (" ".join(w[:13]) + ", " + " ".join(text(40))).upper()))
            want |= {(100 + i, item), (200 + i, item)}
    docs += [(300 + i, " ".join(text(400))) for i in range(40)] + [(400, None), (401, ""), (None, "Short item five words"), (0, docs[0][1])]
    want |= {(None, 50)}
    table = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item_id string")
    got = decontaminate.overlaps(table.repartition(3), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) + 1
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(table, bench, block_items=4).collect()} == want
    kept = decontaminate.decontaminate(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.overlaps(table, bench.limit(0)).count() == 0 and decontaminate.decontaminate(table.limit(0), bench).count() == 0


def brute(item, doc):
    """Whether some window of the item, at some place of the document, has four fifths of its words."""
    n = min(13, len(item))
    return any(5 * sum(a == b for a, b in zip(item[j : j + n], doc[i : i + n])) >= 4 * n for j in range(len(item) - n + 1) for i in range(len(doc) - n + 1))


def test_no_substitutions_hide_a_passage():
    wanted = 0
    for n in [*range(1, 19), 20, 30, 60, 200]:
        item = [f"w{i}" for i in range(n)]
        index = decontaminate.SeedIndex([(1, " ".join(item))])
        places = [p for k in range(min(4, n + 1)) for p in itertools.combinations(range(n), k)] if n < 19 else []
        places += [range(phase, n, k) for k in (2, 3, 4, 5, 6, 7) for phase in range(k)]
        docs = [["a", "b"] + ["other" if i in p else w for i, w in enumerate(item)] + ["c"] for p in map(set, places)]
        got = {d for d, *_ in decontaminate._found(index, [" ".join(d) for d in docs])}
        want = {k for k, d in enumerate(docs) if brute(item, d)}
        assert got == want, (n, [places[k] for k in sorted(got ^ want)][:5])
        wanted += len(want)
    assert wanted > 1000


def test_classifier(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.93


def test_classifier_edges(spark):
    rows = [(1, None), (2, ""), (3, "x"), (None, "x y"), (3, "x"), (4, "\t\n "), (5, "long " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality_classifier.classify(docs, none).collect()] == [0.5] * 7
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, None, 0), (None, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == 7 and got[2].score == got[4].score and quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_features_against_loops():
    """Words, pairs and character n-grams of a text, each hashed as the arrays do."""
    mask = (1 << 64) - 1
    m = int(quality_classifier._M)

    def mix(x):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & mask
        return x ^ x >> 32

    for text in ("", " ", "a", "Ab c\nd", "ñandú 漢字 🙂 x" * 3):
        c = [ord(x) + 1 for x in f" {text} "]
        words = [mix(sum(mix(ord(x) + 1 + k * m & mask) for k, x in enumerate(w)) & mask) for w in text.split()]
        want = words + [mix(a * m + b & mask) for a, b in zip(words, words[1:])]
        for n in (3, 4, 5) if words else ():
            for i in range(len(c) - n + 1):
                h = c[i]
                for x in c[i + 1 : i + n]:
                    h = h * m + x & mask
                want.append(mix(h + n & mask))
        assert sorted(quality_classifier.features(text, 1 << 20).tolist()) == sorted(w % (1 << 20) for w in want), text
