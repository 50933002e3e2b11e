"""The Katz model against plain counting."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import katz
from evidentia.llm.quality_classifier import held_out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["<end>"]


class Plain:
    def __init__(self, texts):
        self.c = collections.Counter(w for t in texts for w in words(t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        m = collections.Counter(self.c.values())
        self.d1 = katz.discounts(m)
        left = sum(m[r] * r * (1 - self.d1[r]) for r in range(1, katz.K + 1))
        self.n1, self.unknown = (self.n, left / self.n) if left > 0 else (self.n + 1, 1 / (self.n + 1))
        self.b = collections.Counter(p for t in texts for p in zip(["<start>", *words(t)], words(t)))
        self.d2 = katz.discounts(collections.Counter(self.b.values()))
        self.h = dict(self.c) | {"<start>": len(texts)}
        self.a = {}
        for h in self.h:
            seen = [w for g, w in self.b if g == h]
            if seen:
                high = sum(self.disc(self.b[h, w]) for w in seen)
                if high >= self.h[h] * (1 - 1e-12):
                    self.h[h] += 1
                self.a[h] = (1 - high / self.h[h]) / (1 - sum(self.p1(w) for w in seen))

    def disc(self, c):
        return self.d2[min(c, katz.K + 1)] * c

    def p1(self, w):
        return self.d1[min(self.c[w], katz.K + 1)] * self.c[w] / self.n1 if self.c[w] else self.unknown

    def p(self, w, h):
        return self.disc(self.b[h, w]) / self.h[h] if self.b[h, w] else self.a.get(h, 1.0) * self.p1(w)

    def row(self, t):
        w = words(t)
        base = sum(math.log10((self.c[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        return len(w), sum(self.c[x] > 0 for x in w), self.n, base, sum(math.log10(self.p(x, h)) for h, x in zip(["<start>", *w], w))


def corpus():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices([f"W{i}" for i in range(60)], weights=[60 / (i + 1) for i in range(60)], k=rnd.randrange(0, 50))) for _ in range(90)]
    return [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "never seen words"), (None, "w1 w1 w0"), (5, texts[5]), (6, texts[6])]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1


@pytest.mark.parametrize("chunk,part", [(1 << 21, 1 << 22), (100, 50), (1, 7)])
def test_scores(spark, monkeypatch, chunk, part):
    """Null ids and texts, repeated rows, a clashing column; chunks and parts of all sizes."""
    monkeypatch.setattr(katz, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(katz, "PART_KEYS", part)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, score string, kind int").repartition(3)
    plain = Plain([t for d, t in rows if not held(d)])
    key = lambda r: (r[0] is None, r[0], r[2], r[5])
    got = sorted((tuple(r) for r in katz.score_corpus(docs, held_out(F.col("doc_id"), 1)).collect()), key=key)
    want = sorted(((d, held(d), *plain.row(t)) for d, t in rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], rtol=1e-9), (g, w)
    for h in [*plain.h, "unheard"]:
        assert abs(sum(plain.p(w, h) for w in plain.c) + plain.a.get(h, 1.0) * plain.unknown - 1) < 1e-9


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in katz.score_corpus(docs, F.lit(True)).collect()}
    assert got[1].train_tokens == 0 and got[1].n_tokens == 3 and got[1].score == 0 and got[1].base_score == 0
    assert katz.score_corpus(docs.limit(0), F.lit(False)).count() == 0


def test_rare_words_and_long_texts(spark):
    """Words under a millionth of the tokens have bigrams; a text of a million words is scored whole."""
    rows = [(i, "a " * (100_000 if i else 1_000_000)) for i in range(4)] + [(20 + i, f"x{i} y{i} a") for i in range(30)] + [(99, "x3 y3 y4 a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = Plain([t for d, t in rows if d != 99])
    assert plain.c["x3"] < 1e-6 * plain.n and plain.b["x3", "y3"]
    got = {r.doc_id: r for r in katz.score_corpus(docs, F.col("doc_id") == 99).collect()}
    assert got[0].n_tokens == 1_000_001
    for d, t in rows[4:]:
        assert np.isclose(got[d].score, plain.row(t)[-1], rtol=1e-9), d
