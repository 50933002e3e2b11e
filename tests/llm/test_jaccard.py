"""The Jaccard join against all pairs of sets."""

import random
import re

import numpy as np
import pytest

from evidentia.llm import jaccard_join


def sets(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    s = [sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = lambda v: min([x for x in v if x is not None], default=None)
    return [(d, len(s[i]), least(groups[root(i)])) for i, (d, _) in enumerate(rows)]


def corpus(seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"Wö{i}" for i in range(400)]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage, texts = make(60), []
    for _ in range(40):
        texts.append(make(rnd.randrange(1, 120)))
    for _ in range(40):
        t = list(rnd.choice(texts))
        for _ in range(rnd.randrange(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
        texts.append(t)
    for _ in range(30):  # a passage that many share
        texts.append(make(rnd.randrange(5, 60)) + passage + make(rnd.randrange(0, 20)))
    walk = make(90)
    for _ in range(30):  # a chain of near copies whose ends don't link
        walk = list(walk)
        walk[rnd.randrange(len(walk))] = rnd.choice(vocabulary)
        texts.append(walk)
    texts += [["a"], ["A"], ["a", "b"], [], ["x"] * 50, ["x"] * 9]
    rows = [(i * 7 % 1009, " ".join(t) if i % 5 else "\n ".join(t).upper()) for i, t in enumerate(texts)]
    return rows + [(5000, None), (5001, ""), (None, "a"), (None, "lone null"), (rows[3][0], rows[3][1]), (rows[4][0], "another text of the same id here")]


@pytest.mark.parametrize("seed,settings", [(20, {}), (3, {"COMMON_WINDOW": 500, "COMMON": 3, "FAN": 2, "PART": 16}), (4, {"STARS": 0, "HOT": 5}), (5, {"LEADERS": 1, "HOT": 3, "FAN": 3, "PART": 4, "STARS": 1, "TREES": 1})])
def test_components(spark, monkeypatch, seed, settings):
    """Whatever the shapes of trees, splits and rounds."""
    for name, value in settings.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n string").repartition(4)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in jaccard_join.join_components(docs).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_pairs_are_given_once():
    """By the tree of their first common home; pairs without one by every tree."""
    homes = np.array([[7, 8], [7, 9], [5, 8], [6, 6]])
    x, y = np.array([0, 0, 1]), np.array([1, 2, 3])
    for key, want in ((7, [True, False, True]), (8, [False, True, True]), (9, [False, False, True])):
        assert jaccard_join._given_here(x, y, np.full(4, key), homes).tolist() == want


def test_tree_finds_all_pairs():
    rnd = np.random.default_rng(1)
    base = [np.unique(rnd.integers(0, 1 << 60, 150).astype(np.uint64)) for _ in range(20)]
    sets_ = [np.unique(np.where(rnd.random(len(b)) < 0.04, rnd.integers(0, 1 << 60, len(b)).astype(np.uint64), b)) for b in base for _ in range(12)]
    points, sizes, labels = np.array([jaccard_join.point(s) for s in sets_]), np.array([len(s) for s in sets_]), np.arange(len(sets_)) // 3
    tree = jaccard_join.RTree(points, sizes, labels)
    got = {tuple(sorted(p)) for x, y in tree.candidates() for p in zip(x.tolist(), y.tolist())}
    overlap = np.minimum(points[:, None], points[None]).sum(axis=2, dtype=np.int64)
    fit = 9 * overlap >= 4 * (sizes[:, None] + sizes)
    want = {(i, j) for i in range(len(sets_)) for j in range(i + 1, len(sets_)) if fit[i, j] and labels[i] != labels[j] and 5 * sizes[i] >= 4 * sizes[j] and 5 * sizes[j] >= 4 * sizes[i]}
    assert got == want and len(want) < 20 * 66 + 50 and len(tree.levels) > 2


def test_long_texts(spark):
    """Groups past the greatest count of a point bound nothing: long near copies still link."""
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(120_000)]
    near = [w if rnd.random() > 0.01 else "other" for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:90_000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.join_components(docs).collect()) == sorted((d, c) for d, _, c in brute(rows))


def test_deduplicate(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "n", "g") for r in rows], "doc_id long, text string, n string, _gone string")
    want = {(c, n) for d, n, c in brute(rows) if n}
    kept = jaccard_join.deduplicate(docs)
    assert kept.columns == docs.columns
    got = [r for r in kept.collect() if sets(r.text)]
    assert len({r.doc_id for r in got}) == len(got) and {r.doc_id for r in got} <= {c for c, _ in want}
    assert {5000, 5001} <= {r.doc_id for r in kept.collect()}
    assert jaccard_join.join_components(docs.limit(0)).count() == 0


def test_bound_never_loses():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rnd.integers(0, 400, rnd.integers(1, 200)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < 0.9], rnd.integers(0, 400, 3).astype(np.uint64)]))
        i = len(np.intersect1d(a, b))
        assert np.minimum(jaccard_join.point(a), jaccard_join.point(b)).sum() >= i
        assert jaccard_join.fine_bound(jaccard_join.fine_point(a), jaccard_join.fine_point(b)) >= i
        if 100 * i >= 80 * (len(a) + len(b) - i):
            assert len(np.intersect1d(jaccard_join.signature(a, b[:5]), jaccard_join.signature(b, b[:5])))
            assert set(jaccard_join.cuts(len(a))) & set(jaccard_join.cuts(len(b)))
