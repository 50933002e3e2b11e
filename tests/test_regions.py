"""Regions and variants against plain Python."""

from evidentia.operators import regions as g
from evidentia.plans import catalog


def test_number_sources(spark):
    ranked = [(1, "b", 1), (1, "lost", 2), (1, "c", 3), (2, "z", 5), (2, "a", 5), (4, "a", 1)]
    available = [(i, o, k, v, o + v) for i, names in ((1, "abcd"), (2, "az"), (3, "dcba")) for k, o in enumerate(names) for v in g.VARIANTS]
    available += [(1, "b", 9, "document_gray", "again"), (None, "a", 0, "document_gray", "none"), (3, None, 9, "document_gray", "none")]
    for phase, most in (("primary", 3), ("fallback", 2)):
        want = []
        for i in (1, 2, 3):
            rank, ord_ = {o: r for k, o, r in ranked if k == i}, {}
            for k, o, at, *_ in available:
                if k == i and o:
                    ord_[o] = min(at, ord_.get(o, at))
            order = sorted({*rank, *ord_}, key=lambda o: (o not in rank, rank.get(o, ord_.get(o)), o))[:most]
            want += [(i, d, order.index(o), v) for k, o, _, v, d in available if k == i and o in order and (v in ("document_gray", "document_ink_clean") or v == "document_binary" and o == order[0])]
        got = g.number_sources(spark.createDataFrame(ranked, "image long, orientation string, rank int"), spark.createDataFrame(available, "image long, orientation string, ord int, variant string, id string"), phase)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_number_variants_broadcasts_nothing(spark):
    plan = catalog.QUERIES["number_variants"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange") == 1, plan
