"""Python workers outlive stages: what one operator remembers in them goes when they serve another."""

import public_tokenizers

from evidentia.llm import bpe, jaccard_join
from evidentia.llm.common import worker_cache


def test_caches_of_other_operators_go(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, "a b c d e f g h i j k"), (4, "x")], "doc_id long, text string")
    tasks, frame = [], type(docs)
    plain = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, f, *a, **k: tasks.append(f) or plain(self, f, *a, **k))
    bpe.digest(docs, public_tokenizers.path("word_bpe_49k.json"))
    jaccard_join.join_components(docs).count()
    encode, *others = tasks
    assert len(others) >= 6
    for task in others:
        list(encode(iter([])))
        assert worker_cache("bpe")
        list(task(iter([])))
        assert not worker_cache("bpe")
