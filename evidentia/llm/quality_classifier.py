"""Quality classifier: supervised subword embeddings.

Words, word pairs and character n-grams of 3 to 5 (over the whole text, since what stands beside white space and breaks
tells much; case kept) are hashed into ``buckets`` rows of an embedding matrix; a document is the mean of its rows, a
softmax over two classes gives its score.  The matrix and the output layer are trained by stochastic gradient descent in
numpy on at most ``max_labelled`` labelled rows, the ones whose seeded hash is smallest.  Since the output is linear in
the mean, scoring needs one number a bucket, and runs over all rows without a shuffle.

Defined results: null texts count as ''; very long texts are scored whole; other columns are not read; texts without words
get the output layer's bias; without labels every score is 0.5; rows of one doc_id with several labels count with the largest; a null label or doc_id isn't learned from; repeated rows
get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import text_of

BUCKETS, DIM, EPOCHS, RATE, MAX_LABELLED, SEED = 1 << 17, 16, 5, 0.5, 4000, 7
THRESHOLD = 0.3
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words, word pairs and character n-grams of a text."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    wide = c.astype(np.uint64) + np.uint64(1)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if len(starts) == 0:
        return np.zeros(0, np.int64)
    # hash of a word: sum of its characters' values, each mixed with its place in the word
    place = np.arange(len(c), dtype=np.int64)
    place -= np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(c)]])))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(wide + place.astype(np.uint64) * _M))])
    w = _mix(sums[ends] - sums[starts])
    out = [w, _mix(w[:-1] * _M + w[1:])]
    h = wide
    for n in range(2, 6):
        if len(h) < 2:
            break
        h = h[:-1] * _M + wide[n - 1 :]
        if n >= 3:
            out.append(_mix(h + np.uint64(n)))
    return (np.concatenate(out) % np.uint64(buckets)).astype(np.int64)


def train(texts: list[str], labels: list[int], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """One number a bucket and a bias: the logit of label 1 is the bias plus the mean of the numbers of a text's buckets."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    if not texts:
        return np.zeros(buckets), 0.0
    bags = []
    for t in texts:
        idx, n = np.unique(features(t, buckets), return_counts=True)
        bags.append((idx.astype(np.int32), n.astype(np.float32)))
    steps, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            lr = rate * (1 - steps / total)
            steps += 1
            idx, n = bags[k]
            share = n / max(1.0, n.sum())
            mean = share @ table[idx]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            grad = p @ out
            out -= lr * np.outer(p, mean)
            bias -= lr * p
            # the usual update of the mean's parts: each row takes the whole gradient by its share of the text, scaled to the bag's size
            table[idx] -= (lr * share * min(len(idx), 50))[:, None] * grad
    return (table @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0])


def labelled_texts(docs: DataFrame, labels: DataFrame, usable: Column, max_labelled: int = MAX_LABELLED, seed: int = SEED) -> tuple[list[str], list[int]]:
    """At most max_labelled labelled texts, by a seeded hash of doc_id; the bound is what the driver and the broadcast hold."""
    chosen = labels.where("doc_id is not null and quality is not null").where(usable).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates().collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [int(r["quality"]) for r in rows]


def score(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            z = np.array([bias + (weights[i].mean() if len(i := features(t, len(weights))) else 0.0) for t in f["text"]])
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "score": p, "predicted": (p >= threshold).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id"), 0).alias("held_out"), text_of().alias("text"))
    got = rows.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int")
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))


def held_out(doc_id: Column, remainder: int) -> Column:
    """Whether crc32 of doc_id as text, modulo 5, is the remainder; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == remainder


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    texts, quality = labelled_texts(docs, labels, ~held_out(F.col("doc_id"), 0))
    return score(docs, *train(texts, quality, **settings))
