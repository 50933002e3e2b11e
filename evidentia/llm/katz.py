"""Language-model scoring: a Katz backoff bigram model with Good-Turing discounts.

Tokens are words, A-Z in lower case, and one end token a text; all training texts are counted.  Unigram counts up to K are
discounted by Good-Turing, and the mass they leave is that of the unknown word.  All bigrams are counted; their counts
are discounted alike, and each history's backoff weight is what exactly normalises it.  p(w | h) is the discounted bigram
where it was seen, else backoff(h) * p(w), and p(w) is the discounted unigram or the unknown word.

Texts are tokenised once, into chunks of about CHUNK_TOKENS tokens, each a file in the shared folder: the distinct words'
64-bit hashes, and the text as places among them.  Only the chunks' paths go through shuffles.  The tables of words, bigrams and histories are partitioned by ranges of key hashes, into
parts of about PART_KEYS keys at every corpus size.  A chunk sends each part its distinct keys of that range (so a hot key is
one entry a chunk) with their training counts; the part adds them up and answers for each of the keys:

1. words and bigrams: the counts, and for which chunk a bigram is new, so that exactly one chunk counts it for its history;
2. histories: chunks send the discounted mass and the unigram mass of the bigrams that are theirs, parts answer the weights.

With both answers a chunk evaluates all of its tokens; nothing about single keys is broadcast or reaches the driver.

Defined results: null and empty texts are one end token; very long texts are whole, in one chunk; repeated rows are counted
and scored each; a null doc_id counts as '' in the split; other columns are not read; without training texts every token is the unknown
word of probability 1 and the base score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import discard, fresh_path, release, remove, spread, text_of, written
from evidentia.llm.files import read_whole, write_whole

K = 5
CHUNK_TOKENS, CHUNK_DOCS, PART_KEYS = 3 << 19, 60_000, 1 << 22
#: No word has a space in it.
END, START = b" end", b" start"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's tokens."""
    import xxhash

    words = [*(text or "").encode().lower().split(), END]
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def discounts(n: dict[int, int], k: int = K) -> np.ndarray:
    """d[0..k+1], d[r] for counts of r, 1 beyond k; where Good-Turing gives no share between 0 and 1, half a count is taken off."""
    out = np.ones(k + 2)
    last = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, k + 1):
        turing = (r + 1) * n.get(r + 1, 0) / n[r] / r if n.get(r) else 0.0
        d = (turing - last) / (1 - last) if last < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _packed(x: np.ndarray) -> bytes:
    """Compressed, bytes of one significance together."""
    import zstandard

    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw, "<u8"), dtype=np.uint64)


def _trim() -> None:
    """Give freed memory back to the system; workers are used again and would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: Chunks (kind 0: their path), questions and answers (kind 1: words, 2: bigrams, 3: histories) are rows of one shape.
_ROW = "kind int, part int, chunk long, n long, path string, a binary, b binary, c binary, d binary, sums array<long>"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
WORDS, PAIRS, HISTORIES = 1, 2, 3


def _rows(rows: list[tuple]) -> pd.DataFrame:
    """Rows, the columns that they leave out null."""
    return pd.DataFrame([(*r, *[None] * (len(_NAMES) - len(r))) for r in rows], columns=_NAMES)


def chunks(docs: DataFrame, held_out: Column, folder: str) -> DataFrame:
    """The tokenised texts, some thousand a file under folder: a row for each."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        total = 0

        def flush() -> pd.DataFrame:
            nonlocal held, total, number
            ids, out, parts = zip(*held)
            words, seq = np.unique(np.concatenate(parts), return_inverse=True)
            sizes = np.array([len(t) for t in parts], "<u4")
            blobs = [json.dumps(ids).encode(), _packed_keys(words), _packed(seq.astype("<u4")), _packed(sizes), _packed(np.array(out, np.uint8))]
            # a name of its own: a repeated task may meet other rows
            path = f"{folder}/{uuid.uuid4().hex}.bin"
            write_whole(path, [np.array([len(b) for b in blobs], "<u8").tobytes(), *blobs])
            row = (0, -1, number, total, path)
            held, total, number = [], 0, number + 1
            return _rows([row])

        for f in frames:
            for doc_id, out, text in zip(f["doc_id"].tolist(), f["held_out"].tolist(), f["text"]):
                held.append((doc_id, out, tokens(text)))
                total += len(held[-1][2])
                if total >= CHUNK_TOKENS or len(held) >= CHUNK_DOCS:
                    yield flush()
                    _trim()
        if held:
            yield flush()
        _trim()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out.alias("held_out"), text_of().alias("text"))
    return written(rows.mapInPandas(run, _ROW), "katz-chunks")


class Chunk:
    """The texts of a row of ``chunks``: words (hashes, then that of the start), seq, before (places of words), text of each token."""

    def __init__(self, row):
        import xxhash

        raw = read_whole(row.path)
        cuts = 40 + np.cumsum([0, *np.frombuffer(raw[:40], "<u8").tolist()])
        ids, words, seq, sizes, held = (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
        self.number, self.ids = row.chunk, json.loads(ids)
        self.words = np.append(_unpacked_keys(words), np.uint64(xxhash.xxh64_intdigest(START)))
        self.start = len(self.words) - 1
        self.end = int(np.searchsorted(self.words[:-1], np.uint64(xxhash.xxh64_intdigest(END))))
        self.seq = _unpacked(seq, "<u4").astype(np.int64)
        self.sizes = _unpacked(sizes, "<u4").astype(np.int64)
        self.held = _unpacked(held, "u1").astype(bool)
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.before = np.empty_like(self.seq)
        self.before[1:] = self.seq[:-1]
        self.before[np.cumsum(self.sizes) - self.sizes] = self.start
        self.codes = self.before * len(self.words) + self.seq

    def halves(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return codes // len(self.words), codes % len(self.words)

    def pair_keys(self, codes: np.ndarray) -> np.ndarray:
        h, w = self.halves(codes)
        return _mix((_mix(self.words) * _FACTOR)[h] + self.words[w])

    def histories(self) -> np.ndarray:
        """Places of the words that come before others."""
        some = np.zeros(len(self.words), bool)
        some[self.before] = True
        return np.flatnonzero(some)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the parts of sorted keys begin, and the end: part p has the keys whose upper half is in the p-th of equal ranges."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))


def _asked(kind: int, chunk: int, parts: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """A row for each part: its keys, ascending, and what is sent with them."""
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], [c[order] for c in columns]
    cuts = _cuts(keys, parts)
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        mine = slice(cuts[p], cuts[p + 1])
        yield (kind, p, chunk, 0, None, _packed_keys(keys[mine]), *[_packed(c[mine]) for c in columns])


def _answered(answers: pd.DataFrame, kind: int, keys: np.ndarray, *kinds: str) -> list[np.ndarray]:
    """What the parts answered for keys, in the order of keys."""
    mine = answers[answers["kind"] == kind].sort_values("part")
    order = np.argsort(keys, kind="stable")
    out = []
    for name, k in zip("abcd", kinds):
        values = np.concatenate([np.zeros(0, k), *[_unpacked(raw, k) for raw in mine[name]]])
        placed = np.empty_like(values)
        placed[order] = values
        out.append(placed)
    return out


def _questions(table: DataFrame, parts: int) -> DataFrame:
    """Distinct words and bigrams of each chunk, with their training counts."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                c = Chunk(row)
                trained = ~c.held[c.text]
                yield _rows([*_asked(WORDS, c.number, parts, c.words[:-1], np.bincount(c.seq[trained], minlength=c.start))])
                codes = np.unique(c.codes)
                seen, times = np.unique(c.codes[trained], return_counts=True)
                counts = np.zeros(len(codes), np.int64)
                counts[np.searchsorted(codes, seen)] = times
                keys = c.pair_keys(codes)
                del trained, codes, seen, times
                yield _rows([*_asked(PAIRS, c.number, parts, keys, counts)])
                del c, keys, counts
                _trim()

    return table.mapInPandas(run, _ROW)


def _count(asked: pd.DataFrame) -> pd.DataFrame:
    """Counts of the keys of a part for each of its askers, doubled, plus 1 for the first asker; and a row of sums: tokens, keys, counts of counts."""
    asked = asked.sort_values("chunk")
    keys = [_unpacked_keys(raw) for raw in asked["a"]]
    ends = np.cumsum([len(k) for k in keys])
    _, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    c = np.bincount(at, weights=np.concatenate([_unpacked(raw, "<i8") for raw in asked["b"]])).astype(np.int64)
    values = c[at] * 2
    values[first] += 1
    kind, part = int(asked["kind"].iloc[0]), int(asked["part"].iloc[0])
    rows = [(kind, part, chunk, 0, None, _packed(values[e - len(k) : e])) for chunk, k, e in zip(asked["chunk"].tolist(), keys, ends.tolist())]
    sums = [int(c.sum()), int((c > 0).sum()), *[int((c == r).sum()) for r in range(1, K + 2)]]
    return _rows([*rows, (kind, part, -1, 0, None, None, None, None, None, sums)])


def _weigh(asked: pd.DataFrame) -> pd.DataFrame:
    """Backoff weights (log10) of the histories of a part, and what their bigrams' counts are divided by, for each asker."""
    asked = asked.sort_values("chunk")
    keys = [_unpacked_keys(raw) for raw in asked["a"]]
    ends = np.cumsum([len(k) for k in keys])
    _, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    sent = [np.concatenate([_unpacked(raw, "<f8") for raw in asked[name]]) for name in "bcd"]
    n, high, low = sent[0][first], np.bincount(at, weights=sent[1]), np.bincount(at, weights=sent[2])
    # a history that leaves no mass gets one count more
    n = n + (high >= n * (1 - 1e-12))
    x = np.log10((1 - high / n) / (1 - low))
    kind, part = int(asked["kind"].iloc[0]), int(asked["part"].iloc[0])
    cuts = [(chunk, slice(e - len(k), e)) for chunk, k, e in zip(asked["chunk"].tolist(), keys, ends.tolist())]
    return _rows([(kind, part, chunk, 0, None, _packed(x[at[mine]]), _packed(n[at[mine]])) for chunk, mine in cuts])


class Katz:
    """What all tokens need of the model: discounts, tokens, distinct words, the unknown word."""

    def __init__(self, words: list[int], pairs: list[int]):
        of = lambda m: {r: c for r, c in enumerate(m[2:], 1)}
        self.n, self.v = words[:2]
        m = of(words)
        self.d1, self.d2 = discounts(m), discounts(of(pairs))
        left = sum(m[r] * r * (1 - self.d1[r]) for r in range(1, K + 1))
        self.n1, self.unknown = (float(self.n), left / self.n) if left > 0 else (self.n + 1.0, 1 / (self.n + 1))

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d1[np.minimum(c, K + 1)] * c / self.n1, self.unknown)

    def mass(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts of bigrams."""
        return self.d2[np.minimum(c, K + 1)] * c

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


def _with_answers(rows: pd.DataFrame) -> tuple[Chunk, np.ndarray]:
    """The chunk, and the counts of its words; that of the start is the number of training texts."""
    c = Chunk(next(rows[rows["kind"] == 0].itertuples(index=False)))
    counts = _answered(rows, WORDS, c.words[:-1], "<i8")[0] >> 1
    return c, np.append(counts, counts[c.end])


def _masses(rows: pd.DataFrame, model: Katz, parts: int) -> pd.DataFrame:
    """A chunk's questions about its histories, with the masses of the bigrams that are new with it."""
    c, counts = _with_answers(rows)
    codes = np.unique(c.codes)
    value = _answered(rows, PAIRS, c.pair_keys(codes), "<i8")[0]
    own = (value & 1 == 1) & (value > 1)
    h, w = c.halves(codes[own])
    size = len(c.words)
    high, low = np.bincount(h, model.mass(value[own] >> 1), size), np.bincount(h, model.unigram(counts)[w], size)
    at = c.histories()
    at = at[counts[at] > 0]
    return _rows([*_asked(HISTORIES, c.number, parts, c.words[at], counts[at].astype(float), high[at], low[at])])


_SCORED = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(rows: pd.DataFrame, model: Katz) -> pd.DataFrame:
    """All texts of a chunk: each token by its bigram, else the history's weight and the word, else the unknown word."""
    c, counts = _with_answers(rows)
    codes, at = np.unique(c.codes, return_inverse=True)
    seen = _answered(rows, PAIRS, c.pair_keys(codes), "<i8")[0] >> 1
    weight, divisor = np.zeros(len(c.words)), np.ones(len(c.words))
    some = c.histories()
    some = some[counts[some] > 0]
    weight[some], divisor[some] = _answered(rows, HISTORIES, c.words[some], "<f8", "<f8")
    h, w = c.halves(codes)
    backed = weight[h] + np.log10(model.unigram(counts))[w]
    p = np.where(seen > 0, np.log10(np.where(seen > 0, model.mass(seen), 1.0) / divisor[h]), backed)
    add = lambda what: np.bincount(c.text, what, len(c.sizes))
    return pd.DataFrame({"doc_id": c.ids, "held_out": c.held, "n_tokens": c.sizes, "n_known": add(counts[c.seq] > 0).astype(np.int64), "base_score": add(model.base(counts)[c.seq]), "score": add(p[at])})


def score_corpus(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from the rows that aren't held out; doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of all."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "katz-texts")
    table = chunks(docs, held_out, folder)
    found = table.agg(F.sum("n").alias("tokens"), F.count("*").alias("chunks")).first()
    parts = max(spread(spark), -(-(found["tokens"] or 0) // PART_KEYS))
    tasks = max(spread(spark), found["chunks"])
    asked = _questions(table.repartition(tasks, "chunk"), parts).repartition(parts, "kind", "part")
    counts = written(asked.groupBy("kind", "part").applyInPandas(_count, _ROW), "katz-counts")
    release(spark)
    sums = counts.where("chunk = -1").groupBy("kind").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(K + 3)]).alias("s"))
    sums = {r["kind"]: r["s"] for r in sums.collect()}
    model = Katz(*[sums.get(kind, [0] * (K + 3)) for kind in (WORDS, PAIRS)])
    known = table.unionByName(counts.where("chunk >= 0"))
    masses = known.repartition(tasks, "chunk").groupBy("chunk").applyInPandas(lambda rows: _masses(rows, model, parts), _ROW)
    weights = written(masses.repartition(parts, "kind", "part").groupBy("kind", "part").applyInPandas(_weigh, _ROW), "katz-weights")
    release(spark)
    scored = known.unionByName(weights).repartition(tasks, "chunk").groupBy("chunk").applyInPandas(lambda rows: _scores(rows, model), _SCORED)
    scored = written(scored.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score"), "katz-scores")
    for used in (table, counts, weights):
        discard(used)
    remove(spark, folder)
    release(spark)
    return scored
