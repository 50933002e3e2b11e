"""Benchmark decontamination by spaced seeds.

Words are runs of letters, digits and non-ASCII bytes, A-Z in lower case.  A document and an item overlap where, the item
laid over the document, some window of the item of WINDOW words (the whole item if it is shorter) equals the document
in TOLERANCE of its places, so substituted words don't hide a passage.  The places of a window are split into groups,
and masks ignore some groups each; the hash of the places that count is looked up, for every window of every document,
among the same hashes of the benchmark, and the overlap is verified at a hit.  There is a mask for every choice of as
many groups as TOLERANCE allows substitutions, so whatever places those are at, some mask ignores them all.

The benchmark goes to the tasks in blocks of at most ``block_items`` items and BLOCK_BYTES of text, each against all
documents, so what is sent is bounded whatever its size.

Defined results: null and wordless texts and items overlap nothing; repeated documents and items are each reported;
of several places where an item overlaps a document, the one with the most equal words counts (ties: the first); empty tables
give no overlaps; other columns of the documents pass through ``decontaminate``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from evidentia.llm.common import text_of

WINDOW, TOLERANCE = 13, 0.8
BLOCK_ITEMS, BLOCK_BYTES, CHUNK_WORDS = 50_000, 16 << 20, 1 << 20
_CLEAN = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(128)) + bytes(range(128, 256))
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) * (k + 3) | 1) & (1 << 64) - 1 for k in range(WINDOW)], np.uint64)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_CLEAN).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def design(n: int) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """Groups of the places of n words, and the groups that count in each mask."""
    wrong = max(s for s in range(n) if n - s >= TOLERANCE * n)
    # more groups make longer seeds and more tables
    count = 1 if wrong == 0 else min(n, wrong + (2 if n == WINDOW else 3))
    groups = [g.tolist() for g in np.array_split(np.arange(n), count)]
    return groups, list(itertools.combinations(range(count), count - wrong))


def _seeds(h: np.ndarray, n: int, groups: list[list[int]], masks: list[tuple[int, ...]]) -> Iterator[np.ndarray]:
    """Hashes of all windows of n words in h, for one mask after another."""
    m = len(h) - n + 1
    parts = []
    for places in groups:
        out = np.zeros(m, np.uint64)
        for k in places:
            out ^= out >> np.uint64(29)
            out += h[k : k + m] * _FACTORS[k]
            out *= np.uint64(0xBF58476D1CE4E5B9)
        parts.append(out)
    for salt, mask in enumerate(masks):
        out = np.full(m, n << 8 | salt, np.uint64)
        for g in mask:
            out ^= out >> np.uint64(29)
            out += parts[g]
            out *= np.uint64(0xBF58476D1CE4E5B9)
        yield out ^ out >> np.uint64(32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(29)


class SeedIndex:
    """Spaced seeds of a block of benchmark items."""

    bits = 20

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items = [(i, _mix(_hashes(w))) for i, t in items if (w := split_words(t))]
        # (words of a window, groups, masks, a table for each mask); shorter items are looked up whole
        self.probes = []
        for n in sorted({min(len(h), WINDOW) for _, h in self.items}):
            groups, masks = design(n)
            mine = [k for k, (_, h) in enumerate(self.items) if min(len(h), WINDOW) == n]
            windows = [len(self.items[k][1]) - n + 1 for k in mine]
            whose, at = np.repeat(mine, windows), np.concatenate([np.arange(w) for w in windows])
            hashes = [list(_seeds(self.items[k][1], n, groups, masks)) for k in mine]
            tables = []
            for m in range(len(masks)):
                keys = np.concatenate([x[m] for x in hashes])
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                seen = np.zeros(1 << self.bits, bool)
                seen[(keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True
                tables.append((seen, keys, whose[order], at[order]))
            self.probes.append((n, groups, masks, tables))

    def overlaps(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, equal words, first word in the document) of verified overlaps; bounds: where the documents begin, and the end."""
        h = _mix(h)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        done = set()
        for n, groups, masks, tables in self.probes:
            if len(h) < n:
                continue
            for w, (seen, keys, whose, at) in zip(_seeds(h, n, groups, masks), tables):
                near = np.flatnonzero(seen[(w >> np.uint64(64 - self.bits)).astype(np.int64)])
                near = near[doc[near] == doc[near + n - 1]]
                lo, hi = np.searchsorted(keys, w[near], "left"), np.searchsorted(keys, w[near], "right")
                for i, a, b in zip(near[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    for x in range(a, b):
                        item, shift = int(whose[x]), i - int(at[x])
                        d = int(doc[i])
                        if (d, item, shift) in done:
                            continue
                        done.add((d, item, shift))
                        mine = self.items[item][1]
                        first, last = max(0, int(bounds[d]) - shift), min(len(mine), int(bounds[d + 1]) - shift)
                        same = mine[first:last] == h[shift + first : shift + last]
                        sums = np.concatenate([[0], np.cumsum(same)])
                        if (sums[n:] - sums[:-n]).max() >= TOLERANCE * n:
                            got = (int(same.sum()), -(shift + first - int(bounds[d])))
                            best[d, item] = max(best.get((d, item), got), got)
        for (d, item), (equal, minus) in sorted(best.items()):
            yield d, item, equal, -minus


def _found(index: SeedIndex, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """Overlaps of texts, a chunk of words at a time; a text is never cut."""
    lo = 0
    while lo < len(texts):
        words, bounds, hi = [], [0], lo
        while hi < len(texts) and (hi == lo or len(words) < CHUNK_WORDS):
            words += split_words(texts[hi])
            bounds.append(len(words))
            hi += 1
        for d, item, equal, first in index.overlaps(_hashes(words), np.array(bounds)):
            yield lo + d, item, equal, first
        lo = hi


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[SeedIndex]:
    block, size = [], 0
    for r in benchmark.select("item_id", text_of().alias("text")).toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if len(block) >= block_items or size >= BLOCK_BYTES:
            yield SeedIndex(block)
            block, size = [], 0
    if block:
        yield SeedIndex(block)


def overlaps(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, equal_words, item_words and first_word of every document and item that overlap."""
    schema = "doc_id long, item_id long, equal_words long, item_words long, first_word long"
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))
    out = None
    for index in _blocks(benchmark, block_items):

        def run(frames: Iterable[pd.DataFrame], index: SeedIndex = index) -> Iterator[pd.DataFrame]:
            for f in frames:
                ids = f["doc_id"].tolist()
                whole = lambda x: None if x is None or x != x else int(x)
                got = [(whole(ids[d]), index.items[k][0], equal, len(index.items[k][1]), first) for d, k, equal, first in _found(index, f["text"].tolist())]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "equal_words", "item_words", "first_word"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        part = rows.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs that overlap no item, as they are."""
    out = docs
    for index in _blocks(benchmark, block_items):
        out = out.where(~_hit(index)(text_of()))
    return out


def _hit(index: SeedIndex):
    @F.pandas_udf(BooleanType())
    def hit(texts: pd.Series) -> pd.Series:
        flags = np.zeros(len(texts), bool)
        flags[[d for d, *_ in _found(index, texts.tolist())]] = True
        return pd.Series(flags)

    return hit
