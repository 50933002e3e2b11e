"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols.

``BpeCodec`` reads a tokenizer file of the word-end kind (NFC, white space, lower case, split by a pattern, bytes as
characters, BPE with an end-of-word suffix).  A word's symbols form a doubly linked list; a heap holds the merge
ranks of neighbouring pairs; an entry whose symbols have changed since is stale and skipped.  Decoding joins the
vocabulary strings of the ids, as the library does for a file without a decoder: with single spaces.

Defined results: null and empty texts have no ids and decode to ''; repeated rows are each encoded; an empty table
gives no rows; the other columns pass through ``encode_column``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import lean_worker, text_of, worker_cache

#: Words that a worker remembers before it starts anew.
CACHE_WORDS = 400_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 characters for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class BpeCodec:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (i, self.vocab[a + b]) for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the library's white space is Unicode's White_Space, which lacks U+001C..1F
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.chars = byte_characters()
        self.known: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def normalize(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # one character at a time: the library knows no final sigma
        return text.lower() if "Σ" not in text else "".join([c.lower() for c in text])

    def encode_word(self, word: str) -> list[int]:
        chars = [self.chars[b] for b in word.encode()]
        chars[-1] += self.suffix
        ids = [self.vocab[c] for c in chars]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if found := self.ranks.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := self.ranks.get((made, ids[k])):
                    heapq.heappush(heap, (found[0], i, made, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := self.ranks.get((ids[h], made))):
                heapq.heappush(heap, (found[0], h, ids[h], made, found[1]))
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> Iterator[str]:
        """Words, and special tokens' strings as such."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield part
            elif part:
                yield from self.words.findall(self.normalize(part))

    def piece_ids(self, piece: str) -> list[int]:
        return [self.special[piece]] if piece in self.special else self.encode_word(piece)

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.piece_ids(p)]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


class _Remembered(dict):
    """ids of pieces as (number, decimal ids, decoded string), made when first asked for."""

    def __init__(self, codec: BpeCodec):
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[int, str, str]:
        if len(self) > CACHE_WORDS:
            self.clear()
        ids = self.codec.piece_ids(piece)
        self[piece] = out = (len(ids), " ".join(map(str, ids)), self.codec.decode(ids))
        return out


def _codec(path: str) -> tuple[BpeCodec, _Remembered]:
    cache = worker_cache("bpe")
    if path not in cache:
        codec = BpeCodec(path)
        cache[path] = codec, _Remembered(codec)
    return cache[path]


def digest(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """doc_id, n_tokens, and hashes of the decimal ids and of the decoded text."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker("bpe")
        codec, known = _codec(path)
        for f in frames:
            n, ids, decoded = [], [], []
            for text in f["text"]:
                found = [known[p] for p in codec.pieces(text)]
                n.append(sum([x[0] for x in found]))
                ids.append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([x[2] for x in found]).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded})

    rows = docs.select("doc_id", text_of(column).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str, column: str = "text", to: str = "ids") -> DataFrame:
    """docs with the ids of a column."""
    from pyspark.sql.types import ArrayType, IntegerType

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        codec, _ = _codec(path)
        return pd.Series([codec.encode(t) for t in texts])

    return docs.withColumn(to, run(text_of(column)))


def decode_column(docs: DataFrame, path: str, column: str = "ids", to: str = "text") -> DataFrame:
    """docs with the text of a column of ids."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        codec, _ = _codec(path)
        return pd.Series([codec.decode(x) for x in ids])

    return docs.withColumn(to, run(F.coalesce(F.col(column), F.array().cast("array<int>"))))
