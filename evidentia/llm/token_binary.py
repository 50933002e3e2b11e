"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Documents are range-partitioned and sorted by doc_id (nulls first; rows of one doc_id by a hash of the text), encoded
once, and kept as blocks.  Token counts over all blocks rank the ids (ties: the smaller id first), so that frequent ids
take one byte.  Each block becomes a file: a header, the documents' ids and lengths, the control bytes (two bits a
token: bytes less one, four tokens a byte) and the data bytes (little-endian ranks).  Decoding takes the four lengths of
a control byte from a table.

Defined results: null and empty texts hold the end id alone; repeated rows are documents of their own, next to each
other; a very long text is whole, in a block that ends after it; other columns, whatever their names, are not read; an
empty table gives no file and no rows.  A file that a repeated task writes again is the same.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.bpe import byte_characters
from evidentia.llm.common import fresh_path, lean_worker, spread, text_of, worker_cache, written
from evidentia.llm.files import read_whole, write_whole

MAGIC = b"EVTOK1\0\0"
BLOCK_TOKENS = 1 << 21
#: Pre-tokens that a worker remembers before it forgets half of them.
CACHE_PIECES = 400_000
#: Characters of the texts whose pre-tokens are looked up together.
BATCH_CHARS = 1 << 21
#: Lengths of the four tokens of each control byte, and how many bytes they take.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


class ChunkEncoder:
    """ids of whole texts by a byte-level BPE file of the tokenizers library.

    A byte-level BPE never merges over pre-tokens' borders.  These follow from the kinds of neighbouring characters, so they
    are found for many texts at a time, each distinct pre-token is looked up once, and the library's model encodes the new.
    The library takes whole the texts with a space before white space or at the end, with characters that may not be what
    they seem to the patterns, or with a special token's string."""

    #: Latin, Greek and Cyrillic letters, marks, general punctuation and currency, without U+001C..1F and U+0085.
    plain = "[\x00-\x1b\x20-\x84\x86-ȳ̀-ͷЀ-ҁ‐-‧‰-⁞₠-₰]"
    #: Kinds of characters.  The library's white space is Unicode's White_Space, which lacks U+001C..1F.
    BORDER, SPACE, WHITE, LETTER, NUMBER, OTHER, ODD = range(7)
    patterns = {OTHER: ".", LETTER: r"\p{L}", NUMBER: r"\p{N}", WHITE: r"\p{White_Space}", SPACE: " "}

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.bytes = dict(enumerate(byte_characters()))
        # the last stands for all characters beyond
        self.kinds = np.full(0x2101, self.ODD, np.uint8)
        characters = "".join(re.findall(self.plain, "".join(map(chr, range(0x2100)))))
        for kind, pattern in self.patterns.items():
            self.kinds[list(map(ord, regex.findall(pattern, characters, regex.DOTALL)))] = kind
        # of each known pre-token: its place in the tables of where its ids begin, how many they are, and which batch had it last
        self.places: dict[str, int] = {}
        self.first, self.size, self.seen, self.batch = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.ids = np.zeros(0, "<u4")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        """Keep the half of the pre-tokens that were met last."""
        keep = np.sort(np.argpartition(-self.seen, CACHE_PIECES // 2)[: CACHE_PIECES // 2])
        names = list(self.places)
        self.places = {names[k]: place for place, k in enumerate(keep.tolist())}
        self.ids = self.ids[_ranges(self.first[keep], self.size[keep])]
        self.size, self.seen = self.size[keep], self.seen[keep]
        self.first = np.cumsum(self.size) - self.size

    def _pieces(self, pieces: list[str]) -> np.ndarray:
        """Places of distinct pre-tokens."""
        if len(self.places) > CACHE_PIECES:
            self._forget()
        at = np.fromiter(map(self.places.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [pieces[k] for k in missing.tolist()]
            # U+001C is not among the plain characters
            named = "\x1c".join(new).encode().decode("latin-1").translate(self.bytes).split(self.bytes[0x1C])
            tokenize = self.model.tokenize
            got = [[t.id for t in tokenize(name)] for name in named]
            size = np.fromiter(map(len, got), np.int64, len(got))
            at[missing] = np.arange(len(self.size), len(self.size) + len(new))
            self.places.update(zip(new, at[missing].tolist()))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), "<u4", int(size.sum()))])
        self.batch += 1
        self.seen[at] = self.batch
        return at

    def _kinds(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The texts, a line feed after each; its characters' codes and kinds; where the texts end."""
        joined = "\n".join([*texts, ""])
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kinds = np.take(self.kinds, codes, mode="clip")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kinds[ends] = self.BORDER
        return joined, codes, kinds, ends

    def _odd(self, kinds: np.ndarray, ends: np.ndarray) -> list[int]:
        """Texts with odd characters, or with a space before white space or at the end."""
        at = np.flatnonzero((kinds == self.ODD) | (kinds == self.SPACE) & (np.append(kinds[1:], self.BORDER) <= self.WHITE))
        return np.unique(np.searchsorted(ends, at)).tolist()

    def _begins(self, codes: np.ndarray, kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
        r"""Where pre-tokens and borders begin, by the library's pattern
        's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+, all spaces being before what isn't white."""
        begins = np.ones(len(kinds), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
        begins[1:] &= kinds[:-1] != self.SPACE
        # of white characters before others the last is apart
        begins[:-1] |= (kinds[:-1] == self.WHITE) & (kinds[1:] > self.WHITE)
        begins[ends] = True
        quotes = np.flatnonzero(codes == ord("'"))
        quotes = quotes[begins[quotes] & (kinds[quotes] == self.OTHER)]
        one, two = codes[quotes + 1], codes[np.minimum(quotes + 2, len(codes) - 1)]
        for size, is_ in ((2, np.isin(one, list(map(ord, "stmd")))), (3, np.isin(one, list(map(ord, "rv"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))):
            begins[quotes[is_] + 1] = False
            begins[quotes[is_] + size] = True
        return np.flatnonzero(begins)

    def _cut(self, texts: list[str]):  # -> pa.DictionaryArray, np.ndarray, list[int]
        """Pre-tokens of the texts, a border after each text; where the borders are; the odd texts, which have no pre-tokens."""
        import pyarrow as pa

        joined, codes, kinds, ends = self._kinds(texts)
        odd = self._odd(kinds, ends)
        if odd:
            even = list(texts)
            for k in odd:
                even[k] = ""
            joined, codes, kinds, ends = self._kinds(even)
        begins = self._begins(codes, kinds, ends)
        borders = np.searchsorted(begins, ends)
        raw = joined.encode()
        offsets = np.append(begins, len(codes)).astype(np.int64)
        if len(raw) > len(codes):
            # plain characters take three bytes at most
            more = np.cumsum((codes > 0x7F).view(np.uint8) + (codes > 0x7FF).view(np.uint8), dtype=np.int64)
            offsets[1:] += more[offsets[1:] - 1]
        return pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode(), borders, odd

    def _some(self, texts: list[str]) -> list[bytes | None]:
        """ids of each text, None for the odd."""
        pieces, borders, odd = self._cut(texts)
        at = self._pieces(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy()]
        size = self.size[at]
        size[borders] = 0
        ids = self.ids[_ranges(self.first[at], size)].tobytes()
        cuts = [0, *(4 * np.cumsum(size)[borders]).tolist()]
        out: list[bytes | None] = [ids[i:j] for i, j in zip(cuts, cuts[1:])]
        for k in odd:
            out[k] = None
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        whole = [any(s in t for s in self.special) for t in texts]
        parts, whose = [], []
        for k, t in enumerate(texts):
            for part in () if whole[k] else _parts(t):
                parts.append(part)
                whose.append(k)
        got: list[list[bytes]] = [[] for _ in texts]
        for lo, hi in _batches(parts):
            for k, ids in zip(whose[lo:hi], self._some(parts[lo:hi])):
                if ids is None:
                    whole[k] = True
                else:
                    got[k].append(ids)
        out = [x[0] if len(x) == 1 else b"".join(x) for x in got]
        odd = [k for k, w in enumerate(whole) if w]
        for k, ids in zip(odd, self._whole([texts[k] for k in odd])):
            out[k] = ids
        return out


def _parts(text: str) -> Iterator[str]:
    """A text, or a very long one's parts: pre-tokens begin anew at spaces."""
    lo = 0
    while len(text) - lo > BATCH_CHARS and (hi := text.find(" ", lo + BATCH_CHARS)) > 0:
        yield text[lo:hi]
        lo = hi
    yield text[lo:] if lo else text


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are encoded together: BATCH_CHARS, or one longer text."""
    lo = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > BATCH_CHARS:
            yield lo, k
            lo = k
            held = 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _encoder(path: str) -> ChunkEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    cache = worker_cache("token_binary")
    if path not in cache:
        cache[path] = ChunkEncoder(path)
    return cache[path]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks (uint32)."""
    n = len(ranks)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    each = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), each[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def file_bytes(start: int, doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> list[bytes]:
    control, data = pack(ranks)
    head = struct.pack("<8sQQQQQ", MAGIC, start, len(counts), len(ranks), len(control), len(data))
    return [head, doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), counts.astype("<u8").tobytes(), control, data, struct.pack("<I", zlib.crc32(data, zlib.crc32(control)))]


def parse_file(raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, doc_ids, known, counts and ranks of a file; a damaged file raises ValueError."""
    magic, start, docs, tokens, n_control, n_data = struct.unpack_from("<8sQQQQQ", raw)
    at = 48
    if magic != MAGIC or len(raw) != at + 17 * docs + n_control + n_data + 4:
        raise ValueError("not a whole token file")
    cuts = np.cumsum([at, 8 * docs, docs, 8 * docs, n_control, n_data])
    ids, known, counts, control, data = (raw[a:b] for a, b in zip(cuts, cuts[1:]))
    if struct.unpack("<I", raw[-4:])[0] != zlib.crc32(data, zlib.crc32(control)):
        raise ValueError("checksum of token file differs")
    return start, np.frombuffer(ids, "<i8"), np.frombuffer(known, np.uint8), np.frombuffer(counts, "<u8"), unpack(control, data, tokens)


_BLOCK = "part int, block int, before long, tokens long, doc_ids binary, known binary, counts binary, ids binary"


def encode_blocks(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Blocks of encoded documents in ascending doc_id order; before: tokens of the part before the block."""

    def encode(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker("token_binary")
        coder, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        whose: list = []

        def flush() -> pd.DataFrame:
            nonlocal ids, whose, block, before
            counts = np.array([len(x) // 4 for x in ids], "<u8")
            known = np.array([x is not None and x == x for x in whose], np.uint8)
            names = np.array([int(x) if k else 0 for x, k in zip(whose, known)], "<i8")
            both = np.frombuffer(b"".join(ids), "<u4")
            row = (part, block, before, len(both), names.tobytes(), known.tobytes(), counts.tobytes(), both.astype("<u2").tobytes() if small else both.tobytes())
            block, before, ids, whose = block + 1, before + len(both), [], []
            return pd.DataFrame([row], columns=[c.split()[0] for c in _BLOCK.split(", ")])

        small = max(coder.library.get_vocab_size(), end_id + 1) <= 1 << 16
        held = 0
        for f in frames:
            names, texts = f["doc_id"].tolist(), f["text"].tolist()
            for lo, hi in _batches(texts):
                for doc_id, got in zip(names[lo:hi], coder.encode(texts[lo:hi])):
                    ids.append(got + end)
                    whose.append(doc_id)
                    held += len(ids[-1]) // 4
                    if held >= BLOCK_TOKENS:
                        yield flush()
                        held = 0
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("_k"), text_of().alias("text"))
    # the hash deals rows without doc_id, or of one doc_id, out to several tasks
    order = [F.col("_k").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(spread(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    return rows.select("doc_id", "text").mapInPandas(encode, _BLOCK)


def _ids(row_ids: bytes, tokens: int) -> np.ndarray:
    return np.frombuffer(row_ids, "<u2" if len(row_ids) == 2 * tokens else "<u4").astype(np.uint32)


def rank_ids(blocks: DataFrame) -> np.ndarray:
    """ids by falling count, ties by rising id.  The driver gets one row for each id of the vocabulary at most."""

    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for f in frames:
            for raw, n in zip(f["ids"], f["tokens"]):
                c = np.bincount(_ids(raw, n))
                total, c = (total, c) if len(total) >= len(c) else (c, total)
                total[: len(c)] += c
        found = np.flatnonzero(total)
        yield pd.DataFrame({"id": found, "n": total[found]})

    got = blocks.select("ids", "tokens").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return got.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int) -> tuple[DataFrame, np.ndarray]:
    """Encode docs, write the files and ranks.bin under folder; returns a table with the files' paths, and the ids by rank."""
    blocks = written(encode_blocks(docs, path, end_id), "token-blocks")
    order = rank_ids(blocks)
    write_whole(f"{folder}/ranks.bin", [order.astype("<u4").tobytes()])
    starts, total = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("tokens").alias("n")).collect(), key=lambda r: r["part"]):
        starts[r["part"]] = total
        total += r["n"]

    def write(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = np.zeros(int(order.max()) + 1 if len(order) else 0, np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        for f in frames:
            for r in f.itertuples(index=False):
                name = f"{folder}/tokens-{r.part:06d}-{r.block:06d}.bin"
                parts = np.frombuffer(r.doc_ids, "<i8"), np.frombuffer(r.known, np.uint8), np.frombuffer(r.counts, "<u8")
                write_whole(name, file_bytes(starts[r.part] + r.before, *parts, rank[_ids(r.ids, r.tokens)]))
                yield pd.DataFrame({"path": [name], "tokens": [r.tokens]})

    return written(blocks.mapInPandas(write, "path string, tokens long"), "token-files"), order


def read_token_files(files: DataFrame, order: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name in f["path"]:
                start, doc_ids, known, counts, ranks = parse_file(read_whole(name))
                raw = order[ranks].astype("<u4").tobytes()
                ends = np.cumsum(counts.astype(np.int64))
                firsts = ends - counts.astype(np.int64)
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(firsts.tolist(), ends.tolist())]
                yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64").copy() if known.all() else pd.Series(doc_ids).astype("Int64").where(known.astype(bool)), "start": start + firsts, "n_tokens": counts.astype(np.int64), "ids_crc32": np.array(crcs, np.int64)})

    dealt = files.select("path").repartition(spread(files.sparkSession), "path")
    return dealt.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    files, order = write_token_files(docs, folder or fresh_path(docs.sparkSession, "tokens"), path, end_id)
    return read_token_files(files, order)
