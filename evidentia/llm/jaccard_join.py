"""N-gram Jaccard join by count-vector R-trees.

A document is the set of its distinct 5-word shingles (64-bit hashes); two documents link when their sets' Jaccard
similarity is 0.8 or more.  Shingles are hashed into GROUPS groups, and the counts of a set's shingles by group are
a point; the sum of two points' coordinate minima bounds the overlap of their sets from above, and so does, with the
corners of bounding boxes, the sum for all pairs of two R-tree nodes.

1. Every document becomes a row of a sketch: size, fingerprint of the set, point, and its signature: the first
   n - ceil(0.8 n) + 1 shingles in a fixed order of all shingles.  Documents that link share a shingle of their
   signatures, so the signature's shingles say which trees a point is in.  The order puts shingles that recur among
   different texts last, which keeps trees small; any order gives the same links.
   A large set is cut into parts of at most PART shingles by hash, since the groups of a point tell little of many shingles.
   If two sets' similarity is 0.8 or more, so is that of one of their parts at least, and what follows holds for it:
   each part has a signature and a point of its own.  Sets of sizes that may link are cut alike: a set is also cut as
   one a quarter larger would be.
2. Documents with equal sets are one class, and only classes go on.
3. In STARS rounds each part is in TREES trees only, its homes: the shared keys of its signature with the least seeded
   hashes, which near copies mostly have in common.  There it meets the leaders; survivors of the bound are verified on the sets, and components formed.  So thousands of near copies
   become one component at the cost of a few pairs each.
4. Then every shingle's points that aren't all of one component form an R-tree, whose nodes hold few components each;
   pairs of nodes are descended where their corners' minima allow a link between components, and all surviving pairs of
   points are verified.  Of points with a home in common only that home's tree gives the pair, so that a pair of which
   many trees hold both is given once or a few times.  No link that matters to the components is left out.

Defined results: null and wordless texts have no shingles and link with nothing; texts of fewer than five words are
one shingle; the component of rows is their smallest non-null doc_id (null if all are null); repeated rows are copies; an empty
table gives no rows; very long texts are whole, and where a group's count passes 255 it bounds nothing; other columns,
whatever their names, stay in ``deduplicate``, where rows that repeat a doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import discard, free_name, lean_worker, release, spread, text_of, written
from evidentia.llm.components import connected_components, with_label

WORDS, GROUPS, PART = 5, 256, 512
#: Children of a node of a tree; node pairs that are expanded together.
FAN, FRONTIER = 8, 512
#: The greatest count of a point; it stands for more, too, and bounds nothing.
FULL = 255
#: Shingles are common that COMMON different texts of some COMMON_WINDOW shingles hold; the longest list of such shingles.
COMMON, COMMON_WINDOW, COMMON_MOST = 8, 1 << 22, 200_000
#: A class is sketched once a task while the task remembers so many.
REMEMBERED = 1 << 20
#: Rounds in which each class meets the leaders of a few trees, how many trees, and leaders that a tree has at most, before all pairs between components.
STARS, TREES, LEADERS = 2, 3, 64
#: Points of a tree beyond which it is split into cells, and the most trees that are.
HOT, HOT_TREES = 8192, 100_000
#: Bits of the filter that spares texts without candidates the shuffle.
FILTER_BITS = 1 << 24
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None) -> np.ndarray:
    """The set as sorted 64-bit hashes; bytes.lower and bytes.split know A-Z and ASCII white space alone."""
    import xxhash

    words = (text or "").encode().lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(h) == 0:
        return h
    if len(h) < WORDS:
        return _mix((h * _FACTORS[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - WORDS + 1
    s = np.full(n, WORDS, np.uint64)
    for k in range(WORDS):
        s += h[k : k + n] * _FACTORS[k]
    return np.unique(_mix(s))


def fingerprint(s: np.ndarray) -> int:
    return int(_mix(s + np.uint64(0x51ED270B)).sum().astype(np.int64)) if len(s) else 0


def _counts(s: np.ndarray, bits: int) -> np.ndarray:
    counts = np.bincount((_mix(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, FULL).astype(np.uint8)


def point(s: np.ndarray) -> np.ndarray:
    return _counts(s, GROUPS.bit_length() - 1)


def unpacked(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, GROUPS)


def fine_point(s: np.ndarray) -> bytes:
    """Counts by as many groups (a power of two) as give about two shingles each."""
    return _counts(s, max(8, int(len(s) // 2).bit_length())).tobytes()


def fine_bound(a: bytes, b: bytes) -> int:
    """At least the overlap of two sets, from their fine points; the larger one's neighbouring groups are added up."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    if FULL in x or FULL in y:
        return 1 << 40
    x, y = (v.reshape(min(len(x), len(y)), -1).sum(axis=1) for v in (x, y))
    return int(np.minimum(x, y).sum())


def signature(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles, common ones last."""
    p = len(s) - (4 * len(s) + 4) // 5 + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        hot = common[at] == s
        s = np.concatenate([s[~hot], s[hot]])
    return s[:p]


def cuts(n: int) -> list[int]:
    """Into how many parts (a power of two) a set of n shingles is cut, and one that is a quarter larger."""
    of = lambda k: 1 << max(0, (k - 1) // PART).bit_length()
    return sorted({of(n), of(5 * n // 4)})


def parts_of(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], list[int], bytes]:
    """Keys and slots of the signatures of all parts; slots (parts' names), sizes and points of the parts that aren't empty."""
    keys, whose, slots, sizes, points = [], [], [], [], []
    for m in cuts(len(s)) if len(s) else []:
        at = (s & np.uint64(m - 1)).astype(np.int64)
        for k in range(m):
            part = s[at == k] if m > 1 else s
            if len(part):
                sig = signature(part, common)
                keys.append(_mix(sig + np.uint64(m)).view(np.int64))
                whose.append(np.full(len(sig), m + k))
                slots.append(m + k)
                sizes.append(len(part))
                points.append(point(part).tobytes())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *keys]), np.concatenate([none, *whose]).astype(np.int32), slots, sizes, b"".join(points)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that recur among the different texts of any window, the most frequent of all documents, sorted; it only sets the order."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker("jaccard_join")
        held: list[np.ndarray] = []
        total, seen = 0, set()

        def flush() -> pd.DataFrame:
            nonlocal held, total, seen
            h, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held, total, seen = [], 0, set()
            return pd.DataFrame({"h": h[c >= COMMON].view(np.int64), "c": c[c >= COMMON]})

        for f in frames:
            for t in f["text"]:
                s = shingles(t)
                if (fp := fingerprint(s)) not in seen:
                    seen.add(fp)
                    held.append(s)
                    total += len(s)
                if total >= COMMON_WINDOW:
                    yield flush()
        yield flush()

    counts = docs.select(text_of().alias("text")).mapInPandas(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    got = counts.orderBy(F.desc("c"), "h").limit(COMMON_MOST).toPandas()["h"].to_numpy(np.int64)
    return np.sort(got.view(np.uint64))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n, fp and fine point of every row; of its parts the slots, sizes and points, and keys and slots of the signatures."""
    common = common_shingles(docs)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker("jaccard_join")
        seen: set[int] = set()
        for f in frames:
            rows = []
            for doc_id, text in zip(f["doc_id"], f["text"]):
                s = shingles(text)
                fp = fingerprint(s)
                # a task's later rows of a class bring nothing new
                keys, whose, slots, sizes, points = parts_of(s[:0] if fp in seen else s, common)
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(fp)
                rows.append((doc_id, len(s), fp, fine_point(s), slots, sizes, points, keys.tobytes(), whose.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "fp", "fine", "slots", "sizes", "points", "sig", "whose"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))
    out = rows.mapInPandas(run, "doc_id string, n long, fp long, fine binary, slots array<int>, sizes array<int>, points binary, sig binary, whose binary")
    return written(out.withColumn("doc_id", F.col("doc_id").cast("long")), "sketch")


def class_points(classes: DataFrame) -> DataFrame:
    """fp, slot, n and point of every part of every class."""
    rows = classes.select("fp", "sizes", "points", F.posexplode("slots").alias("_i", "slot"))
    return rows.select("fp", "slot", F.get("sizes", F.col("_i")).cast("long").alias("n"), F.expr(f"substring(points, _i * {GROUPS} + 1, {GROUPS})").alias("point"))


def _runs(frames: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames cut between different keys, of rows sorted by key."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if f.empty:
            continue
        k = f[key].to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut or (held and held[-1][key].iloc[-1] != k[0]):
            if cut == 0:
                yield pd.concat(held, ignore_index=True)
                held = [f]
            else:
                yield pd.concat([*held, f.iloc[:cut]], ignore_index=True)
                held = [f.iloc[cut:]]
        else:
            held.append(f)
    if held:
        yield pd.concat(held, ignore_index=True)


def blocks(sketched: DataFrame) -> DataFrame:
    """(h, fp, slot) of the signature keys that two classes or more share."""

    def emit(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker("jaccard_join")
        for f in frames:
            hs = [np.frombuffer(x, np.int64) for x in f["sig"]]
            if hs:
                yield pd.DataFrame({"h": np.concatenate(hs), "fp": np.repeat(f["fp"].to_numpy(), [len(h) for h in hs]), "slot": np.concatenate([np.frombuffer(x, np.int32) for x in f["whose"]])})

    def shared(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker("jaccard_join")
        for f in _runs(frames, "h"):
            h, fp, slot = f["h"].to_numpy(), f["fp"].to_numpy(), f["slot"].to_numpy()
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])
            h, fp, slot = h[new], fp[new], slot[new]
            alike = h[1:] == h[:-1]
            keep = np.zeros(len(h), bool)
            keep[1:] |= alike
            keep[:-1] |= alike
            yield pd.DataFrame({"h": h[keep], "fp": fp[keep], "slot": slot[keep]})

    rows = sketched.where("n > 0").select("fp", "sig", "whose").mapInPandas(emit, "h long, fp long, slot int")
    rows = rows.repartition(spread(sketched.sparkSession), "h").sortWithinPartitions("h", "fp")
    return written(rows.mapInPandas(shared, "h long, fp long, slot int"), "blocks")


def _fits(overlap: np.ndarray, total: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Whether an overlap of at most so much allows a similarity of 0.8 at that sum of sizes: 9 * overlap >= 4 * (n + m)."""
    return (9 * overlap >= 4 * total) | full


class RTree:
    """Points packed by component, then size, then their widest coordinate; FAN nodes of a level make one of the next.

    Of a node is known: the greatest corner of its points (in ``top``), their least and greatest size and component."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        wide = points[:, int(np.argmax(np.ptp(points, axis=0)))]
        self.order = np.lexsort((wide, sizes, labels))
        points, sizes, labels = points[self.order], sizes[self.order], labels[self.order]
        self.levels = [(points, (points == FULL).any(axis=1), sizes, sizes, labels, labels)]
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), FAN)
            up = (np.maximum, np.logical_or, np.minimum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(f.reduceat(x, at, axis=0) for f, x in zip(up, self.levels[-1])))

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points of different components whose bound allows a link."""
        zero = np.zeros(1, np.int64)
        stack = [(len(self.levels) - 1, zero, zero)]
        while stack:
            level, i, j = stack.pop()
            top, full, least, most, low, high = self.levels[level]
            near = (5 * most[i] >= 4 * least[j]) & (5 * most[j] >= 4 * least[i]) & ((low[i] != high[j]) | (low[j] != high[i]))
            i, j = i[near], j[near]
            overlap = np.minimum(top[i], top[j]).sum(axis=1, dtype=np.int64)
            ok = _fits(overlap, least[i] + least[j], full[i] | full[j])
            i, j = i[ok], j[ok]
            if level == 0:
                if len(i):
                    yield self.order[i], self.order[j]
                continue
            n = len(self.levels[level - 1][0])
            step = np.arange(FAN)
            for lo in range(0, len(i), FRONTIER):
                a = (i[lo : lo + FRONTIER, None, None] * FAN + step[:, None] + 0 * step).ravel()
                b = (j[lo : lo + FRONTIER, None, None] * FAN + step + 0 * step[:, None]).ravel()
                # a point is no pair with itself
                real = (a < n) & (b < n) & ((a < b) if level == 1 else (a <= b))
                if real.any():
                    stack.append((level - 1, a[real], b[real]))


def _within(h: np.ndarray, n: np.ndarray, label: np.ndarray, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of many trees of at most FAN points, rows sorted by tree h: each is one node, all pairs of which are tested."""
    full = (points == FULL).any(axis=1)
    for d in range(1, FAN):
        i = np.flatnonzero((h[d:] == h[:-d]) & (label[d:] != label[:-d]))
        for lo in range(0, len(i), FRONTIER * FAN):
            x = i[lo : lo + FRONTIER * FAN]
            y = x + d
            x, y = (v[(5 * n[x] >= 4 * n[y]) & (5 * n[y] >= 4 * n[x])] for v in (x, y))
            ok = _fits(np.minimum(points[x], points[y]).sum(axis=1, dtype=np.int64), n[x] + n[y], full[x] | full[y])
            yield x[ok], y[ok]


def _split(rows: DataFrame, key: str, total: int) -> DataFrame:
    """rows with _cells: into how many cells the tree of their key is split.  Only trees beyond HOT points are; what is broadcast of them has HOT_TREES rows at most."""
    hot = max(HOT, -(-total // HOT_TREES))
    big = rows.groupBy(key).count().where(F.col("count") > hot).select(key, F.ceil(F.col("count") / hot).cast("int").alias("_cells"))
    return rows.join(F.broadcast(big), key, "left").withColumn("_cells", F.coalesce("_cells", F.lit(1)))


def stars(homes: DataFrame, points: DataFrame, labels: DataFrame | None, total: int, salt: int) -> DataFrame:
    """Candidates (a, b) of one round: in each tree of its homes (fp, slot, h), or a cell of it, a class meets the leaders until one may be its like."""
    rows = homes.join(points, ["fp", "slot"])
    rows = rows.withColumn("label", F.col("fp")) if labels is None else rows.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    rows = _split(rows, "h", total).withColumn("h", F.xxhash64("h", F.pmod(F.xxhash64(F.lit(salt), "fp"), "_cells"))).drop("_cells")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker("jaccard_join")
        for f in _runs(frames, "h"):
            h, fp, n, label = (f[c].to_numpy() for c in ("h", "fp", "n", "label"))
            points = unpacked(list(f["point"]))
            full = (points == FULL).any(axis=1)
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            out = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                rest = np.arange(s, e)
                for _ in range(LEADERS):
                    if len(rest) < 2:
                        break
                    lead, rest = rest[0], rest[1:]
                    rest = rest[label[rest] != label[lead]]
                    overlap = np.minimum(points[lead], points[rest]).sum(axis=1, dtype=np.int64)
                    ok = _fits(overlap, n[lead] + n[rest], full[lead] | full[rest])
                    out.append((np.full(int(ok.sum()), fp[lead]), fp[rest[ok]]))
                    rest = rest[~ok]
            if out:
                a, b = (np.concatenate(x) for x in zip(*out))
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    dealt = rows.select("h", "fp", "n", "point", "label").repartition(spread(rows.sparkSession), "h").sortWithinPartitions("h", F.xxhash64(F.lit(salt), "fp"))
    return dealt.mapInPandas(run, "a long, b long").distinct()


def _given_here(x: np.ndarray, y: np.ndarray, key: np.ndarray, homes: np.ndarray) -> np.ndarray:
    """Of candidates in the trees of some keys: those whose first common home is that tree, or that have none in common."""
    same = homes[x] == homes[y]
    return ~same.any(axis=1) | (homes[x, same.argmax(axis=1)] == key[x])


def between_components(shared: DataFrame, points: DataFrame, homes: DataFrame, labels: DataFrame | None, total: int) -> DataFrame:
    """All candidates (a, b) of different components, from the trees of shared (h, fp, slot)."""
    spark = shared.sparkSession
    if labels is None:
        rows = shared.withColumn("label", F.col("fp"))
    else:
        rows = shared.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ends = rows.groupBy("h").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("_k")).where("_low <> _high")
    # of a split tree, a point is in the cells of all pairs of parts with its own
    hot = max(HOT, -(-total // HOT_TREES))
    cells = F.ceil(F.col("_k") / hot).cast("int")
    rows = rows.join(ends.select("h", cells.alias("_cells")), "h")
    own = F.pmod(F.xxhash64("fp"), "_cells")
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("_cells") - 1), lambda i: F.struct(F.least(own, i).alias("x"), F.greatest(own, i).alias("y"))))
    rows = rows.select("h", F.col("h").alias("key"), "fp", "slot", "label", "_cells", cell.alias("_c"))
    rows = rows.withColumn("h", F.when(F.col("_cells") > 1, F.xxhash64("h", "_c.x", "_c.y")).otherwise(F.col("h"))).select("h", "key", "fp", "slot", "label")
    rows = rows.join(points.join(homes, ["fp", "slot"]), ["fp", "slot"])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker("jaccard_join")
        for f in _runs(frames, "h"):
            h, key, fp, n, label = (f[c].to_numpy() for c in ("h", "key", "fp", "n", "label"))
            points, home = unpacked(list(f["point"])), np.stack(f["homes"].to_list())
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            k = np.diff(starts)
            at = np.flatnonzero(np.repeat(k <= FAN, k))
            out = [(at[x], at[y]) for x, y in _within(h[at], n[at], label[at], points[at])]
            for s, e in zip(starts[:-1][k > FAN].tolist(), starts[1:][k > FAN].tolist()):
                out += [(s + x, s + y) for x, y in RTree(points[s:e], n[s:e], label[s:e]).candidates()]
            if out:
                x, y = (np.concatenate(v) for v in zip(*out))
                here = _given_here(x, y, key, home)
                a, b = fp[x[here]], fp[y[here]]
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pd.DataFrame(pairs, columns=["a", "b"])

    dealt = rows.select("h", "key", "fp", "n", "point", "label", "homes").repartition(spread(spark), "h").sortWithinPartitions("h", "fp")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def _among(ids: DataFrame):
    """A test whether a doc_id may be among ids: FILTER_BITS bits by hash, so what the driver and tasks get is bounded; all of ids pass."""
    x = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)) + 1  # the bitmap functions count from 1
    parts = ids.groupBy(F.bitmap_bucket_number(x).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).collect()
    size = 4096
    bits = np.zeros(FILTER_BITS // 8 + size, np.uint8)
    for r in parts:
        bits[(r["k"] - 1) * size : r["k"] * size] = np.frombuffer(r["bits"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(at: pd.Series) -> pd.Series:
        a = at.to_numpy(np.int64)
        return pd.Series((shared.value[a >> 3] >> (a & 7).astype(np.uint8) & 1).astype(bool))

    return test(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))


def shingle_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """fp and set of the needed classes (rep, fp), from the representatives' texts."""
    needed = written(needed, "needed")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker("jaccard_join")
        for f in frames:
            fps, sets = [], []
            for fp, text in zip(f["fp"].tolist(), f["text"]):
                s = shingles(text)
                if fingerprint(s) == fp:  # a doc_id may have other rows with other texts
                    fps.append(fp)
                    sets.append(s.view(np.int64))
            yield pd.DataFrame({"fp": np.array(fps, np.int64), "s": sets})

    own = docs.select("doc_id", text_of().alias("text")).where(_among(needed))
    rows = own.join(needed.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("fp", "text")
    return written(rows.mapInPandas(run, "fp long, s array<long>"), "sets")


def refined(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose fine points allow a similarity of 0.8."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker("jaccard_join")
        for f in frames:
            ok = [9 * fine_bound(x, y) >= 4 * t for x, y, t in zip(f["x"], f["y"], f["t"].tolist())]
            yield f.loc[np.array(ok, bool), ["a", "b"]]

    of = lambda k, p: classes.select(F.col("fp").alias(k), F.col("fine").alias(p), F.col("n").alias("n" + k))
    rows = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("t"))
    return written(rows.mapInPandas(run, "a long, b long"), "refined")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets' similarity is 0.8 or more."""
    one = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a")
    two = one.join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    i = F.size(F.array_intersect("sa", "sb"))
    return two.where(100 * i >= 80 * (F.size("sa") + F.size("sb") - i)).select("a", "b")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    pairs = refined(pairs, classes)
    needed = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    sets = shingle_sets(docs, needed.join(classes, "fp").select("rep", "fp"))
    out = written(verified(pairs, sets), "links")
    for used in (sets, pairs):
        discard(used)
    release(docs.sparkSession)
    return out


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    whole = sketch(docs)
    # the parts are with the rows of a class that a task met first
    firsts = [F.max_by(c, F.size("slots")).alias(c) for c in ("slots", "sizes", "points")]
    classes = whole.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fine").alias("fine"), *firsts)
    classes = written(classes, "classes")
    points = written(class_points(classes), "points")
    sketched = written(whole.select("doc_id", "n", "fp"), "rows")
    shared = blocks(whole)
    discard(whole)
    home = lambda salt: F.min(F.struct(F.xxhash64(F.lit(salt), "h").alias("o"), "h"))["h"]
    homes = written(shared.groupBy("fp", "slot").agg(F.array(*[home(k) for k in range(max(1, STARS * TREES))]).alias("homes")), "homes")
    release(docs.sparkSession)
    total = shared.count()
    labels = links = None
    for r in [*range(STARS), None]:
        if r is None:
            found = between_components(shared, points, homes, labels, total)
        else:
            found = stars(homes.select("fp", "slot", F.explode(F.array_distinct(F.slice("homes", r * TREES + 1, TREES))).alias("h")), points, labels, total, r)
        pairs = written(found, "pairs")
        release(docs.sparkSession)
        if pairs.limit(1).count():
            more = _verified(docs, pairs, classes)
            if more.limit(1).count():
                links = more if links is None else links.unionByName(more)
                if labels is not None:
                    discard(labels)
                labels = connected_components(links)
        discard(pairs)
    for used in (shared, homes, points, *([] if links is None else [links])):
        discard(used)
    if labels is None:
        named = classes.select("fp", F.col("rep").alias("component_id"))
    else:
        named = classes.select("fp", "rep").join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
        least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
        named = with_label(named, least, "label").select("fp", "component_id")
    linked = sketched.where("n > 0").join(named, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(sketched.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id; rows without shingles stay."""
    found = written(join_components(docs), "components")
    name = free_name(docs, "_gone")
    gone = found.where(F.col("n_shingles") > 0).groupBy("doc_id").agg(F.min("component_id").alias("c")).where(~F.col("c").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(name))
    out = docs.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
    repeated = found.groupBy("doc_id").count().where("count > 1").join(gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
    if repeated.limit(1).count():
        out = out.dropDuplicates(["doc_id"])
    return out


#: DuckDB's answer; the closure of links is written out, which small tables bear.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
