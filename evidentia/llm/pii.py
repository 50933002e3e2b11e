"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they miss.

Base: e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers, leftmost and non-overlapping per
kind.  Bootstrapping: base spans are the seeds; identifier-like tokens (runs of identifier characters with a digit) that no
base span overlaps are the instances to judge.  The two words before a seed or token are its lexical pattern, whatever
its shape.  Spark scores the bipartite graph of patterns and distinct values in ``rounds`` steps: a value's confidence
in a pattern is 1 - prod(1 - its other patterns'), seeds stay at 1, and a pattern's is the mean of its values' so that its
own vote does not count.  Patterns with ``support`` values of ``confidence`` (seeds, or found in other patterns) and that mean
discover the other tokens they hold, and so in the next round lift patterns that hold those.  All is DataFrame code.

Defined results: null texts count as ''; very long texts are searched whole; repeated rows get equal spans; empty tables give
no rows; a discovered span never overlaps a base span and carries its pattern's most frequent seed kind, or that of the values
it shares with others (ties: the first kind as listed); other columns pass through.  Names beginning with '_p_' are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import discard, text_of, written

KINDS = ("email", "ip", "card", "phone")
_RUN = "[A-Za-z0-9._%+-]"
#: A start inside a run of local-part characters can only match where its run's start does, or after another match; quantifiers that nothing follows are possessive.
EMAIL = rf"(?:\G|(?<!{_RUN})){_RUN}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An identifier-like token: a whole run of 6 to 64 such characters with a digit among the first 40.
TOKEN = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+@-]{0,40}[0-9])[A-Za-z0-9._%+@-]{6,64}(?![A-Za-z0-9._%+@-])"
ROUNDS, SUPPORT, CONFIDENCE = 3, 3, 0.8
#: Matches of a text that are folded together.
RUN = 256
_SPANS = "array<struct<s:int,e:int,m:string>>"


def _once(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _all_matches(text: Column, pattern: str, needs: str) -> Column:
    """Array of (s, e, m): start, end (exclusive, code points) and text of every match.  Gaps from split, matches from regexp_extract_all."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    both = F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda x: x["m"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    # a fold copies what it has at every step, so matches are folded RUN at a time
    runs = _once(both, lambda xs: F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / RUN).cast("int")), lambda i: F.aggregate(F.slice(xs, i * RUN + 1, RUN), zero, step)))
    starts = lambda rs: F.aggregate(rs, F.array(F.lit(0)), lambda acc, r: F.array_append(acc, F.element_at(acc, -1) + r["at"]))
    moved = lambda x: F.transform(x["runs"], lambda r, i: F.transform(r["out"], lambda m: F.struct((m["s"] + F.get(x["starts"], i)).alias("s"), (m["e"] + F.get(x["starts"], i)).alias("e"), m["m"].alias("m"))))
    spans = _once(_once(runs, lambda rs: F.struct(rs.alias("runs"), starts(rs).alias("starts"))), lambda x: F.flatten(moved(x)))
    return F.when(text.rlike(needs), spans).otherwise(F.array().cast(_SPANS))


def _is_ip(m: Column) -> Column:
    plain = F.transform(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    return F.forall(plain, lambda x: (F.length(x) <= 3) & (x.try_cast("int") <= 255))


def _is_card(m: Column) -> Column:
    digits = F.reverse(F.regexp_replace(m, "[^0-9]", ""))
    n = F.length(digits)
    each = F.transform(F.split(F.substring(digits, 1, 19), ""), lambda x, i: F.when(i % 2 == 0, x.try_cast("int")).otherwise((2 * x.try_cast("int")) % 10 + F.floor(2 * x.try_cast("int") / 10).cast("int")))
    total = F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)).cast("int"))
    return (n >= 12) & (n <= 19) & (total % 10 == 0)


def _is_phone(m: Column) -> Column:
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return (n >= 9) & (n <= 15)


_BASE = {"email": (EMAIL, "@", None), "ip": (IP, r"[0-9]\.[0-9]", _is_ip), "card": (CARD, "[0-9]", _is_card), "phone": (PHONE, r"\+[0-9]", _is_phone)}


def base_spans(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with _p_base: array of (s, k, e), start, kind's place in KINDS and end, in that order."""
    out = docs.withColumn("_p_text", text_of(column))
    for kind, (pattern, needs, _) in _BASE.items():
        out = out.withColumn(f"_p_{kind}", _all_matches(F.col("_p_text"), pattern, needs))
    parts = []
    for k, (kind, (_, _, good)) in enumerate(_BASE.items()):
        kept = F.filter(f"_p_{kind}", lambda x: good(x["m"])) if good else F.col(f"_p_{kind}")
        parts.append(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))))
    return out.withColumn("_p_base", F.sort_array(F.concat(*parts))).drop("_p_text", *[f"_p_{k}" for k in KINDS])


def joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(kinds, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def _key() -> Column:
    """Rows with equal doc_id and text have equal spans; the second hash makes chance meetings negligible."""
    return F.concat_ws(":", F.xxhash64("doc_id", text_of()).cast("string"), F.hash(text_of(), "doc_id").cast("string"))


def _before(text: Column, at: Column) -> Column:
    """The last two words (of the last 96 characters) that end before a place, in lower case."""
    left = F.substring(text, F.greatest(F.lit(1), at - 95), F.least(at, F.lit(96)))
    return F.lower(F.regexp_replace(F.regexp_extract(left, r"((?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){1,2})[^\x20\x09-\x0D]*$", 1), r"[\x20\x09-\x0D]+", " "))


def instances(docs: DataFrame) -> DataFrame:
    """Seeds and tokens: key, s, e, value, pattern and kind (null for tokens, which no base span overlaps)."""
    found = base_spans(docs.where(text_of().rlike("[0-9@]")).select(F.col("doc_id"), text_of().alias("text"))).withColumn("_p_key", _key())
    tokens = F.filter(_all_matches(F.col("text"), TOKEN, "[0-9]"), lambda t: ~F.exists("_p_base", lambda b: (b["s"] < t["e"]) & (b["e"] > t["s"])))
    seeds = F.transform("_p_base", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), F.col("text").substr(b["s"] + 1, b["e"] - b["s"]).alias("m"), b["k"].alias("k")))
    both = F.concat(seeds, F.transform(tokens, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), t["m"].alias("m"), F.lit(None).cast("int").alias("k"))))
    rows = found.select("_p_key", "text", F.explode(both).alias("t"))
    rows = rows.select("_p_key", F.col("t.s").alias("s"), F.col("t.e").alias("e"), F.col("t.m").alias("value"), _before(F.col("text"), F.col("t.s")).alias("pattern"), F.col("t.k").alias("kind"))
    return rows.where("pattern <> ''")


def _scores(edges: DataFrame, scores: DataFrame | None, support: int, confidence: float) -> DataFrame:
    """p of the patterns with support, from edges (pattern, value, seed) and the p of the round before."""
    if scores is None:
        conf = edges.select("pattern", F.col("seed").cast("double").alias("c"))
    else:
        miss = F.log(F.greatest(1 - F.coalesce("p", F.lit(0.0)), F.lit(1e-9)))
        rows = edges.join(scores, "pattern", "left").select("pattern", "value", "seed", miss.alias("m"))
        whole = rows.groupBy("value").agg(F.sum("m").alias("_m"))
        conf = rows.join(whole, "value").select("pattern", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp(F.least(F.lit(0.0), F.col("_m") - F.col("m")))).alias("c"))
    return conf.groupBy("pattern").agg(F.avg("c").alias("p"), F.count_if(F.col("c") >= confidence).alias("n")).where(F.col("n") >= support).select("pattern", "p")


def bootstrap(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Discovered spans: key and _p_more, array of (s, k, e)."""
    tokens = written(instances(docs), "pii-tokens")
    # a value that is a seed anywhere is a seed everywhere
    values = tokens.groupBy("value").agg(F.min("kind").alias("kind"))
    edges = tokens.select("pattern", "value").distinct().join(values, "value")
    edges = written(edges.select("pattern", "value", "kind", F.col("kind").isNotNull().alias("seed")), "pii-edges")
    scores = None
    for _ in range(rounds):
        old, scores = scores, written(_scores(edges, scores, support, confidence), "pii-scores")
        if old is not None:
            discard(old)
    sure = scores.where(F.col("p") >= confidence).select("pattern")
    votes = edges.join(sure, "pattern")
    by_kind = votes.where("seed").groupBy("pattern", "kind").agg(F.count("*").alias("n")).groupBy("pattern").agg(F.max_by("kind", F.struct("n", -F.col("kind"))).alias("k"))
    # patterns without a seed take the kind that their values have in other patterns
    shared = votes.where("not seed").join(by_kind, "pattern").groupBy("value").agg(F.min("k").alias("k"))
    lent = votes.join(by_kind, "pattern", "left_anti").join(shared, "value").groupBy("pattern", "k").agg(F.count("*").alias("n")).groupBy("pattern").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("k"))
    more = tokens.where("kind is null").join(by_kind.unionByName(lent), "pattern")
    return more.groupBy("_p_key").agg(F.sort_array(F.collect_set(F.struct("s", F.col("k").cast("int").alias("k"), "e"))).alias("_p_more"))


def find(docs: DataFrame, **settings) -> DataFrame:
    """docs with _p_base and _p_spans (base and discovered).  Only rows with a digit can have discoveries; the others meet no join."""
    more = bootstrap(docs, **settings)
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    digit = text_of().rlike("[0-9]")
    plain = base_spans(docs.where(~digit)).withColumn("_p_spans", F.col("_p_base"))
    held = base_spans(docs.where(digit).withColumn("_p_key", _key())).join(more, "_p_key", "left").drop("_p_key")
    held = held.withColumn("_p_spans", F.sort_array(F.concat("_p_base", F.coalesce("_p_more", none)))).drop("_p_more")
    return plain.unionByName(held)


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base spans, their hash, and all spans."""
    out = find(docs)
    counts = [F.size(F.filter("_p_base", lambda x: x["k"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("_p_base")), 256).alias("base_sha256"), joined(F.col("_p_spans")).alias("spans"))


def mask(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; of overlapping spans the first names the mask.  Null texts stay null."""
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    out = find(docs).withColumn("_p_t", text_of(column))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.array(F.col("_p_t").substr(acc["at"] + 1, x["s"] - acc["at"]), F.get(kinds, x["k"]))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate("_p_spans", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.col("_p_t").substr(acc["at"] + 1, F.length("_p_t"))))
    out = out.withColumn(column, F.when(F.col(column).isNotNull() & (F.size("_p_spans") > 0), masked).otherwise(F.col(column)))
    return out.select(*docs.columns)
