"""Quality rules: base counts and a hashed n-gram log-likelihood ratio per document.

Word unigrams and bigrams are hashed into ``buckets`` cells.  Two multinomials over the cells are estimated from
the whole corpus: the trusted target (documents whose label says quality 1) and the raw corpus (all documents).
A document's score is the mean over its n-grams of log(p_target / p_raw); it is kept when the score reaches
``threshold``.  All is DataFrame code: one shuffle joins labels and counts into at most ``buckets`` rows, and
scoring is a projection over a folded array literal of ``buckets`` doubles, without shuffle or join.

Defined results: a null text counts as ''; texts without words fail the base rules; repeated rows are each
judged (and counted) as they stand; very long texts are judged whole; an empty corpus gives no rows; without any trusted
row every weight is 0 and base rules alone decide; a null doc_id never matches a label; extra columns pass through, but
one named like a result (RESULTS) gives way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import SPACES, free_name, text_of, words_of

#: Cells of the hash; also the bound of what the driver gets and the plan carries.
BUCKETS = 1 << 16
#: Mean log ratio (nats) from which a document is kept.
THRESHOLD = -0.06
#: Pseudo-counts that every cell has in both multinomials, dealt as in the raw corpus: they draw rare cells to a ratio of 1.
SMOOTHING = 64.0
SYMBOLS = "#*$%&|<>"
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more: sort (hash, place), compare neighbours, cover three words each."""
    n = F.size(words)
    zipped = F.arrays_zip(F.slice(words, 1, n - 2).alias("a"), F.slice(words, 2, n - 2).alias("b"), F.slice(words, 3, n - 2).alias("c"))
    hashes = F.transform(zipped, lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")))
    return F.when(n >= 3, F.sort_array(hashes))


def base_columns(docs: DataFrame, column: str = "text", words: str = "_words") -> DataFrame:
    """docs with the words (an array column of that name) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text_of(column)
    line, window = free_name(docs, "_lines"), free_name(docs, "_windows")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumns({words: words_of(text), line: lines})
    out = out.withColumn(window, _repeat_words(F.col(words)))
    m = F.size(window)
    near = F.arrays_zip(F.slice(window, 1, m - 1).alias("x"), F.slice(window, 2, m - 1).alias("y"))
    same = F.filter(near, lambda p: p["x"]["h"] == p["y"]["h"])
    covered = F.flatten(F.transform(same, lambda p: F.flatten(F.array(*[F.array(*[p[k]["i"] + j for j in range(3)]) for k in "xy"]))))
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(line) - F.size(F.array_distinct(line))).cast("long"),
            "n_repeat_words": F.when(m >= 2, F.size(F.array_distinct(covered))).otherwise(0).cast("long"),
        }
    ).drop(line, window)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _cells(a: Column, b: Column, buckets: int) -> tuple[Column, Column]:
    """Cells of the unigram a and of the bigram (a, b)."""
    return F.pmod(F.xxhash64(a), F.lit(buckets)), F.pmod(F.xxhash64(a, b), F.lit(buckets))


def cell_weights(docs: DataFrame, trusted: DataFrame, column: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """log(p_target / p_raw) of each cell; trusted: the doc_id of trusted rows.  The driver gets ``buckets`` rows at most."""
    ids = trusted.select(F.col("doc_id").alias("_id")).where("_id is not null").groupBy("_id").agg(F.lit(1).alias("_t"))
    marked = docs.select(F.col("doc_id").alias("_d"), text_of(column).alias("_x")).join(ids.hint("shuffle_hash"), F.col("_d") == F.col("_id"), "left")
    rows = marked.select(F.coalesce("_t", F.lit(0)).alias("t"), words_of(F.col("_x")).alias("w"))
    pairs = rows.select("t", F.inline(F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, size(w))").alias("b"))))
    uni, bi = _cells(F.col("a"), F.col("b"), buckets)
    grams = pairs.select("t", F.explode(F.array(uni, F.when(F.col("b").isNotNull(), bi))).alias("cell")).where("cell is not null")
    counts = grams.groupBy("cell").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["cell"]], target[r["cell"]] = r["raw"], r["target"]
    if not any(target):
        return [0.0] * buckets
    share = sum(target) / sum(raw)
    return [round(math.log((t + smoothing * share) / (c + smoothing) / share), 4) for c, t in zip(raw, target)]


def score_documents(docs: DataFrame, weights: list[float], column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base columns, llr (mean log ratio, null without words) and kept."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    buckets = len(weights)
    words = free_name(docs, "_words")
    out = base_columns(docs, column, words)
    n = F.size(words)
    uni = F.transform(words, lambda a: F.get(table, F.pmod(F.xxhash64(a), F.lit(buckets)).cast("int")))
    zipped = F.arrays_zip(F.slice(words, 1, n - 1).alias("a"), F.slice(words, 2, n - 1).alias("b"))
    bi = F.transform(zipped, lambda p: F.get(table, F.pmod(F.xxhash64(p["a"], p["b"]), F.lit(buckets)).cast("int")))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    llr = F.when(n == 0, None).when(n == 1, total(uni)).otherwise((total(uni) + total(bi)) / (2 * n - 1))
    out = out.withColumn("llr", llr).drop(words)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("llr", F.lit(0.0)) >= threshold))


def trusted_rows(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs with base columns, llr and kept."""
    return score_documents(docs, cell_weights(docs, trusted_rows(labels), buckets=buckets), threshold=threshold)
