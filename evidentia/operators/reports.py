"""Reports on batches of results, evaluation against expectations, summaries of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as t
from evidentia.functions.scoring import r2


def _n(holds: Column) -> Column:
    return F.count_if(F.coalesce(holds, F.lit(False)))


def _share(part: Column, whole: Column) -> Column:
    """4 digits, 0 of nothing."""
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(0.0)


def _is(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _number() -> Column:
    return F.coalesce("number", F.lit("")) != ""


def report(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by status, class, lookup and fallback, and their rates, of all results or by some columns.

    results: status (processed, error or not processed yet), number, lookup_found (null: not looked up), class, used_fallback.
    Rows without a status count as candidates only."""
    done = F.col("status") == "processed"
    n = lambda holds: _n(done & holds)
    missing, found = F.col("lookup_found") == F.lit(False), F.col("lookup_found") == F.lit(True)
    legacy = ~_number() | F.coalesce(missing, F.lit(False)) | (F.coalesce("class", F.lit("")) != "valid")
    out = results.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), _n(done).alias("processed"), _n(F.col("status") == "error").alias("errors"), n(_number()).alias("detected"), n(found).alias("lookup_found"), n(missing).alias("lookup_missing"),
        *[n(F.col("class") == k).alias(k) for k in ("valid", "review", "invalid")], n(legacy).alias("legacy_candidates"), n(_is("used_fallback")).alias("fallback_used"),
    )
    return out.withColumns({"completion_rate": _share(F.col("processed"), F.col("total")), "detection_rate": _share(F.col("detected"), F.col("processed"))})


def status_counts(results: DataFrame, statuses: list[str], by: list[str] | None = None) -> DataFrame:
    """How many results have each status: one column a status."""
    return results.groupBy(*(by or [])).agg(F.count("*").alias("total"), *[_n(F.col("status") == s).alias(s) for s in statuses])


def recovery_report(manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Messages of a day: fetched, of that day, with media, and what became of them.  manifest: on_day, has_media, status, number, class."""
    media = _is("on_day") & _is("has_media")
    n = lambda holds: _n(media & holds)
    # fixed values: the statuses of a recovered message
    kept = F.col("status").isin("downloaded", "analyzed", "analysis_failed")
    return manifest.groupBy(*(by or [])).agg(
        F.count("*").alias("fetched"), _n(_is("on_day")).alias("of_day"), _n(media).alias("images"), n(kept).alias("downloaded"), n(F.col("status") == "analyzed").alias("analyzed"), n(F.col("status") == "analysis_failed").alias("analysis_failed"),
        n(F.col("status") == "ignored_non_image_or_download_failed").alias("ignored"), n(_number()).alias("detected"), *[n(F.col("class") == k).alias(k) for k in ("valid", "review", "invalid")],
    )


def run_report(items: DataFrame, by: list[str] | None = None, completed: str = "stage_10_completed") -> DataFrame:
    """Outcome of a run over files with expected keys: classes, matches, rates, mean time, the slowest (the first of equals by name).

    items: name, status, class, number, matches (null: nothing expected), origin, used_fallback, confirmed, template_matched, total_ms."""
    timed = (F.col("status") == completed) & (F.coalesce("total_ms", F.lit(0)) > 0)
    return items.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), _n(F.col("status") == completed).alias("succeeded"), _n(F.coalesce("status", F.lit("")) != completed).alias("failed"), *[_n(F.col("class") == k).alias(k) for k in ("valid", "review", "invalid")],
        _n(_number()).alias("detected"), _n(F.coalesce("matches", F.lit(True)) & _number()).alias("matched"), _n(F.col("matches") == F.lit(False)).alias("mismatched"), _n(_number() & (F.col("origin") == "roi")).alias("from_region"),
        _n(_number() & _is("used_fallback")).alias("from_fallback"), _n(_is("confirmed")).alias("confirmed"), _n(_is("template_matched")).alias("template_matched"), F.coalesce(F.floor(F.avg(F.when(timed, F.col("total_ms"))) + 0.5), F.lit(0)).cast("long").alias("mean_ms"),
        F.max_by("name", F.when(timed, F.struct("total_ms", (-F.xxhash64("name")).alias("h")))).alias("slowest"), F.max(F.when(timed, F.col("total_ms"))).alias("slowest_ms"),
    ).withColumn("detection_rate", _share(F.col("detected"), F.col("total")))


def matches_expected(file: Column, number: Column) -> Column:
    """Whether the number is what the file's name expects; null where it expects nothing."""
    return F.when(t.expected_key(file).isNotNull(), F.coalesce(t.expected_key(file) == number, F.lit(False)))


def in_order(rows: DataFrame, ts: str, *ties: str) -> DataFrame:
    """rows numbered by time; those without one come first."""
    return rows.orderBy(F.coalesce(F.col(ts).cast("timestamp").cast("long"), F.lit(0)), *ties)


def result_key(message_id: Column, file: Column) -> Column:
    return F.coalesce(t.some(message_id), t.some(file), F.lit(""))


def keep_last(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: rows of both by key, those of new win; rows without a key are dropped.  Each side has one row a key."""
    some = F.coalesce(F.col(key), F.lit("")) != ""
    return new.where(some).unionByName(old.where(some).join(new.select(key), key, "left_anti"))


def importable(results: DataFrame, least: float = 0.0, unconfirmed: bool = False, limit: int = 0) -> DataFrame:
    """Processed results with a number of enough confidence, looked up unless said otherwise."""
    rows = results.where((F.col("status") == "processed") & _number() & (F.lit(unconfirmed) | _is("lookup_found")) & (F.coalesce("confidence", F.lit(0.0)) >= least))
    return rows.limit(limit) if limit else rows


def imported(candidates: DataFrame, existing: DataFrame, key: str = "number") -> DataFrame:
    """candidates with what becomes of each: already_exists or imported."""
    have = existing.select(key).distinct().withColumn("_have", F.lit(True))
    return candidates.join(have, key, "left").withColumn("outcome", F.when(F.col("_have"), "already_exists").otherwise("imported")).drop("_have")


def result_summary(attempts: Column, reasons: Column, most: int = 8) -> Column:
    """(fallback_used, attempts, reasons) of a processed document: reasons are cut."""
    n = F.coalesce(F.size(attempts), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return F.struct((n > 1).alias("fallback_used"), n.alias("attempts"), F.coalesce(F.slice(reasons, 1, most), F.array().cast("array<string>")).alias("reasons"))


def mean_confidence(confidences: Column) -> Column:
    """Mean of an array, two digits, 0 of nothing."""
    total = F.aggregate(confidences, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.coalesce(F.size(confidences), F.lit(0)) > 0, r2(total / F.size(confidences))).otherwise(0.0)


def field_average(fields: dict[str, tuple[Column, Column]]) -> Column:
    """Mean unit confidence over all fields (found or not), 0 if none is found."""
    any_found = F.lit(False)
    for found, _ in fields.values():
        any_found = any_found | F.coalesce(found, F.lit(False))
    total = F.lit(0.0)
    for _, c in fields.values():
        total = total + t.unit_confidence(c)
    return F.when(any_found, r2(total / len(fields))).otherwise(0.0)


def should_retry(number: Column, lookup_found: Column, rival: Column, rejected: Column, fast: bool = True) -> Column:
    """Whether a fast run's document is analysed again: no number, not known, or a competing one; never where its geometry was rejected."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.lit(fast) & ~yes(rejected) & ((F.coalesce(number, F.lit("")) == "") | ~yes(lookup_found) | yes(rival))


def preferred(first: Column, again: Column) -> Column:
    """Of two analyses (structs with nf and score; again may be null): the second if it has a number or scores higher."""
    better = (F.coalesce(again["nf"], F.lit("")) != "") | (F.coalesce(again["score"], F.lit(0.0)) > F.coalesce(first["score"], F.lit(0.0)))
    return F.when(again.isNotNull() & better, again).otherwise(first)


def top_orientations(evaluations: DataFrame, group: str, most: int = 3) -> DataFrame:
    """Evaluations ranked: matched first, then score, then the number's confidence, then the id; so many a group."""
    w = Window.partitionBy(group).orderBy(F.desc("matched"), F.desc("score"), F.desc("nf_conf"), "orientation")
    return evaluations.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def grouped_evidence(evidence: DataFrame, group: str, default: str = "unknown") -> DataFrame:
    """Evidence by document and orientation: ids in order, and count."""
    name = F.coalesce(t.some(F.col("orientation")), F.lit(default))
    rows = evidence.groupBy(group, name.alias("orientation")).agg(F.sort_array(F.collect_list(F.struct("ord", "id"))).alias("_r"))
    return rows.select(group, "orientation", F.transform("_r", lambda x: x["id"]).alias("ids"), F.size("_r").alias("n"))


def united(branches: list[DataFrame], group: str, *key: str) -> DataFrame:
    """Rows of all branches, the first of each key: earlier branches win, then the order (ord)."""
    rows = [b.withColumn("_b", F.lit(i)) for i, b in enumerate(branches)]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    best = F.min_by(F.struct(*out.columns), F.struct("_b", "ord"))
    return out.groupBy(group, *[F.coalesce(F.col(k), F.lit("")).alias(f"_k{i}") for i, k in enumerate(key)]).agg(best.alias("r")).select("r.*").drop("_b")


def reasons_union(*lists: Column) -> Column:
    """Distinct reasons in order."""
    return F.array_distinct(F.filter(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])), lambda r: F.coalesce(r, F.lit("")) != ""))


def repeated_reads(targets: DataFrame, passes: int = 3) -> DataFrame:
    """Each target once a pass, with an id of its own."""
    rows = targets.withColumn("read", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    return rows.withColumn("read_id", F.when(F.col("read") == 1, F.col("id")).otherwise(F.concat_ws("__read", "id", F.col("read").cast("string"))))


def ranked_results(results: DataFrame, group: str) -> DataFrame:
    """Recognised texts by score; equals keep their order."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "ord")))


def reading_order(lines: DataFrame, group: str, band: float = 10) -> DataFrame:
    """Lines from top to bottom in bands, and from left to right; halves of a band round to even."""
    w = Window.partitionBy(group).orderBy(F.bround(F.col("top") / band), "left", "line_no")
    return lines.withColumn("place", F.row_number().over(w))


def script_orientation_score(confidence: Column, hits: Column, dated: Column, context: Column, horizontal: Column, density: Column) -> Column:
    """Weighted mean of what a rotated page shows (fixed weights)."""
    flag = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return F.round(confidence * 0.48 + F.least(F.lit(1.0), hits / 4) * 0.22 + flag(dated, 0.11) + flag(context, 0.11) + horizontal * 0.05 + F.least(F.lit(1.0), density) * 0.03, 4)


def script_candidate_score(confidence: Column, expected: Column, context: Column, source: Column) -> Column:
    """(score, confidence) of a number read by the plain recogniser: fixed weights for an expected length, context, a short source and a label in it."""
    flag = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    labelled = t.searchable(source).rlike("nf|nfe|nota fiscal|numero|n o|no|nro")
    score = confidence * 0.48 + flag(expected, 0.28) + flag(context, 0.2) + flag(F.length(F.trim(source)) <= 24, 0.08) + flag(labelled, 0.12)
    return F.struct(F.round(F.least(F.lit(0.99), score), 4).alias("score"), F.round(F.least(F.lit(0.99), confidence * 0.7 + flag(context, 0.2)), 4).alias("confidence"))
