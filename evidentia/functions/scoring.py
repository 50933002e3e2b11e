"""Similarity and statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import search_tokens, searchable


def r2(x: Column) -> Column:
    """Two digits, halves up."""
    return F.floor(x * 100 + 0.5) / 100


def r4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length of the searchable texts, 4 digits; two empty texts are alike."""
    x, y = searchable(a), searchable(b)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, 1.0).otherwise(F.round(1 - F.levenshtein(x, y) / longer, 4))


def token_coverage(target: Column, candidate: Column, least: float = 0.72) -> Column:
    """Share of the target's tokens that a candidate's token equals or nearly equals, 4 digits."""
    have = search_tokens(candidate)
    near = lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) >= least
    want = search_tokens(target)
    hits = F.size(F.filter(want, lambda t: F.exists(have, lambda c: (t == c) | near(t, c))))
    return F.when(F.size(want) == 0, 0.0).otherwise(F.round(hits / F.size(want), 4))


def alias_confidence(target: Column, candidate: Column, token_weight: float = 0.82, text_weight: float = 0.18) -> Column:
    s, c = similarity(target, candidate), token_coverage(target, candidate)
    mixed = (c * token_weight + s * text_weight) / (token_weight + text_weight)
    return F.greatest(s, F.least(F.lit(1.0), mixed))


def is_repdigit(x: Column) -> Column:
    return x.rlike(r"^(\d)\1+$")


def nearest_rank(values: Column, share: float) -> Column:
    """Nearest-rank percentile of an array, null if it is empty."""
    s = F.sort_array(values)
    return F.get(s, (F.greatest(F.lit(1), F.ceil(F.size(s) * share)) - 1).cast("int"))
