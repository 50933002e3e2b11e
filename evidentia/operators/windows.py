"""Windows over lines, digit runs and tokens, all within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions import text as t


def bound(x: Column, f) -> Column:
    """f(x) with x computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def line_windows(x: Column) -> Column:
    """Distinct (raw, searchable) of each line, with the next, the one before and both, and of the whole text; first ones stay.

    Each line is normalised once: what is searchable of joined lines is the join of what is searchable of each.  Windows
    without a letter or digit are dropped; a text has at most about eight times its own length in windows."""
    both = lambda c: F.struct(t.normalize_noise(c).alias("raw"), t.searchable(c).alias("searchable"))
    lines = F.filter(F.transform(F.split(t.text(x), "\r?\n", -1), both), lambda w: w["raw"] != "")
    joined = lambda ws: F.struct(F.array_join(F.transform(ws, lambda w: w["raw"]), " ").alias("raw"), F.array_join(F.filter(F.transform(ws, lambda w: w["searchable"]), lambda s: s != ""), " ").alias("searchable"))
    around = lambda ls, i: F.array(*[joined(F.slice(ls, F.greatest(i + 1 - before, F.lit(1)), F.least(i, F.lit(before)) + 1 + after)) for before, after in ((0, 0), (0, 1), (1, 0), (1, 1))])
    whole = F.struct(t.normalize_noise(x).alias("raw"), t.searchable(x).alias("searchable"))
    windows = F.array_append(bound(lines, lambda ls: F.flatten(F.transform(ls, lambda _, i: around(ls, i)))), whole)
    return F.filter(F.array_distinct(windows), lambda w: w["searchable"] != "")


def sliding_digits(x: Column, width: int = 7, shortest: int = 8, longest: int = 11) -> Column:
    """Every window of so many digits of the runs of shortest to longest digits; longer runs are consumed in pieces."""
    runs = F.regexp_extract_all(t.normalize_noise(x), F.lit(f"([0-9]{{{shortest},{longest}}})"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - (width - 1)), lambda i: F.substring(r, i, F.lit(width)))))


def token_windows(tokens: Column, target: int) -> Column:
    """Runs of target - 1 (one at least) to target + 2 tokens, joined by spaces, short ones first."""

    def of(have: Column, k: int) -> Column:
        n = F.size(have)
        runs = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(have, i, F.lit(k)), " "))
        return F.when(n >= k, runs).otherwise(F.array().cast("array<string>"))

    return bound(tokens, lambda have: F.concat(*[of(have, k) for k in range(max(1, target - 1), target + 3)]))
