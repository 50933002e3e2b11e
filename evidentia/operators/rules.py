"""Rule ladders: classes and reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(*rules: tuple[Column, str], default: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(default)
    for holds, name in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), name) for holds, name in rules]))


def overlay(base: Column, over: Column) -> Column:
    """Map with the entries of both; those of over win."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k)), over)


def first_accepted(attempts: Column, status: str = "success") -> Column:
    """The first attempt of an ordered array with the status, else null."""
    return F.get(F.filter(attempts, lambda a: a["status"] == status), F.lit(0))
