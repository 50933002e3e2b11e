"""Boxes (structs of x, y, width and height) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def axis_overlap(a: Column, a_end: Column, b: Column, b_end: Column) -> Column:
    """Length that two intervals share, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a, b))


def overlap_share(a: Column, b: Column) -> Column:
    """Share of a's area that b covers, 0..1; a null box shares nothing."""
    along = lambda at, size: axis_overlap(a[at], a[at] + a[size], b[at], b[at] + b[size])
    area = F.greatest(F.lit(0.0001), a["width"] * a["height"])
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.least(F.lit(1.0), along("x", "width") * along("y", "height") / area))


def expanded(a: Column, by_x: float = 0.02, by_y: float = 0.03) -> Column:
    """A box in units of its page, with padding on all sides."""
    grown = lambda size, by: F.least(F.lit(1.0), a[size] + 2 * by)
    return box(F.greatest(F.lit(0.0), a["x"] - by_x), F.greatest(F.lit(0.0), a["y"] - by_y), grown("width", by_x), grown("height", by_y))
