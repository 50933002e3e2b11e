"""Regions of a page in pixels, plans of steps over variants and regions, and geometry: all arithmetic on columns.

Boxes are structs of x, y, width and height; an image is known by its width and height.  Plans and region definitions are
small static tables, joined by their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as t
from evidentia.functions.scoring import r2

# Orientations with their rotations, variants, and what tells a strip.
ORIENTATIONS = {"upright": 0, "rotate_right": 90, "rotate_left": -90, "upside_down": 180}
VARIANTS = ("document_gray", "document_binary", "document_sharp", "document_ink_clean")
STRIP_LONG, STRIP_SHORT, STRIP_RATIO = 900, 420, 4.2
# Rotations by EXIF orientation, the least score of a trusted anchor, padding of regions by their id.
EXIF = {3: 180, 6: 90, 8: -90}
TRUSTED = 0.6
PADDING = {"nf_block": (0.14, 0.08), "nf_number_line": (0.4, 0.28), "nf_number_tight": (0.48, 0.24), "nf_header": (0.3, 0.24), "nf_series_line": (0.26, 0.22), "nf_block_wide": (0.1, 0.08)}


def _box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*[c.cast("long").alias(k) for k, c in (("x", x), ("y", y), ("width", width), ("height", height))])


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def _inner(size: Column) -> Column:
    """The last place where a box of two pixels fits."""
    return F.greatest(F.lit(0), size - 2)


def capture(width: Column, height: Column) -> Column:
    """(profile, elongation, orientations): a long, thin picture is a strip; a page lies or stands."""
    w, h = F.greatest(F.lit(1), width), F.greatest(F.lit(1), height)
    long, short = F.greatest(w, h), F.least(w, h)
    strip = (long >= STRIP_LONG) & (short <= STRIP_SHORT) & (long / short >= STRIP_RATIO)
    lying = F.when(w >= h, F.array(F.lit("upright"), F.lit("upside_down"))).otherwise(F.array(F.lit("rotate_right"), F.lit("rotate_left")))
    return F.struct(F.when(strip, "receipt_strip").otherwise("document_photo").alias("profile"), r2(long / short).alias("elongation"), lying.alias("orientations"))


def rotation(exif: Column) -> Column:
    """Degrees by the EXIF orientation, 0 for any other."""
    out = F.lit(0)
    for code, angle in EXIF.items():
        out = F.when(exif == code, angle).otherwise(out)
    return out


def variants(images: DataFrame, fast: bool = False) -> DataFrame:
    """A row for each image (image, width, height), orientation that it may have and variant."""
    spark = images.sparkSession
    table = spark.createDataFrame([(o, a, v, f"{o}__{v}") for o, a in ORIENTATIONS.items() for v in VARIANTS], "orientation string, angle int, variant string, id string")
    rows = images.withColumn("_c", capture(F.col("width"), F.col("height"))).withColumn("orientation", F.explode(F.when(F.lit(fast) | (F.col("_c.profile") == "receipt_strip"), F.col("_c.orientations")).otherwise(F.array(*map(F.lit, ORIENTATIONS)))))
    return rows.join(F.broadcast(table), "orientation").drop("_c")


def pixel_box(width: Column, height: Column, box: Column) -> Column:
    """A box in units of the image, in pixels inside it."""
    x, y = clamp(F.floor(width * box["x"]), F.lit(0), _inner(width)), clamp(F.floor(height * box["y"]), F.lit(0), _inner(height))
    return _box(x, y, clamp(F.floor(width * box["width"]), F.lit(2), width - x), clamp(F.floor(height * box["height"]), F.lit(2), height - y))


def expanded_pixels(width: Column, height: Column, box: Column, by_x: Column, by_y: Column, least: int = 4) -> Column:
    """With padding by shares of its size, so many pixels at least, inside the image."""
    px, py = F.greatest(F.lit(least), F.floor(box["width"] * by_x)), F.greatest(F.lit(least), F.floor(box["height"] * by_y))
    x, y = clamp(box["x"] - px, F.lit(0), _inner(width)), clamp(box["y"] - py, F.lit(0), _inner(height))
    return _box(x, y, clamp(box["width"] + px * 2, F.lit(2), width - x), clamp(box["height"] + py * 2, F.lit(2), height - y))


def template_box(width: Column, height: Column, region: Column, box: Column) -> Column:
    """The region's box with its padding."""
    of = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in PADDING.items() for x in (k, v[i])]), region), F.lit((0.1, 0.08)[i]))
    return expanded_pixels(width, height, pixel_box(width, height, box), of(0), of(1))


def anchored_box(width: Column, height: Column, box: Column, expected: Column, anchor: Column) -> Column:
    """Where a box lies if the block expected at ``expected`` (units) was found at ``anchor`` (pixels); without anchor as it is."""
    want, own = pixel_box(width, height, expected), pixel_box(width, height, box)
    sx, sy = anchor["width"] / F.greatest(F.lit(1), want["width"]), anchor["height"] / F.greatest(F.lit(1), want["height"])
    x = clamp(F.floor(anchor["x"] + (own["x"] - want["x"]) * sx), F.lit(0), _inner(width))
    y = clamp(F.floor(anchor["y"] + (own["y"] - want["y"]) * sy), F.lit(0), _inner(height))
    moved = _box(x, y, clamp(F.ceil(own["width"] * sx), F.lit(2), width - x), clamp(F.ceil(own["height"] * sy), F.lit(2), height - y))
    return F.when(anchor.isNull(), own).otherwise(moved)


def resolved_box(width: Column, height: Column, region: Column, box: Column, expected: Column, anchor: Column, score: Column, least_width: Column, least_height: Column) -> Column:
    """(box, strategy, large): by a trusted anchor, or by the template where there is none or the anchor's box is too small and the template's isn't."""
    trusted = anchor.isNotNull() & (F.coalesce(score, F.lit(0.0)) >= TRUSTED)
    by_anchor, by_template = anchored_box(width, height, box, expected, anchor), template_box(width, height, region, box)
    large = lambda b: (b["width"] >= least_width) & (b["height"] >= least_height)
    use = trusted & (large(by_anchor) | ~large(by_template))
    chosen = F.when(use, by_anchor).otherwise(by_template)
    return F.struct(chosen.alias("box"), F.when(use, "nf_anchor").otherwise("template_fixed_safe").alias("strategy"), large(chosen).alias("large"))


def fallback_chain(resolved: DataFrame, definitions: DataFrame, depth: int = 4) -> DataFrame:
    """The region that each requested one comes to: itself if its box is large or nothing stands behind it, else its fallback, and so on.

    resolved: image, region, large; definitions: region, fallback.  A region that was visited ends the walk; the table of regions is small, so ``depth`` joins walk it."""
    steps = resolved.join(F.broadcast(definitions), "region", "left")
    rows = steps.select("image", F.col("region").alias("requested"), "region", "large", "fallback", F.array("region").alias("chain"))
    own = steps.select("image", F.col("region").alias("_next"), F.col("large").alias("_large"), F.col("fallback").alias("_fallback"))
    for _ in range(depth):
        go = ~F.coalesce("large", F.lit(False)) & F.col("fallback").isNotNull() & ~F.array_contains("chain", F.coalesce("fallback", F.lit("")))
        rows = rows.withColumn("_next", F.when(go, F.col("fallback"))).join(own, ["image", "_next"], "left")
        moved = F.col("_large").isNotNull()
        rows = rows.select("image", "requested", F.when(moved, F.col("_next")).otherwise(F.col("region")).alias("region"), F.when(moved, F.col("_large")).otherwise(F.col("large")).alias("large"), F.when(moved, F.col("_fallback")).otherwise(F.col("fallback")).alias("fallback"), F.when(moved, F.array_append("chain", F.col("_next"))).otherwise(F.col("chain")).alias("chain"))
    return rows.select("image", "requested", "region", (F.size("chain") > 1).alias("used_fallback"), "chain")


def planned(sources: DataFrame, plan: DataFrame, regions: DataFrame) -> DataFrame:
    """Targets: a row for each source variant (image, id, variant) and step (step, variant, region) whose variant and region exist."""
    steps = plan.join(regions, "region")
    return sources.join(F.broadcast(steps), "variant").withColumn("target", F.concat_ws("__", "id", "step"))


def planned_regions(found: DataFrame, plan: DataFrame) -> DataFrame:
    """Targets: a row for each region found (image, id, region) and step (step, regions) that lists it."""
    steps = plan.select("step", F.explode("regions").alias("region"))
    return found.join(F.broadcast(steps), "region").withColumn("target", F.concat_ws("__", "id", "step"))


def number_sources(ranked: DataFrame, available: DataFrame, phase: str = "primary", fast: bool = False) -> DataFrame:
    """(image, id): variants whose number is read: grey and ink-clean ones of the best orientations (ranked first, then as listed), binary ones of the best only.

    ranked: image, orientation, rank; available: image, orientation, ord, variant, id."""
    most = 2 if fast or phase != "primary" else 3
    rows = available.select("image", "orientation", "ord", "variant", "id", F.lit(True).alias("listed")).unionByName(ranked.select("image", "orientation", "rank"), allowMissingColumns=True)
    rows = rows.where(F.col("image").isNotNull()).repartition("image")  # one shuffle for all; a join might send the listed variants, many times their table's size, to the driver for a broadcast
    one = Window.partitionBy("image", "orientation")
    rows = rows.withColumns({"rank": F.min("rank").over(one), "ord": F.min("ord").over(one)})
    rows = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("image").orderBy(F.col("rank").isNull(), F.coalesce("rank", "ord"), "orientation")) - 1)
    wanted = F.col("variant").isin("document_gray", "document_ink_clean") | ((F.col("variant") == "document_binary") & (F.col("place") == 0))
    return rows.where((F.col("place") < most) & F.col("listed") & F.col("orientation").isNotNull() & wanted).select("image", "id", "place", "variant")


def focus_variant(variant: Column) -> Column:
    """The document-focus variant of a variant, null for none."""
    v = t.some(variant)
    turned = F.when(F.startswith(v, F.lit("rotate_left_")), "rotate_left_document_focus").when(F.startswith(v, F.lit("rotate_right_")), "rotate_right_document_focus").otherwise("document_focus_grayscale")
    return F.when(v.isNotNull(), F.when(F.contains(v, F.lit("document_focus")), v).otherwise(turned))


def with_focus(wanted: Column, available: Column) -> Column:
    """Wanted variants, each followed by its focus variant, as far as available, each once."""
    both = F.flatten(F.transform(F.array_distinct(wanted), lambda v: F.array(v, focus_variant(v))))
    return F.array_distinct(F.filter(F.array_compact(both), lambda v: F.array_contains(available, v)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def polygon_area(points: Column) -> Column:
    """Area of a polygon of four points or more, else 0."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.when(n >= 4, F.abs(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)) / 2).otherwise(0.0)


def bounding_box(points: Column) -> Column:
    """Of four points or more, in whole pixels, else null."""
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    x, y = of(F.array_min, "x"), of(F.array_min, "y")
    box = _box(F.greatest(F.lit(0), F.floor(x)), F.greatest(F.lit(0), F.floor(y)), F.greatest(F.lit(2), F.ceil(of(F.array_max, "x") - x)), F.greatest(F.lit(2), F.ceil(of(F.array_max, "y") - y)))
    return F.when(F.size(points) >= 4, box)


def geometry_score(width: Column, height: Column, corners: Column, aspect: float, narrow: float, wide: float) -> Column:
    """(score, matched, coverage, aspect, consistency, reasons) of four corners (clockwise from the upper left) on an image."""
    at = lambda i: F.get(corners, F.lit(i))
    top, bottom, left, right = distance(at(0), at(1)), distance(at(3), at(2)), distance(at(0), at(3)), distance(at(1), at(2))
    ratio = ((top + bottom) / 2) / F.greatest(F.lit(1.0), (left + right) / 2)
    cover = polygon_area(corners) / F.greatest(F.lit(1), width * height)
    shape = F.greatest(F.lit(0.0), 1 - F.abs(ratio - aspect) / max(aspect, 1.0))
    filled = F.when(cover >= 0.55, 1.0).when(cover >= 0.35, 0.82).when(cover >= 0.22, 0.58).otherwise(0.24)
    even = lambda a, b: F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(a, b, F.lit(1.0)))
    steady = r2((even(top, bottom) + even(left, right)) / 2)
    score = r2(F.least(F.lit(1.0), shape * 0.52 + filled * 0.28 + steady * 0.2))
    # fixed values: names of reasons
    why = ((ratio < narrow, "aspect_ratio_baixo"), (ratio > wide, "aspect_ratio_alto"), (cover < 0.22, "cobertura_baixa"), (steady < 0.62, "perspectiva_instavel"))
    return F.struct(score.alias("score"), (score >= 0.58).alias("matched"), F.round(cover, 3).alias("coverage"), r2(ratio).alias("aspect"), steady.alias("consistency"), F.array_compact(F.array(*[F.when(h, r) for h, r in why])).alias("reasons"))


def alignment_quality(aspect: Column, geometry: Column, anchor: Column, matched: Column, whole: Column, marked: Column, warped: Column, trim: Column, target: float, narrow: float, wide: float) -> Column:
    """(quality, suspicious_warp): how well an aligned candidate fits.  whole: the source itself; marked: a dark signature; trim: a trim that was refused."""
    yes = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    shape = F.greatest(F.lit(0.0), 1 - F.abs(aspect - target) / max(target, 1.0))
    cropped = yes(whole & (aspect >= narrow * 0.95) & (aspect <= wide * 1.05), 0.2)
    warp = F.when(F.coalesce(warped, F.lit(False)) & (aspect < narrow), r2(F.least(F.lit(0.45), (narrow - aspect) / max(narrow, 1.0) * 0.7))).otherwise(0.0)
    total = shape * 0.34 + geometry * 0.34 + anchor * 0.22 + yes(matched, 0.08) + cropped - yes(marked, 0.45) - warp - yes(trim, 0.08)
    return F.struct(r2(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).alias("quality"), (warp > 0).alias("suspicious_warp"))


def anchor_score(box: Column, expected: Column) -> Column:
    """(score, detected): a found block's likeness to the one expected, by size and shape."""
    one = lambda c: F.greatest(F.lit(1), c)
    size = F.greatest(F.lit(0.0), 1 - (F.abs(1 - box["width"] / one(expected["width"])) + F.abs(1 - box["height"] / one(expected["height"]))) / 2)
    shape = F.greatest(F.lit(0.0), 1 - F.abs(box["width"] / one(box["height"]) - expected["width"] / one(expected["height"])) / 2)
    score = r2(size * 0.6 + shape * 0.4)
    return F.struct(score.alias("score"), (score >= 0.32).alias("detected"))


def rescaled_box(box: Column, by_x: Column, by_y: Column, width: Column, height: Column) -> Column:
    """A box on an image of another size."""
    x, y = clamp(F.floor(box["x"] * by_x), F.lit(0), _inner(width)), clamp(F.floor(box["y"] * by_y), F.lit(0), _inner(height))
    half_up = lambda v: F.floor(v + 0.5)
    w = clamp(F.greatest(F.lit(2), half_up(box["width"] * by_x)), F.lit(2), F.greatest(F.lit(2), width - x))
    return _box(x, y, w, clamp(F.greatest(F.lit(2), half_up(box["height"] * by_y)), F.lit(2), F.greatest(F.lit(2), height - y)))


def rescaled_point(point: Column, by_x: Column, by_y: Column, width: Column, height: Column) -> Column:
    at = lambda v, most: F.greatest(F.lit(0.0), F.least(F.greatest(F.lit(0), most - 1).cast("double"), r2(v)))
    return F.struct(at(point["x"] * by_x, width).alias("x"), at(point["y"] * by_y, height).alias("y"))


def probe_size(width: Column, height: Column, most: int) -> Column:
    """Size of a probe whose longest edge is ``most`` at most."""
    scale = F.least(F.lit(1.0), most / F.greatest(width, height))
    return F.struct(F.floor(width * scale + 0.5).cast("long").alias("width"), F.floor(height * scale + 0.5).cast("long").alias("height"))


def bounds_to_source(width: Column, height: Column, probe_width: Column, probe_height: Column, box: Column) -> Column:
    """Bounds found on a probe, on its source."""
    sx, sy = width / F.greatest(F.lit(1), probe_width), height / F.greatest(F.lit(1), probe_height)
    x, y = F.greatest(F.lit(0), F.floor(box["x"] * sx)), F.greatest(F.lit(0), F.floor(box["y"] * sy))
    return _box(x, y, F.least(width - x, F.greatest(F.lit(2), F.ceil(box["width"] * sx))), F.least(height - y, F.greatest(F.lit(2), F.ceil(box["height"] * sy))))


def recognised_size(width: Column, height: Column, most: int, least: int) -> Column:
    """Size for recognition: the longest edge is ``most`` at most, then ``least`` at least."""
    down = F.least(F.lit(1.0), most / F.greatest(width, height))
    w, h = F.floor(width * down + 0.5), F.floor(height * down + 0.5)
    up = F.greatest(F.lit(1.0), least / F.greatest(w, h))
    return F.struct(F.floor(w * up + 0.5).cast("long").alias("width"), F.floor(h * up + 0.5).cast("long").alias("height"))
