"""Queries of regions, plans and geometry, over images made from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import boxes
from evidentia.operators import regions as g
from evidentia.plans.base import query, r2, table

_IMG = {"image": "p_partkey", "w": "100 + p_partkey * 37 % 1900", "h": "80 + p_partkey * 53 % 900", "bx": "(p_partkey * 7 % 90) / 100.0e0", "by_": "(p_partkey * 11 % 90) / 100.0e0", "bw": "(5 + p_partkey * 13 % 40) / 100.0e0", "bh": "(5 + p_partkey * 17 % 40) / 100.0e0"}
_I = "i AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _IMG.items()) + ", p_partkey FROM part)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(v).alias(k) for k, v in _IMG.items()])
    return rows.withColumn("box", boxes.box(F.col("bx"), F.col("by_"), F.col("bw"), F.col("bh")))


def _clamp(x: str, low: str, high: str) -> str:
    return f"greatest({low}, least({high}, {x}))"


@query(f"""WITH {_I}, c AS (SELECT *, greatest(w, h) AS a, least(w, h) AS b FROM i) SELECT image, CASE WHEN a >= 900 AND b <= 420 AND a / b >= 4.2 THEN 'receipt_strip' ELSE 'document_photo' END AS profile, {r2('a / b')} AS elongation,
  CASE WHEN w >= h THEN 'upright,upside_down' ELSE 'rotate_right,rotate_left' END AS orientations, CASE image % 9 WHEN 3 THEN 180 WHEN 6 THEN 90 WHEN 8 THEN -90 ELSE 0 END AS rotation FROM c""")
def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips and photos, their orientations, and EXIF rotations."""
    rows = images(spark, sf_dir).select("image", g.capture(F.col("w"), F.col("h")).alias("c"), g.rotation(F.col("image") % 9).alias("rotation"))
    return rows.select("image", "c.profile", "c.elongation", F.array_join("c.orientations", ",").alias("orientations"), "rotation")


@query(f"""WITH {_I}, c AS (SELECT *, greatest(w, h) AS a, least(w, h) AS b FROM i), o(orientation, angle) AS (VALUES ('upright', 0), ('rotate_right', 90), ('rotate_left', -90), ('upside_down', 180)), v(variant) AS (VALUES ('document_gray'), ('document_binary'), ('document_sharp'), ('document_ink_clean'))
SELECT image, orientation || '__' || variant AS id, angle FROM c, o, v WHERE NOT (a >= 900 AND b <= 420 AND a / b >= 4.2) OR (w >= h AND orientation IN ('upright', 'upside_down')) OR (w < h AND orientation LIKE 'rotate%')""")
def image_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of each image in the orientations that it may have."""
    return g.variants(images(spark, sf_dir).select("image", F.col("w").alias("width"), F.col("h").alias("height"))).select("image", "id", "angle")


def _pixel(p: str, bx: str, by: str, bw: str, bh: str) -> str:
    return f"{_clamp(f'floor(w * {bx})', '0', 'greatest(0, w - 2)')}::BIGINT AS {p}x, {_clamp(f'floor(h * {by})', '0', 'greatest(0, h - 2)')}::BIGINT AS {p}y, floor(w * {bw}) AS {p}w0, floor(h * {bh}) AS {p}h0"


def _sized(p: str) -> str:
    return f"{_clamp(p + 'w0', '2', f'w - {p}x')}::BIGINT AS {p}w, {_clamp(p + 'h0', '2', f'h - {p}y')}::BIGINT AS {p}h"


_PIXELS = f"p0 AS (SELECT *, {_pixel('o', 'bx', 'by_', 'bw', 'bh')}, {_pixel('e', '0.6e0', '0.2e0', '0.3e0', '0.5e0')} FROM i), p AS (SELECT *, {_sized('o')}, {_sized('e')} FROM p0)"
_ANCHOR = "CASE WHEN image % 3 <> 0 THEN image % 50 END AS ax, image % 40 AS ay, 20 + image % 300 AS aw, 20 + image % 200 AS ah, (image % 101) / 100e0 AS score, CASE image % 3 WHEN 0 THEN 0.4e0 WHEN 1 THEN 0.14e0 ELSE 0.1e0 END AS px, CASE image % 3 WHEN 0 THEN 0.28e0 WHEN 1 THEN 0.08e0 ELSE 0.08e0 END AS py"
_BOXES = f"""{_I}, {_PIXELS}, a AS (SELECT *, {_ANCHOR} FROM p), s AS (SELECT *, aw / greatest(1, ew) AS sx, ah / greatest(1, eh) AS sy, greatest(4, floor(ow * px)) AS dx, greatest(4, floor(oh * py)) AS dy FROM a),
m AS (SELECT *, {_clamp('floor(ax + (ox - ex) * sx)', '0', 'greatest(0, w - 2)')} AS mx, {_clamp('floor(ay + (oy - ey) * sy)', '0', 'greatest(0, h - 2)')} AS my, {_clamp('ox - dx', '0', 'greatest(0, w - 2)')} AS tx, {_clamp('oy - dy', '0', 'greatest(0, h - 2)')} AS ty FROM s),
b AS (SELECT *, {_clamp('ceil(ow * sx)', '2', 'w - mx')} AS mw, {_clamp('ceil(oh * sy)', '2', 'h - my')} AS mh, {_clamp('ow + dx * 2', '2', 'w - tx')} AS tw, {_clamp('oh + dy * 2', '2', 'h - ty')} AS th FROM m),
u AS (SELECT *, coalesce(ax IS NOT NULL AND score >= 0.6 AND ((mw >= 120 AND mh >= 60) OR NOT (tw >= 120 AND th >= 60)), false) AS use FROM b)"""


@query(f"""WITH {_BOXES} SELECT image, ox AS x, oy AS y, ow AS width, oh AS height, CASE WHEN use THEN 'nf_anchor' ELSE 'template_fixed_safe' END AS strategy, (CASE WHEN use THEN mx ELSE tx END)::BIGINT AS rx, (CASE WHEN use THEN my ELSE ty END)::BIGINT AS ry, (CASE WHEN use THEN mw ELSE tw END)::BIGINT AS rw, (CASE WHEN use THEN mh ELSE th END)::BIGINT AS rh,
  CASE WHEN use THEN mw >= 120 AND mh >= 60 ELSE tw >= 120 AND th >= 60 END AS large FROM u""")
def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in pixels: as they are, by a trusted anchor, or by the padded template."""
    k, w, h = F.col("image"), F.col("w"), F.col("h")
    anchor = F.when(k % 3 != 0, boxes.box(k % 50, k % 40, 20 + k % 300, 20 + k % 200))
    region = F.when(k % 3 == 0, "nf_number_line").when(k % 3 == 1, "nf_block").otherwise("other")
    expected = boxes.box(*map(F.lit, (0.6, 0.2, 0.3, 0.5)))
    rows = images(spark, sf_dir).select("image", g.pixel_box(w, h, F.col("box")).alias("o"), g.resolved_box(w, h, region, F.col("box"), expected, anchor, (k % 101) / 100, F.lit(120), F.lit(60)).alias("r"))
    return rows.select("image", "o.*", "r.strategy", *[F.col(f"r.box.{c}").alias(a) for c, a in (("x", "rx"), ("y", "ry"), ("width", "rw"), ("height", "rh"))], "r.large")


_DEFS = "d(region, fallback) AS (VALUES ('tight', 'line'), ('line', 'block'), ('block', 'wide'), ('wide', NULL), ('loop', 'ring'), ('ring', 'loop'))"


@query(f"""WITH RECURSIVE {_DEFS}, s AS (SELECT p_partkey AS image, region, fallback, (p_partkey * length(region) + ascii(region)) % 3 = 0 AS large FROM part, d),
w AS (SELECT image, region AS requested, region, large, fallback, [region] AS chain FROM s UNION ALL SELECT w.image, requested, s.region, s.large, s.fallback, list_append(chain, s.region) FROM w JOIN s ON s.image = w.image AND s.region = w.fallback WHERE NOT w.large AND NOT list_contains(chain, w.fallback))
SELECT DISTINCT ON (image, requested) image, requested, region, len(chain) > 1 AS used_fallback, array_to_string(chain, ',') AS chain FROM w ORDER BY image, requested, len(chain) DESC""")
def region_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where too small regions fall back to, without going round."""
    defs = spark.createDataFrame([("tight", "line"), ("line", "block"), ("block", "wide"), ("wide", None), ("loop", "ring"), ("ring", "loop")], "region string, fallback string")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), F.explode(F.array(*[F.lit(r) for r in ("tight", "line", "block", "wide", "loop", "ring")])).alias("region"))
    rows = rows.withColumn("large", (F.col("image") * F.length("region") + F.ascii("region")) % 3 == 0)
    return g.fallback_chain(rows, defs).withColumn("chain", F.array_join("chain", ","))


@query("""WITH s AS (SELECT p_partkey AS image, 'v' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'gray' WHEN 1 THEN 'binary' ELSE 'none' END AS variant FROM part), p(step, variant, region) AS (VALUES ('a', 'gray', 'head'), ('b', 'gray', 'lost'), ('c', 'binary', 'foot')), r(region) AS (VALUES ('head'), ('foot')), q(step, region) AS (VALUES ('x', 'head'), ('x', 'foot'), ('y', 'foot'))
SELECT image, id || '__' || p.step AS target, string_agg(q.step, ',' ORDER BY q.step) AS second FROM s JOIN p USING (variant) JOIN r USING (region) JOIN q USING (region) GROUP BY ALL""")
def planned_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps over variants and regions, and steps that list regions."""
    k = F.col("p_partkey")
    sources = table(spark, sf_dir, "part").select(k.alias("image"), F.concat(F.lit("v"), k).alias("id"), F.when(k % 3 == 0, "gray").when(k % 3 == 1, "binary").otherwise("none").alias("variant"))
    plan = spark.createDataFrame([("a", "gray", "head"), ("b", "gray", "lost"), ("c", "binary", "foot")], "step string, variant string, region string")
    first = g.planned(sources, plan, spark.createDataFrame([("head",), ("foot",)], "region string")).select("image", F.col("target").alias("id"), "region")
    more = g.planned_regions(first, spark.createDataFrame([("x", ["head", "foot"]), ("y", ["foot"])], "step string, regions array<string>"))
    return more.groupBy("image", F.col("id").alias("target")).agg(F.array_join(F.sort_array(F.collect_list("step")), ",").alias("second"))


@query("""WITH a AS (SELECT p_partkey AS image, o.orientation, o.ord, v.variant, o.orientation || v.variant AS id FROM part, (VALUES ('o1', 1), ('o2', 2), ('o3', 3), ('o4', 4)) o(orientation, ord), (VALUES ('document_gray'), ('document_binary'), ('document_ink_clean'), ('document_sharp')) v(variant)),
r AS (SELECT p_partkey AS image, 'o' || (p_partkey % 4 + 1) AS orientation, 1 AS rank FROM part WHERE p_partkey % 5 <> 0), l AS (SELECT DISTINCT image, orientation, ord FROM a),
t AS (SELECT l.image, l.orientation, row_number() OVER (PARTITION BY l.image ORDER BY rank IS NULL, coalesce(rank, ord), l.orientation) - 1 AS place FROM l LEFT JOIN r ON r.image = l.image AND r.orientation = l.orientation)
SELECT image, id, place FROM a JOIN t USING (image, orientation) WHERE place < 3 AND (variant IN ('document_gray', 'document_ink_clean') OR (variant = 'document_binary' AND place = 0))""")
def number_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants whose number is read."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k.alias("image"))
    each = parts.select("image", F.posexplode(F.array(*[F.lit(f"o{i}") for i in (1, 2, 3, 4)])).alias("i", "orientation")).withColumn("ord", F.col("i") + 1)
    rows = each.withColumn("variant", F.explode(F.array(*map(F.lit, g.VARIANTS)))).withColumn("id", F.concat("orientation", "variant")).drop("i")
    ranked = parts.where("image % 5 <> 0").select("image", F.concat(F.lit("o"), F.col("image") % 4 + 1).alias("orientation"), F.lit(1).alias("rank"))
    return g.number_sources(ranked, rows).select("image", "id", F.col("place").cast("long").alias("place"))


@query("""SELECT p_partkey AS image, CASE p_partkey % 4 WHEN 0 THEN 'rotate_left_gray,rotate_left_document_focus' WHEN 1 THEN 'rotate_right_document_focus' WHEN 2 THEN 'document_focus_grayscale' ELSE 'rotate_left_gray,rotate_left_document_focus' END AS ids FROM part""")
def focus_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted variants with their focus variants, as far as there are any."""
    k, lit = F.col("p_partkey") % 4, lambda *x: F.array(*map(F.lit, x))
    wanted = F.when(k == 0, lit("rotate_left_gray", "rotate_left_gray")).when(k == 1, lit("rotate_right_x", "")).when(k == 2, lit("sharp")).otherwise(lit("rotate_left_gray", "rotate_left_document_focus"))
    have = lit("rotate_left_gray", "rotate_left_document_focus", "rotate_right_document_focus", "document_focus_grayscale")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), F.array_join(g.with_focus(wanted, have), ",").alias("ids"))


_AT = {"x0": "bx * 100", "y0": "by_ * 50", "x1": "bx * 100 + w", "y1": "bh * 100", "x2": "w * 1.1e0", "y2": "h + bw * 10", "x3": "bw * 100", "y3": "h * 0.9e0"}
_EVEN = "greatest(0e0, 1 - abs({a} - {b}) / greatest({a}, {b}, 1e0))"
_SIDES = ", ".join(f"sqrt((x{i} - x{j}) * (x{i} - x{j}) + (y{i} - y{j}) * (y{i} - y{j})) AS {n}" for n, i, j in (("top", 0, 1), ("bottom", 3, 2), ("lft", 0, 3), ("rgt", 1, 2)))


@query(f"""WITH {_I}, c AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _AT.items())} FROM i), s AS (SELECT *, {_SIDES}, abs(0e0 + (x0 * y1 - x1 * y0) + (x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y0 - x0 * y3)) / 2 AS area FROM c),
r AS (SELECT *, ((top + bottom) / 2) / greatest(1e0, (lft + rgt) / 2) AS ratio, area / greatest(1, (w * 2) * (h * 2)) AS cover, {r2(f"({_EVEN.format(a='top', b='bottom')} + {_EVEN.format(a='lft', b='rgt')}) / 2")} AS steady FROM s),
q AS (SELECT *, {r2("least(1e0, greatest(0e0, 1 - abs(ratio - 3.2e0) / 3.2e0) * 0.52e0 + CASE WHEN cover >= 0.55 THEN 1e0 WHEN cover >= 0.35 THEN 0.82e0 WHEN cover >= 0.22 THEN 0.58e0 ELSE 0.24e0 END * 0.28e0 + steady * 0.2e0)")} AS score FROM r)
SELECT image, score, score >= 0.58 AS matched, {r2('ratio')} AS aspect, steady AS consistency, array_to_string(list_filter([CASE WHEN ratio < 2.2 THEN 'aspect_ratio_baixo' END, CASE WHEN ratio > 5 THEN 'aspect_ratio_alto' END, CASE WHEN cover < 0.22 THEN 'cobertura_baixa' END, CASE WHEN steady < 0.62 THEN 'perspectiva_instavel' END], lambda x: x IS NOT NULL), ',') AS reasons,
  greatest(0, floor(least(x0, x1, x2, x3)))::BIGINT AS x, greatest(2, ceil(greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3)))::BIGINT AS width FROM q""")
def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well four corners fit a page."""
    at = lambda i: F.struct(F.expr(_AT[f"x{i}"]).alias("x"), F.expr(_AT[f"y{i}"]).alias("y"))
    rows = images(spark, sf_dir).withColumn("corners", F.array(*[at(i) for i in range(4)]))
    rows = rows.select("image", g.geometry_score(F.col("w") * 2, F.col("h") * 2, F.col("corners"), 3.2, 2.2, 5.0).alias("g"), g.bounding_box(F.col("corners")).alias("b"))
    return rows.select("image", "g.score", "g.matched", "g.aspect", "g.consistency", F.array_join("g.reasons", ",").alias("reasons"), "b.x", "b.width")


_WARP = f"CASE WHEN image % 2 = 0 AND a < 2.2 THEN {r2('least(0.45e0, (2.2e0 - a) / 2.2e0 * 0.7e0)')} ELSE 0e0 END"


@query(f"""WITH {_I}, c AS (SELECT *, w / h AS a, 10 + image % 90 AS fw, 10 + image % 45 AS fh FROM i), q AS (SELECT *, {_WARP} AS warp, greatest(0e0, 1 - (abs(1 - fw / 60) + abs(1 - fh / 30)) / 2) AS size, greatest(0e0, 1 - abs(fw / fh - 60 / 30) / 2) AS shape FROM c)
SELECT image, {r2("greatest(0e0, least(1e0, greatest(0e0, 1 - abs(a - 3.2e0) / 3.2e0) * 0.34e0 + bx * 0.34e0 + by_ * 0.22e0 + CASE WHEN image % 3 = 0 THEN 0.08e0 ELSE 0e0 END + CASE WHEN image % 5 = 0 AND a >= 2.2e0 * 0.95e0 AND a <= 5e0 * 1.05e0 THEN 0.2e0 ELSE 0e0 END - CASE WHEN image % 7 = 0 THEN 0.45e0 ELSE 0e0 END - warp - CASE WHEN image % 11 = 0 THEN 0.08e0 ELSE 0e0 END))")} AS quality,
  warp > 0 AS suspicious_warp, {r2('size * 0.6e0 + shape * 0.4e0')} AS anchor, {r2('size * 0.6e0 + shape * 0.4e0')} >= 0.32 AS detected FROM q""")
def alignment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of aligned candidates, and likeness of a found block to the expected one."""
    k, a = F.col("image"), F.col("w") / F.col("h")
    quality = g.alignment_quality(a, F.col("bx"), F.col("by_"), k % 3 == 0, k % 5 == 0, k % 7 == 0, k % 2 == 0, k % 11 == 0, 3.2, 2.2, 5.0)
    anchor = g.anchor_score(boxes.box(F.lit(0), F.lit(0), 10 + k % 90, 10 + k % 45), boxes.box(*map(F.lit, (0, 0, 60, 30))))
    return images(spark, sf_dir).select("image", quality.alias("q"), anchor.alias("n")).select("image", "q.quality", "q.suspicious_warp", F.col("n.score").alias("anchor"), "n.detected")


_SX, _SY = "1.5e0", "0.7e0"


@query(f"""WITH {_I}, {_PIXELS}, s AS (SELECT *, {_clamp(f'floor(ox * {_SX})', '0', 'greatest(0, w - 2)')} AS sx, {_clamp(f'floor(oy * {_SY})', '0', 'greatest(0, h - 2)')} AS sy, least(1e0, 700 / greatest(w, h)) AS f FROM p), q AS (SELECT *, floor(w * f + 0.5) AS qw, floor(h * f + 0.5) AS qh FROM s), u AS (SELECT *, greatest(1e0, 1400 / greatest(qw, qh)) AS up, w / greatest(1, qw) AS bx2, h / greatest(1, qh) AS by2 FROM q)
SELECT image, sx::BIGINT AS x, sy::BIGINT AS y, {_clamp(f'greatest(2, floor(ow * {_SX} + 0.5))', '2', 'greatest(2, w - sx)')}::BIGINT AS width, {_clamp(f'greatest(2, floor(oh * {_SY} + 0.5))', '2', 'greatest(2, h - sy)')}::BIGINT AS height, greatest(0e0, least((greatest(0, w - 1))::DOUBLE, {r2(f'ox * {_SX}')})) AS px,
  qw::BIGINT AS probe_width, floor(qw * up + 0.5)::BIGINT AS read_width, greatest(0, floor(3 * bx2))::BIGINT AS back_x, least(w - greatest(0, floor(3 * bx2)), greatest(2, ceil(10 * bx2)))::BIGINT AS back_width FROM u""")
def rescaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and points on images of other sizes, probes, and sizes for recognition."""
    w, h = F.col("w"), F.col("h")
    rows = images(spark, sf_dir).withColumns({"o": g.pixel_box(w, h, F.col("box")), "p": g.probe_size(w, h, 700)})
    by = F.lit(1.5), F.lit(0.7)
    rows = rows.withColumns({"s": g.rescaled_box(F.col("o"), *by, w, h), "t": g.rescaled_point(F.col("o"), *by, w, h), "r": g.recognised_size(w, h, 700, 1400), "b": g.bounds_to_source(w, h, F.col("p.width"), F.col("p.height"), boxes.box(*map(F.lit, (3, 3, 10, 10))))})
    return rows.select("image", "s.*", F.col("t.x").alias("px"), F.col("p.width").alias("probe_width"), F.col("r.width").alias("read_width"), F.col("b.x").alias("back_x"), F.col("b.width").alias("back_width"))
