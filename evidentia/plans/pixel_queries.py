"""Queries of pixel kernels, over small images that arithmetic makes of suppliers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import pixels as px
from evidentia.plans.base import query, table

_W, _H = 24, 16
_R, _G, _B = "(k * 31 + x * 7 + y * 13 + x * y) % 256", "(k * 17 + x * 11 + y * 5) % 256", "(k * 3 + x * 29 + y * 3) % 256"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, width, height and RGB bytes."""
    byte = lambda sql: f"substring(hex(CAST({sql} AS INT) + 256), 2, 2)"
    pixel = " || ".join(byte(sql) for sql in (_R, _G, _B))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image"), F.col("s_suppkey").alias("k"))
    line = f"array_join(transform(sequence(0, {_H} - 1), y -> array_join(transform(sequence(0, {_W} - 1), x -> {pixel}), '')), '')"
    return rows.select("image", F.lit(_W).alias("width"), F.lit(_H).alias("height"), F.unhex(F.expr(line)).alias("pixels"))


_GRID = f"""g AS (SELECT k, x, y, {_R} AS r, {_G} AS g, {_B} AS b FROM (SELECT s_suppkey AS k FROM supplier), range({_W}) a(x), range({_H}) c(y)), l AS (SELECT *, floor(r * 0.299e0 + g * 0.587e0 + b * 0.114e0 + 0.5)::INT AS v,
  ((r > g + 28 AND r > b + 28) OR (b > r + 18 AND b > g + 18)) AND greatest(r, g, b) - least(r, g, b) >= 24 AS ink FROM g)"""


def _thresholds(rgb: np.ndarray) -> tuple:
    gray = px.luminance(rgb)
    whole, near = px.threshold(gray, 128), px.adaptive_threshold(gray, 3, 8)
    clean = px.without_ink(rgb)
    return int((whole == 255).sum()), int((near == 255).sum()), int((clean != rgb).any(axis=-1).sum()), int(gray.sum()), int(px.erode(px.threshold(gray, 240)).sum()) // 255


@query(f"""WITH {_GRID}, m AS (SELECT a.k, a.x, a.y, any_value(a.v) AS v, avg(n.v) AS mean, max(CASE WHEN abs(n.x - a.x) <= 1 AND abs(n.y - a.y) <= 1 AND n.v >= 240 THEN 1 ELSE 0 END) AS grown FROM l a JOIN l n ON n.k = a.k AND abs(n.x - a.x) <= 3 AND abs(n.y - a.y) <= 3 GROUP BY ALL),
t AS (SELECT k, sum((v >= 128)::INT)::BIGINT AS white, sum((v > mean - 8)::INT)::BIGINT AS adaptive, sum(v)::BIGINT AS light, sum(grown)::BIGINT AS grown FROM m GROUP BY k), i AS (SELECT k, sum((ink AND (r < 255 OR g < 255 OR b < 255))::INT)::BIGINT AS ink FROM l GROUP BY k)
SELECT k AS image, white, adaptive, ink, light, grown FROM t JOIN i USING (k)""")
def pixel_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White pixels by a global and by an adaptive threshold, coloured ink, luminance, and white grown by erosion."""
    return px.apply(images(spark, sf_dir), _thresholds, "white long, adaptive long, ink long, light long, grown long").drop("error")


def _projections(rgb: np.ndarray) -> tuple:
    gray = px.luminance(rgb)
    band = px.dominant_band((gray < 128).sum(axis=1), 12) or (-1, -1)
    present, score, dark, edges, rows, columns = px.signature(gray)
    return round(px.projection_score(gray), 6), *band, present, dark, edges, rows, columns


@query(f"""WITH {_GRID}, rows_ AS (SELECT k, y, sum((v < 180)::INT) AS dark, sum((v < 128)::INT) AS black, sum((v < 208)::INT) AS ink FROM l GROUP BY ALL), cols AS (SELECT k, x, sum((v < 208)::INT) AS ink FROM l GROUP BY ALL),
runs AS (SELECT k, min(y) AS s, max(y) AS e FROM (SELECT k, y, y - row_number() OVER (PARTITION BY k ORDER BY y) AS run FROM rows_ WHERE black >= 12) GROUP BY k, run), band AS (SELECT DISTINCT ON (k) k, s, e FROM runs ORDER BY k, e - s DESC, s),
edge AS (SELECT a.k, count(*) AS n FROM l a JOIN l b ON b.k = a.k AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) WHERE abs(a.v - b.v) >= 28 AND (a.v < 228 OR b.v < 228) GROUP BY 1),
f AS (SELECT r.k, var_pop(dark) AS score, sum(ink) / {_W * _H} AS dark, avg((ink >= 4)::INT) AS rws FROM rows_ r GROUP BY 1), c AS (SELECT k, avg((ink >= 4)::INT) AS cls FROM cols GROUP BY 1)
SELECT f.k AS image, round(score, 6) AS projection, coalesce(s, -1) AS band_start, coalesce(e, -1) AS band_end, dark >= 0.003 AND coalesce(n, 0) / {2 * _W * _H} >= 0.0015 AND rws >= 0.015 AND cls >= 0.015 AND dark * 10 + coalesce(n, 0) / {2 * _W * _H} * 8 + rws * 0.75 + cls * 0.75 >= 0.115 AS present,
  dark, coalesce(n, 0) / {2 * _W * _H} AS edges, rws AS row_share, cls AS column_share FROM f JOIN c USING (k) LEFT JOIN band USING (k) LEFT JOIN edge USING (k)""")
def pixel_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of dark rows, the longest dark band, and what tells a signature."""
    schema = "projection double, band_start long, band_end long, present boolean, dark double, edges double, row_share double, column_share double"
    return px.apply(images(spark, sf_dir), _projections, schema).drop("error")
