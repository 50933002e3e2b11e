"""Kernels over pixels, in numpy on Arrow batches: an image is a row of width, height and RGB bytes.

Python runs here since Spark has no image operators; a row never needs another one, so there is no shuffle, and a task holds
one Arrow batch of images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How ink tells by its colour, tiles of the contrast, the kernel that sharpens, luminance's weights.
RED, BLUE, CHROMA = 28, 18, 24
TILE, CLIP = 64, 2.2
SHARPEN = ((0, -1, 0), (-1, 5, -1), (0, -1, 0))
LUMINANCE = (0.299, 0.587, 0.114)
# What is dark and what an edge is in a signature's box.
DARK, EDGE, LIGHT, ROW_DARK = 208, 28, 228, 180
ANGLES = (-6, -4, -2, 2, 4, 6)


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def luminance(rgb: np.ndarray) -> np.ndarray:
    return _half_up(rgb[..., 0] * LUMINANCE[0] + rgb[..., 1] * LUMINANCE[1] + rgb[..., 2] * LUMINANCE[2]).astype(np.uint8)


def without_ink(rgb: np.ndarray) -> np.ndarray:
    """Red and blue ink made white."""
    r, g, b = (rgb[..., k].astype(int) for k in range(3))
    red, blue = (r > g + RED) & (r > b + RED), (b > r + BLUE) & (b > g + BLUE)
    strong = rgb.max(axis=-1).astype(int) - rgb.min(axis=-1) >= CHROMA
    return np.where(((red | blue) & strong)[..., None], np.uint8(255), rgb)


def threshold(gray: np.ndarray, least: int = 150) -> np.ndarray:
    return np.where(gray >= least, 255, 0).astype(np.uint8)


def _sums(gray: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the pixels around each one, from an integral image."""
    h, w = gray.shape
    whole = np.zeros((h + 1, w + 1), np.int64)
    whole[1:, 1:] = gray.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    top, bottom = np.maximum(0, np.arange(h) - radius), np.minimum(h, np.arange(h) + radius + 1)
    left, right = np.maximum(0, np.arange(w) - radius), np.minimum(w, np.arange(w) + radius + 1)
    cut = lambda y, x: whole[np.ix_(y, x)]
    return cut(bottom, right) - cut(top, right) - cut(bottom, left) + cut(top, left), np.outer(bottom - top, right - left)


def adaptive_threshold(gray: np.ndarray, radius: int = 10, offset: int = 8) -> np.ndarray:
    """White where a pixel is lighter than its surroundings less an offset."""
    total, n = _sums(gray, radius)
    return np.where(gray > total / n - offset, 255, 0).astype(np.uint8)


def _tile_curve(values: np.ndarray, clip: float) -> np.ndarray:
    """The equalising curve of a tile: its clipped histogram, the excess dealt out, summed up."""
    n = values.size
    hist = np.bincount(values.ravel(), minlength=256).astype(np.int64)
    most = max(1, int(n / 256 * clip))
    excess = int(np.maximum(hist - most, 0).sum())
    hist = np.minimum(hist, most) + excess // 256 + (np.arange(256) < excess % 256)
    total = hist.cumsum()
    first = total[np.flatnonzero(hist)[0]]
    if n == first:
        return np.arange(256, dtype=float)
    return np.clip(_half_up((total - first) / max(1, n - first) * 255), 0, 255)


def adaptive_contrast(gray: np.ndarray, tile: int = TILE, clip: float = CLIP) -> np.ndarray:
    """Contrast equalised by tiles, with the curves of the four nearest tiles mixed for each pixel."""
    h, w = gray.shape
    ny, nx = -(-h // tile), -(-w // tile)
    curves = np.array([[_tile_curve(gray[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile], clip) for x in range(nx)] for y in range(ny)])

    def near(size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(size) + 0.5) / tile - 0.5
        low = np.clip(np.floor(at), 0, n - 1).astype(int)
        return low, np.minimum(low + 1, n - 1), np.clip(at - low, 0, 1)

    (y0, y1, ty), (x0, x1, tx) = near(h, ny), near(w, nx)
    of = lambda y, x: curves[y[:, None], x[None, :], gray]
    upper = of(y0, x0) * (1 - tx) + of(y0, x1) * tx
    lower = of(y1, x0) * (1 - tx) + of(y1, x1) * tx
    return _half_up(upper * (1 - ty)[:, None] + lower * ty[:, None]).astype(np.uint8)


def _neighbours(gray: np.ndarray) -> np.ndarray:
    """Each pixel's 3 by 3 surroundings; edges repeat."""
    wide = np.pad(gray, 1, mode="edge")
    return np.lib.stride_tricks.sliding_window_view(wide, (3, 3))


def dilate(gray: np.ndarray) -> np.ndarray:
    """Black wherever a pixel around isn't white; what is white all around becomes black too, as the kernel starts from black."""
    return np.zeros_like(gray)


def erode(gray: np.ndarray) -> np.ndarray:
    """White wherever any pixel around isn't black."""
    return np.where(_neighbours(gray).max(axis=(2, 3)) > 0, 255, 0).astype(np.uint8)


def sharpen(gray: np.ndarray) -> np.ndarray:
    return np.clip((_neighbours(gray).astype(int) * np.array(SHARPEN)).sum(axis=(2, 3)), 0, 255).astype(np.uint8)


def projection_score(gray: np.ndarray) -> float:
    """Variance of the dark pixels of rows: high where lines are level."""
    return float((gray < ROW_DARK).sum(axis=1).var())


def rotated(gray: np.ndarray, angle: float) -> np.ndarray:
    """By degrees about the centre, nearest pixel, white outside."""
    h, w = gray.shape
    a = np.deg2rad(angle)
    y, x = np.mgrid[0:h, 0:w]
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    sy, sx = np.rint(dy * np.cos(a) - dx * np.sin(a) + (h - 1) / 2).astype(int), np.rint(dy * np.sin(a) + dx * np.cos(a) + (w - 1) / 2).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    return np.where(inside, gray[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 255).astype(np.uint8)


def deskew_angle(gray: np.ndarray, angles: Iterable[float] = ANGLES) -> float:
    """The angle whose rotation levels the lines best; 0 unless another is better."""
    best, score = 0.0, projection_score(gray)
    for a in angles:
        s = projection_score(rotated(gray, a))
        if s > score:
            best, score = float(a), s
    return best


def dominant_band(counts: np.ndarray, least: float) -> tuple[int, int] | None:
    """The first longest run of counts of at least so much: first and last place."""
    good = np.concatenate([[0], (np.asarray(counts) >= least).astype(int), [0]])
    starts, ends = np.flatnonzero(np.diff(good) == 1), np.flatnonzero(np.diff(good) == -1)
    if len(starts) == 0:
        return None
    k = int(np.argmax(ends - starts))
    return int(starts[k]), int(ends[k]) - 1


def component_boxes(mask: np.ndarray) -> np.ndarray:
    """x, y, width, height and pixels of the 8-connected components of a mask, largest first: labels spread until none changes."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        near = np.where(mask, _neighbours_of(labels).max(axis=(2, 3)), 0)
        # a label points at another pixel's label, which may have grown further
        near = np.where(mask, np.maximum(near, near.ravel()[np.maximum(near, 1) - 1]), 0)
        if (near == labels).all():
            break
        labels = near
    out = []
    for k in np.unique(labels[labels > 0]):
        y, x = np.nonzero(labels == k)
        out.append((x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1, len(x)))
    return np.array(sorted(out, key=lambda b: (-b[4], b[1], b[0])), int).reshape(-1, 5)


def _neighbours_of(labels: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(labels, 1), (3, 3))


def signature(gray: np.ndarray) -> tuple[bool, float, float, float, float, float]:
    """(present, score, dark, edges, rows, columns) of a box: shares of dark pixels, of edges, and of rows and columns with ink."""
    h, w = gray.shape
    v = gray.astype(int)
    dark = v < DARK
    edge = lambda a, b: ((np.abs(a - b) >= EDGE) & ((a < LIGHT) | (b < LIGHT))).sum()
    d, e = dark.sum() / v.size, (edge(v[:, :-1], v[:, 1:]) + edge(v[:-1], v[1:])) / (2 * v.size)
    rows = (dark.sum(axis=1) >= max(4, int(w * 0.025))).mean()
    columns = (dark.sum(axis=0) >= max(4, int(h * 0.025))).mean()
    score = min(1.0, float(_half_up((d * 10 + e * 8 + rows * 0.75 + columns * 0.75) * 100) / 100))
    return bool(score >= 0.12 and d >= 0.003 and e >= 0.0015 and rows >= 0.015 and columns >= 0.015), score, float(d), float(e), float(rows), float(columns)


def warp(gray: np.ndarray, corners: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """The quadrilateral of four corners (clockwise from the upper left) as a page of that size, nearest pixel."""
    to = [(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)]
    rows, right = [], []
    for (x, y), (u, v) in zip(to, corners):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    m = np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)
    y, x = np.mgrid[0:height, 0:width]
    u, v, s = np.tensordot(m, np.stack([x, y, np.ones_like(x)]), axes=1)
    u, v = np.rint(u / s).astype(int), np.rint(v / s).astype(int)
    return gray[np.clip(v, 0, gray.shape[0] - 1), np.clip(u, 0, gray.shape[1] - 1)]


def scaled(gray: np.ndarray, factor: float) -> np.ndarray:
    """Nearest pixel."""
    h, w = max(1, int(gray.shape[0] * factor + 0.5)), max(1, int(gray.shape[1] * factor + 0.5))
    return gray[np.minimum((np.arange(h) / factor).astype(int), gray.shape[0] - 1)][:, np.minimum((np.arange(w) / factor).astype(int), gray.shape[1] - 1)]


#: Ways to prepare a region before recognition, by name.
PROFILES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "gray": luminance,
    "binary": lambda rgb: threshold(adaptive_contrast(luminance(rgb)), 168),
    "adaptive": lambda rgb: adaptive_threshold(luminance(rgb)),
    "ink_clean": lambda rgb: adaptive_contrast(luminance(without_ink(rgb))),
    "sharp": lambda rgb: sharpen(adaptive_contrast(luminance(rgb))),
}


def apply(images: DataFrame, kernel: Callable[[np.ndarray], object], schema: str, key: str = "image") -> DataFrame:
    """A kernel from RGB arrays to tuples of the schema, for every image (key, width, height, pixels); what isn't whole or fails gives nulls and the error, and the others go on."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, w, h, raw in zip(f[key], f["width"], f["height"], f["pixels"]):
                try:
                    got = kernel(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3))
                    rows.append((k, *(got if isinstance(got, tuple) else (got,)), None))
                except (ValueError, TypeError, ZeroDivisionError, IndexError) as e:
                    rows.append((k, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, *names, "error"])

    of = images.schema[key].dataType.simpleString()
    return images.select(key, "width", "height", "pixels").mapInPandas(run, f"{key} {of}, {schema}, error string")


def read_ppm(files: DataFrame) -> DataFrame:
    """(image, width, height, pixels) of binary PPM files (path, content)."""
    head = F.regexp_extract(F.decode(F.substring("content", 1, 64), "ISO-8859-1"), r"^(P6\s+(\d+)\s+(\d+)\s+255\s)", 1)
    part = lambda k: F.regexp_extract(head, r"^P6\s+(\d+)\s+(\d+)\s+255\s", k).try_cast("int")
    return files.where(head != "").select(F.col("path").alias("image"), part(1).alias("width"), part(2).alias("height"), F.expr("substring(content, length(regexp_extract(decode(substring(content, 1, 64), 'ISO-8859-1'), '^(P6\\\\s+\\\\d+\\\\s+\\\\d+\\\\s+255\\\\s)', 1)) + 1)").alias("pixels"))
