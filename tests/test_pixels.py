"""Kernels against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from evidentia.operators import pixels as px

RND = np.random.default_rng(3)


def test_adaptive_threshold_and_morphology():
    gray = RND.integers(0, 256, (13, 17)).astype(np.uint8)
    got, white, sharp = px.adaptive_threshold(gray, 2, 5), px.erode(px.threshold(gray, 200)), px.sharpen(gray)
    for y in range(13):
        for x in range(17):
            near = gray[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3]
            assert got[y, x] == (255 if gray[y, x] > near.mean() - 5 else 0)
            close = gray[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
            assert white[y, x] == (255 if (close >= 200).any() else 0)
            at = lambda b, a: int(gray[min(max(b, 0), 12), min(max(a, 0), 16)])
            assert sharp[y, x] == min(255, max(0, 5 * at(y, x) - at(y - 1, x) - at(y + 1, x) - at(y, x - 1) - at(y, x + 1)))
    assert not px.dilate(gray).any()


def test_adaptive_contrast():
    gray = RND.integers(40, 90, (70, 100)).astype(np.uint8)
    got = px.adaptive_contrast(gray, 32)
    assert got.shape == gray.shape and got.std() > gray.std()
    assert (px.adaptive_contrast(np.full((5, 5), 7, np.uint8), clip=1000) == 7).all()
    one = px._tile_curve(np.array([[0, 0], [255, 255]], np.uint8), 1000)
    assert one[0] == 0 and one[255] == 255 and (np.diff(one) >= 0).all()


def test_bands_boxes_and_skew():
    assert px.dominant_band(np.array([5, 5, 0, 5, 5, 0, 5]), 5) == (0, 1) and px.dominant_band(np.array([1]), 2) is None
    mask = np.zeros((8, 9), bool)
    mask[0, 0] = mask[1, 1] = mask[2, 2] = mask[5:8, 6] = mask[7, 8] = True
    assert px.component_boxes(mask).tolist() == [[0, 0, 3, 3, 3], [6, 5, 1, 3, 3], [8, 7, 1, 1, 1]]
    page = np.full((120, 200), 255, np.uint8)
    page[20:100:16] = 0
    assert px.deskew_angle(page) == 0 and px.deskew_angle(px.rotated(page, 4)) == -4
    flat = px.warp(page, [(10, 10), (189, 10), (189, 99), (10, 99)], 90, 45)
    assert flat.shape == (45, 90) and flat[0, 0] == page[10, 10] and px.scaled(page, 0.5).shape == (60, 100)


def test_batches(spark):
    raw = bytes(range(12))
    rows = spark.createDataFrame([(1, 2, 2, raw), (2, 2, 2, raw[:5]), (3, None, 2, None)], "image int, width int, height int, pixels binary")
    got = {r.image: r for r in px.apply(rows, lambda rgb: int(px.luminance(rgb).sum()), "light long").collect()}
    assert got[1].light == sum(int(a * 0.299 + b * 0.587 + c * 0.114 + 0.5) for a, b, c in zip(raw[::3], raw[1::3], raw[2::3])) and got[1].error is None
    assert got[2].light is None and "ValueError" in got[2].error and got[3].error
    ppm = spark.createDataFrame([("a", b"P6 2 2\n255\n" + raw), ("b", b"GIF")], "path string, content binary")
    assert [(r.image, r.width, r.height, bytes(r.pixels)) for r in px.read_ppm(ppm).collect()] == [("a", 2, 2, raw)]
    for name, kernel in px.PROFILES.items():
        assert kernel(np.frombuffer(raw, np.uint8).reshape(2, 2, 3)).shape == (2, 2), name
    assert rows.where(F.lit(False)).count() == 0
