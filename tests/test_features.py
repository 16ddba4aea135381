"""Geometric and texture vectors against plain loops."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limber.functions import texture
from limber.operators import features

POSES = "i int, keypoints array<array<double>>, visibility array<double>"
JOINTS = [(5, 7, 9), (6, 8, 10), (7, 5, 11), (8, 6, 12), (5, 11, 13), (6, 12, 14), (11, 13, 15), (12, 14, 16)]
LIMBS = [(5, 7), (6, 8), (7, 9), (8, 10), (11, 13), (12, 14), (13, 15), (14, 16), (5, 6), (11, 12)]


def brute(points, seen):
    if points is None or seen is None or len(points) < 17:
        return None
    p = []
    for i in range(17):
        xy = points[i][:2] if points[i] is not None else []
        ok = len(xy) == 2 and all(c is not None and math.isfinite(c) for c in xy) and i < len(seen) and seen[i] is not None and seen[i] >= 0.3
        p.append(np.array(xy) if ok else None)
    middle = lambda a, b: np.mean([q for q in (p[a], p[b]) if q is not None], axis=0) if p[a] is not None or p[b] is not None else None
    hip, shoulder = middle(11, 12), middle(5, 6)
    if hip is None or shoulder is None or not np.linalg.norm(shoulder - hip) > 0:
        return None
    unit = np.linalg.norm(shoulder - hip)
    out = [c for q in p for c in ((q - hip) / unit if q is not None else (0.0, 0.0))]
    for a, b, c in JOINTS:
        if any(p[x] is None for x in (a, b, c)) or not np.linalg.norm(p[a] - p[b]) * np.linalg.norm(p[c] - p[b]):
            out.append(0.0)
        else:
            u, v = p[a] - p[b], p[c] - p[b]
            out.append(math.acos(np.clip(u @ v / (np.linalg.norm(u) * np.linalg.norm(v)), -1, 1)) / math.pi)
    return out + [np.linalg.norm(p[a] - p[b]) / unit if p[a] is not None and p[b] is not None else 0.0 for a, b in LIMBS]


def vectors(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], POSES).withColumn("geometric", F.lit("old"))
    return [r["geometric"] for r in features.geometric_features(df).orderBy("i").collect()]


def agree(got, want):
    assert (got is None) == (want is None)
    if want is not None:
        assert len(got) == features.GEOMETRIC_DIM and np.allclose(got, want, atol=1e-7)


def test_geometry(spark):
    rng = np.random.default_rng(3)
    pose = lambda k=17, extra=0: rng.uniform(0, 100, (k, 2 + extra)).tolist()
    full = [1.0] * 17
    rows = [(pose(), full) for _ in range(4)] + [(pose(), rng.random(17).tolist()) for _ in range(30)]
    rows += [(pose(133, 1), [1.0] * 133), (pose(16), full), (None, full), (pose(), None), (pose(), []), (pose(), [None] * 17), ([], []), ([None] * 17, full)]
    for change in ([float("nan"), 1.0], [None, 1.0], [float("inf"), 1.0], [1.0], []):
        p = pose()
        p[7] = change
        rows.append((p, full))
    one_side, none, same = [1.0] * 17, [1.0] * 17, pose()
    one_side[6] = one_side[12] = 0.0
    none[11] = none[12] = 0.0
    for i in (5, 6, 11, 12):
        same[i] = [3.0, 4.0]
    folded = pose()
    folded[9] = folded[7] = folded[5]
    rows += [(pose(), one_side), (pose(), none), (same, full), (folded, full), (pose(), [0.3] * 17), (pose(), [0.29999] * 17), (pose(), [float("nan")] * 17)]
    for got, (points, seen) in zip(vectors(spark, rows), rows, strict=True):
        agree(got, brute(points, [None if v is not None and v != v else v for v in seen] if seen is not None else None))
    assert vectors(spark, []) == []


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 50), st.floats(0, 50)), min_size=17, max_size=17), st.floats(-500, 500), st.floats(-500, 500), st.floats(0.25, 8))
def test_geometry_does_not_depend_on_place_or_size(spark, points, dx, dy, scale):
    moved = [[x * scale + dx, y * scale + dy] for x, y in points]
    a, b = vectors(spark, [([list(p) for p in points], [1.0] * 17), (moved, [1.0] * 17)])
    torso = math.dist(*[np.mean([points[i], points[j]], axis=0) for i, j in ((5, 6), (11, 12))])
    if torso > 0.1:
        longest = [max(math.dist(points[x], points[y]) for x, y in ((j[0], j[1]), (j[2], j[1]))) for j in JOINTS]
        shortest = [min(math.dist(points[x], points[y]) for x, y in ((j[0], j[1]), (j[2], j[1]))) for j in JOINTS]
        for i, (u, v) in enumerate(zip(a, b, strict=True)):
            if not 34 <= i < 42 or shortest[i - 34] > 0.1 and longest[i - 34] > 0:
                assert math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-4)


def histograms(rgb):
    """The same by loops."""
    h, w = rgb.shape[:2]
    grey = [[0.299 * float(p[0]) + 0.587 * float(p[1]) + 0.114 * float(p[2]) for p in row] for row in rgb]
    at = lambda y, x: grey[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]
    cells, pixels = np.zeros((8, 8, 9)), np.zeros((8, 8))
    for y in range(h):
        for x in range(w):
            gx, gy = (at(y, x + 1) - at(y, x - 1)) / 2, (at(y + 1, x) - at(y - 1, x)) / 2
            place = math.atan2(gy, gx) % math.pi / (math.pi / 9) - 0.5
            low, length = math.floor(place), math.hypot(gx, gy)
            cells[y * 8 // h, x * 8 // w, low % 9] += length * (1 - (place - low))
            cells[y * 8 // h, x * 8 // w, (low + 1) % 9] += length * (place - low)
            pixels[y * 8 // h, x * 8 // w] += 1
    cells /= np.maximum(pixels, 1)[:, :, None]
    out = np.zeros((8, 8, 9))
    for y in range(8):
        for x in range(8):
            blocks = [(a, b) for a in (y - 1, y) for b in (x - 1, x) if 0 <= a < 7 and 0 <= b < 7]
            for a, b in blocks:
                out[y, x] += np.minimum(cells[y, x] / math.sqrt((cells[a : a + 2, b : b + 2] ** 2).sum() + 1e-6), 0.2) / len(blocks)
    return (out / np.linalg.norm(out)).ravel() if out.any() else out.ravel()


@pytest.mark.parametrize("shape", [(8, 8), (16, 24), (5, 3), (1, 1), (33, 70)])
def test_texture(shape):
    rng = np.random.default_rng(sum(shape))
    x = rng.integers(0, 256, (*shape, 3), dtype=np.uint8)
    got = texture.gradient_histograms(x)
    assert got.shape == (features.VISUAL_DIM,) and np.allclose(got, histograms(x), atol=1e-9)
    assert not got.any() or math.isclose(np.linalg.norm(got), 1)
    assert not texture.gradient_histograms(np.full((*shape, 3), 7, dtype=np.uint8)).any()
    assert np.allclose(texture.gradient_histograms(np.repeat(np.repeat(x[:8, :8], 2, 0), 2, 1) // 2), texture.gradient_histograms(np.repeat(np.repeat(x[:8, :8], 2, 0), 2, 1)), atol=0.2)


def test_texture_of_images(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (9, 12, 3), dtype=np.uint8)
    df = spark.createDataFrame([("a", 9, 12, 3, x.tobytes()), ("a", 9, 12, 3, x.tobytes()), (None, 9, 12, 1, x[:, :, 0].tobytes()), ("none", None, None, None, None)], "path string, height int, width int, n_channels int, data binary")
    got = features.visual_features(df.withColumn("visual", F.lit(1)), ("path", "height")).collect()
    by = {r["path"]: r["visual"] for r in got}
    assert len(got) == 4 and by["none"] is None and np.allclose(by["a"], histograms(x[:, :, ::-1]), atol=1e-6) and len(by[None]) == 576
    assert features.visual_features(df.limit(0)).count() == 0


def test_fused(spark):
    df = spark.createDataFrame([([1.0] * 52, [0.5] * 576), (None, [0.5] * 576), ([1.0] * 52, None)], "geometric array<double>, visual array<float>")
    assert [r["fused"] and len(r["fused"]) for r in features.fused_features(df).collect()] == [628, None, None]
