"""Images cut into bands against the whole, and the sinks and batches of images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from limber.functions import pixels
from limber.operators import detect
from limber.sources import bands
from limber.sources import images as imgs

IMAGES = "path string, height int, width int, n_channels int, data binary"
SHAPES = [(40, 60), (41, 9), (7, 30), (64, 64), (1, 1), (90, 33), (23, 200)]


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(6)
    smooth = lambda h, w: (np.add.outer(np.sin(np.arange(h) / 5), np.cos(np.arange(w) / 7)) * 50 + 120)[:, :, None] + rng.normal(0, 6, (h, w, 3))
    return {f"p{i}": np.clip(smooth(h, w), 0, 255).astype(np.uint8) for i, (h, w) in enumerate(SHAPES)}


@pytest.fixture(scope="module")
def frame(spark, pictures):
    rows = [(k, *x.shape, x.tobytes()) for k, x in pictures.items()] + [("none", None, None, None, None), ("empty", 0, 0, 3, b"")]
    return spark.createDataFrame(rows, IMAGES).repartition(3)


def whole(df):
    return {r["path"]: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3) for r in df.collect()}


def equal(got, want):
    assert set(got) == set(want)
    for k in want:
        assert np.array_equal(got[k], want[k]), k


@pytest.mark.parametrize("rows", [5, 16, 1000])
def test_bands_equal_the_whole(spark, pictures, frame, rows):
    assert bands.bands_of(frame, rows).count() == sum(-(-h // rows) for h, _ in SHAPES)
    equal(whole(bands.joined(bands.denoise_bands(frame, rows))), {k: pixels.denoise(x) for k, x in pictures.items()})
    equal(whole(bands.joined(bands.enhance_bands(frame, rows))), {k: pixels.enhance_contrast(x) for k, x in pictures.items()})
    for w, h in ((31, 47), (5, 3), (100, 90)):
        equal(whole(bands.joined(bands.resize_bands(frame, F.lit(w), F.lit(h), rows))), {k: pixels.resize(x, w, h) for k, x in pictures.items()})


def test_preprocessing_by_bands(spark, pictures, frame):
    few = frame.where("path in ('p0', 'p1', 'p5')")
    want = {}
    for k in ("p0", "p1", "p5"):
        out = pixels.denoise(pixels.enhance_contrast(pictures[k]))
        h, w = out.shape[:2]
        s = 96 / min(h, w) if min(h, w) < 96 else 1.0
        want[k] = pixels.resize(out, int(w * s), int(h * s)) if s != 1.0 else out
    equal(whole(bands.preprocess_bands(few, min_side=96, rows=17)), want)
    assert bands.preprocess_bands(frame.limit(0)).count() == 0
    grey = spark.createDataFrame([(None, 4, 5, 1, bytes(range(20)))], IMAGES)
    assert whole(bands.joined(bands.resize_bands(grey, F.lit(5), F.lit(4))))[None].shape == (4, 5, 3)


def test_denoise_by_definition():
    """Patches and windows by loops."""
    rng = np.random.default_rng(2)
    x = rng.integers(90, 110, (7, 6, 3), dtype=np.uint8)
    r, s = 1, 2
    wide = np.pad(x.astype(float), ((r + s,) * 2, (r + s,) * 2, (0, 0)), mode="symmetric")
    want = np.zeros(x.shape)
    for y in range(7):
        for c in range(6):
            weights, total = 0.0, 0.0
            patch = wide[y + s : y + s + 3, c + s : c + s + 3]
            for dy in range(-s, s + 1):
                for dx in range(-s, s + 1):
                    other = wide[y + s + dy : y + s + dy + 3, c + s + dx : c + s + dx + 3]
                    k = np.exp(-((patch - other) ** 2).mean() / 9)
                    weights, total = weights + k, total + k * other[1, 1]
            want[y, c] = total / weights
    assert np.array_equal(pixels.denoise(x, 3.0, 3, 5), np.rint(want).astype(np.uint8))


def test_bitmaps_round_trip(spark, pictures, frame, tmp_path):
    named = frame.withColumn("path", F.concat(F.when(F.col("path") == "p1", "sub/").otherwise(""), "path", F.lit(".bmp")))
    assert imgs.write_images(named, f"file://{tmp_path}/out").count() == len(SHAPES)
    read = whole(imgs.scan_images(spark, f"{tmp_path}/out", recursive=True))
    equal({k.rpartition("/")[2][:-4]: x for k, x in read.items()}, pictures)


def test_crops_in_batches(spark, frame):
    class Many:
        def __call__(self, rgb):
            raise AssertionError("one by one")

        def many(self, crops):
            one = detect.brightness_detector()
            return [one(c) * (2 if c.shape[1] % 2 else 1) for c in crops]

    def each():
        one = detect.brightness_detector()
        return lambda rgb: one(rgb) * (2 if rgb.shape[1] % 2 else 1)

    tagged = frame.withColumn("tag", F.concat(F.lit("t"), "path"))
    columns = ["path", "tag", "det_idx", "person_id", "keypoints", "bbox", "overall_confidence"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    want = rows(detect.two_stage(tagged, detect.thirds_detector, each, carry=("tag",)))
    assert rows(detect.two_stage_batched(tagged, detect.thirds_detector, Many, carry=("tag",))) == want == rows(detect.two_stage_batched(tagged, detect.thirds_detector, each, carry=("tag",)))
    assert len(want) > 10 and detect.two_stage_batched(tagged.limit(0), detect.thirds_detector, each).count() == 0
