"""Rules of the pose operators against plain numpy, and their edge cases."""

import math
from functools import partial

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limber.functions import pixels, vectors
from limber.operators import bench, boxes, detect, ensemble, index, knn
from limber.sources import images as imgs
from limber.sources import store
from limber.streaming import append_features


def pose_rows(seed=3, k=7):
    rng = np.random.default_rng(seed)
    rows = []
    for image in range(6):
        for model in range(2):
            if image == 4 or (image == 5 and model == 0):  # an image without poses, one without model 0
                continue
            for det in range(2):
                vis = rng.random(k)
                vis[0] = 0.0
                rows.append((image, model, None if model == 0 else 1.2, det, rng.random((k, 2)).tolist(), vis.tolist(), rng.random(4).tolist(), float(rng.random()), image * 10 + model))
    return rows


SCHEMA = "image_id int, model_idx int, weight double, det_idx int, keypoints array<array<double>>, visibility array<double>, bbox array<double>, overall_confidence double, person_id int"


@pytest.mark.parametrize("method", ["weighted_average", "confidence_weighted"])
def test_ensemble_matches_the_formula(spark, method):
    rows = pose_rows()
    got = {r["image_id"]: r for r in ensemble.fuse_poses(spark.createDataFrame(rows[::-1], SCHEMA), method).collect()}
    assert sorted(got) == [0, 1, 2, 3, 5]
    for image, r in got.items():
        use = [x for x in rows if x[0] == image and x[3] == 0]
        w = np.array([x[2] or 1.0 for x in use])
        kp, vis = np.array([x[4] for x in use]), np.array([x[5] for x in use])
        if method == "weighted_average":
            k, v, c = np.einsum("mkc,m->kc", kp, w / w.sum()), vis.T @ w / w.sum(), np.mean([x[7] for x in use])
        else:
            wv = vis * w[:, None]
            k, v = np.einsum("mkc,mk->kc", kp, wv) / (wv.sum(0)[:, None] + 1e-6), wv.sum(0) / w.sum()
            c = v.mean()
        assert np.allclose(r["keypoints"], k) and np.allclose(r["visibility"], v) and math.isclose(r["overall_confidence"], c)
        assert r["bbox"] == use[0][6] and r["person_id"] == use[0][8]


def test_ensemble_edges(spark):
    with pytest.raises(ValueError):
        ensemble.fuse_poses(spark.createDataFrame([], SCHEMA), "median")
    assert ensemble.fuse_poses(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = pose_rows()
    odd = [(*rows[0][:4], rows[0][4][:-1], rows[0][5][:-1], *rows[0][6:]), rows[2]]
    with pytest.raises(Exception, match="keypoints"):
        ensemble.fuse_poses(spark.createDataFrame(odd, SCHEMA)).collect()


def test_ensemble_fuses_all_coordinates(spark):
    rows = [(1, m, w, 0, [[float(m), 2.0, 10.0 * m], [1.0, 1.0, 1.0]], [0.5, 0.5], [0.0] * 4, 0.5, m) for m, w in ((0, 1.0), (1, 3.0))]
    r = ensemble.fuse_poses(spark.createDataFrame(rows, SCHEMA), "weighted_average").head()
    assert r["keypoints"] == [[0.75, 2.0, 7.5], [1.0, 1.0, 1.0]]
    none = ensemble.fuse_poses(spark.createDataFrame([(*rows[0][:2], 0.0, *rows[0][3:])], SCHEMA), "weighted_average").head()
    assert none["keypoints"] == [[None] * 3] * 2 and none["visibility"] == [None] * 2
    assert ensemble.fuse_poses(spark.createDataFrame([(*rows[0][:2], 0.0, *rows[0][3:])], SCHEMA)).head()["keypoints"] == [[0.0] * 3] * 2


def test_boxes_keep_their_numbers(spark):
    df = spark.createDataFrame([(1, 0, 0.2, 0), (1, 1, 0.3, 0), (1, 2, 0.9, 1), (1, 3, 0.29999, 0), (1, 4, None, 0), (2, 0, 0.5, 0)], "image int, n int, conf double, cls int")
    kept = boxes.person_boxes(boxes.number_boxes(df, "image", "n")).collect()
    assert sorted((r["image"], r["box_idx"]) for r in kept) == [(1, 1), (2, 0)]


def reference_crop(x1, y1, x2, y2, w, h):
    px, py = (x2 - x1) * 0.1, (y2 - y1) * 0.1
    return int(max(0, x1 - px)), int(max(0, y1 - py)), int(min(w, x2 + px)), int(min(h, y2 + py))


def test_crop_bounds(spark):
    cases = [(10.5, 20.2, 50.9, 90.1), (-5.0, -5.0, 30.0, 30.0), (400.0, 300.0, 500.0, 330.0), (0.0, 0.0, 0.0, 0.0), (600.0, 10.0, 700.0, 20.0)]
    df = spark.createDataFrame([(*c, 480, 320) for c in cases], "x1 double, y1 double, x2 double, y2 double, w int, h int")
    got = [tuple(r) for r in df.select(*boxes.crop_bounds(*map(F.col, ("x1", "y1", "x2", "y2", "w", "h")))).collect()]
    assert got == [reference_crop(*c, 480, 320) for c in cases]
    odd = spark.createDataFrame([(None, 1.0, 2.0, 3.0, 480, 320), (float("nan"), 1.0, 2.0, 3.0, 480, 320)], df.schema)
    null, nan = odd.select(*boxes.crop_bounds(*map(F.col, ("x1", "y1", "x2", "y2", "w", "h")))).collect()
    assert tuple(null) == (None,) * 4 and nan["x1_pad"] == 0 and nan["x2_pad"] == 480


def test_map_back_inverts_the_crop(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 9.0], [3.0, 4.0, 8.0]], [5.0, 6.0, 7.0, 8.0], 10, 20, 3)], "keypoints array<array<double>>, bbox array<double>, x_offset int, y_offset int, box_idx int")
    r = boxes.map_back(df).head()
    assert r["keypoints"] == [[11.0, 22.0, 9.0], [13.0, 24.0, 8.0]] and r["bbox"] == [15.0, 26.0, 7.0, 8.0] and r["person_id"] == 3


def test_upsample_dims_truncate(spark):
    df = spark.range(1, 700).select(F.col("id").cast("int").alias("h"), F.lit(900).alias("w"))
    got = {r["h"]: (r["new_w"], r["new_h"]) for r in df.select("h", *boxes.upsample_dims(F.col("w"), F.col("h"))).collect()}
    for h, x in got.items():
        s = 512 / h if h < 512 else 1.0
        assert x == (int(900 * s), int(h * s))
    assert sum(x[1] == 511 and h != 511 for h, x in got.items()) == 35


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.floats(-5, 5, width=32), min_size=4, max_size=4), min_size=1, max_size=12), st.integers(1, 6), st.sampled_from(["cosine", "dot", "l2"]))
def test_knn_matches_brute_force(spark, rows, k, metric):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "pose_id long, feature_vector array<float>")
    q = rows[0]

    def score(v):
        if metric == "dot":
            return sum(a * b for a, b in zip(q, v, strict=True))
        if metric == "l2":
            return -math.dist(q, v)
        n = math.hypot(*q) * math.hypot(*v)
        return sum(a * b for a, b in zip(q, v, strict=True)) / n if n else None

    expected = sorted((-s for v in rows if (s := score(v)) is not None))[:k]
    got = knn.search_similar(df, q, k, metric).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(expected) + 1))
    assert np.allclose([r["similarity_score"] * (1 if metric == "l2" else -1) for r in got], expected, atol=1e-6)


def test_knn_batch_equals_single(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x[150] = x[3]  # a tie
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "pose_id long, feature_vector array<float>")
    for metric in ("cosine", "dot", "l2"):
        batch = knn.search_similar_batch(df, df.where("pose_id < 20").withColumnRenamed("pose_id", "query_id"), 4, metric).collect()
        for i in (0, 3, 19):
            single = knn.search_similar(df, x[i].tolist(), 4, metric).orderBy("rank").collect()
            mine = sorted((r["rank"], r["pose_id"]) for r in batch if r["query_id"] == i)
            assert mine == [(r["rank"], r["pose_id"]) for r in single]


def test_knn_batch_with_repeated_and_string_ids(spark):
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.9, 0.1]), (None, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "pose_id string, feature_vector array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("q", [1.0, 0.0]), (None, [1.0, 0.0]), ("z", [0.0, 0.0]), ("r", [0.0, 2.0])], "query_id string, feature_vector array<float>")
    got = knn.search_similar_batch(df, asked, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["pose_id"]) for r in got] == [("q", 1, "a"), ("q", 2, "a"), ("r", 1, "b"), ("r", 2, None)]
    assert knn.search_similar_batch(df, asked.limit(0), 2).count() == 0 and knn.search_similar_batch(df.limit(0), asked, 2).count() == 0
    with pytest.raises(ValueError, match="2 dimensions.*3"):
        knn.search_similar_batch(spark.createDataFrame([("a", [1.0, 2.0, 3.0])], df.schema), asked)


def test_knn_batch_in_a_grid(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 7)
    monkeypatch.setattr(knn, "CHUNK", 40)
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(300, 6)) + 1000).astype(np.float32)  # far from the origin, where a product form loses digits
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pose_id long, feature_vector array<float>")
    got = knn.search_similar_batch(df, df.where("pose_id < 25").withColumnRenamed("pose_id", "query_id"), 6, "l2").collect()
    for i in range(25):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(1))
        want = np.lexsort((np.arange(300), d))[:6]
        mine = sorted((r["rank"], r["pose_id"], r["similarity_score"]) for r in got if r["query_id"] == i)
        assert [m[1] for m in mine] == want.tolist() and np.allclose([m[2] for m in mine], d[want])


def test_score_mapping(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "pose_id long, feature_vector array<float>")
    got = knn.search_similar(df, [0.0, 0.0], 2, "l2", mapping="inverse", scale=5.0).orderBy("rank").collect()
    assert [r["similarity_score"] for r in got] == [1.0, 0.5]
    asked = df.where("pose_id = 1").withColumnRenamed("pose_id", "query_id")
    batch = knn.search_similar_batch(df, asked, 2, "l2", mapping="exponential", scale=5.0).orderBy("rank").collect()
    assert batch[0]["similarity_score"] == 1.0 and math.isclose(batch[1]["similarity_score"], math.exp(-1))
    with pytest.raises(ValueError):
        knn.search_similar(df, [1.0, 0.0], 2, "cosine", mapping="inverse")


def test_knn_refuses_other_dimensions(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "pose_id long, feature_vector array<float>")
    with pytest.raises(ValueError, match="3 dimensions.*2"):
        knn.search_similar(df, [1.0, 2.0, 3.0])
    assert knn.search_similar(df.limit(0), [1.0]).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0]), ([0.0, 0.0], None)], "g array<double>, v array<double>")
    a, b = df.select(vectors.l2_normalize(F.col("g")).alias("u"), vectors.fuse(F.col("g"), F.col("v")).alias("f"), vectors.cosine(F.col("g"), F.col("g")).alias("c")).collect()
    assert a["u"] == [0.6, 0.8] and a["f"] == [3.0, 4.0, 1.0] and a["c"] == 1.0
    assert b["u"] == [0.0, 0.0] and b["f"] is None and b["c"] is None
    r = spark.range(1).select(vectors.inverse_distance_score(F.lit(2.0), 2.0).alias("i"), vectors.exponential_score(F.lit(2.0), 2.0).alias("e")).head()
    assert r["i"] == 0.5 and math.isclose(r["e"], math.exp(-1))


def test_bench(spark):
    runs = spark.createDataFrame([("a", True, 0.5, 2.0), ("a", False, 0.9, 4.0), ("a", None, None, None), ("b", False, 0.1, 1.0)], "g string, detected boolean, confidence double, elapsed_s double")
    a, b = bench.bench_summary(runs, "g").orderBy("g").collect()
    assert (a["n_images"], a["n_detected"], a["avg_confidence"], a["avg_time_detected"]) == (3, 1, 0.5, 2.0) and math.isclose(a["avg_time"], 2 / 3)
    assert (b["n_detected"], b["avg_confidence"], b["avg_time"]) == (0, 0.0, 0.0)
    none = bench.bench_summary(runs.limit(0)).head()
    assert none["n_images"] == 0 and none["avg_time"] is None


def test_index_round_trip(spark, tmp_path):
    f = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "pose_id long, feature_vector array<float>")
    p = spark.createDataFrame([(1, 7, 0.5, "2025-01-02"), (2, 7, 0.6, "2025-01-01"), (3, 8, 0.7, "2025-01-01")], "id long, image_id long, overall_confidence double, created_at string")
    i = spark.createDataFrame([(7, "a.jpg")], "id long, file_path string")
    rows = index.index_rows(f, p, i)
    assert [r["pose_id"] for r in index.in_build_order(rows).collect()] == [2, 1]
    path = str(tmp_path / "index")
    assert index.index_stats(index.build_index(rows, path)).head() == (2, 2, 2)
    assert index.build_index(rows.limit(0), path).count() == 2
    reader = index.read_index(spark, path)
    assert index.build_index(rows.limit(1), path, force_rebuild=True).count() == 1
    assert reader.count() == 2  # what was read goes on being one whole version
    assert index.build_index(reader.unionByName(rows), path, force_rebuild=True).count() == 4  # also of itself
    assert sorted(index.read_index(spark, path, v).count() for v in (0, 1, 2)) == [1, 2, 4]
    with pytest.raises(ValueError):
        index.build_index(rows.unionByName(rows.withColumn("feature_vector", F.array(F.lit(1.0).cast("float")))), path, force_rebuild=True)
    assert index.read_index(spark, path).count() == 4
    assert len(index.clear_old_versions(spark, path)) == 2 and index.read_index(spark, path).count() == 4
    with pytest.raises(FileNotFoundError):
        index.read_index(spark, str(tmp_path / "none"))
    rows.write.parquet(str(tmp_path / "arrivals"))
    copy, ck = str(tmp_path / "copy"), str(tmp_path / "ck")
    for _ in range(2):
        append_features(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "arrivals")), copy, ck).awaitTermination()
        assert index.read_index(spark, copy).count() == 2
    assert index.append_index(rows, copy, (ck, 0)).count() == 2  # that batch is there
    rows.limit(1).write.mode("append").parquet(str(tmp_path / "arrivals"))
    append_features(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "arrivals")), copy, ck).awaitTermination()
    assert index.read_index(spark, copy).count() == 3
    with pytest.raises(ValueError):
        index.append_index(rows.withColumn("feature_vector", F.array(F.lit(1.0).cast("float"))), copy)
    index.clear_index(spark, path)
    assert not (tmp_path / "index").exists()


def test_index_edges(spark):
    f = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (None, [2.0]), (2, None), (3, [3.0])], "pose_id long, feature_vector array<float>")
    p = spark.createDataFrame([(1, 7, 0.5, None), (2, 7, None, None), (3, None, 0.1, None), (None, 7, 0.1, None)], "id long, image_id long, overall_confidence double, created_at string")
    i = spark.createDataFrame([(7, None), (None, "x.jpg")], "id long, file_path string")
    rows = index.index_rows(f, p, i)
    assert sorted((r["pose_id"], r["feature_vector"] is None) for r in rows.collect()) == [(1, False), (1, False), (2, True)]
    assert index.index_stats(rows).head() == (3, 1, 1)
    assert index.index_stats(rows.limit(0)).head() == (0, None, None) and index.in_build_order(rows.limit(0)).count() == 0
    assert knn.search_similar(rows, [1.0], 5).count() == 2


def test_box_edges(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 5, 0.9), (None, 1, 0.9), (None, 2, 0.9)], "image int, n int, conf double").withColumn("cls", F.lit(0))
    numbered = boxes.number_boxes(df, "image", "n").collect()
    assert sorted((r["image"] or 0, r["box_idx"]) for r in numbered) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert boxes.person_boxes(df.withColumn("cls", F.lit(None).cast("int"))).count() == 0 and boxes.number_boxes(df.limit(0), "image", "n").count() == 0
    poses = spark.createDataFrame([([[1.0]], [1.0, 2.0], 1, 1, None), (None, None, 1, 1, 2), ([], [1.0, 2.0, 3.0, 4.0], None, 1, 2)], "keypoints array<array<double>>, bbox array<double>, x_offset int, y_offset int, box_idx int")
    whole = boxes.map_back(poses.where("box_idx = 2")).orderBy(F.col("bbox").isNull()).collect()
    assert whole[0]["keypoints"] == [] and whole[0]["bbox"] == [None, 3.0, 3.0, 4.0] and whole[1]["keypoints"] is None and whole[1]["bbox"] is None


def test_detectors_on_repeated_and_missing_images(spark):
    grey = bytes([200]) * 27
    df = spark.createDataFrame([("a", 3, 3, 3, grey), ("a", 3, 3, 3, grey), (None, 3, 3, 3, grey), ("dark", 3, 3, 3, bytes(27))], IMAGES).withColumn("note", F.lit("n"))
    some = partial(detect.brightness_detector, 0.5)
    got = detect.detect(df, some, carry=("note",)).collect()
    assert sorted(str(r["path"]) for r in got) == ["None", "a", "a"] and {r["note"] for r in got} == {"n"} and all(r["elapsed_s"] >= 0 for r in got)
    fused = detect.detect(df, some, models=[some, detect.brightness_detector], carry=("note",)).collect()
    assert sorted(str(r["path"]) for r in fused) == ["None", "a", "dark"] and all(r["note"] == "n" for r in fused)
    assert detect.detect(df.limit(0), some, persons=detect.thirds_detector).count() == 0
    assert detect.detect_persons(df, detect.thirds_detector).where("path = 'dark'").count() == 3


def test_padded_box_agrees_with_the_columns(spark):
    rng = np.random.default_rng(4)
    cases = [tuple(map(float, c)) for c in rng.uniform(-50, 600, (40, 4))] + [(float("nan"), 1.0, 2.0, 3.0)]
    df = spark.createDataFrame([(i, *c, 480, 320) for i, c in enumerate(cases)], "i int, x1 double, y1 double, x2 double, y2 double, w int, h int")
    got = df.select("i", *boxes.crop_bounds(*map(F.col, ("x1", "y1", "x2", "y2", "w", "h")))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [detect.padded_box(dict(zip(("x1", "y1", "x2", "y2"), c, strict=True)), 480, 320) for c in cases]


def test_pixels():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (40, 60, 3), dtype=np.uint8)
    assert np.abs(pixels.from_lab(pixels.to_lab(x)).astype(int) - x).max() <= 1
    out, scale = pixels.preprocess(x[:20, :30], with_denoise=False)
    assert out.shape == (512, 768, 3) and scale == 25.6
    flat = np.full((30, 30, 3), 90, dtype=np.uint8)
    assert (pixels.denoise(flat) == 90).all() and (pixels.resize(flat, 47, 61) == 90).all()
    noisy = np.clip(flat + rng.normal(0, 3, flat.shape), 0, 255).astype(np.uint8)
    assert pixels.denoise(noisy).std() < noisy.std()
    same, one = pixels.upsample(np.zeros((512, 600, 3), dtype=np.uint8))
    assert same.shape == (512, 600, 3) and one == 1.0


IMAGES = "path string, height int, width int, n_channels int, data binary"


def test_detectors(spark):
    rng = np.random.default_rng(1)
    frames = [(f"p{i}", 60, 80, 3, rng.integers(0, 256, (60, 80, 3), dtype=np.uint8).tobytes()) for i in range(3)]
    df = spark.createDataFrame(frames, IMAGES)
    plain = detect.detect(df, detect.brightness_detector)
    assert plain.count() == 3 and plain.where("person_id is null").count() == 3

    def persons():
        return lambda rgb: [{"x1": 0.0, "y1": 0.0, "x2": 5.0, "y2": 5.0, "conf": 0.1, "cls": 0}, {"x1": 20.0, "y1": 10.0, "x2": 60.0, "y2": 50.0, "conf": 0.3, "cls": 0}]

    two = detect.detect(df, detect.brightness_detector, persons=persons).collect()
    assert len(two) == 3 and {r["person_id"] for r in two} == {1}
    assert all(r["bbox"] == [16.0, 6.0, 48.0, 48.0] and math.isclose(r["keypoints"][2][0], 40.0) for r in two)
    fused = detect.detect(df, detect.brightness_detector, models=[detect.brightness_detector] * 2).collect()
    one = {r["path"]: r for r in plain.collect()}
    assert all(np.allclose(r["keypoints"], one[r["path"]]["keypoints"], atol=1e-3) for r in fused)
    with pytest.raises(ValueError):
        detect.detect(df, detect.brightness_detector, persons=persons, models=[detect.brightness_detector])
    small = imgs.preprocess_images(df.limit(1), with_denoise=False).head()
    assert (small["height"], small["width"], round(small["scale_x"], 3)) == (512, 682, 8.533)
    assert imgs.normalize_images(df, (10, 20)).select("width", "height").distinct().collect() == [(10, 20)]
    assert detect.detect(df.limit(0), detect.brightness_detector).count() == 0


def bmp(x):
    """A 24-bit BMP of an H x W x 3 BGR array whose width is a multiple of 4."""
    h, w = x.shape[:2]
    body = x[::-1].tobytes()
    return b"BM" + (54 + len(body)).to_bytes(4, "little") + b"\0\0\0\0" + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + body


def test_image_scan(spark, tmp_path):
    x = np.arange(4 * 8 * 3, dtype=np.uint8).reshape(4, 8, 3)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bmp").write_bytes(bmp(x))
    (tmp_path / "sub" / "b.bmp").write_bytes(bmp(x))
    (tmp_path / "bad.bmp").write_bytes(b"no image")
    found = imgs.scan_images(spark, str(tmp_path), glob="*.bmp").collect()
    assert len(found) == 1 and found[0]["data"] == x.tobytes()
    assert imgs.scan_images(spark, str(tmp_path), recursive=True).count() == 2
    assert imgs.scan_files(spark, str(tmp_path)).count() == 2
    assert imgs.image_metadata(imgs.scan_images(spark, str(tmp_path))).head()["width"] == 8




def test_poses_of_an_ensemble_are_fused_by_tasks_of_few(spark, monkeypatch):
    """However few tasks the images came in, a task fuses about so many poses; images of a null path are one."""
    monkeypatch.setattr(detect, "POSES_A_TASK", 10)
    rows = [(None if i < 2 else f"p{i}", 4, 5, 3, bytes([40 * (i % 6)]) * 60) for i in range(60)]
    images = spark.createDataFrame(rows, "path string, height int, width int, n_channels int, data binary").coalesce(1)
    models = [detect.brightness_detector, partial(detect.brightness_detector, 0.0, 1.0)]
    fused = detect.detect(images, models[0], models=models)
    got = {r["path"]: r for r in fused.collect()}
    assert len(got) == 59 and None in got and fused.rdd.getNumPartitions() == 13
    assert all(len(r["keypoints"]) == 5 and r["bbox"] == [0.0, 0.0, 5.0, 4.0] for r in got.values())
