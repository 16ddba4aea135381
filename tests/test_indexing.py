"""A directory of images from scan to search."""

import os
import uuid
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from limber.operators import detect, models
from limber.plans import indexing
from limber.sources import images as imgs
from limber.sources import store
from test_operators import bmp


def geometric(poses):
    return poses.withColumn("geometric", F.flatten("keypoints"))


def visual(poses):
    return poses.withColumn("visual", F.array(F.col("overall_confidence")))


@pytest.fixture(scope="module")
def photos(tmp_path_factory):
    where = tmp_path_factory.mktemp("photos")
    rng = np.random.default_rng(2)
    for i in range(5):
        (where / f"p{i}.bmp").write_bytes(bmp(rng.integers(0, 50 * (i + 1), (20, 24 + 4 * i, 3), dtype=np.uint8)))
    return str(where)


def test_index_and_search(spark, photos, tmp_path):
    root, path = f"{tmp_path}/store", f"{tmp_path}/index"
    assert indexing.index_directory(spark, photos, root, detect.brightness_detector, geometric, visual).head()["poses_indexed"] == 5
    assert indexing.index_directory(spark, photos, root, detect.brightness_detector, geometric, visual).head()["poses_indexed"] == 0  # nothing new
    rows = indexing.build_search_index(spark, root, path)
    assert rows.count() == 5
    query = rows.where(F.col("file_path").endswith("p2.bmp")).head()["feature_vector"]
    found = indexing.search(rows, query, 3, "l2").orderBy("rank").collect()
    assert found[0]["image_path"].endswith("p2.bmp") and found[0]["similarity_score"] == "0.000" and len(found) == 3
    plain = indexing.build_search_index(spark, root, f"{tmp_path}/geo", "geometric_features")
    assert len(plain.head()["feature_vector"]) == len(query) - 1
    with pytest.raises(ValueError):
        indexing.search(plain, query)


def test_preprocessing_keeps_coordinates(spark, photos):
    plain = {r["path"]: r["bbox"] for r in indexing.detected(spark, photos, detect.brightness_detector, glob="p0.bmp").collect()}
    ready = {r["path"]: r["bbox"] for r in indexing.detected(spark, photos, detect.brightness_detector, glob="p0.bmp", preprocess=True).collect()}
    assert all(np.allclose(ready[p], b, atol=0.1) for p, b in plain.items())
    smaller = {r["path"]: r for r in indexing.detected(spark, photos, detect.brightness_detector, glob="p0.bmp", target_size=(12, 10)).collect()}
    assert all(np.allclose(smaller[p]["bbox"], b) and smaller[p]["image_width"] == 24 for p, b in plain.items())


def test_benchmark(spark, photos):
    variants = {"plain": lambda x: detect.detect(x, detect.brightness_detector), "ensemble": lambda x: detect.detect(x, detect.brightness_detector, models=[detect.brightness_detector] * 2)}
    got = {r["variant"]: r for r in indexing.benchmark(spark, photos, variants, glob="*.bmp").collect()}
    assert set(got) == set(variants) and all(r["n_images"] == r["n_detected"] == 5 and r["avg_time"] > 0 for r in got.values())
    report = {r["variant"]: r for r in indexing.benchmark_report(spark.createDataFrame(list(got.values())), "plain").collect()}
    assert report["plain"]["slowdown"] == 1.0 and report["ensemble"]["slowdown"] > 0


def test_index_without_any_extractor_of_ones_own(spark, photos, tmp_path):
    root, path = f"{tmp_path}/store", f"{tmp_path}/index"
    assert indexing.index_directory(spark, photos, root, detect.figure_detector).head()["poses_indexed"] == 5
    rows = indexing.build_search_index(spark, root, path)
    assert {len(r["feature_vector"]) for r in rows.collect()} == {628}
    query = indexing.query_vectors(spark, photos, detect.figure_detector, glob="p3.bmp").head()
    assert np.isclose(np.linalg.norm(query["visual"]), 1)
    found = indexing.search(rows, query["fused"], 2, "l2").orderBy("rank").collect()
    assert found[0]["image_path"].endswith("p3.bmp") and found[0]["similarity_score"] == "0.000"
    ready = indexing.detected(spark, photos, detect.figure_detector, preprocess=True, with_denoise=False, texture=True, glob="p1.bmp").head()
    assert len(ready["visual"]) == 576
    fused = indexing.query_vectors(spark, photos, detect.figure_detector, glob="p1.bmp", models=[detect.figure_detector] * 2).head()
    assert len(fused["fused"]) == 628


def test_only_new_and_changed_files_are_decoded(spark, tmp_path):
    rng = np.random.default_rng(8)
    where, state, root = tmp_path / "photos", f"{tmp_path}/state", f"{tmp_path}/store"
    where.mkdir()
    write = lambda name, w=24: (where / name).write_bytes(bmp(rng.integers(0, 255, (20, w, 3), dtype=np.uint8)))
    for i in range(3):
        write(f"p{i}.bmp")
    found, mark = imgs.scan_new_images(spark, str(where), state)
    assert found.count() == 3
    again, _ = imgs.scan_new_images(spark, str(where), state)
    assert again.count() == 3  # nothing is marked yet
    assert mark() == 3
    found, mark = imgs.scan_new_images(spark, str(where), state)
    assert found.columns == again.columns and found.count() == 0 and mark() == 0 and "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    write("p3.bmp")
    write("p1.bmp", 28)
    os.utime(where / "p2.bmp", (1_000_000_000, 1_000_000_000))  # an older time is another time
    (where / "note.txt").write_text("no image")
    found, mark = imgs.scan_new_images(spark, str(where), state)
    assert sorted(r["path"][-6:] for r in found.collect()) == ["p1.bmp", "p2.bmp", "p3.bmp"] and mark() == 4  # the text is known to be none now
    assert imgs.scan_new_images(spark, str(where), state)[0].count() == 0
    write("p9.bmp")
    index = partial(indexing.index_directory, spark, str(where), root, detect.figure_detector, state=state)
    assert [index().head()[0] for _ in range(2)] == [1, 0]
    assert store.read_table(spark, root, "images").count() == 1


def test_a_model_is_loaded_once_a_process(spark, photos, tmp_path):
    (tmp_path / "loads").mkdir()
    (tmp_path / "m").mkdir()
    (tmp_path / "model.txt").write_text("0.0")
    (tmp_path / "m" / "model.txt").write_text("2.0")
    where = f"{tmp_path}/loads"

    def load(path):
        """Leaves a mark each time it is called."""
        with open(path, "rb") as f:
            least = float(f.read())
        open(f"{where}/{uuid.uuid4().hex}", "w").close()
        return least

    shared = models.share_model(spark, f"{tmp_path}/model.txt")
    assert models.share_model(spark, f"file://{tmp_path}/model.txt") == shared
    factory = models.model_factory(shared, load, detect.figure_detector)
    many = imgs.scan_images(spark, photos).repartition(5)
    for _ in range(3):
        assert detect.detect(many, factory).count() == 5
    assert 1 <= len(os.listdir(where)) <= 4  # 15 tasks, in at most four processes
    other = models.share_model(spark, f"{tmp_path}/m/model.txt")  # another file of the same name
    assert other.name != shared.name and detect.detect(many, models.model_factory(other, load, detect.figure_detector)).count() == 0
    before = len(os.listdir(where))
    assert detect.detect(many.limit(0), models.model_factory(models.ModelFile(shared.name, "0" * 64), load)).count() == 0 and len(os.listdir(where)) == before
    with pytest.raises(Exception, match="SHA-256"):
        detect.detect(many, models.model_factory(models.ModelFile(shared.name, "0" * 64), load)).collect()
    with pytest.raises(Exception, match="does not exist|No such file"):
        models.share_model(spark, f"{tmp_path}/none.txt")


def test_images_without_pixels(spark):
    rows = [("a", 2, 2, 3, bytes(12)), ("null", None, None, None, None), ("empty", 0, 0, 3, b""), ("odd", None, 2, 3, bytes(12)), (None, 2, 2, 3, bytes(12))]
    df = spark.createDataFrame(rows, "path string, height int, width int, n_channels int, data binary").withColumn("note", F.lit(None).cast("string"))
    for out in (imgs.normalize_images(df, (4, 4)), imgs.preprocess_images(df, with_denoise=False, target_size=(4, 4))):
        got = {r["path"]: r for r in out.collect()}
        assert len(got) == 5 and len(got["a"]["data"]) == 48 and got["null"]["data"] is None and got["null"]["height"] is None and got["empty"]["width"] == 0 and got["odd"]["scale_x"] == 1.0
    assert sorted(str(r["path"]) for r in detect.detect(df, detect.figure_detector).collect()) == ["None", "a"]
    assert detect.detect(df, detect.figure_detector, persons=detect.thirds_detector).select("path").distinct().count() == 2


def test_files_are_compared_in_the_tasks_that_list_them(spark, photos, tmp_path):
    """No task takes in all parts of the listing, and what is known is not held whole by each."""
    files = imgs.scan_files(spark, photos)
    known = files.where(F.col("path").endswith("p1.bmp")).localCheckpoint()
    changed = imgs._changed(files, known)
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert changed.count() == 4 and "SortMergeJoin" in plan and "Broadcast" not in plan
    imgs.scan_new_images(spark, photos, f"{tmp_path}/state")[1]()
    assert imgs.scan_new_images(spark, photos, f"{tmp_path}/state")[1]() == 0


NAMES = ("a.bmp", "b c.bmp", "d%20.bmp", "e[1].bmp", "f{x}.bmp", "g*?.bmp", ".h.bmp", "_i.bmp", "_i=1.bmp", "j._COPYING_", "_metadata.bmp", "more/k.bmp", "more/deep/l.bmp", "_metadata/m.bmp", "_x/n.bmp", ".y/o.bmp", "p.png")


@pytest.fixture
def odd_files(tmp_path):
    """Images, some of names that Spark passes over or takes for patterns, an empty file, a link and a link to nothing."""
    where, rng = tmp_path / "odd", np.random.default_rng(3)
    for name in NAMES:
        (where / name).parent.mkdir(parents=True, exist_ok=True)
        (where / name).write_bytes(bmp(rng.integers(0, 255, (6, 8, 3), dtype=np.uint8)))
    (where / "empty.bmp").touch()
    (where / "link.bmp").symlink_to(where / "none")
    (where / "link2.bmp").symlink_to(where / "a.bmp")
    return str(where)


def test_tasks_list_what_the_reader_lists(spark, odd_files, tmp_path):
    for i, (recursive, glob) in enumerate([(False, None), (True, None), (True, "*.bmp"), (True, "{a,k,p}.*"), (False, "[!a]*.b?p")]):
        listed = imgs._listed(spark, odd_files, f"{tmp_path}/{i}", recursive, glob)
        assert sorted(listed.collect()) == sorted(imgs.scan_files(spark, odd_files, recursive, glob).collect())
    one = imgs._listed(spark, f"{odd_files}/a.bmp", f"{tmp_path}/one")
    assert one.collect() == imgs.scan_files(spark, f"{odd_files}/a.bmp").collect() and one.count() == 1
    assert imgs._listed(spark, f"{odd_files}/m*", f"{tmp_path}/some").collect() == imgs.scan_files(spark, f"{odd_files}/m*").collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        imgs._listed(spark, f"{odd_files}/none", f"{tmp_path}/none")


def test_the_driver_never_holds_the_paths_of_all_files(spark, odd_files, tmp_path, monkeypatch):
    loaded, load = [], imgs._loaded
    monkeypatch.setattr(imgs, "_loaded", lambda session, paths: loaded.append(len(paths)) or load(session, paths))
    whole, mark = imgs.scan_new_images(spark, odd_files, f"{tmp_path}/whole", recursive=True)
    n = whole.count()
    assert n == mark() == 12 and loaded == [12]
    monkeypatch.setattr(imgs, "FILES_AT_ONCE", 5)
    monkeypatch.setattr(imgs, "scan_files", None)  # Spark's own listing is not called
    loaded.clear()
    parts, mark = imgs.scan_new_images(spark, odd_files, f"{tmp_path}/parts", recursive=True)
    assert sorted(parts.collect()) == sorted(whole.collect()) and mark() == n and loaded == [5, 5, 2]
    made, _ = imgs.scan_new_images(spark, odd_files, f"{tmp_path}/made", recursive=True, made=lambda images: images.select("path", F.length("data").alias("n")))
    assert sorted(made.collect()) == sorted(whole.select("path", F.length("data").alias("n")).collect())
    assert imgs.scan_new_images(spark, odd_files, f"{tmp_path}/parts", recursive=True)[0].count() == 0
    index = partial(indexing.index_directory, spark, odd_files, f"{tmp_path}/store", detect.figure_detector, state=f"{tmp_path}/state", recursive=True)
    assert [index().head()[0] for _ in range(2)] == [12, 0]
    state = imgs._for_many_files(spark).conf
    assert state.get("spark.sql.session.timeZone") == "UTC" and spark.conf.get("spark.sql.files.openCostInBytes") != state.get("spark.sql.files.openCostInBytes")
