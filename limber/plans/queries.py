"""Queries of the pose-similarity operators over the test tables, with their SQL.

The tables stand in for poses, images and features: vectors are ``embeddings``,
detections ``events``, image files ``customer``, and so on. Every query runs
over its whole tables; a limit stands only where it is a top-k.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limber.functions import vectors
from limber.operators import bench, boxes, cells, detect, ensemble, index, knn, models
from limber.operators import features as feats
from limber.plans import indexing
from limber.session import own_folder
from limber.sources import bands, store, versions
from limber.sources import images as imgs

K = 5
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pose_id"), F.col("embedding").alias("feature_vector"))


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return features(spark, sf_dir).where("pose_id = 7").head()["feature_vector"]


def _single(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = knn.search_similar(features(spark, sf_dir), _first_vector(spark, sf_dir), K, metric)
        return found.select(F.col("rank").cast("long").alias("rank"), "pose_id", F.round("similarity_score", 9).alias("similarity_score"))

    return run


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 asks for its five nearest."""
    f = features(spark, sf_dir)
    asked = f.where("pose_id % 100 = 0").withColumnRenamed("pose_id", "query_id")
    found = knn.search_similar_batch(f, asked, K, "dot")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "pose_id", F.round("similarity_score", 9).alias("similarity_score"))


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("image_id"), F.col("value").alias("overall_confidence"), F.col("ts").alias("created_at"))
    images = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("file_path"))
    rows = index.in_build_order(index.index_rows(features(spark, sf_dir), poses, images))
    return rows.select("pose_id", "overall_confidence", "file_path", F.size("feature_vector").cast("long").alias("dim"))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_stats(features(spark, sf_dir))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.table_counts({n: table(spark, sf_dir, n) for n in ("events", "part", "embeddings")})


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = features(spark, sf_dir).select("pose_id", vectors.l2_normalize(F.transform("feature_vector", lambda x: x.cast("double") * 3)).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return v.select("pose_id", F.round(F.get("v", F.lit(0)), 9).alias("first"), F.round(total, 6).alias("total"))


def fuse_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    geometric = f.select("pose_id", F.slice("feature_vector", 1, 52).alias("g"))
    visual = f.select((F.col("pose_id") - 1).alias("pose_id"), F.col("feature_vector").alias("v"))
    fused = geometric.join(visual, "pose_id").select("pose_id", vectors.fuse(F.col("g"), F.col("v")).alias("x"))
    return fused.select("pose_id", F.size("x").cast("long").alias("dim"), F.round(F.pow(vectors.norm(F.col("x")), 2), 6).alias("squared_norm"))


def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("image_id"), "event_id", ((F.col("event_id") % 10) / 10).alias("conf"), F.when(F.col("event_type") == "click", 0).otherwise(1).alias("cls")
    )
    kept = boxes.person_boxes(boxes.number_boxes(found, "image_id", "event_id"))
    return kept.select("image_id", "event_id", F.col("box_idx").cast("long").alias("box_idx"), "conf")


def crop_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 10).alias("x1"), (F.col("l_discount") * 1000).alias("y1"), (F.col("l_tax") * 2000).alias("w"), (F.col("l_quantity") * 7.3).alias("h"),
        (F.col("l_discount") * 10).alias("conf"), F.lit(480).alias("width"), F.lit(320).alias("height"), F.lit(0).alias("cls"),
    )
    b = boxes.person_boxes(li.select("*", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2")))
    return b.select("l_orderkey", "l_linenumber", *boxes.crop_bounds(*map(F.col, ("x1", "y1", "x2", "y2", "width", "height"))))


def _points(v: str) -> F.Column:
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(F.get(v, i * 2).cast("double"), F.get(v, i * 2 + 1).cast("double")))


def map_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = features(spark, sf_dir).select(
        "pose_id", _points("feature_vector").alias("keypoints"), F.array(*[F.get("feature_vector", F.lit(i)).cast("double") for i in range(4)]).alias("bbox"),
        (F.col("pose_id") % 640).cast("int").alias("x_offset"), (F.col("pose_id") % 480).cast("int").alias("y_offset"), (F.col("pose_id") % 3).cast("int").alias("box_idx"),
    )
    m = boxes.map_back(poses)
    total = lambda i: F.round(F.aggregate("keypoints", F.lit(0.0), lambda a, p: a + p[i]), 6)
    return m.select("pose_id", "person_id", total(0).alias("sum_x"), total(1).alias("sum_y"), *[F.round(F.get("bbox", F.lit(i)), 9).alias(f"bbox_{i}") for i in range(4)])


def upsample_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 16).alias("w"), (F.lit(40) + F.col("p_partkey") % 600).cast("int").alias("h"))
    new_w, new_h, _ = boxes.upsample_dims(F.col("w"), F.col("h"))
    return p.select("p_partkey", new_w, new_h)


def model_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    model = (F.col("pose_id") % 2).cast("int")
    return f.select(
        F.expr("pose_id div 2").alias("image_id"), model.alias("model_idx"), F.when(model == 0, F.lit(1.0)).otherwise(F.lit(1.2)).alias("weight"), F.lit(0).alias("det_idx"),
        _points("feature_vector").alias("keypoints"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.abs(F.get("feature_vector", i * 2).cast("double"))).alias("visibility"),
        F.array(F.get("feature_vector", F.lit(0)).cast("double")).alias("bbox"), F.abs(F.get("feature_vector", F.lit(1)).cast("double")).alias("overall_confidence"), F.col("pose_id").cast("int").alias("person_id"),
    )


def _ensemble(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = ensemble.fused_points(model_poses(spark, sf_dir), method)
        return p.select("image_id", F.col("k").cast("long").alias("k"), *[F.round(c, 8).alias(c) for c in ("x", "y", "visibility")])

    return run


def _ensemble_pose(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = ensemble.fuse_poses(model_poses(spark, sf_dir), method)
        return p.select(
            "image_id", "person_id", F.round(F.get("bbox", F.lit(0)), 9).alias("bbox_0"), F.round("overall_confidence", 8).alias("overall_confidence"), F.size("keypoints").cast("long").alias("n_keypoints")
        )

    return run


def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select("event_type", (F.col("value") < 20).alias("detected"), F.col("value").alias("confidence"), ((F.col("event_id") % 100) / 50).alias("elapsed_s"))
    s = bench.bench_summary(runs, "event_type")
    return s.select("event_type", "n_images", "n_detected", *[F.round(c, 6).alias(c) for c in ("avg_confidence", "avg_time", "avg_time_detected")])


def slowdown_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("elapsed_s"), F.col("value").alias("confidence"), (F.col("event_id") % 2 == 1).alias("variant"))
    s = bench.slowdown(runs, "user_id", F.col("variant"))
    return s.select("user_id", *[F.round(c, 6).alias(c) for c in ("slowdown", "conf_single", "conf_variant")])


def _mapped_knn(mapping: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = knn.search_similar(features(spark, sf_dir), _first_vector(spark, sf_dir), K, "l2", mapping=mapping, scale=2.0)
        return found.select(F.col("rank").cast("long").alias("rank"), "pose_id", F.round("similarity_score", 9).alias("similarity_score"))

    return run


def knn_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search joined with the images' paths, as the report has it."""
    named = features(spark, sf_dir).withColumn("file_path", F.concat(F.lit("photos/"), F.col("pose_id").cast("string")))
    return indexing.search(named, _first_vector(spark, sf_dir), K).withColumn("rank", F.col("rank").cast("long"))


def index_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes over two feature tables, of one set of poses and images."""
    f, poses = features(spark, sf_dir), table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("image_id"), F.col("value").alias("overall_confidence"), F.col("ts").alias("created_at"))
    images = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("file_path"))
    geometric = f.withColumn("feature_vector", F.slice("feature_vector", 1, 52))
    stats = [index.index_stats(index.index_rows(t, poses, images)).withColumn("features", F.lit(n)) for n, t in (("fused", f), ("geometric", geometric))]
    return stats[0].unionByName(stats[1])


def partial_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of two models, some of which found nothing in an image and some more than one pose; the first has no weight."""
    f = features(spark, sf_dir).where("pose_id % 5 <> 0")
    model = (F.col("pose_id") % 2).cast("int")
    return f.select(
        F.expr("pose_id div 4").alias("image_id"), model.alias("model_idx"), F.when(model == 1, F.lit(1.2)).alias("weight"), F.expr("cast(pose_id div 2 % 2 as int)").alias("det_idx"),
        _points("feature_vector").alias("keypoints"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.abs(F.get("feature_vector", i * 2).cast("double"))).alias("visibility"),
        F.array(F.get("feature_vector", F.lit(0)).cast("double")).alias("bbox"), F.abs(F.get("feature_vector", F.lit(1)).cast("double")).alias("overall_confidence"), F.col("pose_id").cast("int").alias("person_id"),
    )


def ensemble_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only first poses count, models without one have no weight, and a weight that is not given is 1."""
    p = ensemble.fused_points(partial_poses(spark, sf_dir), "weighted_average")
    return p.select("image_id", F.col("k").cast("long").alias("k"), *[F.round(c, 8).alias(c) for c in ("x", "y", "visibility")])


def flat_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of one grey for each part."""
    p = table(spark, sf_dir, "part").select("p_partkey", (8 + F.col("p_partkey") % 9).cast("int").alias("width"), (6 + F.col("p_size") % 7).cast("int").alias("height"), (F.col("p_partkey") % 256).alias("grey"))
    data = F.unhex(F.repeat(F.lpad(F.hex("grey"), 2, "0"), F.col("width") * F.col("height") * 3))
    return p.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"), "height", "width", F.lit(3).alias("n_channels"), data.alias("data"))


def _shown_poses(poses: DataFrame) -> DataFrame:
    total = lambda i: F.round(F.aggregate("keypoints", F.lit(0.0), lambda a, p: a + p[i]), 6)
    return poses.select("path", total(0).alias("sum_x"), total(1).alias("sum_y"), *[F.round(F.get("bbox", F.lit(i)), 6).alias(f"bbox_{i}") for i in range(4)], F.round("overall_confidence", 6).alias("overall_confidence"), "person_id")


def detect_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark images give no pose and no row."""
    return _shown_poses(detect.detect(flat_images(spark, sf_dir), partial(detect.brightness_detector, 0.25)))


def detect_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes filtered by class and confidence, padded crops, poses mapped back, numbers of the unfiltered boxes."""
    return _shown_poses(detect.detect(flat_images(spark, sf_dir), detect.brightness_detector, persons=detect.thirds_detector))


def detect_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models, of which the second sees bright images only and has the default weight."""
    models = [partial(detect.brightness_detector, 0.25), partial(detect.brightness_detector, 0.5, 1.0)]
    config = ensemble.EnsembleConfig(weights=(1.0,), fusion_method="weighted_average")
    return _shown_poses(detect.detect(flat_images(spark, sf_dir), models[0], models=models, config=config))


def detect_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect_persons(flat_images(spark, sf_dir), detect.thirds_detector)
    return found.select("path", F.col("box_idx").cast("long").alias("box_idx"), "x1", "y1", "x2", "y2", "conf", F.col("cls").cast("long").alias("cls"))


def normalize_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = imgs.normalize_images(flat_images(spark, sf_dir), (16, 12))
    return out.select("path", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.length("data").cast("long").alias("n_bytes"), F.hex(F.substring("data", 1, 1)).alias("first"), F.round("scale_x", 9).alias("scale_x"), F.round("scale_y", 9).alias("scale_y"))


def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imgs.image_metadata(flat_images(spark, sf_dir))


def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored, and what each table holds, after the same detections were stored twice."""
    f = features(spark, sf_dir)
    rows = f.select(
        F.concat(F.lit("image"), (F.col("pose_id") % 100).cast("string")).alias("image_path"), F.lit(4).alias("width"), F.lit(5).alias("height"), (F.col("pose_id") % 7).cast("int").alias("person_id"),
        _points("feature_vector").alias("keypoints"), F.array(F.lit(1.0)).alias("visibility"), F.array(F.lit(0.0)).alias("bbox"), F.lit(0.5).alias("overall_confidence"), F.lit(None).cast("timestamp").alias("created_at"),
        F.slice("feature_vector", 1, 52).alias("geometric"), F.when(F.col("pose_id") % 3 == 0, F.col("feature_vector")).alias("visual"), F.col("feature_vector").alias("fused"),
    )
    root = _own(spark, "store")
    stored = [store.store_detections(rows, root) for _ in range(2)]
    counts = bench.table_counts({f"stored {i + 1}": s for i, s in enumerate(stored)} | {t: store.read_table(spark, root, t) for t in store.TABLES})
    index_size = bench.table_counts({"index": index.index_rows(*(store.read_table(spark, root, t) for t in ("fused_features", "pose_detections", "images")))})
    return counts.unionByName(index_size)


def bench_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("variant"), (F.col("value") < 20).alias("detected"), F.col("value").alias("confidence"), ((F.col("event_id") % 100) / 50).alias("elapsed_s"))
    return indexing.benchmark_report(bench.bench_summary(runs, "variant"), "click")


def detect_two_stage_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons' crops of many images in one batch of the pose model, over textured images."""
    return _shown_poses(detect.two_stage_batched(scene_images(spark, sf_dir), detect.thirds_detector, detect.brightness_detector))


def _pruned(metric: str) -> Query:
    """As knn_batch, in an index that leaves out cells."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f, path = features(spark, sf_dir), _own(spark, "cells")
        cells.build_cells(f, path)
        found, _ = cells.search_cells(spark, path, f.where("pose_id % 100 = 0").withColumnRenamed("pose_id", "query_id"), K, metric)
        return found.select("query_id", F.col("rank").cast("long").alias("rank"), "pose_id", F.round("similarity_score", 9).alias("similarity_score"))

    return run


def _own(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pose of each vector, several to an image and none of a person, as plain detection has them."""
    return features(spark, sf_dir).select(
        "pose_id", F.concat(F.lit("image"), (F.col("pose_id") % 40).cast("string")).alias("image_path"), F.lit(4).alias("width"), F.lit(5).alias("height"), F.lit(None).cast("int").alias("person_id"),
        _points("feature_vector").alias("keypoints"), F.array(F.lit(1.0)).alias("visibility"), F.array(F.lit(0.0)).alias("bbox"), F.lit(0.5).alias("overall_confidence"), F.lit(None).cast("timestamp").alias("created_at"),
        F.slice("feature_vector", 1, 52).alias("geometric"), F.when(F.col("pose_id") % 3 == 0, F.col("feature_vector")).alias("visual"), F.col("feature_vector").alias("fused"),
    )


def store_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: the even poses, all of them, and each once more with its keypoints moved. Per batch and image what was stored, and in the end what each image has."""
    poses, root = _detections(spark, sf_dir), _own(spark, "store")
    moved = poses.withColumn("keypoints", F.transform("keypoints", lambda p: F.array(p[0] + 10, p[1])))
    batches = [poses.where("pose_id % 2 = 0"), poses, moved]
    stored = [store.store_detections(b, root).groupBy("image_path").agg(F.count(F.lit(1)).alias("n")).withColumn("batch", F.lit(i)) for i, b in enumerate(batches)]
    now = store.snapshot(spark, root)
    held = now.read(spark, "pose_detections").join(now.read(spark, "images").withColumnRenamed("id", "image_id"), "image_id").groupBy(F.col("file_path").alias("image_path")).agg(F.countDistinct("id").alias("n")).withColumn("batch", F.lit(-1))
    return reduce(DataFrame.unionByName, [*stored, held]).select("image_path", F.col("batch").cast("long").alias("batch"), "n")


def store_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table before and after visual_features is emptied, and after pose_detections is, with what depends on it; the first as a snapshot that is read last."""
    root = _own(spark, "store")
    store.store_detections(_detections(spark, sf_dir), root)
    first = store.snapshot(spark, root)
    store.truncate(spark, root, "visual_features")
    second = store.snapshot(spark, root)
    store.truncate(spark, root, "pose_detections", cascade=True)
    shown = [bench.table_counts({t: s.read(spark, t) for t in store.TABLES}).withColumn("at", F.lit(i)) for i, s in enumerate((first, second, store.snapshot(spark, root)))]
    return reduce(DataFrame.unionByName, shown).select(F.col("at").cast("long").alias("at"), "table_name", "n_rows")


def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the even vectors, rebuilt of all while it is read, and cleared: what each reader sees."""
    f, path = features(spark, sf_dir), _own(spark, "index")
    before = index.build_index(f.where("pose_id % 2 = 0"), path)
    kept = index.build_index(f, path)  # it is there already
    after = index.build_index(f, path, force_rebuild=True)
    again = index.append_index(f.where("pose_id % 2 = 1"), path, ("odd", 0))
    same = index.append_index(f.where("pose_id % 2 = 1"), path, ("odd", 0))
    shown = {"before": before, "not rebuilt": kept, "rebuilt": after, "appended": again, "appended once": same, "now": index.read_index(spark, path)}
    stats = [index.index_stats(d).withColumn("reader", F.lit(n)) for n, d in shown.items()]
    return reduce(DataFrame.unionByName, stats)


def _photos(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a BMP file of each vector, the odd ones in a folder within it, and files that are no images."""
    where = _own(spark, "photos")
    number = F.regexp_extract("path", r"\d+$", 0)
    named = texture_images(spark, sf_dir).withColumn("path", F.concat(F.when(number.cast("long") % 2 == 1, F.lit("more/")).otherwise(F.lit("")), F.lit("v"), number, F.lit(".bmp")))
    imgs.write_images(named, where).count()
    return where


def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a folder by glob, of it and what is in it, and the lengths of the files."""
    where = _photos(spark, sf_dir)
    tail = F.regexp_extract("path", r"((?:more/)?v\d+\.bmp)$", 1).alias("file")
    shown = lambda df, name: df.select(F.lit(name).alias("scan"), tail, F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), F.sha2("data", 256).alias("pixels"))
    files = imgs.scan_files(spark, where, recursive=True, glob="*.bmp").select(F.lit("files").alias("scan"), tail, F.col("length").alias("height"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("string").alias("pixels"))
    return shown(imgs.scan_images(spark, where, glob="v*.bmp"), "glob").unionByName(shown(imgs.scan_images(spark, where, recursive=True), "recursive")).unionByName(files)


def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder's own images, then those within it too: what each run decodes, and a third that has nothing left."""
    where, state = _photos(spark, sf_dir), _own(spark, "state")
    tail, runs = F.regexp_extract("path", r"((?:more/)?v\d+\.bmp)$", 1).alias("file"), []
    for i, recursive in enumerate((False, True, True)):
        found, mark = imgs.scan_new_images(spark, where, state, recursive, "*.bmp", lambda images: images.select(tail, F.sha2("data", 256).alias("pixels")))
        mark()
        runs.append(found.select(F.lit(i).cast("long").alias("run"), "file", "pixels"))
    return reduce(DataFrame.unionByName, runs)


def index_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder indexed twice with the library's own extractors, and the index over the fused vectors."""
    where, root, path = _photos(spark, sf_dir), _own(spark, "store"), _own(spark, "index")
    runs = [indexing.index_directory(spark, where, root, detect.figure_detector, recursive=True).select(F.lit(f"run {i}").alias("what"), F.col("poses_indexed").alias("n_total"), F.lit(None).cast("int").alias("dim_min"), F.lit(None).cast("int").alias("dim_max")) for i in range(2)]
    stats = index.index_stats(indexing.build_search_index(spark, root, path)).select(F.lit("index").alias("what"), "n_total", "dim_min", "dim_max")
    return reduce(DataFrame.unionByName, [*runs, stats])


def index_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of an index, old ones cleared, then all: how many versions there are and what the newest holds."""
    f, path = features(spark, sf_dir), _own(spark, "index")
    shown = []

    def look(step: str) -> None:
        numbers = versions.versions(spark, path)
        held = index.read_index(spark, path) if numbers else f.limit(0)
        kept = held.count()  # before the next step takes it away
        shown.append(f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), F.lit(len(numbers)).cast("long").alias("n_versions"), F.lit(kept).cast("long").alias("n_total"), "n"))

    for remainder in (0, 1):
        index.build_index(f.where(F.col("pose_id") % 2 == remainder), path, force_rebuild=True)
    index.build_index(f, path, force_rebuild=True)
    look("built")
    index.clear_old_versions(spark, path)
    look("old ones cleared")
    index.clear_index(spark, path)
    look("cleared")
    index.build_index(f.where("pose_id % 2 = 0"), path)
    look("built anew")
    return reduce(DataFrame.unionByName, shown)


def detect_model_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector whose file, made of the table, is brought to the executors: brightness of at least a level that the vectors' mean sets."""
    images, where = scene_images(spark, sf_dir), _own(spark, "model")
    mean = features(spark, sf_dir).agg(F.format_string("%.6f", 0.5 + F.avg(F.get("feature_vector", F.lit(0)).cast("double"))).alias("value"))
    mean.coalesce(1).write.text(where)
    name = next(n for n in versions.names(spark, where) if n.startswith("part-"))

    def load(path: str) -> float:
        with open(path) as f:
            return float(f.read())

    return _shown_poses(detect.detect(images, models.model_factory(models.share_model(spark, f"{where}/{name}"), load, detect.brightness_detector)))


def bench_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two detectors over a folder of images, without the times."""
    variants = {"all": lambda x: detect.detect(x, detect.figure_detector), "bright": lambda x: detect.detect(x, partial(detect.figure_detector, 0.5))}
    found = indexing.benchmark(spark, _photos(spark, sf_dir), variants, glob="*.bmp")
    return found.select("variant", "n_images", "n_detected", F.round("avg_confidence", 8).alias("avg_confidence"))


def geometric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 52 numbers of each pose, a row each; keypoints of little visibility are left out."""
    f = features(spark, sf_dir)
    seen = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.abs(F.get("feature_vector", i * 2 + 1).cast("double")) * 5)
    poses = f.select("pose_id", _points("feature_vector").alias("keypoints"), seen.alias("visibility"))
    found = feats.geometric_features(poses).select("pose_id", F.posexplode("geometric").alias("place", "value"))
    return found.select("pose_id", F.col("place").cast("long").alias("place"), F.round("value", 8).alias("value"))


def texture_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of 8 x 8 pixels for each vector: its numbers as blue, and moved on by 5 and 10 places as green and red."""
    v = lambda k, c: F.get("embedding", (k + 5 * c) % 64).cast("double")
    byte = lambda k, c: F.lpad(F.hex(F.least(F.greatest(F.floor(128 + 400 * v(k, c)), F.lit(0)), F.lit(255))), 2, "0")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.concat(*[byte(k, c) for c in range(3)]))
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("vector/"), F.col("vec_id").cast("string")).alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("n_channels"), F.unhex(F.array_join(pixels, "")).alias("data")
    )


def scene_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image 12 wide and 10 high for each vector, filled as those of 8 x 8 are."""
    v = lambda k, c: F.get("embedding", (k + 5 * c) % 64).cast("double")
    byte = lambda k, c: F.lpad(F.hex(F.least(F.greatest(F.floor(128 + 400 * v(k, c)), F.lit(0)), F.lit(255))), 2, "0")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(119)), lambda k: F.concat(*[byte(k, c) for c in range(3)]))
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("vector/"), F.col("vec_id").cast("string")).alias("path"), F.lit(10).alias("height"), F.lit(12).alias("width"), F.lit(3).alias("n_channels"), F.unhex(F.array_join(pixels, "")).alias("data")
    )


def _pixel_rows(images: DataFrame) -> DataFrame:
    """path, y, x and the three bytes of each pixel, as they stand."""
    at = images.select("path", "width", F.hex("data").alias("h"), F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("i"))
    byte = lambda c: F.conv(F.substring("h", F.col("i") * 6 + 2 * c + 1, F.lit(2)), 16, 10).cast("long").alias(f"c{c}")
    return at.select("path", F.floor(F.col("i") / F.col("width")).alias("y"), (F.col("i") % F.col("width")).cast("long").alias("x"), *[byte(c) for c in range(3)])


def contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lightness equalised by tiles, in bands of 4 rows."""
    return _pixel_rows(bands.joined(bands.enhance_bands(scene_images(spark, sf_dir), 4)))


def denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-local means in bands of 4 rows; smaller windows than by default, for the SQL's sake."""
    return _pixel_rows(bands.joined(bands.denoise_bands(scene_images(spark, sf_dir), 4, template=3, search=5)))


def upsample_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short side brought up to 16, bicubic, in bands of 5 rows."""
    new_w, new_h, _ = boxes.upsample_dims(F.col("width"), F.col("height"), 16)
    return _pixel_rows(bands.joined(bands.resize_bands(scene_images(spark, sf_dir), new_w, new_h, 5)))


def normalize_textured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resized to 16 x 12, red first."""
    return _pixel_rows(imgs.normalize_images(scene_images(spark, sf_dir), (16, 12)))


def visual_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not 0 of each image's 576 numbers."""
    found = feats.visual_features(texture_images(spark, sf_dir)).select("path", F.posexplode("visual").alias("place", "value"))
    return found.select("path", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 5).alias("value")).where("value <> 0")


def queries() -> dict[str, Query]:
    plain = (
        index_cleared, detect_model_file, bench_photos,
        contrast, denoise, upsample_pixels, normalize_textured,
        geometric_features, visual_features, detect_two_stage_batched, store_incremental, store_truncate, index_versions, directory_scan, incremental_scan, index_photos,
        knn_report, index_swap, ensemble_partial, detect_plain, detect_two_stage, detect_ensemble, detect_persons, normalize_image, image_metadata, store_counts, bench_report,
        knn_batch, index_build, index_stats, table_counts, l2_normalize, fuse_features, box_filter, crop_bounds, map_back, upsample_dims, bench_summary, slowdown_ratio,
    )
    return {f.__name__: f for f in plain} | {
        "knn_pruned": _pruned("dot"),
        "knn_pruned_cosine": _pruned("cosine"),
        "knn_pruned_l2": _pruned("l2"),
        "knn_single": _single("cosine"),
        "knn_dot": _single("dot"),
        "knn_l2": _single("l2"),
        "knn_l2_inverse": _mapped_knn("inverse"),
        "knn_l2_exponential": _mapped_knn("exponential"),
        "ensemble_weighted": _ensemble("weighted_average"),
        "ensemble_confidence": _ensemble("confidence_weighted"),
        "ensemble_weighted_pose": _ensemble_pose("weighted_average"),
        "ensemble_confidence_pose": _ensemble_pose("confidence_weighted"),
    }


_FEATURES = "f AS (SELECT vec_id AS pose_id, embedding::DOUBLE[] AS v FROM embeddings)"
_MODEL_POINTS = f"""{_FEATURES}, p AS (
  SELECT pose_id // 2 AS image_id, pose_id % 2 AS model_idx, CASE WHEN pose_id % 2 = 0 THEN 1.0::DOUBLE ELSE 1.2::DOUBLE END AS w, pose_id, v, unnest(range(0, 32)) AS k FROM f
), q AS (SELECT image_id, model_idx, w, pose_id, k, v[k * 2 + 1] AS x, v[k * 2 + 2] AS y, abs(v[k * 2 + 1]) AS vis, abs(v[2]) AS conf, v[1] AS b FROM p)"""


def _knn_sql(measure: str, order: str, shown: str = "score") -> str:
    return f"""WITH {_FEATURES}, q AS (SELECT v AS qv FROM f WHERE pose_id = 7), s AS (SELECT pose_id, {measure} AS score FROM f, q)
    SELECT row_number() OVER (ORDER BY score {order}, pose_id) AS rank, pose_id, round({shown}, 9) AS similarity_score FROM s ORDER BY score {order}, pose_id LIMIT {K}"""


def _ensemble_sql(method: str) -> str:
    use = "w" if method == "weighted_average" else "vis * w"
    below = "sum(w)" if method == "weighted_average" else f"(sum(vis * w) + {ensemble.EPSILON}::DOUBLE)"
    return f"""WITH {_MODEL_POINTS} SELECT image_id, k, round(sum(x * {use}) / {below}, 8) AS x, round(sum(y * {use}) / {below}, 8) AS y, round(sum(vis * w) / sum(w), 8) AS visibility
    FROM q GROUP BY image_id, k"""


def _pose_sql(method: str) -> str:
    overall = "avg(conf)" if method == "weighted_average" else "avg(seen)"
    return f"""WITH {_MODEL_POINTS}, a AS (SELECT image_id, k, avg(conf) AS conf, sum(vis * w) / sum(w) AS seen, arg_min(pose_id, model_idx) AS person_id, arg_min(b, model_idx) AS b FROM q GROUP BY image_id, k)
    SELECT image_id, any_value(person_id)::INT AS person_id, round(any_value(b), 9) AS bbox_0, round({overall}, 8) AS overall_confidence, count(*) AS n_keypoints FROM a GROUP BY image_id"""


def _geometric_sql() -> str:
    p = lambda i: f"x[{i + 1}] AS x{i}, y[{i + 1}] AS y{i}"
    middle = lambda a, b, c: f"coalesce(({c}{a} + {c}{b}) / 2, {c}{a}, {c}{b})"
    length = lambda a, b: f"sqrt((x{a} - x{b}) ** 2 + (y{a} - y{b}) ** 2)"
    numbers = [n for i in range(17) for n in (f"(x{i} - hx) / u", f"(y{i} - hy) / u")]
    for a, b, c in ((5, 7, 9), (6, 8, 10), (7, 5, 11), (8, 6, 12), (5, 11, 13), (6, 12, 14), (11, 13, 15), (12, 14, 16)):
        dot = f"(x{a} - x{b}) * (x{c} - x{b}) + (y{a} - y{b}) * (y{c} - y{b})"
        numbers.append(f"acos(CASE WHEN {length(a, b)} * {length(c, b)} > 0 THEN greatest(-1::DOUBLE, least(1::DOUBLE, ({dot}) / ({length(a, b)} * {length(c, b)}))) END) / pi()")
    numbers += [f"{length(a, b)} / u" for a, b in ((5, 7), (6, 8), (7, 9), (8, 10), (11, 13), (12, 14), (13, 15), (14, 16), (5, 6), (11, 12))]
    return f"""WITH {_FEATURES}, s AS (SELECT pose_id, list_transform(range(0, 17), lambda i: CASE WHEN abs(v[2 * i + 2]) * 5 >= 0.3::DOUBLE THEN v[2 * i + 1] END) AS x, list_transform(range(0, 17), lambda i: CASE WHEN abs(v[2 * i + 2]) * 5 >= 0.3::DOUBLE THEN v[2 * i + 2] END) AS y FROM f),
      p AS (SELECT pose_id, {', '.join(map(p, range(17)))} FROM s), h AS (SELECT *, {middle(11, 12, 'x')} AS hx, {middle(11, 12, 'y')} AS hy, {middle(5, 6, 'x')} AS sx, {middle(5, 6, 'y')} AS sy FROM p),
      u AS (SELECT *, sqrt((sx - hx) ** 2 + (sy - hy) ** 2) AS u FROM h), g AS (SELECT pose_id, [{', '.join(f'coalesce({n}, 0)' for n in numbers)}] AS g FROM u WHERE u > 0)
    SELECT pose_id, unnest(range(0, 52)) AS place, round(unnest(g), 8) AS value FROM g"""


_PIXEL = "least(255, greatest(0, floor(128 + 400 * v[({k} + 5 * {c}) % 64 + 1])))"


def _visual_sql() -> str:
    grey = " + ".join(f"{w} * {_PIXEL.format(k='k', c=c)}" for c, w in enumerate(("0.114::DOUBLE", "0.587::DOUBLE", "0.299::DOUBLE")))
    return f"""WITH {_FEATURES}, p AS (SELECT pose_id, k // 8 AS r, k % 8 AS c, {grey} AS g FROM (SELECT pose_id, v, unnest(range(0, 64)) AS k FROM f)),
      d AS (SELECT p.pose_id, p.r, p.c, (e.g - w.g) / 2 AS gx, (s.g - n.g) / 2 AS gy FROM p
        JOIN p e ON e.pose_id = p.pose_id AND e.r = p.r AND e.c = least(p.c + 1, 7) JOIN p w ON w.pose_id = p.pose_id AND w.r = p.r AND w.c = greatest(p.c - 1, 0)
        JOIN p s ON s.pose_id = p.pose_id AND s.c = p.c AND s.r = least(p.r + 1, 7) JOIN p n ON n.pose_id = p.pose_id AND n.c = p.c AND n.r = greatest(p.r - 1, 0)),
      a AS (SELECT *, sqrt(gx * gx + gy * gy) AS m, (atan2(gy, gx) + CASE WHEN atan2(gy, gx) < 0 THEN pi() ELSE 0 END) AS t FROM d),
      b AS (SELECT *, (CASE WHEN t >= pi() THEN 0 ELSE t END) * 9 / pi() - 0.5::DOUBLE AS z FROM a),
      o AS (SELECT pose_id, r, c, m, [floor(z)::INT, floor(z)::INT + 1] AS bins, [m * (1 - (z - floor(z))), m * (z - floor(z))] AS shares FROM b),
      h AS (SELECT pose_id, r, c, ((bin + 9) % 9) AS bin, sum(share) AS x FROM (SELECT pose_id, r, c, unnest(bins) AS bin, unnest(shares) AS share FROM o) GROUP BY ALL),
      e AS (SELECT pose_id, r, c, sum(x * x) AS x FROM h GROUP BY ALL),
      k AS (SELECT y.pose_id, y.r, y.c, sqrt(sum(e.x) + 1e-6::DOUBLE) AS length FROM (SELECT DISTINCT pose_id, r, c FROM e WHERE r < 7 AND c < 7) y JOIN e ON e.pose_id = y.pose_id AND e.r BETWEEN y.r AND y.r + 1 AND e.c BETWEEN y.c AND y.c + 1 GROUP BY ALL),
      q AS (SELECT h.pose_id, h.r, h.c, h.bin, avg(least(h.x / k.length, 0.2::DOUBLE)) AS x FROM h JOIN k ON k.pose_id = h.pose_id AND h.r BETWEEN k.r AND k.r + 1 AND h.c BETWEEN k.c AND k.c + 1 GROUP BY ALL),
      l AS (SELECT pose_id, sqrt(sum(x * x)) AS l FROM q GROUP BY pose_id)
    SELECT 'vector/' || pose_id AS path, (r * 8 + c) * 9 + bin AS place, round((x / l)::FLOAT::DOUBLE, 5) AS value FROM q JOIN l USING (pose_id) WHERE l > 0 AND round((x / l)::FLOAT::DOUBLE, 5) <> 0"""


_FLAT = "p AS (SELECT p_partkey, 'part/' || p_partkey AS path, (8 + p_partkey % 9)::INT AS w, (6 + p_size % 7)::INT AS h, (p_partkey % 256) / 255 AS light FROM part)"


_TWO_STAGE = f"""WITH {_FLAT}, b AS (SELECT *, unnest(range(0, 3))::INT AS i FROM p), c AS (
              SELECT *, i * w / 4 AS x1, i * w / 4 + w / 2 AS x2 FROM b WHERE i >= 1 AND NOT (i = 2 AND w % 2 = 1)
            ), d AS (SELECT *, trunc(greatest(0::DOUBLE, x1 - (x2 - x1) * 0.1::DOUBLE)) AS l, trunc(least(w::DOUBLE, x2 + (x2 - x1) * 0.1::DOUBLE)) AS r FROM c)
            SELECT path, round(2.5 * (r - l) + 5 * l, 6)::DOUBLE AS sum_x, round(2.5 * h, 6)::DOUBLE AS sum_y, l AS bbox_0, 0.0::DOUBLE AS bbox_1, r - l AS bbox_2, h::DOUBLE AS bbox_3, round(light, 6) AS overall_confidence, i AS person_id FROM d"""


_SCENE = f"""{_FEATURES}, p AS (SELECT pose_id, k // 12 AS y, k % 12 AS x, {', '.join(f"{_PIXEL.format(k='k', c=c)} AS c{c}" for c in range(3))} FROM (SELECT pose_id, v, unnest(range(0, 120)) AS k FROM f))"""


def _resize_sql(width: int, height: int, names: tuple[str, str, str]) -> str:
    def taps(name: str, n_in: int, n_out: int) -> str:
        near, far = "((1.25::DOUBLE * t - 2.25::DOUBLE) * t * t + 1)", "(((-0.75::DOUBLE * t + 3.75::DOUBLE) * t - 6) * t + 3)"
        return f"""{name} AS (SELECT o, least(greatest(i, 0), {n_in - 1}) AS i, CASE WHEN t <= 1 THEN {near} WHEN t < 2 THEN {far} ELSE 0 END AS w
          FROM (SELECT o, i, abs(z - i) AS t FROM (SELECT o, z, floor(z)::INT + unnest([-1, 0, 1, 2]) AS i FROM (SELECT o, (o + 0.5::DOUBLE) * {n_in} / {n_out} - 0.5::DOUBLE AS z FROM (SELECT unnest(range(0, {n_out})) AS o)))))"""

    rows = ", ".join(f"sum(c{c} * w) AS c{c}" for c in range(3))
    out = ", ".join(f"greatest(0, least(255, round_even(sum(c{c} * w), 0)))::BIGINT AS {names[c]}" for c in range(3))
    return f"""WITH {_SCENE}, {taps('ty', 10, height)}, {taps('tx', 12, width)}, r AS (SELECT pose_id, ty.o AS y, x, {rows} FROM p JOIN ty ON ty.i = p.y GROUP BY ALL)
    SELECT 'vector/' || pose_id AS path, y, tx.o AS x, {out} FROM r JOIN tx ON tx.i = r.x GROUP BY pose_id, y, tx.o"""


def _denoise_sql() -> str:
    mirrored = lambda at, n: f"CASE WHEN {at} < 0 THEN -1 - {at} WHEN {at} >= {n} THEN {2 * n - 1} - {at} ELSE {at} END"
    squares = " + ".join(f"(a.c{c} - b.c{c}) ** 2" for c in range(3))
    out = ", ".join(f"round_even(sum(k * c{c}) / sum(k), 0)::BIGINT AS c{c}" for c in range(3))
    return f"""WITH {_SCENE}, g AS (SELECT yy, xx, {mirrored('yy', 10)} AS y, {mirrored('xx', 12)} AS x FROM (SELECT unnest(range(-3, 13)) AS yy) CROSS JOIN (SELECT unnest(range(-3, 15)) AS xx)),
      w AS (SELECT pose_id, yy, xx, c0, c1, c2 FROM p JOIN g USING (y, x)), o AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy) CROSS JOIN (SELECT unnest(range(-2, 3)) AS dx)),
      d AS (SELECT a.pose_id, a.yy, a.xx, dy, dx, {squares} AS d FROM w a CROSS JOIN o JOIN w b ON b.pose_id = a.pose_id AND b.yy = a.yy + dy AND b.xx = a.xx + dx WHERE a.yy BETWEEN -1 AND 10 AND a.xx BETWEEN -1 AND 12),
      s AS (SELECT pose_id, yy + unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) AS y, xx + unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) AS x, dy, dx, d FROM d),
      k AS (SELECT pose_id, y, x, dy, dx, exp(-sum(d) / 27 / 9) AS k FROM s WHERE y BETWEEN 0 AND 9 AND x BETWEEN 0 AND 11 GROUP BY ALL)
    SELECT 'vector/' || k.pose_id AS path, y, x, {out} FROM k JOIN w ON w.pose_id = k.pose_id AND w.yy = y + dy AND w.xx = x + dx GROUP BY k.pose_id, y, x"""


def _contrast_sql() -> str:
    white, xyz = (0.950456, 1.0, 1.088754), ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
    back = np.linalg.inv(np.array(xyz)).tolist()
    n = lambda v: f"({v!r})::DOUBLE"
    linear = ", ".join(f"CASE WHEN c{c} / 255 > {n(0.04045)} THEN pow((c{c} / 255 + {n(0.055)}) / {n(1.055)}, {n(2.4)}) ELSE c{c} / 255 / {n(12.92)} END AS l{c}" for c in range(3))
    t = ", ".join(f"({n(m[0])} * l2 + {n(m[1])} * l1 + {n(m[2])} * l0) / {n(w)} AS t{i}" for i, (m, w) in enumerate(zip(xyz, white, strict=True)))
    f = ", ".join(f"CASE WHEN t{i} > {n(0.008856)} THEN cbrt(t{i}) ELSE {n(7.787)} * t{i} + 16::DOUBLE / 116 END AS f{i}" for i in range(3))
    undone = ", ".join(f"CASE WHEN {e} > {n(0.206893)} THEN pow({e}, 3) ELSE ({e} - 16::DOUBLE / 116) / {n(7.787)} END * {n(w)} AS u{i}" for i, (e, w) in enumerate(zip(("(g + a / 500)", "g", "(g - b / 200)"), white, strict=True)))
    light = ", ".join(f"greatest(0, least(1, {n(m[0])} * u0 + {n(m[1])} * u1 + {n(m[2])} * u2)) AS r{i}" for i, m in enumerate(back))
    out = ", ".join(f"greatest(0, least(255, round_even(255 * CASE WHEN r{i} > {n(0.0031308)} THEN {n(1.055)} * pow(r{i}, 1 / {n(2.4)}) - {n(0.055)} ELSE {n(12.92)} * r{i} END, 0)))::BIGINT AS c{2 - i}" for i in range(3))
    return f"""WITH {_SCENE}, l AS (SELECT *, {linear} FROM p), t AS (SELECT *, {t} FROM l), f3 AS (SELECT *, {f} FROM t),
      m AS (SELECT pose_id, y, x, 500 * (f0 - f1) AS a, 200 * (f1 - f2) AS b, greatest(0, least(255, round_even((116 * f1 - 16) * {n(2.55)}, 0)))::INT AS q FROM f3),
      g AS (SELECT yy // 2 AS ty, xx // 2 AS tx, CASE WHEN yy < 10 THEN yy ELSE 18 - yy END AS y, CASE WHEN xx < 12 THEN xx ELSE 22 - xx END AS x FROM (SELECT unnest(range(0, 16)) AS yy) CROSS JOIN (SELECT unnest(range(0, 16)) AS xx)),
      h AS (SELECT pose_id, ty, tx, list(DISTINCT q) AS levels FROM m JOIN g USING (y, x) GROUP BY ALL),
      i AS (SELECT *, (y + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS zy, (x + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS zx FROM m),
      j AS (SELECT *, greatest(0, least(7, floor(zy)::INT)) AS y0, greatest(0, least(7, floor(zx)::INT)) AS x0 FROM i),
      e AS (SELECT *, greatest(0, least(1, zy - y0)) AS fy, greatest(0, least(1, zx - x0)) AS fx FROM j),
      w AS (SELECT e.*, least(7, y0 + dy) AS ty, least(7, x0 + dx) AS tx, (CASE dy WHEN 1 THEN fy ELSE 1 - fy END) * (CASE dx WHEN 1 THEN fx ELSE 1 - fx END) AS share FROM e CROSS JOIN (SELECT unnest([0, 0, 1, 1]) AS dy, unnest([0, 1, 0, 1]) AS dx)),
      s AS (SELECT w.pose_id, y, x, a, b, sum(share * (len(list_filter(levels, lambda z: z <= q)) + least(q + 1, 4 - len(levels))) * 255 / 4) AS v FROM w JOIN h ON h.pose_id = w.pose_id AND h.ty = w.ty AND h.tx = w.tx GROUP BY ALL),
      o AS (SELECT pose_id, y, x, a, b, (greatest(0, least(255, round_even(v, 0))) / {n(2.55)} + 16) / 116 AS g FROM s), u AS (SELECT *, {undone} FROM o), r AS (SELECT *, {light} FROM u)
    SELECT 'vector/' || pose_id AS path, y, x, {out} FROM r"""


def _batch_sql(measure: str, order: str) -> str:
    return f"""WITH {_FEATURES}, s AS (SELECT q.pose_id AS query_id, f.pose_id, {measure} AS score FROM f, f AS q WHERE q.pose_id % 100 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, pose_id) AS rank FROM s) SELECT query_id, rank, pose_id, round(score, 9) AS similarity_score FROM r WHERE rank <= {K}"""


def _pixels_sql() -> str:
    """file, and the SHA-256 of its pixels (blue, green, red)."""
    byte = " || ".join(f"printf('%02X', {_PIXEL.format(k='k', c=c)}::INT)" for c in range(3))
    return f"""{_FEATURES}, b AS (SELECT pose_id, k, {byte} AS x FROM (SELECT pose_id, v, unnest(range(0, 64)) AS k FROM f)),
      p AS (SELECT pose_id, CASE WHEN pose_id % 2 = 1 THEN 'more/' ELSE '' END || 'v' || pose_id || '.bmp' AS file, sha256(unhex(string_agg(x, '' ORDER BY k))) AS pixels FROM b GROUP BY pose_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "index_cleared": """WITH n AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 2 = 0) AS even FROM embeddings),
            x AS (SELECT n, unnest([{'s': 'built', 'v': 3, 'k': n}, {'s': 'old ones cleared', 'v': 1, 'k': n}, {'s': 'cleared', 'v': 0, 'k': 0}, {'s': 'built anew', 'v': 1, 'k': even}]) AS x FROM n) SELECT x.s AS step, x.v::BIGINT AS n_versions, x.k::BIGINT AS n_total, n FROM x""",
        "detect_model_file": f"""WITH {_SCENE}, m AS (SELECT printf('%.6f', 0.5::DOUBLE + avg(v[1]))::DOUBLE AS least FROM f), l AS (SELECT pose_id, sum(c0 + c1 + c2) / 360 / 255 AS light FROM p GROUP BY pose_id)
            SELECT 'vector/' || pose_id AS path, 30.0::DOUBLE AS sum_x, 25.0::DOUBLE AS sum_y, 0.0::DOUBLE AS bbox_0, 0.0::DOUBLE AS bbox_1, 12.0::DOUBLE AS bbox_2, 10.0::DOUBLE AS bbox_3, round(light, 6) AS overall_confidence, NULL::INT AS person_id FROM l, m WHERE light >= least""",
        "bench_photos": f"""WITH {_FEATURES}, b AS (SELECT pose_id, avg({_PIXEL.format(k='k', c='c')}) / 255 AS light FROM (SELECT pose_id, v, unnest(range(0, 64)) AS k FROM f) CROSS JOIN (SELECT unnest(range(0, 3)) AS c) WHERE pose_id % 2 = 0 GROUP BY pose_id)
            SELECT 'all' AS variant, count(*) AS n_images, count(*) AS n_detected, round(avg(light), 8) AS avg_confidence FROM b UNION ALL SELECT 'bright', count(*), count(*) FILTER (light >= 0.5), round(coalesce(avg(light) FILTER (light >= 0.5), 0), 8) FROM b""",
        "contrast": _contrast_sql(),
        "denoise": _denoise_sql(),
        "upsample_pixels": _resize_sql(19, 16, ("c0", "c1", "c2")),
        "normalize_textured": _resize_sql(16, 12, ("c2", "c1", "c0")),
        "knn_pruned": _batch_sql("list_inner_product(q.v, f.v)", "DESC"),
        "knn_pruned_cosine": _batch_sql("list_cosine_similarity(q.v, f.v)", "DESC"),
        "knn_pruned_l2": _batch_sql("list_distance(q.v, f.v)", "ASC"),
        "store_incremental": """WITH v AS (SELECT vec_id % 2 AS odd, 'image' || vec_id % 40 AS image_path FROM embeddings)
            SELECT image_path, 0::BIGINT AS batch, count(*) AS n FROM v WHERE odd = 0 GROUP BY image_path UNION ALL SELECT image_path, 1, count(*) FROM v WHERE odd = 1 GROUP BY image_path
            UNION ALL SELECT image_path, 2, count(*) FROM v GROUP BY image_path UNION ALL SELECT image_path, -1, 2 * count(*) FROM v GROUP BY image_path""",
        "store_truncate": """WITH n AS (SELECT count(*) AS n, count(DISTINCT vec_id % 40) AS images, count(*) FILTER (vec_id % 3 = 0) AS visual FROM embeddings),
            x AS (SELECT unnest([{'t': 'images', 'a': images, 'b': images, 'c': images}, {'t': 'pose_detections', 'a': n, 'b': n, 'c': 0}, {'t': 'geometric_features', 'a': n, 'b': n, 'c': 0}, {'t': 'visual_features', 'a': visual, 'b': 0, 'c': 0}, {'t': 'fused_features', 'a': n, 'b': n, 'c': 0}]) AS x FROM n)
            SELECT unnest([0, 1, 2])::BIGINT AS at, x.t AS table_name, unnest([x.a, x.b, x.c])::BIGINT AS n_rows FROM x""",
        "index_versions": """WITH n AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 2 = 0) AS even, min(len(embedding))::INT AS a, max(len(embedding))::INT AS b FROM embeddings),
            x AS (SELECT a, b, unnest([{'r': 'before', 'n': even}, {'r': 'not rebuilt', 'n': even}, {'r': 'rebuilt', 'n': n}, {'r': 'appended', 'n': 2 * n - even}, {'r': 'appended once', 'n': 2 * n - even}, {'r': 'now', 'n': 2 * n - even}]) AS x FROM n)
            SELECT x.r AS reader, x.n::BIGINT AS n_total, a AS dim_min, b AS dim_max FROM x""",
        "directory_scan": f"""WITH {_pixels_sql()} SELECT 'glob' AS scan, file, 8::BIGINT AS height, 8::BIGINT AS width, pixels FROM p WHERE pose_id % 2 = 0 UNION ALL SELECT 'recursive', file, 8, 8, pixels FROM p
            UNION ALL SELECT 'files', file, 54 + 192, NULL, NULL FROM p""",
        "incremental_scan": f"WITH {_pixels_sql()} SELECT (pose_id % 2)::BIGINT AS run, file, pixels FROM p",
        "index_photos": "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT 'run 0' AS what, n AS n_total, NULL::INT AS dim_min, NULL::INT AS dim_max FROM n UNION ALL SELECT 'run 1', 0, NULL, NULL UNION ALL SELECT 'index', n, 628, 628 FROM n",
        "geometric_features": _geometric_sql(),
        "visual_features": _visual_sql(),
        "knn_l2_inverse": _knn_sql("list_distance(v, qv)", "ASC", "1 / (1 + score / 2)"),
        "knn_l2_exponential": _knn_sql("list_distance(v, qv)", "ASC", "exp(-score / 2)"),
        "knn_report": f"""WITH {_FEATURES}, q AS (SELECT v AS qv FROM f WHERE pose_id = 7), s AS (SELECT pose_id, list_cosine_similarity(v, qv) AS score FROM f, q)
            SELECT row_number() OVER (ORDER BY score DESC, pose_id) AS rank, 'photos/' || pose_id AS image_path, printf('%.3f', score) AS similarity_score FROM s ORDER BY score DESC, pose_id LIMIT {K}""",
        "index_swap": """WITH j AS (SELECT embedding AS v FROM embeddings JOIN events ON vec_id = event_id JOIN customer ON user_id = c_custkey)
            SELECT 'fused' AS features, count(*) AS n_total, min(len(v))::INT AS dim_min, max(len(v))::INT AS dim_max FROM j UNION ALL SELECT 'geometric', count(*), min(len(v[1:52]))::INT, max(len(v[1:52]))::INT FROM j""",
        "ensemble_partial": f"""WITH {_FEATURES}, p AS (SELECT pose_id // 4 AS image_id, CASE WHEN pose_id % 2 = 1 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS w, v, unnest(range(0, 32)) AS k FROM f WHERE pose_id % 5 <> 0 AND pose_id // 2 % 2 = 0)
            SELECT image_id, k, round(sum(v[k * 2 + 1] * w) / sum(w), 8) AS x, round(sum(v[k * 2 + 2] * w) / sum(w), 8) AS y, round(sum(abs(v[k * 2 + 1]) * w) / sum(w), 8) AS visibility FROM p GROUP BY image_id, k""",
        "detect_plain": f"""WITH {_FLAT} SELECT path, round(2.5 * w, 6)::DOUBLE AS sum_x, round(2.5 * h, 6)::DOUBLE AS sum_y, 0.0::DOUBLE AS bbox_0, 0.0::DOUBLE AS bbox_1, w::DOUBLE AS bbox_2, h::DOUBLE AS bbox_3,
            round(light, 6) AS overall_confidence, NULL::INT AS person_id FROM p WHERE light >= 0.25""",
        "detect_two_stage": _TWO_STAGE,
        "detect_two_stage_batched": f"""WITH {_SCENE}, b AS (SELECT i, i * 3.0::DOUBLE AS x1, i * 3.0::DOUBLE + 6 AS x2 FROM (SELECT unnest([1, 2])::INT AS i)),
            k AS (SELECT i, trunc(greatest(0::DOUBLE, x1 - (x2 - x1) * 0.1::DOUBLE)) AS l, trunc(least(12::DOUBLE, x2 + (x2 - x1) * 0.1::DOUBLE)) AS r FROM b)
            SELECT 'vector/' || pose_id AS path, round(2.5 * (r - l) + 5 * l, 6)::DOUBLE AS sum_x, 25.0::DOUBLE AS sum_y, l AS bbox_0, 0.0::DOUBLE AS bbox_1, r - l AS bbox_2, 10.0::DOUBLE AS bbox_3,
              round(sum(c0 + c1 + c2) / count(*) / 3 / 255, 6) AS overall_confidence, i AS person_id FROM p JOIN k ON x >= l AND x < r GROUP BY pose_id, i, l, r""",
        "detect_ensemble": f"""WITH {_FLAT} SELECT path, round(2.5 * w + CASE WHEN light >= 0.5 THEN 2.5 ELSE 0 END, 6)::DOUBLE AS sum_x, round(2.5 * h, 6)::DOUBLE AS sum_y, 0.0::DOUBLE AS bbox_0, 0.0::DOUBLE AS bbox_1, w::DOUBLE AS bbox_2, h::DOUBLE AS bbox_3,
            round(light, 6) AS overall_confidence, NULL::INT AS person_id FROM p WHERE light >= 0.25""",
        "detect_persons": f"""WITH {_FLAT}, b AS (SELECT *, unnest(range(0, 3)) AS box_idx FROM p)
            SELECT path, box_idx, box_idx * w / 4 AS x1, 0.0::DOUBLE AS y1, box_idx * w / 4 + w / 2 AS x2, h::DOUBLE AS y2, [0.2::DOUBLE, 0.3::DOUBLE, 0.9::DOUBLE][box_idx + 1] AS conf, (box_idx = 2 AND w % 2 = 1)::BIGINT AS cls FROM b""",
        "normalize_image": f"""WITH {_FLAT} SELECT path, 16::BIGINT AS width, 12::BIGINT AS height, (16 * 12 * 3)::BIGINT AS n_bytes, printf('%02X', p_partkey % 256) AS first, round(16 / w, 9) AS scale_x, round(12 / h, 9) AS scale_y FROM p""",
        "image_metadata": f"WITH {_FLAT} SELECT path, w AS width, h AS height FROM p",
        "store_counts": """WITH v AS (SELECT count(*) AS n, count(DISTINCT vec_id % 100) AS images, count(*) FILTER (vec_id % 3 = 0) AS visual FROM embeddings)
            SELECT x.t AS table_name, x.n::BIGINT AS n_rows FROM (SELECT unnest([{'t': 'stored 1', 'n': n}, {'t': 'stored 2', 'n': 0}, {'t': 'images', 'n': images}, {'t': 'pose_detections', 'n': n}, {'t': 'geometric_features', 'n': n}, {'t': 'visual_features', 'n': visual},
              {'t': 'fused_features', 'n': n}, {'t': 'index', 'n': n}]) AS x FROM v)""",
        "bench_report": """WITH r AS (SELECT event_type AS variant, value < 20 AS detected, value AS c, (event_id % 100) / 50 AS t FROM events),
            s AS (SELECT variant, count(*) AS n_images, count(*) FILTER (detected) AS n_detected, coalesce(avg(c) FILTER (detected), 0) AS conf, coalesce(sum(t) FILTER (detected), 0) / count(*) AS time, coalesce(avg(t) FILTER (detected), 0) AS hit FROM r GROUP BY variant)
            SELECT variant, n_images, n_detected, printf('%.3f', conf) AS avg_confidence, printf('%.3f', time) AS avg_time, round(hit / nullif((SELECT hit FROM s WHERE variant = 'click'), 0), 3) AS slowdown FROM s""",
        "knn_single": _knn_sql("list_cosine_similarity(v, qv)", "DESC"),
        "knn_dot": _knn_sql("list_inner_product(v, qv)", "DESC"),
        "knn_l2": _knn_sql("list_distance(v, qv)", "ASC"),
        "knn_batch": f"""WITH {_FEATURES}, s AS (SELECT q.pose_id AS query_id, f.pose_id, list_inner_product(q.v, f.v) AS score FROM f, f AS q WHERE q.pose_id % 100 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pose_id) AS rank FROM s)
            SELECT query_id, rank, pose_id, round(score, 9) AS similarity_score FROM r WHERE rank <= {K}""",
        "index_build": """SELECT vec_id AS pose_id, value AS overall_confidence, c_name AS file_path, len(embedding) AS dim FROM embeddings JOIN events ON vec_id = event_id JOIN customer ON user_id = c_custkey
            ORDER BY ts, vec_id""",
        "index_stats": "SELECT count(*) AS n_total, min(len(embedding))::INT AS dim_min, max(len(embedding))::INT AS dim_max FROM embeddings",
        "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("events", "part", "embeddings")),
        "l2_normalize": f"""WITH {_FEATURES}, g AS (SELECT pose_id, list_transform(v, lambda x: x * 3) AS v FROM f), n AS (SELECT pose_id, v, sqrt(list_inner_product(v, v)) AS n FROM g)
            SELECT pose_id, round(v[1] / n, 9) AS first, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total FROM n""",
        "fuse_features": f"""WITH {_FEATURES}, x AS (SELECT a.pose_id, list_concat(a.v[1:52], b.v) AS x FROM f AS a JOIN f AS b ON b.pose_id = a.pose_id + 1)
            SELECT pose_id, len(x) AS dim, round(list_inner_product(x, x), 6) AS squared_norm FROM x""",
        "box_filter": """WITH n AS (SELECT user_id AS image_id, event_id, (event_id % 10) / 10 AS conf, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS box_idx FROM events)
            SELECT image_id, event_id, box_idx, conf FROM n WHERE event_type = 'click' AND conf >= 0.3::DOUBLE""",
        "crop_bounds": """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity * 10 AS x1, l_discount * 1000 AS y1, l_quantity * 10 + l_tax * 2000 AS x2, l_discount * 1000 + l_quantity * 7.3::DOUBLE AS y2, l_discount * 10 AS conf FROM lineitem)
            SELECT l_orderkey, l_linenumber, trunc(greatest(0::DOUBLE, x1 - (x2 - x1) * 0.1::DOUBLE))::INT AS x1_pad, trunc(greatest(0::DOUBLE, y1 - (y2 - y1) * 0.1::DOUBLE))::INT AS y1_pad,
              trunc(least(480::DOUBLE, x2 + (x2 - x1) * 0.1::DOUBLE))::INT AS x2_pad, trunc(least(320::DOUBLE, y2 + (y2 - y1) * 0.1::DOUBLE))::INT AS y2_pad
            FROM b WHERE conf >= 0.3::DOUBLE""",
        "map_back": f"""WITH {_FEATURES} SELECT pose_id, (pose_id % 3)::INT AS person_id,
              round(list_sum(list_transform(range(0, 32), lambda i: v[i * 2 + 1] + (pose_id % 640))), 6) AS sum_x, round(list_sum(list_transform(range(0, 32), lambda i: v[i * 2 + 2] + (pose_id % 480))), 6) AS sum_y,
              round(v[1] + (pose_id % 640), 9) AS bbox_0, round(v[2] + (pose_id % 480), 9) AS bbox_1, round(v[3], 9) AS bbox_2, round(v[4], 9) AS bbox_3 FROM f""",
        "upsample_dims": """WITH p AS (SELECT p_partkey, p_size * 16 AS w, 40 + p_partkey % 600 AS h FROM part), s AS (SELECT *, CASE WHEN least(w, h) < 512 THEN 512::DOUBLE / least(w, h) ELSE 1::DOUBLE END AS scale FROM p)
            SELECT p_partkey, trunc(w * scale)::INT AS new_w, trunc(h * scale)::INT AS new_h FROM s""",
        "ensemble_weighted": _ensemble_sql("weighted_average"),
        "ensemble_confidence": _ensemble_sql("confidence_weighted"),
        "ensemble_weighted_pose": _pose_sql("weighted_average"),
        "ensemble_confidence_pose": _pose_sql("confidence_weighted"),
        "bench_summary": """WITH r AS (SELECT event_type, value < 20 AS detected, value AS c, (event_id % 100) / 50 AS t FROM events)
            SELECT event_type, count(*) AS n_images, count(*) FILTER (detected) AS n_detected, round(coalesce(avg(c) FILTER (detected), 0), 6) AS avg_confidence,
              round(coalesce(sum(t) FILTER (detected), 0) / count(*), 6) AS avg_time, round(coalesce(avg(t) FILTER (detected), 0), 6) AS avg_time_detected FROM r GROUP BY event_type""",
        "slowdown_ratio": """WITH r AS (SELECT user_id, value AS t, event_id % 2 = 1 AS v FROM events)
            SELECT user_id, round(avg(t) FILTER (v) / nullif(avg(t) FILTER (NOT v), 0), 6) AS slowdown, round(avg(t) FILTER (NOT v), 6) AS conf_single, round(avg(t) FILTER (v), 6) AS conf_variant FROM r GROUP BY user_id""",
    }
