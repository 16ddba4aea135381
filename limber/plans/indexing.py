"""Whole jobs over a directory of images: index it, detect in it, search it, compare detectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limber.operators import bench, detect, features, index, knn
from limber.sources import images, store

#: From detections (path, the pose's fields) joined with their images to the same with a vector column added.
Extractor = Callable[[DataFrame], DataFrame]


def detected(
    spark: SparkSession, directory: str, poses: detect.Factory, *, recursive: bool = False, glob: str | None = None, preprocess: bool = False, with_denoise: bool = True, target_size: tuple[int, int] | None = None, texture: bool = False, **how
) -> DataFrame:
    """Poses of all images of a directory, with the images' own image_width and image_height and, if asked for, their texture (column visual).

    Each image is read, described, enhanced, resized and searched in maps of one
    stage. Coordinates are those of the image as read: where it was made larger
    or smaller for the detector, they are scaled back.
    """
    return detected_in(_sized(images.scan_images(spark, directory, recursive, glob)), poses, preprocess=preprocess, with_denoise=with_denoise, target_size=target_size, texture=texture, **how)


def _sized(scanned: DataFrame) -> DataFrame:
    """The images with their own size beside what later stages make of it."""
    return scanned.withColumns({"image_width": F.col("width"), "image_height": F.col("height")})


def detected_in(scanned: DataFrame, poses: detect.Factory, *, preprocess: bool = False, with_denoise: bool = True, target_size: tuple[int, int] | None = None, texture: bool = False, **how) -> DataFrame:
    """:func:`detected`, of images (with image_width and image_height) at hand."""
    seen = ("image_width", "image_height", *(["visual"] if texture else []))
    if texture:
        scanned = features.visual_features(scanned, tuple(scanned.columns))
    if preprocess:
        ready = images.preprocess_images(scanned, with_denoise, target_size)
    elif target_size:
        ready = images.normalize_images(scanned, target_size, convert_to_rgb=False)  # detectors turn BGR into RGB
    else:
        return detect.detect(scanned, poses, carry=seen, **how)
    found = detect.detect(ready, poses, carry=(*seen, "scale_x", "scale_y"), **how)
    x, y = F.col("scale_x"), F.col("scale_y")
    by_place = lambda v: F.transform(v, lambda c, i: F.when(i % 2 == 0, c / x).otherwise(c / y))
    point = lambda p: F.transform(p, lambda c, i: F.when(i == 0, c / x).when(i == 1, c / y).otherwise(c))
    return found.withColumns({"keypoints": F.transform("keypoints", point), "bbox": by_place("bbox")}).drop("scale_x", "scale_y")


def described(found: DataFrame, geometric: Extractor = features.geometric_features, visual: Extractor | None = None, texture: bool = True) -> DataFrame:
    """Poses found (with their images' visual if ``texture``) as the store takes them, with geometric, visual and fused vectors: what is indexed, and what is asked for.

    Without ``visual`` the vector of the image's own texture is taken, or, with ``texture`` off, none.
    """
    found = geometric(found)
    if visual or not texture:
        found = visual(found) if visual else found.withColumn("visual", F.lit(None).cast("array<double>"))
    return features.fused_features(found).select(
        F.col("path").alias("image_path"), F.col("image_width").alias("width"), F.col("image_height").alias("height"), "det_idx", "person_id", "keypoints", "visibility", "bbox", "overall_confidence",
        F.current_timestamp().alias("created_at"), "geometric", "visual", "fused",
    )


def query_vectors(spark: SparkSession, directory: str, poses: detect.Factory, geometric: Extractor = features.geometric_features, visual: Extractor | None = None, texture: bool = True, **how) -> DataFrame:
    """What an index made by :func:`index_directory` with the same arguments can be asked for: the vectors of the poses in a directory's images (or in one image)."""
    own = texture and visual is None
    return described(detected(spark, directory, poses, texture=own, **how), geometric, visual, own)


def index_directory(
    spark: SparkSession, directory: str, root: str, poses: detect.Factory, geometric: Extractor = features.geometric_features, visual: Extractor | None = None, texture: bool = True, state: str | None = None, recursive: bool = False, glob: str | None = None, **how
) -> DataFrame:
    """Detect, extract, fuse and store; one row: poses_indexed, those that were not stored before.

    Extractors other than the library's add a column geometric or visual. With
    ``state``, a folder that remembers which files were indexed, files that have
    not changed since are not opened.
    """
    own = texture and visual is None
    look = lambda scanned: described(detected_in(_sized(scanned), poses, texture=own, **how), geometric, visual, own)
    rows, mark = images.scan_new_images(spark, directory, state, recursive, glob, look) if state else (look(images.scan_images(spark, directory, recursive, glob)), lambda: 0)
    stored = store.store_detections(rows, root)
    mark()
    return stored.agg(F.count(F.lit(1)).alias("poses_indexed"))


def build_search_index(spark: SparkSession, root: str, path: str, table: str = "fused_features", force_rebuild: bool = False) -> DataFrame:
    """The index over one of the store's feature tables."""
    now = store.snapshot(spark, root)
    rows = index.index_rows(*(now.read(spark, t) for t in (table, "pose_detections", "images")))
    return index.build_index(rows, path, force_rebuild)


def search_report(found: DataFrame) -> DataFrame:
    """rank, image_path and the score to three decimals, as text."""
    return found.select("rank", F.col("file_path").alias("image_path"), F.format_string("%.3f", "similarity_score").alias("similarity_score"))


def search(index_rows: DataFrame, query: list[float], k: int = 5, metric: str = "cosine", mapping: str | None = None, scale: float = 1.0) -> DataFrame:
    return search_report(knn.search_similar(index_rows.select("pose_id", "feature_vector", "file_path"), query, k, metric, mapping=mapping, scale=scale))


def image_runs(scanned: DataFrame, poses: DataFrame) -> DataFrame:
    """One row an image: path, detected, confidence (of its first pose) and elapsed_s (of the detector over the image; null where it found nothing)."""
    first = poses.groupBy("path").agg(F.min_by("overall_confidence", F.struct(F.coalesce("person_id", F.lit(0)), "det_idx")).alias("confidence"), F.max("elapsed_s").alias("elapsed_s"))
    return scanned.select("path").join(first, "path", "left").select("path", F.col("confidence").isNotNull().alias("detected"), "confidence", "elapsed_s")


def benchmark(spark: SparkSession, directory: str, variants: dict[str, Callable[[DataFrame], DataFrame]], glob: str = "*.jpg") -> DataFrame:
    """Each variant (a function from images to poses) run over the directory: variant, n_images, n_detected, avg_confidence, avg_time, avg_time_detected.

    An image is timed in the task that searches it, around the detector alone.
    """
    scanned = images.scan_images(spark, directory, glob=glob)
    runs = [image_runs(scanned, run(scanned)).withColumn("variant", F.lit(name)) for name, run in variants.items()]
    return bench.bench_summary(reduce(DataFrame.unionByName, runs), "variant")


def benchmark_report(summary: DataFrame, baseline: str) -> DataFrame:
    """The summary as text to three decimals, and each variant's mean time over that of ``baseline`` (null if it found nothing)."""
    text = lambda c: F.format_string("%.3f", c)
    base = summary.where(F.col("variant") == baseline).select(F.col("avg_time_detected").alias("base_time"))
    with_base = summary.join(F.broadcast(base), how="left")  # one row at most
    slowdown = F.try_divide(F.col("avg_time_detected"), F.nullif("base_time", F.lit(0.0)))
    return with_base.select("variant", "n_images", "n_detected", text("avg_confidence").alias("avg_confidence"), text("avg_time").alias("avg_time"), F.round(slowdown, 3).alias("slowdown"))
