"""One pose from the poses that several models found in an image.

Input rows: image, model_idx, weight, det_idx, keypoints, visibility, bbox,
overall_confidence, person_id. Of each model the first pose (det_idx 0) counts;
a model without a pose has no row and no weight. The box and person id are
those of the first model that has a pose.

Both fusions are grouped sums over (image, keypoint, coordinate), so partial
sums are combined map-side. All coordinates are fused, x, y and what follows.

Edge cases: a null weight is 1; where all weights are 0 the fused values are
null (weighted_average) or 0 (confidence_weighted, visibility null); a null
coordinate or visibility adds nothing; a repeated row counts twice; rows of a
null image are one image; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-6
DEFAULT_WEIGHT = 1.0


@dataclass(frozen=True)
class EnsembleConfig:
    """``weights`` by model_idx; ``min_agreement`` is carried for compatibility and has no effect."""

    weights: tuple[float, ...] = (1.0, 1.2)
    fusion_method: str = "confidence_weighted"
    min_agreement: float = 0.5


def first_poses(poses: DataFrame) -> DataFrame:
    return poses.where("det_idx = 0").withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(DEFAULT_WEIGHT)))


def fused_points(poses: DataFrame, method: str, image_col: str = "image_id") -> DataFrame:
    """The long form, one row a keypoint: image, k (from 0), x, y, visibility and coords (all coordinates)."""
    points = first_poses(poses).select(image_col, "weight", F.posexplode(F.arrays_zip("keypoints", "visibility")).alias("k", "p"))
    w, vis = F.col("weight"), F.col("p.visibility").cast("double")
    seen = F.try_divide(F.sum(vis * w), F.sum(w))
    if method == "weighted_average":
        use, divide = w, F.sum(w)
    elif method == "confidence_weighted":
        use, divide = vis * w, F.sum(vis * w) + F.lit(EPSILON)
    else:
        raise ValueError(f"unknown fusion method: {method}")
    each = points.select(image_col, "k", w.alias("weight"), "p", F.posexplode("p.keypoints").alias("c", "value"))
    fused = each.groupBy(image_col, "k", "c").agg(F.try_divide(F.sum(F.col("value").cast("double") * use), divide).alias("value"), seen.alias("visibility"))
    by_point = fused.groupBy(image_col, "k").agg(F.array_sort(F.collect_list(F.struct("c", "value", "visibility"))).alias("all"))
    coords = F.transform("all", lambda v: v["value"])
    return by_point.select(
        image_col, "k", F.get(coords, F.lit(0)).alias("x"), F.get(coords, F.lit(1)).alias("y"), F.get("all", F.lit(0))["visibility"].alias("visibility"), coords.alias("coords")
    )


def fuse_poses(poses: DataFrame, method: str = "confidence_weighted", image_col: str = "image_id", carry: dict[str, Column] | None = None, tasks: int | None = None) -> DataFrame:
    """At most one pose per image: keypoints, visibility, bbox, overall_confidence, person_id. Models must agree on the number of keypoints.

    ``carry`` adds columns, each an aggregate over the image's first poses. With
    ``tasks`` the images are dealt over so many tasks, which do all that follows:
    the number of poses a task holds is then the caller's choice.
    """
    carry = carry or {}
    poses = poses.withColumn("of", F.struct(F.col(image_col).alias("image")))  # never null itself, so that it deals and joins rows of a null image too
    poses = poses if tasks is None else poses.repartition(tasks, "of")
    first = first_poses(poses)
    points = fused_points(poses, method, "of").groupBy("of").agg(F.array_sort(F.collect_list(F.struct("k", "coords", "visibility"))).alias("points"))
    about = first.groupBy("of").agg(
        F.min_by(F.struct("bbox", "person_id"), "model_idx").alias("base"),
        F.avg("overall_confidence").alias("mean_confidence"),
        F.min(F.size("keypoints")).alias("fewest"),
        F.max(F.size("keypoints")).alias("most"),
        *[c.alias(name) for name, c in carry.items()],
    )
    agreed = F.when(F.col("fewest") == F.col("most"), F.lit(True)).otherwise(F.raise_error(F.lit("models disagree on the number of keypoints")).cast("boolean"))
    visibility = F.transform("points", lambda p: p["visibility"])
    mean_visibility = F.try_divide(F.aggregate(visibility, F.lit(0.0), lambda a, x: a + x), F.size("points"))
    return (
        about.where(agreed)
        .join(points.hint("merge"), "of")
        .select(
            F.col("of.image").alias(image_col),
            F.transform("points", lambda p: p["coords"]).alias("keypoints"),
            visibility.alias("visibility"),
            F.col("base.bbox").alias("bbox"),
            (F.col("mean_confidence") if method == "weighted_average" else mean_visibility).alias("overall_confidence"),
            F.col("base.person_id").alias("person_id"),
            *carry,
        )
    )
