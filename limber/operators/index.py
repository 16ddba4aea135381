"""The vector index: the fused features joined with their poses and images, kept as a table of versions.

Edge cases: rows with a null key drop out of the joins; a repeated feature, pose
or image row repeats the index row; null vectors are kept, have no dimension
(null) and are no neighbours; an index of no rows has null dimensions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from limber.session import delete_path
from limber.sources import versions


def index_rows(features: DataFrame, poses: DataFrame, images: DataFrame) -> DataFrame:
    """pose_id, feature_vector, overall_confidence, file_path, created_at. Inner joins: poses without a feature row, or features without a pose or image, drop out. ``features`` may be any of the feature tables."""
    p = poses.select(F.col("id").alias("pose_id"), "image_id", "overall_confidence", "created_at")
    i = images.select(F.col("id").alias("image_id"), "file_path")
    return features.select("pose_id", "feature_vector").join(p, "pose_id").join(i, "image_id").select("pose_id", "feature_vector", "overall_confidence", "file_path", "created_at")


def in_build_order(rows: DataFrame) -> DataFrame:
    """By created_at and, where that ties, pose_id. Only for output whose order is read; searches need none."""
    return rows.orderBy("created_at", "pose_id")


def index_stats(index: DataFrame) -> DataFrame:
    """n_total, dim_min, dim_max."""
    return index.agg(F.count(F.lit(1)).alias("n_total"), F.min(F.size("feature_vector")).alias("dim_min"), F.max(F.size("feature_vector")).alias("dim_max"))


def read_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The index as it is now, or an older version that has not been cleared. What is returned stays readable while the index is rebuilt."""
    number, content = versions.read_version(spark, path, version)
    if not content:
        raise FileNotFoundError(f"there is no index at {path}")
    return spark.read.schema(StructType.fromJson(content["schema"])).parquet(*[f"{path}/data/{f}" for f in content["folders"]])


def _write_rows(rows: DataFrame, path: str) -> tuple[str, Row]:
    """A folder with the rows, and their stats; vectors of different dimensions are an error."""
    spark, folder = rows.sparkSession, f"rows-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/data/{folder}")
    stats = index_stats(spark.read.schema(rows.schema).parquet(f"{path}/data/{folder}")).head()
    if stats["n_total"] and stats["dim_min"] != stats["dim_max"]:
        delete_path(spark, f"{path}/data/{folder}")
        raise ValueError(f"vectors of {stats['dim_min']} to {stats['dim_max']} dimensions in one index")
    return folder, stats


def build_index(rows: DataFrame, path: str, force_rebuild: bool = False) -> DataFrame:
    """Write the index unless it is there; ``force_rebuild`` puts a new version in its place.

    The rows are written under a name of their own, and only then does the
    version log name them, so readers see one whole version at any time, and
    ``rows`` may come from the index itself. Of two jobs that build at once the
    later one's version stands, or, without ``force_rebuild``, the earlier one's.
    """
    spark = rows.sparkSession
    number, content = versions.read_version(spark, path)
    if content and not force_rebuild:
        return read_index(spark, path, number)
    folder, stats = _write_rows(rows, path)
    while True:
        try:
            number = versions.commit(spark, path, number, {"folders": [folder], "schema": rows.schema.jsonValue(), "dim": stats["dim_min"], "tokens": {}})
            return read_index(spark, path, number)
        except versions.Conflict:
            number, _ = versions.read_version(spark, path)
            if not force_rebuild:
                delete_path(spark, f"{path}/data/{folder}")
                return read_index(spark, path, number)


def append_index(rows: DataFrame, path: str, token: tuple[str, int] | None = None) -> DataFrame:
    """Add rows to the index as a new version, or make it of them; returns that version.

    A token (a source's name and a number that grows with each of its batches)
    makes this safe to repeat: a batch whose number is not above the last one of
    its source is not added again.
    """
    spark, folder = rows.sparkSession, None
    while True:
        number, content = versions.read_version(spark, path)
        tokens = dict(content.get("tokens", {}))
        if token and tokens.get(token[0], -1) >= token[1]:
            if folder:
                delete_path(spark, f"{path}/data/{folder}")
            return read_index(spark, path, number)
        if folder is None:
            folder, stats = _write_rows(rows, path)
        dim = content.get("dim")
        if None not in (dim, stats["dim_min"]) and dim != stats["dim_min"]:
            delete_path(spark, f"{path}/data/{folder}")
            raise ValueError(f"vectors of {stats['dim_min']} dimensions for an index of {dim}")
        new = {"folders": [*content.get("folders", []), folder], "schema": content.get("schema") or rows.schema.jsonValue(), "dim": stats["dim_min"] if dim is None else dim, "tokens": tokens | ({token[0]: token[1]} if token else {})}
        try:
            return read_index(spark, path, versions.commit(spark, path, number, new))
        except versions.Conflict:
            continue


def clear_old_versions(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete all but the newest ``keep`` versions, and what broken-off builds left; nothing may be building, or reading older ones, meanwhile."""
    newest = versions.versions(spark, path)[-keep:]
    return versions.clear(spark, path, {f for v in newest for f in versions.read_version(spark, path, v)[1]["folders"]}, keep)


def clear_index(spark: SparkSession, path: str) -> None:
    """Delete the index's files."""
    delete_path(spark, path)
