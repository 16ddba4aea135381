"""The feature store: five Parquet tables under one folder, changed by whole commits.

A batch writes its rows of all five tables into a folder of its own and then
commits: the commit names the folders that each table consists of. So a batch
is in all tables or in none, whatever breaks off between them, and a reader
that took a snapshot goes on reading it while others store or truncate.

Ids are hashes of content: an image's of its path, a pose's of its path,
person, place in the detector's output and everything the detector said of it.
What is stored already is left alone, so any job can run again.

Edge cases: a null vector gives no feature row; a null image path is an image of
its own; detections alike in all that an id is made of are numbered, and each
is kept; no detections store nothing, and make no commit; other columns than
the store's are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limber.session import delete_path
from limber.sources import versions

VECTORS = ("geometric_features", "visual_features", "fused_features")
TABLES = ("images", "pose_detections", *VECTORS)
#: Tables that are emptied along with a table, by name.
DEPENDANTS = {"images": TABLES[1:], "pose_detections": VECTORS}

SCHEMAS = {
    "images": "id string, file_path string, width int, height int",
    "pose_detections": "id string, image_id string, overall_confidence double, created_at timestamp, person_id int, det_idx int, keypoints array<array<double>>, visibility array<double>, bbox array<double>",
} | dict.fromkeys(VECTORS, "pose_id string, feature_vector array<float>")
#: What a pose's id is made of, beside the number among poses alike.
CONTENT = ("image_path", "person_id", "det_idx", "keypoints", "visibility", "bbox", "overall_confidence")
#: A commit that others were faster than is tried again so many times.
TRIES = 20


@dataclass(frozen=True)
class Snapshot:
    """A version of the store: the folders of each table."""

    root: str
    version: int
    tables: dict[str, list[str]]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """A table as it was at this version; empty if it had nothing."""
        if name not in SCHEMAS:
            raise ValueError(f"the store has no table {name}")
        folders = [f"{self.root}/data/{f}/{name}" for f in self.tables.get(name, [])]
        return spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else spark.createDataFrame([], SCHEMAS[name])


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The newest version of the store, or an older one that has not been cleared."""
    number, content = versions.read_version(spark, root, version)
    return Snapshot(root, number, content)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the store's tables as it is now; several that must agree are read from one :func:`snapshot`."""
    return snapshot(spark, root).read(spark, name)


def _digest(*parts: Column) -> Column:
    """128 bits, as hexadecimal text, of values of which any may be null: no two of 10^12 poses are likely to meet."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 32)


def _identified(detections: DataFrame) -> DataFrame:
    """The detections with image_id and pose_id, those alike numbered.

    They are counted with a map-side combine and multiplied again, so that no
    task gathers them; of what they may differ in (created_at, vectors, size)
    one row's is taken for all.
    """
    have = {c.lower() for c in detections.columns}
    det_idx = (F.col("det_idx") if "det_idx" in have else F.lit(None)).cast("int").alias("det_idx")
    fields = ("image_path", "width", "height", "person_id", "keypoints", "visibility", "bbox", "overall_confidence", "created_at", "geometric", "visual", "fused")
    rows = detections.select(*fields, det_idx).withColumn("content", _digest(*[F.col(c).alias(c) for c in CONTENT]))
    whole = F.struct(*[F.col(c) for c in (*fields, "det_idx")])
    order = F.struct("created_at", *[F.to_json(F.struct(c)) for c in ("geometric", "visual", "fused")], "width", "height")
    alike = rows.groupBy("content").agg(F.min_by(whole, order).alias("row"), F.count(F.lit(1)).alias("n"))
    numbered = alike.select("content", "row.*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("number"))
    pose_id = F.when(F.col("number") == 1, F.col("content")).otherwise(_digest(F.col("content").alias("content"), F.col("number").alias("number")))
    return numbered.select("*", _digest(F.col("image_path").alias("image_path")).alias("image_id"), pose_id.alias("pose_id"))


def _parts(rows: DataFrame) -> dict[str, DataFrame]:
    """What the rows are in each table."""
    parts = {
        "images": rows.groupBy(F.col("image_id").alias("id")).agg(F.min("image_path").alias("file_path"), F.max("width").cast("int").alias("width"), F.max("height").cast("int").alias("height")),
        "pose_detections": rows.select(F.col("pose_id").alias("id"), "image_id", "overall_confidence", "created_at", "person_id", "det_idx", "keypoints", "visibility", "bbox"),
    }
    for name in VECTORS:
        v = F.col(name.removesuffix("_features"))
        parts[name] = rows.where(v.isNotNull()).select("pose_id", v.cast("array<float>").alias("feature_vector"))
    return parts


def _write_batch(rows: DataFrame, base: Snapshot, folder: str) -> bool:
    """Write what ``base`` lacks of the rows; whether that is anything. Only what a commit names counts."""
    spark = rows.sparkSession
    path = f"{base.root}/data/{folder}"

    def lacking(part: DataFrame, name: str) -> DataFrame:
        """The rows whose id the store lacks. What it has is met with the batch first, so that ids of a large store need no shuffle where the batch can be broadcast."""
        known = base.read(spark, name).select("id").join(part.select("id"), "id", "left_semi")
        return part.join(known, "id", "left_anti")

    fresh = lacking(rows.withColumnRenamed("pose_id", "id"), "pose_detections").withColumnRenamed("id", "pose_id")
    fresh.write.parquet(f"{path}/rows")
    fresh = spark.read.schema(fresh.schema).parquet(f"{path}/rows")
    if fresh.isEmpty():
        return False
    for name, part in _parts(fresh).items():
        (lacking(part, name) if name == "images" else part).write.parquet(f"{path}/{name}")
    delete_path(spark, f"{path}/rows")
    return True


def store_detections(detections: DataFrame, root: str) -> DataFrame:
    """Store the detections that are not stored yet, and their features, in one commit; returns pose_id and image_path of those.

    Input: image_path, width, height, the pose's columns (det_idx if there is
    one), created_at, and geometric, visual and fused vectors. Models run once:
    the detections are written before anything is compared. If others commit
    meanwhile, what they stored is compared again.
    """
    spark = detections.sparkSession
    batch = f"{root}/data/input-{uuid.uuid4().hex}"
    identified = _identified(detections)
    identified.write.parquet(batch)
    rows = spark.read.schema(identified.schema).parquet(batch)
    try:
        for _ in range(TRIES):
            base, folder = snapshot(spark, root), f"batch-{uuid.uuid4().hex}"
            if not _write_batch(rows, base, folder):
                delete_path(spark, f"{root}/data/{folder}")
                return spark.createDataFrame([], "pose_id string, image_path string")
            try:
                number = versions.commit(spark, root, base.version, {t: [*base.tables.get(t, []), folder] for t in TABLES})
            except versions.Conflict:
                delete_path(spark, f"{root}/data/{folder}")
                continue
            stored = Snapshot(root, number, {"pose_detections": [folder]}).read(spark, "pose_detections")
            paths = snapshot(spark, root, number).read(spark, "images").select(F.col("id").alias("image_id"), F.col("file_path").alias("image_path"))
            return stored.select(F.col("id").alias("pose_id"), "image_id").join(paths, "image_id").select("pose_id", "image_path")
        raise versions.Conflict(f"{root} was changed by others {TRIES} times in a row")
    finally:
        delete_path(spark, batch)


def truncate(spark: SparkSession, root: str, name: str, cascade: bool = False) -> None:
    """Empty a table and, with ``cascade``, the tables that refer to it, in one commit. Snapshots taken before keep their rows."""
    if name not in SCHEMAS:
        raise ValueError(f"the store has no table {name}")
    empty = {name, *(DEPENDANTS.get(name, ()) if cascade else ())}
    for _ in range(TRIES):
        base = snapshot(spark, root)
        try:
            versions.commit(spark, root, base.version, {t: [] if t in empty else base.tables.get(t, []) for t in TABLES})
            return
        except versions.Conflict:
            continue
    raise versions.Conflict(f"{root} was changed by others {TRIES} times in a row")


def compact(spark: SparkSession, root: str) -> int:
    """Write each table as one folder, in one commit, and return its number; a commit of others meanwhile is a :class:`Conflict`."""
    base, folder = snapshot(spark, root), f"batch-{uuid.uuid4().hex}"
    for name in TABLES:
        base.read(spark, name).write.parquet(f"{root}/data/{folder}/{name}")
    return versions.commit(spark, root, base.version, {t: [folder] for t in TABLES})


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete what the newest ``keep`` versions do not name: folders of truncated tables, of compacted batches and of jobs that broke off. Nothing may be writing, or reading older versions, meanwhile."""
    newest = versions.versions(spark, root)[-keep:]
    named = {f for v in newest for folders in snapshot(spark, root, v).tables.values() for f in folders}
    return versions.clear(spark, root, named, keep)
