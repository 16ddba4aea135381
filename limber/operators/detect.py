"""Pluggable detectors: models run inside tasks, made when the first image arrives; :mod:`limber.operators.models` keeps one instance a Python process.

No model weights are part of this library. A detector is a factory that
returns a function from an RGB array to a list of poses (dicts with keypoints,
visibility, bbox (x, y, w, h) and overall_confidence); a person model's
function returns boxes (dicts with x1, y1, x2, y2, conf, cls).

Edge cases: an image in which nothing is found, or that has no pixels, gives no rows; a box without
confidence, or one whose crop is empty, is passed over; an image that is there
twice gives its rows twice (an ensemble fuses all rows of a path); no images
give no rows.
"""

from __future__ import annotations

import math
import re
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limber.functions.pixels import bgr_to_rgb
from limber.operators.boxes import CROP_PADDING, MIN_PERSON_CONF, PERSON, map_back
from limber.operators.ensemble import EnsembleConfig, fuse_poses
from limber.session import own_folder
from limber.sources.images import as_array, has_pixels

#: Poses of an ensemble's models that a task fuses, about.
POSES_A_TASK = 20_000

Pose = dict
Factory = Callable[[], Callable[[np.ndarray], list[Pose]]]

POSE_FIELDS = "keypoints array<array<double>>, visibility array<double>, bbox array<double>, overall_confidence double"
BOX_FIELDS = "x1 double, y1 double, x2 double, y2 double, conf double, cls int"


def brightness_detector(least: float = 0.0, shift: float = 0.0) -> Callable[[np.ndarray], list[Pose]]:
    """A deterministic stand-in for tests: one pose whose five keypoints follow from the image's size, moved right by ``shift``; none where the mean brightness (0 to 1) is below ``least``."""

    def detect(rgb: np.ndarray) -> list[Pose]:
        if rgb.size == 0:
            return []
        h, w = rgb.shape[:2]
        light = float(rgb.mean()) / 255
        if light < least:
            return []
        points = [[w * f + shift, h * f] for f in (0.1, 0.3, 0.5, 0.7, 0.9)]
        return [{"keypoints": points, "visibility": [light] * 5, "bbox": [0.0, 0.0, float(w), float(h)], "overall_confidence": light}]

    return detect


#: Places of a standing figure's 17 keypoints in its image.
FIGURE = (
    (0.50, 0.10), (0.53, 0.08), (0.47, 0.08), (0.56, 0.10), (0.44, 0.10), (0.62, 0.25), (0.38, 0.25), (0.68, 0.40), (0.32, 0.40),
    (0.70, 0.55), (0.30, 0.55), (0.58, 0.55), (0.42, 0.55), (0.60, 0.75), (0.40, 0.75), (0.60, 0.95), (0.40, 0.95),
)


def figure_detector(least: float = 0.0) -> Callable[[np.ndarray], list[Pose]]:
    """A deterministic stand-in with a body's 17 keypoints: a standing figure whose wrists are raised by the brightness of its side of the image."""

    def detect(rgb: np.ndarray) -> list[Pose]:
        if rgb.size == 0:
            return []
        h, w = rgb.shape[:2]
        light = float(rgb.mean()) / 255
        if light < least:
            return []
        raised = {9: float(rgb[:, w // 2 :].mean()) / 255, 10: float(rgb[:, : max(1, w // 2)].mean()) / 255}
        points = [[w * x, h * (y - 0.5 * raised.get(i, 0.0))] for i, (x, y) in enumerate(FIGURE)]
        return [{"keypoints": points, "visibility": [1.0] * len(points), "bbox": [0.0, 0.0, float(w), float(h)], "overall_confidence": light}]

    return detect


def padded_box(box: dict, width: int, height: int, padding: float = CROP_PADDING) -> tuple[int, int, int, int]:
    """x1, y1, x2, y2 of the crop, as :func:`boxes.crop_bounds` has them."""
    x1, y1, x2, y2 = (float(box[c]) for c in ("x1", "y1", "x2", "y2"))
    pad_x, pad_y = (x2 - x1) * padding, (y2 - y1) * padding
    low = lambda v: 0 if math.isnan(v) else int(max(0.0, v))
    high = lambda v, most: most if math.isnan(v) else int(min(float(most), v))
    return low(x1 - pad_x), low(y1 - pad_y), high(x2 + pad_x, width), high(y2 + pad_y, height)


def thirds_detector() -> Callable[[np.ndarray], list[dict]]:
    """A deterministic stand-in for a person model: three boxes of half the width, of growing confidence; the last is no person where the width is odd."""

    def detect(rgb: np.ndarray) -> list[dict]:
        h, w = rgb.shape[:2]
        return [{"x1": i * w / 4, "y1": 0.0, "x2": i * w / 4 + w / 2, "y2": float(h), "conf": conf, "cls": int(i == 2 and w % 2)} for i, conf in enumerate((0.2, 0.3, 0.9))]

    return detect


#: From an image (RGB) to rows of the columns that follow the path and the time.
Work = Callable[[np.ndarray], list[tuple]]


def _run(images: DataFrame, make: Callable[[], Work], fields: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One map over the images, each decoded once: path, the carried columns, elapsed_s (of the image, alike in its rows) and ``fields``."""
    kept = ["path", *carry]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*kept).schema) + f", elapsed_s double, {fields}"
    names = [*kept, "elapsed_s", *re.findall(r"(\w+) (?:int|double|array|binary)", fields)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = None
        for batch in batches:
            work = work or make()
            rows = []
            for r in batch.to_dict("records"):
                if not has_pixels(r):
                    continue
                began = time.perf_counter()
                found = work(bgr_to_rgb(as_array(r["data"], *(int(r[c]) for c in ("height", "width", "n_channels")))))
                took = time.perf_counter() - began
                rows += [(*(r[c] for c in kept), took, *x) for x in found]
            yield pd.DataFrame(rows, columns=names)

    return images.select(*dict.fromkeys([*kept, "height", "width", "n_channels", "data"])).mapInPandas(run, schema)


_POSE = ("keypoints", "visibility", "bbox", "overall_confidence")
_BOX = ("x1", "y1", "x2", "y2", "conf", "cls")


def detect_poses(images: DataFrame, factory: Factory, carry: tuple[str, ...] = ()) -> DataFrame:
    """path, det_idx, the pose's fields and person_id (null: there are no boxes)."""

    def make() -> Work:
        model = factory()
        return lambda rgb: [(i, *(pose[c] for c in _POSE)) for i, pose in enumerate(model(rgb))]

    return _run(images, make, f"det_idx int, {POSE_FIELDS}", carry).withColumn("person_id", F.lit(None).cast("int"))


def detect_persons(images: DataFrame, factory: Factory, carry: tuple[str, ...] = ()) -> DataFrame:
    """path, box_idx (the place in the model's output) and the box's fields."""

    def make() -> Work:
        model = factory()
        return lambda rgb: [(i, *(box[c] for c in _BOX)) for i, box in enumerate(model(rgb))]

    return _run(images, make, f"box_idx int, {BOX_FIELDS}", carry)


def two_stage(images: DataFrame, persons: Factory, poses: Factory, min_conf: float = MIN_PERSON_CONF, padding: float = CROP_PADDING, carry: tuple[str, ...] = ()) -> DataFrame:
    """Poses found in the padded crops of persons, in the image's coordinates.

    The crops are taken in the task that has the image, so no pixels are
    shuffled; boxes of other classes or of less confidence are passed over
    before the pose model sees them. person_id is the box's number.
    """

    def make() -> Work:
        find, model = persons(), poses()

        def work(rgb: np.ndarray) -> list[tuple]:
            found = []
            for number, box in enumerate(find(rgb)):
                if box["cls"] != PERSON or box["conf"] is None or not box["conf"] >= min_conf:
                    continue
                x1, y1, x2, y2 = padded_box(box, rgb.shape[1], rgb.shape[0], padding)
                if x2 > x1 and y2 > y1:
                    found += [(i, number, x1, y1, *(pose[c] for c in _POSE)) for i, pose in enumerate(model(rgb[y1:y2, x1:x2]))]
            return found

        return work

    found = _run(images, make, f"det_idx int, box_idx int, x_offset int, y_offset int, {POSE_FIELDS}", carry)
    return map_back(found).select("path", *carry, "elapsed_s", "det_idx", *_POSE, "person_id")


def person_crops(images: DataFrame, persons: Factory, min_conf: float = MIN_PERSON_CONF, padding: float = CROP_PADDING, carry: tuple[str, ...] = ()) -> DataFrame:
    """The padded crops of persons as a table: path, the carried columns, elapsed_s, box_idx, x_offset, y_offset, height, width, n_channels (3) and data (BGR)."""

    def make() -> Work:
        find = persons()

        def work(rgb: np.ndarray) -> list[tuple]:
            found = []
            for number, box in enumerate(find(rgb)):
                if box["cls"] != PERSON or box["conf"] is None or not box["conf"] >= min_conf:
                    continue
                x1, y1, x2, y2 = padded_box(box, rgb.shape[1], rgb.shape[0], padding)
                if x2 > x1 and y2 > y1:
                    found.append((number, x1, y1, y2 - y1, x2 - x1, 3, np.ascontiguousarray(bgr_to_rgb(rgb[y1:y2, x1:x2])).tobytes()))
            return found

        return work

    return _run(images, make, "box_idx int, x_offset int, y_offset int, height int, width int, n_channels int, data binary", carry)


def poses_in_crops(crops: DataFrame, poses: Factory, carry: tuple[str, ...] = ()) -> DataFrame:
    """A table function over crops of many images at once: every row of a batch, whichever image it is of, goes to the model together.

    The model may offer ``many``, from a list of crops to a list of their lists
    of poses, to use that; otherwise it sees them one after the other. Returns
    path, the carried columns, elapsed_s (the crops' own and an equal share of
    the batch's), det_idx, the pose's fields and person_id, in the image's coordinates.
    """
    kept = ["path", *carry, "elapsed_s", "box_idx", "x_offset", "y_offset"]
    fields = {f.name: f.dataType.simpleString() for f in crops.select(*kept).schema}
    returned = ", ".join(f"`{n}` {t}" for n, t in fields.items()) + f", det_idx int, {POSE_FIELDS}"
    types = [pa.int32(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]

    class Poses:
        model = None

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            self.model = self.model or poses()
            rows = batch.select(["height", "width", "n_channels", "data"]).to_pylist()
            began = time.perf_counter()
            images = [bgr_to_rgb(as_array(r["data"], r["height"], r["width"], r["n_channels"])) for r in rows]
            found = self.model.many(images) if hasattr(self.model, "many") else [self.model(x) for x in images]
            share = (time.perf_counter() - began) / max(1, len(rows))
            at = pa.array([i for i, of in enumerate(found) for _ in of], pa.int64())
            flat = [(i, *(pose[c] for c in _POSE)) for of in found for i, pose in enumerate(of)]
            columns = {c: batch.column(c).take(at) for c in kept}
            columns["elapsed_s"] = pc.add(columns["elapsed_s"], share)
            for j, (name, kind) in enumerate(zip(("det_idx", *_POSE), types, strict=True)):
                columns[name] = pa.array([r[j] for r in flat], kind)
            yield pa.table(columns)

    table = F.arrow_udtf(Poses, returnType=returned)
    found = table(crops.select(*kept, "height", "width", "n_channels", "data").asTable())
    return map_back(found).select("path", *carry, "elapsed_s", "det_idx", *_POSE, "person_id")


def two_stage_batched(images: DataFrame, persons: Factory, poses: Factory, min_conf: float = MIN_PERSON_CONF, padding: float = CROP_PADDING, carry: tuple[str, ...] = ()) -> DataFrame:
    """What :func:`two_stage` finds, with the crops of many images in a batch of the pose model. Crops pass from one Python stage to the next, so this pays where the model gains by batches."""
    return poses_in_crops(person_crops(images, persons, min_conf, padding, carry), poses, carry)


def model_poses(images: DataFrame, models: list[Factory], weights: tuple[float | None, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """The poses of each model, in one map: path, model_idx, weight (null where none is given), det_idx, the pose's fields and person_id (null)."""
    known = [weights[i] if i < len(weights) else None for i in range(len(models))]

    def make() -> Work:
        made = [factory() for factory in models]
        return lambda rgb: [(m, known[m], i, *(pose[c] for c in _POSE)) for m, model in enumerate(made) for i, pose in enumerate(model(rgb))]

    return _run(images, make, f"model_idx int, weight double, det_idx int, {POSE_FIELDS}", carry).withColumn("person_id", F.lit(None).cast("int"))


def ensemble(images: DataFrame, models: list[Factory], config: EnsembleConfig | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """At most one fused pose per image.

    The models' poses are written to the shared folder first: models run once,
    and the number of tasks that fuse follows from the number of poses, not
    from how many tasks the images came in.
    """
    config = config or EnsembleConfig()
    spark = images.sparkSession
    found, path = model_poses(images, models, config.weights, carry).where("det_idx = 0"), f"{own_folder(spark)}/poses-{uuid.uuid4().hex}"
    found.write.parquet(path)
    poses = spark.read.schema(found.schema).parquet(path)
    kept = {c: F.min(c) for c in (*carry, "elapsed_s")}
    return fuse_poses(poses, config.fusion_method, "path", kept, 1 + poses.count() // POSES_A_TASK).withColumn("det_idx", F.lit(0))


def detect(images: DataFrame, poses: Factory, persons: Factory | None = None, models: list[Factory] | None = None, config: EnsembleConfig | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Plain, two-stage (``persons`` given) or ensemble (``models`` given) detection; the two exclude each other. ``carry`` names columns of the images to keep."""
    if persons and models:
        raise ValueError("two-stage and ensemble detection exclude each other")
    if models:
        return ensemble(images, models, config, carry)
    return two_stage(images, persons, poses, carry=carry) if persons else detect_poses(images, poses, carry)
