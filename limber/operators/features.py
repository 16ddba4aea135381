"""Feature vectors of poses: 52 numbers of the body's geometry, 576 of the image's texture.

The geometric vector is a Catalyst expression over a pose's keypoints:

* 34 coordinates of the 17 body keypoints in the torso's frame: the origin is
  the middle of the hips, the unit the distance from there to the middle of the
  shoulders, the axes the image's;
* 8 joint angles over pi (elbows, shoulders, hips, knees; left before right);
* 10 lengths over the torso's (upper arms, forearms, thighs, shins; left before
  right, limb by limb; then shoulders and hips).

It stays the same when the pose is moved or made larger. Keypoints follow the
common 17-point body order (nose, eyes, ears, shoulders, elbows, wrists, hips,
knees, ankles; left before right); whole-body sets begin with these.

Edge cases: a keypoint of less than ``MIN_VISIBILITY``, or with a coordinate
that is null or not finite, is not seen, and what needs it is 0; of a pair of
hips or shoulders one is enough for a middle. A pose without a hip, a shoulder
or any distance between them, one of fewer than 17 keypoints, and one whose
keypoints or visibilities are null has a null vector. A repeated row has its
vector each time; no rows give none; other columns are kept, a column of the
new vector's name is replaced.

The texture vector is taken in an Arrow map by
:func:`limber.functions.texture.gradient_histograms`; an image of no pixels
has a null vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limber.functions.texture import gradient_histograms
from limber.functions.vectors import fuse
from limber.sources.images import as_array, has_pixels

GEOMETRIC_DIM, VISUAL_DIM = 52, 576
BODY_POINTS, MIN_VISIBILITY = 17, 0.3

#: Places of the body's keypoints.
L_SHOULDER, R_SHOULDER, L_ELBOW, R_ELBOW, L_WRIST, R_WRIST, L_HIP, R_HIP, L_KNEE, R_KNEE, L_ANKLE, R_ANKLE = range(5, 17)
#: Angles at the middle one of three keypoints.
JOINTS = (
    (L_SHOULDER, L_ELBOW, L_WRIST), (R_SHOULDER, R_ELBOW, R_WRIST), (L_ELBOW, L_SHOULDER, L_HIP), (R_ELBOW, R_SHOULDER, R_HIP),
    (L_SHOULDER, L_HIP, L_KNEE), (R_SHOULDER, R_HIP, R_KNEE), (L_HIP, L_KNEE, L_ANKLE), (R_HIP, R_KNEE, R_ANKLE),
)
LIMBS = (
    (L_SHOULDER, L_ELBOW), (R_SHOULDER, R_ELBOW), (L_ELBOW, L_WRIST), (R_ELBOW, R_WRIST), (L_HIP, L_KNEE), (R_HIP, R_KNEE),
    (L_KNEE, L_ANKLE), (R_KNEE, R_ANKLE), (L_SHOULDER, R_SHOULDER), (L_HIP, R_HIP),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _points(keypoints: str, visibility: str, min_visibility: float) -> Column:
    """x and y of each body keypoint; null where it is not seen."""

    def point(i: Column) -> Column:
        p = F.get(keypoints, i)
        x, y, seen = F.get(p, F.lit(0)).cast("double"), F.get(p, F.lit(1)).cast("double"), F.get(visibility, i).cast("double")
        ok = F.coalesce(_finite(x) & _finite(y) & (seen >= min_visibility) & ~F.isnan(seen), F.lit(False))
        return F.struct(F.when(ok, x).alias("x"), F.when(ok, y).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(BODY_POINTS - 1)), point)


def _middle(points: Column, a: int, b: int, axis: str) -> Column:
    """The middle of two keypoints, of the one that is seen if only one is; null if neither is."""
    p, q = (F.get(points, F.lit(i))[axis] for i in (a, b))
    return F.coalesce((p + q) / 2, p, q)


def _frame(points: Column) -> Column:
    """The middle of the hips and how far the middle of the shoulders lies from it; unit is null where there is no such distance."""

    def framed(m: Column) -> Column:
        unit = F.sqrt((m["sx"] - m["x"]) * (m["sx"] - m["x"]) + (m["sy"] - m["y"]) * (m["sy"] - m["y"]))
        return F.struct(m["x"].alias("x"), m["y"].alias("y"), F.when((unit > 0) & (unit != float("inf")), unit).alias("unit"))

    ends = {"x": (L_HIP, R_HIP, "x"), "y": (L_HIP, R_HIP, "y"), "sx": (L_SHOULDER, R_SHOULDER, "x"), "sy": (L_SHOULDER, R_SHOULDER, "y")}
    return _let(F.struct(*[_middle(points, *of).alias(name) for name, of in ends.items()]), framed)


def _listed(places: tuple[tuple[int, ...], ...]) -> Column:
    return F.array(*[F.array(*map(F.lit, p)) for p in places])


def _between(points: Column, a: Column, b: Column) -> Column:
    """The vector from keypoint b to keypoint a, and its length."""
    p, q = F.get(points, a), F.get(points, b)
    x, y = p["x"] - q["x"], p["y"] - q["y"]
    return F.struct(x.alias("x"), y.alias("y"), F.sqrt(x * x + y * y).alias("length"))


def _angle(points: Column, joint: Column) -> Column:
    """The angle at a joint's middle keypoint over pi; null where it has none."""

    def of(u: Column, v: Column) -> Column:
        cosine = F.try_divide(u["x"] * v["x"] + u["y"] * v["y"], F.nullif(u["length"] * v["length"], F.lit(0.0)))
        return _let(cosine, lambda c: F.when(c.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))) / F.pi()))  # greatest and least pass a null over

    arms = F.struct(_between(points, F.get(joint, F.lit(0)), F.get(joint, F.lit(1))).alias("u"), _between(points, F.get(joint, F.lit(2)), F.get(joint, F.lit(1))).alias("v"))
    return _let(arms, lambda a: of(a["u"], a["v"]))


def geometry(keypoints: str = "keypoints", visibility: str = "visibility", min_visibility: float = MIN_VISIBILITY) -> Column:
    """The 52 numbers as an expression."""

    def numbers(points: Column, f: Column) -> Column:
        places = F.flatten(F.transform(points, lambda p: F.array((p["x"] - f["x"]) / f["unit"], (p["y"] - f["y"]) / f["unit"])))
        angles = F.transform(_listed(JOINTS), lambda j: _angle(points, j))
        lengths = F.transform(_listed(LIMBS), lambda i: _between(points, F.get(i, F.lit(0)), F.get(i, F.lit(1)))["length"] / f["unit"])
        return F.when(f["unit"].isNotNull(), F.transform(F.concat(places, angles, lengths), lambda v: F.coalesce(v, F.lit(0.0))))

    whole = _let(_points(keypoints, visibility, min_visibility), lambda p: _let(_frame(p), lambda f: numbers(p, f)))
    return F.when((F.size(keypoints) >= BODY_POINTS) & F.col(visibility).isNotNull(), whole)


def geometric_features(poses: DataFrame, out: str = "geometric", min_visibility: float = MIN_VISIBILITY) -> DataFrame:
    """The poses (keypoints, visibility) with their 52 numbers in a column ``out``."""
    return poses.withColumn(out, geometry(min_visibility=min_visibility))


def _described(batches: Iterator[pa.RecordBatch], carried: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = []
        for r in batch.select(["height", "width", "n_channels", "data"]).to_pylist():
            vectors.append(None if not has_pixels(r) else gradient_histograms(as_array(r["data"], r["height"], r["width"], r["n_channels"])[:, :, ::-1]).astype(np.float32))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(vectors, pa.list_(pa.float32()))], names=[*carried, "visual"])


def visual_features(images: DataFrame, carry: tuple[str, ...] = ("path",)) -> DataFrame:
    """The images' 576 numbers: the carried columns and visual (array<float>, unit length or, for images without any edge, all 0)."""
    carried = list(carry)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*carried).schema)
    return images.select(*dict.fromkeys([*carried, "height", "width", "n_channels", "data"])).mapInArrow(lambda it: _described(it, carried), f"{kept}, visual array<float>")


def fused_features(poses: DataFrame, geometric: str = "geometric", visual: str = "visual", out: str = "fused") -> DataFrame:
    """The poses with both parts as one vector of 628 numbers; null where either part is."""
    return poses.withColumn(out, fuse(F.col(geometric), F.col(visual)))
