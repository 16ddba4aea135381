"""Person boxes, padded crops and the way back to image coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_PERSON_CONF = 0.3
CROP_PADDING = 0.1
MIN_SIDE = 512
PERSON = 0


def number_boxes(boxes: DataFrame, image_col: str, *order: str) -> DataFrame:
    """Add box_idx, the place (from 0) in the detector's own output. Number before filtering: the numbers are person ids and keep their gaps. Rows that tie in ``order`` are numbered in any order; boxes of null images are numbered together."""
    return boxes.withColumn("box_idx", F.row_number().over(Window.partitionBy(image_col).orderBy(*order)) - 1)


def person_boxes(boxes: DataFrame, min_conf: float = MIN_PERSON_CONF, class_col: str = "cls", conf_col: str = "conf") -> DataFrame:
    """Boxes of persons with at least ``min_conf``. Null confidence is dropped."""
    return boxes.where((F.col(class_col) == PERSON) & (F.col(conf_col) >= F.lit(float(min_conf))))


def crop_bounds(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, padding: float = CROP_PADDING) -> list[Column]:
    """x1_pad, y1_pad, x2_pad, y2_pad (int): the box widened by ``padding`` of its size and cut at the image. Null if any input is; a NaN counts as outside and gives the image's border."""
    pad_x, pad_y = (x2 - x1) * F.lit(padding), (y2 - y1) * F.lit(padding)
    known = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    low = lambda v: F.when(known, F.when(F.isnan(v), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), v)).cast("int"))
    high = lambda v, most: F.when(known & most.isNotNull(), F.when(F.isnan(v), most.cast("double")).otherwise(F.least(most.cast("double"), v)).cast("int"))
    return [
        low(x1 - pad_x).alias("x1_pad"),
        low(y1 - pad_y).alias("y1_pad"),
        high(x2 + pad_x, width).alias("x2_pad"),
        high(y2 + pad_y, height).alias("y2_pad"),
    ]


def shift_keypoints(keypoints: Column, dx: Column, dy: Column) -> Column:
    """Keypoints (x, y, ...) moved by an offset; what follows x and y stays."""
    return F.transform(keypoints, lambda p: F.concat(F.array(p[0] + dx, p[1] + dy), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0)))))


def shift_bbox(bbox: Column, dx: Column, dy: Column) -> Column:
    """A box (x, y, w, h) moved by an offset: its size stays."""
    return F.concat(F.array(bbox[0] + dx, bbox[1] + dy), F.slice(bbox, 3, F.greatest(F.size(bbox) - 2, F.lit(0))))


def map_back(poses: DataFrame, dx_col: str = "x_offset", dy_col: str = "y_offset", person_col: str = "box_idx") -> DataFrame:
    """Poses found in crops, in the image's coordinates; person_id is the box's number."""
    dx, dy = F.col(dx_col), F.col(dy_col)
    return poses.withColumns({"keypoints": shift_keypoints(F.col("keypoints"), dx, dy), "bbox": shift_bbox(F.col("bbox"), dx, dy), "person_id": F.col(person_col)})


def upsample_dims(width: Column, height: Column, min_side: int = MIN_SIDE) -> list[Column]:
    """new_w, new_h (int) and scale: the short side brought up to ``min_side``; truncation can leave it one short."""
    short = F.least(width, height)
    scale = F.when(short < min_side, F.lit(float(min_side)) / short).otherwise(F.lit(1.0))
    return [(width * scale).cast("int").alias("new_w"), (height * scale).cast("int").alias("new_h"), scale.alias("scale")]
