"""Vector expressions over ``array<float>`` or ``array<double>`` columns. All are Catalyst expressions; elements are summed as doubles.

A null vector, or one holding a null, gives null. Lengths must agree: a
comparison of vectors of different lengths gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y)))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(v), lambda x: x * x)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))))


def cosine(a: Column, b: Column) -> Column:
    """Null when either vector has no length: it has no direction to compare."""
    return F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0)))


def l2_normalize(v: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(_double(v), lambda x: x / n)).otherwise(_double(v))


def fuse(geometric: Column, visual: Column) -> Column:
    """Geometric and visual parts one after the other, unweighted; null if either is."""
    return F.concat(_double(geometric), _double(visual))


def inverse_distance_score(distance: Column, scale: float = 1.0) -> Column:
    """1 at distance 0, falling as 1 / (1 + d / scale)."""
    return 1.0 / (1.0 + distance / F.lit(float(scale)))


def exponential_score(distance: Column, scale: float = 1.0) -> Column:
    """1 at distance 0, falling as exp(-d / scale)."""
    return F.exp(-distance / F.lit(float(scale)))


#: Score mappings of a distance and a scale.
MAPPINGS = {"inverse": inverse_distance_score, "exponential": exponential_score}
#: Name to (expression, whether larger is nearer).
METRICS = {"cosine": (cosine, True), "dot": (dot, True), "l2": (l2_distance, False)}
