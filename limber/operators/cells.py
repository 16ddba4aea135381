"""An exact nearest-neighbour index that leaves out what cannot matter.

Vectors are grouped into cells around centroids, and each cell keeps how far
its members lie from the centroid: as a distance and as an angle. For a query,
these bound from both sides what any member can cost, under every metric:

* L2: |q - c| - r and |q - c| + r;
* dot: the product with the centroid, give or take |q| r;
* cosine: the angle to the centroid, give or take the cell's.

A query is first compared with the members of a few cells that bound its k-th
neighbour best; only cells whose lower bound is no worse than the k-th cost
found there are then read. Cells are left out, never results: what comes back
is what a scan of all vectors gives.

The centroids come from a bounded sample, and how good they are decides only
what is left out. Cell statistics (``MOST_CELLS`` rows) pass through the
driver, and so does one block of queries, of a checked size.

Edge cases: null vectors and vectors that hold a null or NaN are not indexed;
zero vectors are, but have no cosine; vectors of different dimensions are an
error; a repeated row is found twice; an empty index finds nothing; queries are
treated as in :mod:`limber.operators.knn`; other columns than id and vector are
not kept.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from limber.operators import knn
from limber.sources import versions

#: Cells at most, vectors of the sample a cell, and rounds of fitting the centroids to it.
MOST_CELLS, SAMPLED, FIT_ROUNDS = 1024, 32, 5
#: Rows a cell that the files of an index are made for, about.
ROWS_A_FILE = 1_000_000


@dataclass(frozen=True)
class Cells:
    """What the driver knows of an index."""

    centroids: np.ndarray
    radius: np.ndarray
    angle: np.ndarray
    n: np.ndarray

    def bounds(self, q: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that a member of each cell can cost each query (queries x cells)."""
        if metric == "l2":
            d = np.sqrt(np.maximum(((q[:, None, :] - self.centroids[None]) ** 2).sum(2), 0)) if q.size * len(self.centroids) < 1 << 24 else _distances(q, self.centroids)
            low, high = np.maximum(d - self.radius, 0), d + self.radius
            slack = 1e-7 * (np.linalg.norm(q, axis=1)[:, None] + np.linalg.norm(self.centroids, axis=1) + self.radius)
        else:
            dot = q @ self.centroids.T
            length, size = np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(self.centroids, axis=1)
            if metric == "dot":
                low, high = -dot - length * self.radius, -dot + length * self.radius
                slack = 1e-9 * length * (size + self.radius)
            else:
                cosine = np.divide(dot, length * size, out=np.zeros_like(dot), where=length * size > 0)
                a = np.arccos(np.clip(cosine, -1, 1))
                whole = np.where(size > 0, self.angle, math.pi)  # a centroid at the origin bounds no angle
                low, high = -np.cos(np.maximum(a - whole, 0)), -np.cos(np.minimum(a + whole, math.pi))
                slack = np.full_like(low, 1e-7)
        return low - slack, high + slack


def _distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All distances, row by row of q, without the product form's loss of digits."""
    return np.stack([np.sqrt(((one - c) ** 2).sum(1)) for one in q])


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    for lo in range(0, len(x), 4096):
        part = x[lo : lo + 4096]
        out[lo : lo + 4096] = ((centroids**2).sum(1)[None] - 2 * part @ centroids.T).argmin(1)
    return out


def fit_centroids(sample: np.ndarray, n_cells: int) -> np.ndarray:
    """Centroids of a sample by a few rounds of Lloyd, from evenly spaced rows of it; empty cells keep theirs."""
    centroids = sample[np.linspace(0, len(sample) - 1, n_cells).astype(int)].copy()
    for _ in range(FIT_ROUNDS):
        cell = _nearest(sample, centroids)
        n = np.bincount(cell, minlength=n_cells)
        total = np.zeros_like(centroids)
        np.add.at(total, cell, sample)
        centroids[n > 0] = total[n > 0] / n[n > 0, None]
    return centroids


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """id, v, cell, distance and angle to the centroid (null without a direction)."""
    for batch in batches:
        x = knn._matrix(batch.column("v"))
        if not len(x):
            continue
        cell = _nearest(x, centroids)
        c = centroids[cell]
        scale = np.linalg.norm(x, axis=1) * np.linalg.norm(c, axis=1)
        cosine = np.divide((x * c).sum(1), scale, out=np.zeros(len(x)), where=scale > 0)
        angle = pa.array(np.arccos(np.clip(cosine, -1, 1)), mask=scale == 0)
        columns = [batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(((x - c) ** 2).sum(1))), angle]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "cell", "distance", "angle"])


def build_cells(index: DataFrame, path: str, n_cells: int | None = None, id_col: str = "pose_id", vector_col: str = "feature_vector") -> None:
    """Write a new version of the cell index of the vectors at ``path``; readers of older ones are not disturbed.

    Files are ranged by cell, so that a search opens only those of its cells.
    """
    spark = index.sparkSession
    thin = index.where(knn.usable(vector_col, "l2")).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    size = knn.sizes(thin)
    if size["n"] and size["least"] != size["most"]:
        raise ValueError(f"vectors of {size['least']} to {size['most']} dimensions in one index")
    wanted = n_cells or min(MOST_CELLS, math.isqrt(size["n"]))
    sample = thin.orderBy(F.xxhash64("id", "v")).limit(wanted * SAMPLED).select(F.lit(0).alias("q"), "v")
    x = knn.collected(sample)[1] if size["n"] else np.zeros((0, 0))
    centroids = spark.sparkContext.broadcast(fit_centroids(x, max(1, min(wanted, len(x)))) if len(x) else np.zeros((1, 1)))
    kind = thin.schema["id"].dataType.simpleString()
    folder = f"cells-{uuid.uuid4().hex}"
    rows = thin.mapInArrow(lambda it: _assigned(it, centroids.value), f"id {kind}, v array<double>, cell int, distance double, angle double")
    ranged = rows.repartitionByRange(max(1, -(-size["n"] // ROWS_A_FILE), min(64, wanted // 16)), "cell", "id").sortWithinPartitions("cell")
    ranged.write.parquet(f"{path}/data/{folder}")
    stats = spark.read.schema(rows.schema).parquet(f"{path}/data/{folder}").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"), F.max("angle").alias("angle"))
    kept = [[r["cell"], r["n"], r["radius"], math.pi if r["angle"] is None else r["angle"]] for r in stats.collect()]  # MOST_CELLS at most
    content = {"folders": [folder], "schema": rows.schema.jsonValue(), "dim": size["least"], "cells": [[*c, centroids.value[c[0]].tolist()] for c in sorted(kept)]}
    while True:
        try:
            versions.commit(spark, path, versions.read_version(spark, path)[0], content)
            return
        except versions.Conflict:
            continue


def read_cells(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, np.ndarray, Cells]:
    """The rows of a version, the numbers of its cells, and what the driver knows of them."""
    _, content = versions.read_version(spark, path, version)
    if not content:
        raise FileNotFoundError(f"there is no index at {path}")
    rows = spark.read.schema(StructType.fromJson(content["schema"])).parquet(*[f"{path}/data/{f}" for f in content["folders"]])
    numbers = np.array([c[0] for c in content["cells"]], dtype=np.int64)
    column = lambda i: np.array([c[i] for c in content["cells"]], dtype=np.float64)
    return rows, numbers, Cells(np.array([c[4] for c in content["cells"]]).reshape(len(numbers), content["dim"] or 0), column(2), column(3), column(1))


def _search(batches: Iterator[pa.RecordBatch], shared: tuple, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """A task's rows, each against the queries that need its cell."""
    asked, q, needed = shared
    best = None
    for batch in batches:
        ids, x, cell = batch.column("id"), knn._matrix(batch.column("v")), batch.column("cell").to_numpy()
        best = best or knn.Best(len(q), k, ids.type)
        for c in np.unique(cell):
            of = np.flatnonzero(needed[:, c])
            if len(of):
                at = np.flatnonzero(cell == c)
                knn.scan_block(q, ids.take(pa.array(at)), x[at], best, metric, of)
    if best:
        yield from pa.table({"query_id": asked.take(best.rows["q"].combine_chunks()), "id": best.rows["id"], "cost": best.rows["cost"]}).combine_chunks().to_batches()


def _over(spark: SparkSession, rows: DataFrame, numbers: np.ndarray, asked: pa.Array, q: np.ndarray, needed: np.ndarray, k: int, metric: str, types: str) -> DataFrame:
    """Costs of the k best rows a task in the cells that any query needs; no other cell's rows are read."""
    by_number = np.zeros((len(q), int(numbers.max(initial=0)) + 1), dtype=bool)
    by_number[:, numbers] = needed
    shared = spark.sparkContext.broadcast((asked, q, by_number))
    cells = [int(c) for c in numbers[needed.any(axis=0)]]
    read = rows.where(F.col("cell").isin(cells)) if cells else rows.limit(0)
    if metric == "cosine":
        read = read.where(knn.usable("v", metric))
    return read.select("id", "v", "cell").coalesce(knn.SCANS).mapInArrow(lambda it: _search(it, shared.value, k, metric), types)


def _first_cells(low: np.ndarray, high: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the cells to look into first (its most promising, until they hold k rows), and what its k-th neighbour costs at most."""
    order = np.argsort(high, axis=1, kind="stable")
    held = np.cumsum(n[order], axis=1)
    enough = np.minimum((held < k).sum(axis=1), high.shape[1] - 1)
    most = np.where(held[:, -1] >= k, np.take_along_axis(high, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0], np.inf)
    by_low = np.argsort(low, axis=1, kind="stable")
    so_far = np.cumsum(n[by_low], axis=1) - n[by_low]
    first = np.zeros(low.shape, dtype=bool)
    np.put_along_axis(first, by_low, so_far < k, axis=1)
    return first, most


def search_cells(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 5, metric: str = "cosine", id_col: str = "pose_id", vector_col: str = "feature_vector", query_col: str = "query_id", mapping: str | None = None, scale: float = 1.0, version: int | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """The neighbours as :func:`knn.search_similar_batch` gives them, and how much was left out: pairs compared and pairs in all, cells read and cells in all.

    Queries beyond one block (``knn.BLOCK``, ``knn.BLOCK_BYTES``) are an error:
    ask in blocks, or scan with :func:`knn.search_similar_batch`.
    """
    rows, numbers, cells = read_cells(spark, path, version)
    asked = knn.askable(queries, metric, query_col, vector_col)
    size = knn.sizes(asked)
    if size["n"] > knn.BLOCK or size["n"] * (size["most"] or 0) * 8 > knn.BLOCK_BYTES:
        raise ValueError(f"{size['n']} queries are more than one block; scan the index instead")
    dim = cells.centroids.shape[1] if len(numbers) else None
    if size["n"] and (size["least"] != size["most"] or dim not in (None, size["least"])):
        raise ValueError(f"the query has {size['least']} to {size['most']} dimensions, the index {dim}")
    types = f"query_id {asked.schema['q'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, cost double"
    if not size["n"] or not len(numbers):
        return knn.ranked(spark.createDataFrame([], types), k, metric, id_col, mapping, scale), {"pairs": 0, "all_pairs": 0, "cells": 0, "all_cells": len(numbers)}
    ids, q = knn.collected(asked)
    low, high = cells.bounds(q, metric)
    first, most = _first_cells(low, high, cells.n, k)
    if metric == "cosine":
        most[:] = np.inf  # zero vectors count among a cell's rows, but are no neighbours
    probe = _over(spark, rows, numbers, ids, q, first, k, metric, types).groupBy("query_id").agg(F.sort_array(F.collect_list("cost")).alias("costs"))  # k a task and query
    place = {v: i for i, v in enumerate(ids.to_pylist())}
    for r in probe.select("query_id", F.get("costs", F.lit(k - 1)).alias("cost")).collect():  # one a query at most
        if r["cost"] is not None:
            most[place[r["query_id"]]] = min(most[place[r["query_id"]]], r["cost"])
    needed = low <= (most + 1e-9 * (1 + np.abs(np.where(np.isfinite(most), most, 0))))[:, None]
    found = _over(spark, rows, numbers, ids, q, needed, k, metric, types)
    report = {"pairs": int((needed * cells.n).sum()), "all_pairs": int(len(q) * cells.n.sum()), "cells": int(needed.any(axis=0).sum()), "all_cells": len(numbers)}
    return knn.ranked(found, k, metric, id_col, mapping, scale), report
