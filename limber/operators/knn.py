"""Exact nearest neighbours over a table of vectors.

One query is an expression and a top-k (``TakeOrderedAndProject``: no shuffle
of the index). A block of queries (up to ``BLOCK`` of them and ``BLOCK_BYTES``,
counted first) is broadcast; each task goes through its part of the index and
keeps the k nearest rows of every query so far, so that the index is read once
and not shuffled, and a window ranks what a bounded number of tasks kept. More
queries meet the index in a grid: index rows are dealt to chunks and queries to
blocks of bounded size, every cell of the grid is one matrix product whose k
nearest rows a query are kept, and a window ranks these. There neither side
passes through the driver, and a cell's memory does not grow with either table.

Vectors that have no score (null, wrong length, zero under cosine, NaN) are not
neighbours. Ties are broken by the smaller index id; a row that is in the index
twice can be found twice. Of several queries with one id the smallest vector
asks; queries with a null id, or without a score, find nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from limber.functions.vectors import MAPPINGS, METRICS

#: Queries of a block and index rows of a chunk, about.
BLOCK, CHUNK = 4096, 16_384
#: Bytes of a block of queries that is broadcast, at most.
BLOCK_BYTES = 128 << 20
#: Tasks that scan an index, at most; so what they keep does not grow with it.
SCANS = 4096
#: Queries whose scores with a chunk are held at once.
AT_ONCE = 256


def _mapped(score: Column, metric: str, mapping: str | None, scale: float) -> Column:
    """The score itself, or a distance mapped by its scale to a score of at most 1."""
    if mapping is None:
        return score
    if METRICS[metric][1]:
        raise ValueError(f"{metric} is no distance to map")
    return MAPPINGS[mapping](score, scale)


def _of_dimension(v: str, dim: int) -> Column:
    """The vector; one of another dimension fails the job."""
    message = F.concat(F.lit(f"the query has {dim} dimensions, the index "), F.size(v).cast("string"))
    return F.when(F.col(v).isNull() | (F.size(v) == dim), F.col(v)).otherwise(F.raise_error(message).cast("array<double>"))


def search_similar(
    index: DataFrame, query: list[float], k: int = 5, metric: str = "cosine", id_col: str = "pose_id", vector_col: str = "feature_vector", mapping: str | None = None, scale: float = 1.0
) -> DataFrame:
    """rank (from 1), the index's columns but the vector, similarity_score; the k nearest rows.

    ``mapping`` (inverse or exponential, with ``scale``) makes scores of distances.
    """
    one = index.where(F.col(vector_col).isNotNull()).select(F.size(vector_col).alias("dim")).head()  # a single row tells of most mistakes at once
    if one and one["dim"] != len(query):
        raise ValueError(f"the query has {len(query)} dimensions, the index {one['dim']}")
    measure, larger = METRICS[metric]
    score = measure(_of_dimension(vector_col, len(query)), F.array(*[F.lit(float(x)) for x in query]))
    near = index.withColumn("similarity_score", score).where(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))
    order = [F.desc("similarity_score") if larger else F.asc("similarity_score"), F.asc(id_col)]
    top = near.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.orderBy(*order))  # over k rows
    shown = _mapped(F.col("similarity_score"), metric, mapping, scale).alias("similarity_score")
    return top.select(rank.alias("rank"), *[c for c in index.columns if c != vector_col], shown)


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(whole), -1 if len(whole) else 0)


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Costs of pairs, without the loss of digits that the product form of a distance has."""
    if metric == "l2":
        return np.sqrt(((q - x) ** 2).sum(1))
    dot = (q * x).sum(1)
    return -dot / (np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1)) if metric == "cosine" else -dot


def candidates(q: np.ndarray, x: np.ndarray, metric: str, k: int, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row) among which are the k nearest rows of each query that cost no more than ``worst``, and their exact costs.

    A matrix product finds them; what it may be wrong by is allowed for, so that rounding does not decide.
    """
    if metric == "cosine":
        unit_q, unit_x = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (q, x))
        key, slack, limit = -(unit_q @ unit_x.T), 1e-11, worst.copy()
    elif metric == "dot":
        key, slack, limit = -(q @ x.T), 1e-11 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0), worst.copy()
    else:
        qq, xx = (q**2).sum(1), (x**2).sum(1)
        key, slack, limit = qq[:, None] + xx[None] - 2 * q @ x.T, 1e-11 * (qq + xx.max(initial=0)), worst**2
    if len(x) > k:
        limit = np.minimum(limit, np.partition(key, k - 1, axis=1)[:, k - 1])
    row, place = np.nonzero(key <= (limit + slack + 1e-11 * np.abs(np.where(np.isfinite(limit), limit, 0)))[:, None])
    return row, place, _exact(q[row], x[place], metric)


class Best:
    """The k nearest rows so far of each of n queries, ties by the smaller id."""

    def __init__(self, n: int, k: int, id_type: pa.DataType) -> None:
        self.k, self.worst = k, np.full(n, np.inf)
        self.rows = pa.table({"q": pa.array([], pa.int64()), "cost": pa.array([], pa.float64()), "id": pa.array([], id_type)})

    def add(self, q: np.ndarray, cost: np.ndarray, ids: pa.Array) -> None:
        if not len(q):
            return
        new = pa.table({"q": pa.array(q.astype(np.int64)), "cost": pa.array(cost), "id": ids})
        both = pa.concat_tables([self.rows, new]).combine_chunks().sort_by([("q", "ascending"), ("cost", "ascending"), ("id", "ascending")])
        of = both["q"].to_numpy()
        place = np.arange(len(of)) - np.searchsorted(of, of)
        self.rows = both.filter(pa.array(place < self.k))
        full = place == self.k - 1
        self.worst[of[full]] = both["cost"].to_numpy()[full]


def scan_block(q: np.ndarray, ids: pa.Array, x: np.ndarray, best: Best, metric: str, of: np.ndarray | None = None) -> None:
    """Let rows (ids, x) compete for the queries, or for those numbered ``of``."""
    of = np.arange(len(q)) if of is None else of
    for lo in range(0, len(of), AT_ONCE):
        mine = of[lo : lo + AT_ONCE]
        row, place, cost = candidates(q[mine], x, metric, best.k, best.worst[mine])
        best.add(mine[row], cost, ids.take(pa.array(place)))


def _scan(batches: Iterator[pa.RecordBatch], block: tuple[pa.Array, np.ndarray], k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """A task's part of the index against the whole block."""
    asked, q = block
    best = None
    for batch in batches:
        ids, x = batch.column("id"), _matrix(batch.column("v"))
        if x.shape[1] != q.shape[1]:
            raise ValueError(f"the query has {q.shape[1]} dimensions, the index {x.shape[1]}")
        best = best or Best(len(q), k, ids.type)
        scan_block(q, ids, x, best, metric)
    if best:
        yield from pa.table({"query_id": asked.take(best.rows["q"].combine_chunks()), "id": best.rows["id"], "cost": best.rows["cost"]}).combine_chunks().to_batches()


def _cell(k: int, metric: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One cell of the grid: the k nearest rows of a chunk for each query of a block."""

    def nearest(chunk: pa.Table, block: pa.Table) -> pa.Table:
        best = Best(block.num_rows, k, chunk["id"].type)
        if chunk.num_rows and block.num_rows:
            scan_block(_matrix(block["v"]), chunk["id"].combine_chunks(), _matrix(chunk["v"]), best, metric)
        return pa.table({"query_id": block["q"].take(best.rows["q"].combine_chunks()), "id": best.rows["id"], "cost": best.rows["cost"]})

    return nearest


def askable(queries: DataFrame, metric: str, query_col: str, vector_col: str) -> DataFrame:
    """q and v of the queries that can find anything, one vector an id."""
    return queries.where(usable(vector_col, metric) & F.col(query_col).isNotNull()).groupBy(F.col(query_col).alias("q")).agg(F.min(vector_col).alias("v"))


def usable(vector_col: str, metric: str) -> Column:
    """Whether a vector has a score."""
    there = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x))
    return there & F.exists(vector_col, lambda x: x != 0) if metric == "cosine" else there


def sizes(vectors: DataFrame) -> Row:
    """n, least and most dimensions of a column v."""
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).head()


def collected(asked: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of a block whose size has been checked."""
    table = asked.toArrow()
    return table["q"].combine_chunks(), _matrix(table["v"])


def ranked(found: DataFrame, k: int, metric: str, id_col: str, mapping: str | None, scale: float) -> DataFrame:
    """The k best of what was found (query_id, id, cost) for each query."""
    order = Window.partitionBy("query_id").orderBy("cost", F.asc_nulls_last("id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = _mapped(-F.col("cost") if METRICS[metric][1] else F.col("cost"), metric, mapping, scale)
    return top.select("query_id", "rank", F.col("id").alias(id_col), score.alias("similarity_score"))


def search_similar_batch(
    index: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", id_col: str = "pose_id", vector_col: str = "feature_vector", query_col: str = "query_id", mapping: str | None = None, scale: float = 1.0
) -> DataFrame:
    """query_id, rank, ``id_col``, similarity_score: the k nearest index rows of each query."""
    asked = askable(queries, metric, query_col, vector_col)
    thin = index.where(usable(vector_col, metric)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    types = f"query_id {asked.schema['q'].dataType.simpleString()}, id {thin.schema['id'].dataType.simpleString()}, cost double"
    a = sizes(asked)
    if a["n"] and a["least"] != a["most"]:
        raise ValueError(f"the queries have {a['least']} to {a['most']} dimensions")
    if a["n"] <= BLOCK and a["n"] * (a["least"] or 0) * 8 <= BLOCK_BYTES:
        one = thin.select(F.size("v").alias("dim")).head()  # a single row tells of most mistakes at once; tasks look at all
        if a["n"] and one and one["dim"] != a["least"]:
            raise ValueError(f"the query has {a['least']} dimensions, the index {one['dim']}")
        spark = index.sparkSession
        block = spark.sparkContext.broadcast(collected(asked))
        tasks = thin if a["n"] else thin.limit(0)
        found = tasks.coalesce(SCANS).mapInArrow(lambda it: _scan(it, block.value, k, metric), types)
        return ranked(found, k, metric, id_col, mapping, scale)
    b = sizes(thin)
    if b["n"] and (b["least"], b["most"]) != (a["least"], a["least"]):
        raise ValueError(f"the query has {a['least']} dimensions, the index {b['least']} to {b['most']}")
    n_blocks, n_chunks = max(1, -(-a["n"] // BLOCK)), max(1, -(-b["n"] // CHUNK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_chunks)).cast("int")  # also repeated ids are spread
    chunks = thin.select("id", "v", dealt.alias("chunk")).select("*", every(n_blocks).alias("block"))
    blocks = asked.select("q", "v", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int").alias("block")).select("*", every(n_chunks).alias("chunk"))
    found = chunks.groupBy("chunk", "block").cogroup(blocks.groupBy("chunk", "block")).applyInArrow(_cell(k, metric), types)
    return ranked(found, k, metric, id_col, mapping, scale)
