"""Product codes for vectors, fitted by weighted Lloyd rounds over distinct integer parts.

Components become integers, vectors are cut into ``PARTS`` consecutive parts,
and equal parts of one position are one row with its number as weight. All
assigning is done once for such a row: a task multiplies nothing by hand, it
compares its rows with the position's codebook in numpy and returns one sum a
codebook entry. Codes and errors are then joined back to the vectors.

The codebooks (entries x dimension integers, whatever the table holds) are all
that passes through the driver. Joins read written tables, so that a part that
a third of the vectors share can be split.

Edge cases:

* vectors that are null or hold a null or non-finite component are dropped;
  so are those whose length is no positive multiple of ``PARTS``, and those of
  another length than the kept vector of the smallest id has;
* components saturate at ``MOST`` (2^29, a component of 2^21), so that squared distances fit a long;
* repeated rows are each coded, and each can give a codebook entry: the first
  ones are taken by id, then by vector; null ids come last; null labels are one label;
* fewer than ``ENTRIES`` vectors make codebooks of as many entries;
* an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limber.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest integer component either way.
MOST = 1 << 29
#: Parts compared with a codebook at once.
AT_ONCE = 8192


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and v (integers) of the vectors that can be coded, of all lengths."""
    usable = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-MOST)), F.lit(MOST)).cast("int")
    fits = usable & (F.size(vector_col) > 0) & (F.size(vector_col) % PARTS == 0)
    return vectors.where(fits).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(vector_col, whole).alias("v"))


def first_vectors(kept: DataFrame, n: int) -> np.ndarray:
    """The integers of the first ``n`` vectors, n rows at most."""
    first = kept.orderBy(F.col("vec_id").isNull(), "vec_id", "v").select("v").limit(n).collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of the book for each row, the lower one of equals, and the squared distance; all in integers."""
    code, error = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    for lo in range(0, len(x), AT_ONCE):
        rows = x[lo : lo + AT_ONCE]
        d = np.zeros((len(rows), len(book)), dtype=np.int64)
        for j in range(x.shape[1]):
            d += (rows[:, j, None] - book[None, :, j]) ** 2
        best = d.argmin(axis=1)
        code[lo : lo + AT_ONCE], error[lo : lo + AT_ONCE] = best, d[np.arange(len(rows)), best]
    return code, error


def _parts(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("position").to_numpy(), batch.column("part").flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct parts with their code and error."""
    for batch in batches:
        position, x = _parts(batch, books.shape[2])
        code, error = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        for p in np.unique(position):
            at = np.flatnonzero(position == p)
            code[at], error[at] = nearest(x[at], books[p])
        yield pa.RecordBatch.from_arrays([batch.column("position"), batch.column("part"), pa.array(code), pa.array(error)], names=["position", "part", "code", "error"])


def _summed(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task's parts add to each entry: its weight and weighted component sums."""
    n_parts, n_entries, width = books.shape
    weight, total = np.zeros(n_parts * n_entries, dtype=np.int64), np.zeros((n_parts * n_entries, width), dtype=np.int64)
    for batch in batches:
        position, x = _parts(batch, width)
        w = batch.column("weight").to_numpy()
        for p in np.unique(position):
            at = np.flatnonzero(position == p)
            slot = p * n_entries + nearest(x[at], books[p])[0]
            np.add.at(weight, slot, w[at])
            np.add.at(total, slot, x[at] * w[at, None])
    used = np.flatnonzero(weight)
    columns = {"slot": pa.array(used.astype(np.int32)), "weight": pa.array(weight[used])} | {f"c{j}": pa.array(total[used, j]) for j in range(width)}
    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: the floor of the mean of what is nearest to each entry; unused entries stay."""
    width = books.shape[2]
    sums = [f"c{j}" for j in range(width)]
    schema = "slot int, weight long, " + ", ".join(f"{c} long" for c in sums)
    rows = distinct.mapInArrow(lambda it: _summed(it, books), schema).groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("weight", *sums)]).collect()
    new = books.reshape(-1, width).copy()
    for r in rows:  # one an entry at most
        new[r["slot"]] = [r[c] // r["weight"] for c in sums]
    return new.reshape(books.shape)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _exploded(v: str, width: int) -> Column:
    """The parts of a vector, with their positions."""
    return F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.slice(v, p * width + 1, width))).alias("position", "part")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """One row a kept vector: the id, code, error, label_error, codebooks_sha256 and the label.

    ``entries`` is 128 at most: a code is shown as two hex digits, and eight of them are summed in a long.
    """
    if not 1 <= entries <= 128:
        raise ValueError("codebooks have 1 to 128 entries")
    kept = written(integer_vectors(vectors, id_col, vector_col, label_col), "integers")
    first = kept.orderBy(F.col("vec_id").isNull(), "vec_id", "v").select(F.size("v").alias("dim")).head()
    dim = first["dim"] if first else PARTS
    kept = kept.where(F.size("v") == dim).withColumn("row", F.monotonically_increasing_id())  # of written files, so rows keep their numbers
    width = dim // PARTS
    start = first_vectors(kept, entries)
    books = start.reshape(-1, PARTS, width).transpose(1, 0, 2).copy()

    parts = kept.select("row", "vec_id", "label", _exploded("v", width))
    distinct = written(parts.groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")), "parts")
    if len(start):
        for _ in range(rounds):
            books = lloyd_round(distinct, books)
    coded = written(distinct.select("position", "part").mapInArrow(lambda it: _coded(it, books), "position int, part array<int>, code long, error long"), "codes")

    place = lambda low: F.sum(F.when(F.col("position").between(low, low + 7), F.expr(f"shiftleft(code, ({low + 7} - position) * 8)")).otherwise(F.lit(0).cast("long")))
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    joined = parts.join(coded, ["position", "part"]).groupBy("row", "vec_id", "label").agg(place(0).alias("high"), place(8).alias("low"), F.sum("error").alias("error"))
    errors = written(joined.select("vec_id", "label", F.concat(hexed("high"), hexed("low")).alias("code"), "error"), "errors")
    totals = written(errors.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "totals")
    return errors.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).select(
        F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"), "label"
    )
