"""Packing into length buckets of least padding.

Documents longer than ``max_len`` tokens are cut into spans. The histogram of
span lengths over the whole table has at most ``max_len`` rows; a dynamic
program over it chooses the ``n_buckets`` bucket lengths with the least total
padding. Inside each bucket the spans are numbered and every
``token_budget // bucket_len`` of them form a batch.

The numbering never gathers a bucket: spans are dealt to shards by a hash of
their row, not of the id, so that no id is hot; they are numbered inside a
shard, and the running sum of the shards' counts gives each shard its first
number. There are as many shards as ``SHARD_ROWS`` asks for, so which documents
share a batch depends on the size of the table; how much is padded does not.
Only ids and lengths are shuffled.

Edge cases: a document without tokens (null or empty text) gives one row with
null bucket, batch and slot; a null id is an id like any other; repeated rows
each take a place; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limber.llm.common import text_of, words, written

MAX_LEN = 2048
N_BUCKETS = 8
TOKEN_BUDGET = 65_536
#: Spans of a shard, about; and up to so many shards their counts are broadcast.
SHARD_ROWS = 50_000
BROADCAST_SHARDS = 4096


def best_boundaries(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """The bucket lengths, ascending, that pad least; lengths must be ascending and distinct. O(n_buckets * len(lengths)^2)."""
    if not lengths:
        return []
    long, c = np.array(lengths, dtype=np.float64), np.array(counts, dtype=np.float64)
    rows, tokens = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(c * long)]
    k = min(n_buckets, len(lengths))
    least = np.full(len(lengths) + 1, np.inf)
    least[0] = 0
    came = np.zeros((k, len(lengths) + 1), dtype=np.int64)
    for b in range(k):
        new = np.full(len(lengths) + 1, np.inf)
        for j in range(1, len(lengths) + 1):  # the bucket's lengths are i..j-1, padded to lengths[j-1]
            cost = least[:j] + long[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            came[b, j] = i = int(np.argmin(cost))
            new[j] = cost[i]
        least = new
    found, j = [], len(lengths)
    for b in reversed(range(k)):
        found.append(lengths[j - 1])
        j = int(came[b, j])
    return found[::-1]


def token_lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and the number of words, the lengths used when no token counts are given."""
    return df.select(F.col(id_col), F.size(words(text_of(text_col))).cast("long").alias("n_tokens"))


def pack(
    lengths: DataFrame,
    id_col: str = "doc_id",
    length_col: str = "n_tokens",
    max_len: int = MAX_LEN,
    n_buckets: int = N_BUCKETS,
    token_budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """One row per span: id, span, start, n_tokens, bucket, bucket_len, batch_id, slot."""
    total = F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("total")
    docs = written(lengths.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), total), "lengths")
    n_spans = F.greatest(F.lit(1), F.ceil(F.col("total") / max_len)).cast("int")
    spans = docs.select("id", "row", "total", F.explode(F.sequence(F.lit(0), n_spans - 1)).alias("span")).select(
        "id",
        "row",
        "span",
        (F.col("span").cast("long") * max_len).alias("start"),
        F.least(F.lit(max_len), F.col("total") - F.col("span").cast("long") * max_len).cast("long").alias("length"),
    )
    # At most max_len rows come to the driver.
    histogram = sorted((r["length"], r["count"]) for r in spans.where(F.col("length") > 0).groupBy("length").count().collect())
    bounds = best_boundaries([x for x, _ in histogram], [n for _, n in histogram], n_buckets)
    n_shards = 1 + sum(n for _, n in histogram) // SHARD_ROWS

    bucket, bucket_len, capacity, first_batch = (F.lit(None).cast(t) for t in ("int", "long", "long", "long"))
    done = batches = 0
    starts = []
    for b in bounds:
        inside = sum(n for x, n in histogram if done < x <= b)
        starts.append(batches)
        batches += -(-inside // max(1, token_budget // b))
        done = b
    for i, b in reversed(list(enumerate(bounds))):
        fits = F.col("length") <= b
        bucket = F.when(fits, F.lit(i)).otherwise(bucket)
        bucket_len = F.when(fits, F.lit(b).cast("long")).otherwise(bucket_len)
        capacity = F.when(fits, F.lit(max(1, token_budget // b)).cast("long")).otherwise(capacity)
        first_batch = F.when(fits, F.lit(starts[i]).cast("long")).otherwise(first_batch)
    placed = spans.where(F.col("length") > 0).select(
        "*", bucket.alias("bucket"), bucket_len.alias("bucket_len"), capacity.alias("capacity"), first_batch.alias("first_batch"),
        F.pmod(F.xxhash64("row", "span"), F.lit(n_shards)).alias("shard"),
    )
    # n_buckets * n_shards rows: one for many thousand spans.
    counts = placed.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("id", "span", "row")) - 1
    offsets = F.broadcast(offsets) if n_shards <= BROADCAST_SHARDS else offsets
    numbered = placed.withColumn("local", local).join(offsets, ["bucket", "shard"]).withColumn("number", F.col("offset") + F.col("local"))
    packed = numbered.select(
        F.col("id").alias(id_col), "span", "start", F.col("length").alias("n_tokens"), "bucket", "bucket_len",
        (F.col("first_batch") + F.expr("number div capacity")).alias("batch_id"), (F.col("number") % F.col("capacity")).cast("int").alias("slot"),
    )
    nothing = spans.where(F.col("length") <= 0).select(
        F.col("id").alias(id_col), "span", "start", F.col("length").alias("n_tokens"), F.lit(None).cast("int").alias("bucket"),
        F.lit(None).cast("long").alias("bucket_len"), F.lit(None).cast("long").alias("batch_id"), F.lit(None).cast("int").alias("slot"),
    )
    return packed.unionByName(nothing)
