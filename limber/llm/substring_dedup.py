"""Substring de-duplication: seed and extend.

A window is ``window`` consecutive words of one document. Every word covered
by a window that also starts in a document with a smaller id is removed.

1. Seeds. Of the k-word runs inside each window the one with the smallest hash
   is its anchor (winnowing). The choice depends on the window's words alone,
   so equal windows have equal anchors at equal offsets, and about one position
   in 21 is an anchor. Anchors found in two documents or more are the seeds.
2. Extend. Around each seed the windows that have it as their anchor reach
   ``window - k`` words to either side. An occurrence is compared, window by
   window in both directions, with the occurrence in the smallest id, the hub;
   if windows are left and a third row holds the seed, also with the smallest
   id of those that have some left. What is left then is matched by digest.
3. Neighbouring windows that match join up into the maximal repeats, whose
   words are removed.

Documents whose words equal those of a smaller id are settled by a digest of
the whole. Comparisons are of 64-bit digests, within one 64-bit anchor. Texts
are shuffled once, to meet their seeds; then only those that have any. A hot
seed is only ever joined with its one hub and aggregated, never gathered.

Edge cases: null and short texts have no windows and keep all their words; a
null id is larger than none and smaller than none, its row keeps everything;
rows of one id are one document, so repeats among them stay; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limber.llm.common import text_of, words, written

WINDOW = 50
K = 10
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def run_digests(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit digest of each run of ``size`` words, from the words' own 64-bit hashes."""
    n = len(ids)
    sums = np.r_[np.uint64(0), np.cumsum(ids.view(np.uint64) * _powers(_BASE, n), dtype=np.uint64)]
    x = (sums[size:] - sums[:-size]) * _powers(_INVERSE, n - size + 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(ids: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, their digests, and the first and last window start that has each as its anchor."""
    grams = run_digests(ids, k)
    spans = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1)
    chosen = spans.argmin(axis=1) + np.arange(len(spans))
    at, first, n = np.unique(chosen, return_index=True, return_counts=True)
    return at, grams[at], first, first + n - 1


def _ids(lists: pa.ListArray, i: int) -> np.ndarray:
    return lists[i].values.to_numpy(zero_copy_only=False)


def _seeds(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, positions, digests = [], [], []
        lists = batch.column("wh")
        for i in range(len(lists)):
            at, digest, _, _ = anchors(_ids(lists, i), window, k)
            rows.append(np.full(len(at), i))
            positions.append(at.astype(np.int32))
            digests.append(digest.view(np.int64))
        if rows:
            ids = batch.column("id").take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(digests)), ids, pa.array(np.concatenate(positions))], names=["anchor", "id", "pos"])


def _contexts(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """For each marked anchor the digests of its windows."""
    for batch in batches:
        lists, marks = batch.column("wh"), batch.column("marks")
        out: dict[str, list] = {x: [] for x in ("row", "anchor", "pos", "lo", "hub", "several", "digests")}
        for i in range(len(lists)):
            ids = _ids(lists, i)
            at, digest, lo, hi = anchors(ids, window, k)
            windows = run_digests(ids, window).view(np.int64)
            place = {int(p): j for j, p in enumerate(at)}
            for mark in marks[i].as_py():
                j = place.get(mark["pos"])
                if j is not None:
                    for name, v in (("row", i), ("anchor", digest[j : j + 1].view(np.int64)[0]), ("pos", mark["pos"]), ("lo", lo[j]), ("hub", mark["hub"]), ("several", mark["several"]), ("digests", windows[lo[j] : hi[j] + 1])):
                        out[name].append(v)
        sizes = np.array([len(x) for x in out["digests"]], dtype=np.int32)
        flat = np.concatenate(out["digests"]) if out["digests"] else np.empty(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(out["anchor"], dtype=np.int64)),
                batch.column("id").take(pa.array(np.array(out["row"], dtype=np.int64))),
                pa.array(np.array(out["pos"], dtype=np.int32)),
                pa.array(np.array(out["lo"], dtype=np.int32)),
                pa.array(np.array(out["hub"], dtype=bool)),
                pa.array(np.array(out["several"], dtype=bool)),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat)),
            ],
            names=["anchor", "id", "pos", "lo", "hub", "several", "digests"],
        )


def maximal_repeats(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges [from, to) covered by windows at ``starts`` (ascending)."""
    found: list[tuple[int, int]] = []
    for s in starts.tolist():
        if found and s <= found[-1][1]:
            found[-1] = (found[-1][0], s + window)
        else:
            found.append((s, s + window))
    return found


def _cut(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for id_, text, starts in zip(batch["id"], batch["text"], batch["starts"], strict=True):
            ws = text.encode().split()
            keep, at = [], 0
            spans = [(a, min(b, len(ws))) for a, b in maximal_repeats(np.unique(starts), window)]
            for a, b in spans:
                keep += ws[at:a]
                at = b
            keep += ws[at:]
            kept = b" ".join(keep)
            rows.append((id_, len(ws), len(ws) - len(keep), hashlib.sha256(kept).hexdigest(), kept.decode(), [{"from": a, "to": b} for a, b in spans]))
        yield pd.DataFrame(rows, columns=["id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"])


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def repeated_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, with_text: bool = True) -> DataFrame:
    """One row per input row: the id, n_words, n_removed, kept_sha256 and, if ``with_text``, kept_text and the removed spans."""
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    split = docs.select("*", words(F.col("text")).alias("w"))
    whole = written(split.select("id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("same")).where("id is not null"), "whole")
    long = whole.where(F.col("n_words") >= window)
    first = long.groupBy("same").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("same", "first")
    first = written(first, "first")  # written, so that a join of its own can split a hot text
    copies = written(long.join(first, "same").where("id > first").select("id").distinct(), "copies")

    hashed = F.transform("w", lambda x: F.xxhash64(x)).alias("wh")
    windowed = split.where(F.col("id").isNotNull() & (F.size("w") >= window)).select("id", hashed)
    found = written(windowed.mapInArrow(lambda it: _seeds(it, window, k), f"anchor long, id {id_type}, pos int"), "anchors")
    groups = found.groupBy("anchor").agg(F.min(F.struct("id", "pos")).alias("hub"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("hub.id < last")
    groups = written(groups, "groups")  # written, so that a join of its own can split a hot seed
    seeds = found.join(groups, "anchor").select("id", F.struct("pos", ((F.col("hub.id") == F.col("id")) & (F.col("hub.pos") == F.col("pos"))).alias("hub"), (F.col("n") > 2).alias("several")).alias("mark"))
    marks = seeds.join(copies, "id", "left_anti").groupBy("id").agg(F.collect_set("mark").alias("marks"))

    # The one shuffle of all texts. Texts without seeds are done here and not carried on.
    copy = copies.withColumn("copy", F.lit(True))
    met = docs.where("id is not null").join(marks, "id", "left").join(copy, "id", "left").select("id", "text", "marks", F.coalesce("copy", F.lit(False)).alias("copy"))
    plain = met.select("*", words(F.col("text")).alias("w"))
    judged = written(
        plain.select(
            "id", "marks", "copy", F.size("w").cast("long").alias("n_words"),
            F.when(F.col("copy"), "").otherwise(F.array_join("w", " ")).alias("kept_text"),
        ).select("id", "marks", "copy", "n_words", _sha(F.col("kept_text")).alias("kept_sha256"), *(["kept_text"] if with_text else [F.when(F.col("marks").isNotNull(), F.col("kept_text")).alias("kept_text")])),
        "judged",
    )
    open_ = judged.where("marks is not null").select("id", F.transform(words(F.col("kept_text")), lambda x: F.xxhash64(x)).alias("wh"), "marks")
    contexts = open_.mapInArrow(lambda it: _contexts(it, window, k), f"anchor long, id {id_type}, pos int, lo int, hub boolean, several boolean, digests array<long>")
    contexts = written(contexts, "contexts")

    hubs = contexts.where("hub").select("anchor", F.col("id").alias("hub_id"), (F.col("pos") - F.col("lo")).alias("hub_reach"), F.col("digests").alias("hub_digests"))
    shift = F.col("hub_reach") - (F.col("pos") - F.col("lo"))
    same_window = lambda d, i: (F.col("hub_id") < F.col("id")) & F.coalesce(F.get("hub_digests", i + F.col("shift")) == d, F.lit(False))
    compared = contexts.where("not hub").join(hubs, "anchor").withColumn("shift", shift).select("id", "anchor", "pos", "lo", "several", "digests", F.transform("digests", same_window).alias("same"))
    compared = written(compared, "compared")
    # Once more with the smallest id that is still open, for groups whose hub is the odd one out.
    open_again = compared.where(F.col("several") & F.exists("same", lambda x: ~x))
    second = open_again.groupBy("anchor").agg(F.min(F.struct("id", (F.col("pos") - F.col("lo")).alias("reach"), "digests")).alias("hub"))
    second = second.select("anchor", F.col("hub.id").alias("hub_id"), F.col("hub.reach").alias("hub_reach"), F.col("hub.digests").alias("hub_digests"))
    second = written(second, "second")
    again = open_again.join(second, "anchor").withColumn("shift", shift).select("id", "anchor", "pos", "lo", "several", "digests", F.zip_with("same", F.transform("digests", same_window), lambda x, y: x | y).alias("same"))
    compared = written(compared.where(~(F.col("several") & F.exists("same", lambda x: ~x))).unionByName(again), "compared_again")
    by_hub = compared.select("id", F.filter(F.transform("same", lambda x, i: F.when(x, F.col("lo") + i)), lambda s: s.isNotNull()).alias("starts")).where(F.size("starts") > 0)

    pending = compared.where("several").select("id", "anchor", "lo", F.posexplode(F.arrays_zip("digests", "same")).alias("i", "w")).where("not w.same")
    keyed = pending.select("anchor", F.col("w.digests").alias("digest"), "id", (F.col("lo") + F.col("i")).alias("start"))
    least = keyed.groupBy("anchor", "digest").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last").select("anchor", "digest", "least")
    least = written(least, "least")
    by_rest = keyed.join(least, ["anchor", "digest"]).where("id > least").select("id", F.array("start").alias("starts"))
    removed = by_hub.unionByName(by_rest).groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    cut_schema = f"id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<`from`:int,`to`:int>>"
    hit = judged.where("marks is not null").select("id", F.col("kept_text").alias("text")).join(removed, "id").mapInPandas(lambda it: _cut(it, window), cut_schema)
    intact = judged.join(removed.select("id"), "id", "left_anti")
    all_span = F.array(F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to")))
    no_span = F.array().cast("array<struct<`from`:int,`to`:int>>")
    rest = intact.select(
        "id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        "kept_sha256", "kept_text", F.when(F.col("copy"), all_span).otherwise(no_span).alias("spans"),
    )
    joined = F.array_join("w", " ")
    unknown = split.where("id is null").select("id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), _sha(joined).alias("kept_sha256"), joined.alias("kept_text"), no_span.alias("spans"))
    out = hit.unionByName(rest).unionByName(unknown)
    shown = [F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept_text", "spans"] if with_text else [])]
    return out.select(*shown)
