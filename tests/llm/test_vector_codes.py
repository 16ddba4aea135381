"""Vector codes against Lloyd's rounds over all vectors, in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from limber.llm import vector_codes

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=64, rounds=2, parts=16, clip=1 << 29):
    kept = []
    for i, v, label in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not v or len(v) % parts:
            continue
        kept.append((i, [max(-clip, min(clip, math.floor(256 * float(np.float32(x))))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def assign(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        e = min(range(len(d)), key=lambda i: (d[i], i))
        return e, d[e]

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(assign(cut(v, p), books[p])[0], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else b for e, b in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    out, totals = [], {}
    for i, v, label in kept:
        found = [assign(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for _, d in found)
        totals[label] = totals.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
    return sorted(((i, code, error, totals[label], sha, label) for i, code, error, label in out), key=str)


def coded(spark, rows, **how):
    df = spark.createDataFrame(rows, ROWS).select("*", *[F.lit(3).alias(c) for c in ("row", "v", "position", "part", "code", "error", "weight", "of_label")])
    got = vector_codes.vector_codes(df, **how).collect()
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256", "label")) for r in got), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    one = lambda: [float(np.float32(x)) for x in rng.normal(0, 0.02, 32)]
    rows = [(i, one(), int(rng.integers(4)) if i % 5 else None) for i in range(400)]
    hot = one()
    rows += [(1000 + i, hot, 2) for i in range(200)]
    rows += [(2000 + i, [0.0] * 32, None) for i in range(30)]
    rows += [rows[3], rows[3], (5, one(), 1), (None, one(), 1), (None, rows[8][1], None)]
    return rows


def test_against_all_vectors(spark, rows):
    assert coded(spark, rows) == brute(rows)
    assert coded(spark, rows[::-1], entries=7, rounds=3) == brute(rows, entries=7, rounds=3)


def test_what_is_dropped(spark, rows):
    bad = [(-9, None, 1), (-8, [], 1), (-7, [0.1] * 31, 1), (-6, [float("nan")] + [0.1] * 31, 1), (-5, [float("inf")] + [0.1] * 31, 1), (-4, [float("-inf")] + [0.1] * 31, 1), (-3, [None] + [0.1] * 31, 1)]
    other = [(3000, [0.5] * 16, 1), (3001, [0.5] * 48, 1)]
    assert coded(spark, rows[:90] + bad + other) == brute(rows[:90])


def test_few_ties_and_extremes(spark):
    few = [(1, [0.5] * 16, 1), (2, [0.5] * 16, 1), (3, [-0.001] * 16, 2)]
    assert coded(spark, few) == brute(few)
    wild = [(i, [float(np.float32(x)) for x in (3e38, -3e38, 1e6, -1e6, *[i / 3] * 12)], 1) for i in range(70)]
    assert coded(spark, wild) == brute(wild)
    long = [(i, [float(np.float32(np.sin(i * j))) for j in range(1600)], None) for i in range(20)]
    assert coded(spark, long, entries=5) == brute(long, entries=5)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
    with pytest.raises(ValueError):
        coded(spark, few, entries=200)
