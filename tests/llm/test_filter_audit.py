"""The filter audit against every order run one after the other."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from limber.llm import filter_audit

WS = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string"


def fails(doc, first):
    i, text, _ = doc
    t = text or ""
    w = [x for x in WS.split(t) if x]
    found = set()
    if len(w) < 200:
        found.add("A")
    if 100 * len(set(w)) < 50 * len(w):
        found.add("B")
    if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
        found.add("C")
    if re.search(r"[#$%&*|]", t):
        found.add("D")
    if i is not None and first[t] is not None and i > first[t]:
        found.add("E")
    return found


def brute(docs, labels):
    first = {}
    for i, t, _ in docs:
        known = [x for x in (first.get(t or ""), i) if x is not None]
        first[t or ""] = min(known) if known else None
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, totals = {}, collections.Counter()
    parts = collections.defaultdict(list)
    for d in docs:
        parts[d[2] or ""].append((d[0], fails(d, first)))
    for part, members in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in m[1] for m in members) - len(gone), sum(m[1] == {f} for m in members), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone),
                ]
                totals[part, f] += len(gone)
    return {k: (*v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got}
    assert len(found) == len(got)
    return found


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        n, pool = int(rng.choice([3, 199, 200, 260])), int(rng.choice([20, 4000]))
        w = [f"w{rng.integers(pool)}" for _ in range(n)]
        if rng.random() < 0.4:
            w = [x.upper() if rng.random() < 0.2 else x for x in w]
        if rng.random() < 0.3:
            w[0] += rng.choice(list("#$%&*|"))
        rows.append((i, " ".join(w), ["hot", "b", None, ""][int(rng.choice(4, p=[0.6, 0.2, 0.1, 0.1]))]))
    rows += [(500 + i, rows[i % 3][1], "hot" if i % 2 else "copies") for i in range(40)]
    rows += [(600, None, "b"), (601, "", "b"), (602, " \n\t", "b"), (603, "a  b\x0bc d", "b"), (None, rows[0][1], "b"), (None, None, None)]
    rows += [rows[4], rows[4], (700, "Word " * 50_000, "b"), (701, "A" * 49 + "a" * 2451, "b"), (702, "A" * 51 + "a" * 2449, "b"), (4, "another text of id 4", "b")]
    return rows


LABELS = [(i, i % 2, i % 3 % 2) for i in range(0, 150, 2)] + [(500, None, 1), (502, 1, None), (4, 0, 1), (4, 1, 0), (None, 1, 1), (9999, 1, 1)]


def frames(spark, docs, labels):
    clashing = ("id", "part", "mask", "digest", "first", "good", "toxic", "n", "w", "quality")
    d = spark.createDataFrame(docs, DOCS).select("*", *[F.lit(1).alias(c) for c in clashing])
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))


def test_against_every_order(spark, docs):
    assert rows_of(filter_audit.filter_audit(*frames(spark, docs, LABELS))) == brute(docs, LABELS)


def test_empty_tables(spark, docs):
    d, k = frames(spark, docs, LABELS)
    assert filter_audit.filter_audit(d.limit(0), k).count() == 0
    assert rows_of(filter_audit.filter_audit(d, k.limit(0))) == brute(docs, [])


def test_sums_hold(spark, docs):
    got = rows_of(filter_audit.filter_audit(*frames(spark, docs, LABELS)))
    n = collections.Counter(d[2] or "" for d in docs)
    for (part, order, step), r in got.items():
        before = n[part] if step == 1 else got[part, order, step - 1][0]
        assert r[0] + r[1] == before
    for part in n:
        survivors = got[part, "ABCDE", 5][0]
        assert sum({o[s - 1]: r[6] for (p, o, s), r in got.items() if p == part}.values()) == 120 * (n[part] - survivors)
