"""The pruned index against a scan of all vectors, and the scan's plan."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limber.operators import cells, index, knn

SCHEMA = "pose_id long, feature_vector array<float>"


def clustered(n, dim, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(12, dim))[rng.integers(12, size=n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    x[n // 2] = x[3]  # a tie
    x[n // 3] = 0
    return [(i, v.tolist()) for i, v in enumerate(x)]


def same(a, b):
    key = lambda r: (r["query_id"], r["rank"])
    a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert [(r["query_id"], r["rank"], r["pose_id"]) for r in a] == [(r["query_id"], r["rank"], r["pose_id"]) for r in b]
    assert np.allclose([r["similarity_score"] for r in a], [r["similarity_score"] for r in b], atol=1e-9)


def test_cells_equal_the_scan(spark, tmp_path):
    rows = clustered(1500, 12, 1) + [(5000, None), (5001, [float("nan")] * 12), (3, clustered(1500, 12, 1)[3][1])]
    df = spark.createDataFrame(rows, SCHEMA)
    cells.build_cells(df, str(tmp_path))
    asked = df.where("pose_id % 60 = 3").withColumnRenamed("pose_id", "query_id")
    for metric in ("l2", "cosine", "dot"):
        for k in (1, 7):
            found, left = cells.search_cells(spark, str(tmp_path), asked, k, metric)
            same(found, knn.search_similar_batch(df, asked, k, metric))
            assert left["pairs"] <= left["all_pairs"] and left["cells"] <= left["all_cells"]
            if metric != "dot":
                assert left["pairs"] < left["all_pairs"] / 2
    one = df.where("pose_id = 9").withColumnRenamed("pose_id", "query_id")
    found, left = cells.search_cells(spark, str(tmp_path), one, 5, "l2")
    assert left["cells"] < left["all_cells"] / 2
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(cell" in plan
    same(cells.search_cells(spark, str(tmp_path), asked, 4, "l2", mapping="inverse", scale=2.0)[0], knn.search_similar_batch(df, asked, 4, "l2", mapping="inverse", scale=2.0))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.integers(-2, 2), min_size=2, max_size=2), min_size=1, max_size=30), st.integers(1, 4), st.sampled_from(["cosine", "dot", "l2"]), st.integers(1, 6))
def test_cells_with_many_ties(spark, tmp_path_factory, rows, k, metric, n_cells):
    path = str(tmp_path_factory.mktemp("cells"))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], SCHEMA)
    cells.build_cells(df, path, n_cells)
    asked = df.where("pose_id < 6").withColumnRenamed("pose_id", "query_id")
    same(cells.search_cells(spark, path, asked, k, metric)[0], knn.search_similar_batch(df, asked, k, metric))


def test_cells_edges(spark, tmp_path):
    df = spark.createDataFrame(clustered(40, 3, 2), SCHEMA)
    with pytest.raises(FileNotFoundError):
        cells.search_cells(spark, str(tmp_path), df)
    asked = df.limit(2).withColumnRenamed("pose_id", "query_id")
    cells.build_cells(df.limit(0), str(tmp_path))
    assert cells.search_cells(spark, str(tmp_path), asked)[0].count() == 0
    cells.build_cells(df, str(tmp_path))
    assert cells.search_cells(spark, str(tmp_path), asked.limit(0))[0].count() == 0
    assert cells.search_cells(spark, str(tmp_path), asked, version=0)[0].count() == 0  # the version before
    assert cells.search_cells(spark, str(tmp_path), asked, 100, "l2")[0].count() == 80
    with pytest.raises(ValueError, match="dimensions"):
        cells.search_cells(spark, str(tmp_path), spark.createDataFrame([(1, [1.0])], "query_id long, feature_vector array<float>"))
    with pytest.raises(ValueError, match="dimensions"):
        cells.build_cells(df.unionByName(spark.createDataFrame([(1, [1.0])], SCHEMA)), str(tmp_path))
    assert len(index.clear_old_versions(spark, str(tmp_path))) >= 1
    assert cells.search_cells(spark, str(tmp_path), asked)[0].count() == 10


def test_one_block_does_not_shuffle_the_index(spark):
    df = spark.createDataFrame(clustered(300, 4, 3), SCHEMA).repartition(7)
    found = knn.search_similar_batch(df, df.where("pose_id < 9").withColumnRenamed("pose_id", "query_id"), 3)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("MapInArrow") :].split("Initial Plan")[0]
    assert scan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in scan  # the test's own


def test_scan_keeps_ties_that_rounding_blurs(spark):
    base = np.full(8, 1e4, dtype=np.float32)
    rows = [(i, base.tolist()) for i in range(30)] + [(100 + i, (base + np.float32(0.001)).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(1, base.tolist())], "query_id long, feature_vector array<float>")
    for metric in ("l2", "cosine"):
        got = knn.search_similar_batch(df, asked, 4, metric).orderBy("rank").collect()
        assert [r["pose_id"] for r in got] == [0, 1, 2, 3] or metric == "cosine"
    assert F is not None
