"""The pipeline's stages against brute force, and the registry."""

import collections
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from limber.llm.common import own_folder
from limber.llm.mixing import mixing_weights
from limber.llm.token_counts import token_counts

WS = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def split(text):
    return [w for w in WS.split(text or "") if w]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(31)
    text = lambda n: " ".join(f"v{rng.integers(3000)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))
    rows = [(i, text(int(rng.integers(60, 160)))) for i in range(50)]
    rows += [(100 + i, rows[3][1].replace(" ", "\n", 4)) for i in range(4)]
    rows += [(200 + i, " ".join("new" if j in (9, 40 + i) else w for j, w in enumerate(rows[8][1].split()))) for i in range(5)]
    rows += [(300, None), (301, ""), (302, "too short"), (303, "a | b | c | d | e\n" * 30), rows[0]]
    docs = spark.createDataFrame([(i, t, ["en", "de"][i % 2], f"s{i % 3}", len(t or "")) for i, t in rows], DOCS)
    where = tmp_path_factory.mktemp("sf")
    docs.withColumn("row", F.lit(1)).write.parquet(f"{where}/documents.parquet")
    return str(where)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        path = f"{sf_dir}/{name.replace(' ', '_')}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    ids = [sorted(r["doc_id"] for r in d.collect()) for d in seen]
    clean = sorted([*range(50), *range(100, 104), *range(200, 205), 0])
    assert ids[1] == clean
    assert ids[2] == sorted(set(clean) - set(range(100, 104)))
    assert ids[3] == list(range(50))
    sampled = mixing_weights(seen[3]).where("sampled").select("doc_id").collect()
    assert ids[4] == sorted(r["doc_id"] for r in sampled) and 0 < len(ids[4]) <= 50
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    lengths = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs).collect()}
    assert all(n >= len(split(r["text"])) for r in docs.collect() for n in [lengths[r["doc_id"]]])
    total = collections.Counter()
    for r in packed:
        total[r["doc_id"]] += r["n_tokens"]
    assert total == lengths


def test_run_and_empty(spark, sf_dir, tmp_path):
    before = set(os.listdir(own_folder(spark).removeprefix("file:"))) if os.path.isdir(own_folder(spark).removeprefix("file:")) else set()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    left = set(os.listdir(own_folder(spark).removeprefix("file:"))) - before
    assert len(left) == 1 and left.pop().startswith("packing-")  # nothing else is left behind
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {re.match(r"op\d+_", n)[0] for n in names if n.startswith("op")} == {f"op{i}_" for i in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
