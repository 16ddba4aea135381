"""The store: content ids, whole commits, snapshots."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from limber.sources import store, versions

SCHEMA = (
    "image_path string, width int, height int, person_id int, keypoints array<array<double>>, visibility array<double>, bbox array<double>,"
    " overall_confidence double, created_at timestamp, geometric array<double>, visual array<double>, fused array<double>"
)


def detections(spark, n=2, path="a.jpg"):
    return spark.createDataFrame([(path, 4, 5, i, [[1.0, float(i)]], [1.0], [0.0] * 4, 0.5, None, [1.0], None if i else [2.0], [1.0, 2.0]) for i in range(n)], SCHEMA)


def counts(spark, root):
    return {t: store.read_table(spark, root, t).count() for t in store.TABLES}


def test_store(spark, tmp_path):
    df, root = detections(spark), str(tmp_path)
    assert store.read_table(spark, root, "images").count() == 0
    assert store.store_detections(df, root).count() == 2
    assert store.store_detections(df, root).count() == 0  # nothing new
    assert counts(spark, root) == {"images": 1, "pose_detections": 2, "geometric_features": 2, "visual_features": 1, "fused_features": 2}
    more = df.withColumn("image_path", F.lit("b.jpg")).unionByName(df)
    more = more.unionByName(more.where("image_path = 'b.jpg' and person_id = 0"))  # the same pose once more
    assert sorted(r["image_path"] for r in store.store_detections(more, root).collect()) == ["b.jpg"] * 3
    assert store.store_detections(more, root).count() == 0
    assert store.read_table(spark, root, "pose_detections").select("id").distinct().count() == 5
    assert store.store_detections(df.limit(0), root).count() == 0
    before = store.snapshot(spark, root)
    store.truncate(spark, root, "pose_detections", cascade=True)
    assert store.read_table(spark, root, "fused_features").count() == 0 and store.read_table(spark, root, "images").count() == 2
    assert before.read(spark, "fused_features").count() == 5 and store.snapshot(spark, root, before.version).read(spark, "images").count() == 2
    assert sorted(os.listdir(f"{root}/data")) == sorted(f for f in os.listdir(f"{root}/data") if f.startswith("batch-"))  # no input is left behind
    with pytest.raises(ValueError):
        store.read_table(spark, root, "poses")


def test_a_new_pose_is_told_from_a_stored_one(spark, tmp_path):
    """Plain detection has no person; ids must not depend on what else is in the batch, or on its order."""
    one = detections(spark, 1).withColumn("person_id", F.lit(None).cast("int"))
    other = one.withColumn("keypoints", F.array(F.array(F.lit(-9.0), F.lit(-9.0))))
    root = str(tmp_path)
    assert store.store_detections(one, root).count() == 1
    assert store.store_detections(one.unionByName(other), root).count() == 1
    points = sorted(r["keypoints"][0] for r in store.read_table(spark, root, "pose_detections").collect())
    assert points == [[-9.0, -9.0], [1.0, 0.0]]
    third = one.withColumn("keypoints", F.array(F.array(F.lit(5.0), F.lit(5.0))))
    assert store.store_detections(third, root).count() == 1  # another pose of a known path
    assert store.store_detections(one.withColumn("det_idx", F.lit(1)), root).count() == 1
    assert store.store_detections(one.withColumn("overall_confidence", F.lit(None).cast("double")), root).count() == 1
    assert store.read_table(spark, root, "images").count() == 1


@pytest.mark.parametrize("after", ["rows", *store.TABLES])
def test_a_crash_between_tables_leaves_readers_consistent(spark, tmp_path, monkeypatch, after):
    root = str(tmp_path)
    store.store_detections(detections(spark), root)
    before = counts(spark, root)
    parts = store._parts

    def broken(rows):
        found = parts(rows)
        names = list(found)
        for name in names[names.index(after) + 1 if after in names else 0 :]:
            found[name] = found[name].withColumn(found[name].columns[0], F.raise_error(F.lit("lost")))
        return found

    if after != store.TABLES[-1]:
        monkeypatch.setattr(store, "_parts", broken)
        with pytest.raises(Exception, match="lost"):
            store.store_detections(detections(spark, 3, "b.jpg"), root)
    else:  # all tables are written, the commit is not
        monkeypatch.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.store_detections(detections(spark, 3, "b.jpg"), root)
    assert counts(spark, root) == before
    monkeypatch.undo()
    assert store.store_detections(detections(spark, 3, "b.jpg"), root).count() == 3
    assert counts(spark, root) == {"images": 2, "pose_detections": 5, "geometric_features": 5, "visual_features": 2, "fused_features": 5}
    assert len(store.vacuum(spark, root)) == 1 and counts(spark, root)["pose_detections"] == 5
    assert len(os.listdir(f"{root}/data")) == 2 and len(os.listdir(f"{root}/log")) == len([f for f in os.listdir(f"{root}/log") if "00001.json" in f])


def test_writers_at_once(spark, tmp_path):
    """All of several batches are stored, what they share only once, and each commit is one batch."""
    root = str(tmp_path)
    frames = [detections(spark, 3, "shared.jpg").unionByName(detections(spark, 2, f"own{i}.jpg")) for i in range(3)]
    failed = []

    def run(df):
        try:
            store.store_detections(df, root).count()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(df,)) for df in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and counts(spark, root)["pose_detections"] == 3 + 3 * 2 and counts(spark, root)["images"] == 4
    assert versions.versions(spark, root) == [0, 1, 2]
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, 0, {})


def test_compact_and_vacuum(spark, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        store.store_detections(detections(spark, 2, f"{i}.jpg"), root)
    old, before = store.snapshot(spark, root), counts(spark, root)
    store.compact(spark, root)
    assert counts(spark, root) == before and old.read(spark, "images").count() == 3
    assert len(store.vacuum(spark, root)) == 3 and counts(spark, root) == before
    assert store.store_detections(detections(spark, 3, "1.jpg"), root).count() == 1
