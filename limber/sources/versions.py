"""A log of versions: one small file a commit, which names everything the version holds.

Data is written first, into folders that no version names yet; then the commit
file is written under a name of its own and renamed to its number. A rename to
a number that is taken fails, so of two writers that started from one version
one is told to begin again, and a job that breaks off before its rename has
changed nothing. Readers take the highest number once and read what it names:
they never see part of a commit, and what they read stays until it is cleared.

A version's content is a JSON object; there is one file per version, so that
reading the newest needs no other.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has committed meanwhile."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, store = _path(spark, path)
    return store.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, by name; nothing if there is none."""
    p, store = _path(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """All versions that can be read, ascending."""
    return sorted(int(n.removesuffix(".json")) for n in names(spark, f"{root}/log") if n.endswith(".json") and n[:-5].isdecimal())


def read_version(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    """A version's number and content; of the newest if none is asked for. Before the first commit: -1 and nothing."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return -1, {}
        version = known[-1]
    p, store = _path(spark, f"{root}/log/{version:020d}.json")
    stream = store.open(p)
    try:
        return version, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, after: int, content: dict) -> int:
    """Make ``content`` the version that follows ``after``; :class:`Conflict` if there is one already."""
    jvm = spark._jvm
    new, store = _path(spark, f"{root}/log/{after + 1:020d}.json")
    draft, _ = _path(spark, f"{root}/log/draft-{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(json.dumps(content).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.makeQualified(new).toUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # no overwriting
    try:
        context.rename(store.makeQualified(draft), store.makeQualified(new), never)
    except Py4JJavaError as refused:
        store.delete(draft, False)
        if "FileAlreadyExistsException" in str(refused.java_exception):
            raise Conflict(f"version {after + 1} of {root} is taken") from refused
        raise
    return after + 1


def clear(spark: SparkSession, root: str, named: set[str], keep: int = 1) -> list[str]:
    """Delete all but the newest ``keep`` versions' files and the folders of ``data`` that ``named`` lacks; returns these folders.

    Nothing may be writing, or reading older versions, meanwhile.
    """
    gone = [n for n in names(spark, f"{root}/data") if n not in named]
    old = [f"{v:020d}.json" for v in versions(spark, root)[:-keep]] + [n for n in names(spark, f"{root}/log") if n.startswith("draft-")]
    for path in [f"{root}/data/{n}" for n in gone] + [f"{root}/log/{n}" for n in old]:
        p, store = _path(spark, path)
        store.delete(p, True)
    return gone
