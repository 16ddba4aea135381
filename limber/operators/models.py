"""Model files on executors: shared once, checked by digest, loaded once a Python process.

A file of any store that Spark reads is copied under its digest into the shared
folder and added to the application, so that each executor fetches it once.
The task that first needs the model checks the digest of what it got and loads
it; tasks that follow in the same Python process, of this and of later jobs,
use the instance that is there.

Edge cases: a file that is not there is an error on the driver; one that
changed on its way is an error in the task; two files of one name are told
apart by their digests; a model is loaded when the first image arrives, so
tasks without images load nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark import SparkFiles
from pyspark.sql import SparkSession

from limber.session import own_folder

#: Models of this process, by the digest of their file and the name of their loader.
_loaded: dict[tuple[str, str], Any] = {}


@dataclass(frozen=True)
class ModelFile:
    """A file that executors have."""

    name: str
    sha256: str

    def path(self) -> str:
        """Where it lies in this process's machine; checked."""
        local = SparkFiles.get(self.name)
        with open(local, "rb") as f:
            found = hashlib.file_digest(f, "sha256").hexdigest()
        if found != self.sha256:
            raise ValueError(f"{self.name} has the SHA-256 {found}")
        return local


def share_model(spark: SparkSession, path: str) -> ModelFile:
    """Bring a model's file to the executors."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(path)
    store = source.getFileSystem(conf)
    stream = store.open(source)
    try:
        sha256 = jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
    file = ModelFile(f"{sha256[:16]}-{source.getName()}", sha256)
    copy = jvm.org.apache.hadoop.fs.Path(f"{own_folder(spark)}/models/{file.name}")
    target = copy.getFileSystem(conf)
    if not target.exists(copy):
        draft = jvm.org.apache.hadoop.fs.Path(f"{copy}.draft")
        jvm.org.apache.hadoop.fs.FileUtil.copy(store, source, target, draft, False, conf)
        target.rename(draft, copy)
    spark.sparkContext.addFile(target.makeQualified(copy).toString())
    return file


def loaded(file: ModelFile, load: Callable[[str], Any]) -> Any:
    """The model of a file, as ``load`` makes it of a path: this process's instance."""
    key = (file.sha256, f"{load.__module__}.{load.__qualname__}")
    if key not in _loaded:
        _loaded[key] = load(file.path())
    return _loaded[key]


def model_factory(file: ModelFile, load: Callable[[str], Any], use: Callable[[Any], Callable] | None = None) -> Callable[[], Callable]:
    """A factory for :mod:`limber.operators.detect`: ``load`` makes a model of the file's path, once a process; ``use`` makes a detector of the model (by default it is one)."""

    def make() -> Callable:
        model = loaded(file, load)
        return use(model) if use else model

    return make
