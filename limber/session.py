"""What a Spark session needs to run the library's Python stages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shared: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (tests, a laptop) is a folder of our
    own set, and then through ``setCheckpointDir`` so that later calls find it.
    On a cluster a folder of one machine would not do, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="limber-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; jobs leave there what their results still read."""
    return f"{shared_dir(spark)}/limber-{spark.sparkContext.applicationId}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def share_package(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shared:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp()  # the driver serves the archive from there until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = shutil.make_archive(str(Path(folder) / package.name), "zip", root_dir=package.parent, base_dir=package.name)
        spark.sparkContext.addPyFile(archive)
        _shared.add(app)
