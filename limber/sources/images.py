"""Images as a table: path, height, width, n_channels and the pixels as bytes (BGR).

Edge cases: files that are no images are left out; an image without pixels
(null or empty bytes, or sizes that are null or not positive) is kept as it is
by preprocessing and normalising, with null pixels and scales of 1; one whose
bytes do not fit its sizes is an error; repeated rows are each treated, null
columns beside the pixels are kept, and no images give none.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limber.functions import pixels
from limber.session import delete_path, own_folder
from limber.sources import versions

IMAGES = "path string, height int, width int, n_channels int, data binary"
FILES = "path string, length long, modificationTime timestamp"

#: Bytes of changed images that a task hands on at once, about: small images may become large ones.
OUT_BYTES = 32 << 20
#: Files whose names a task writes down, about.
FILES_A_TASK = 100_000
#: New files that are decoded together: the driver holds the paths and times of so many, not of all.
FILES_AT_ONCE = 10_000
#: Folders whose files a task lists, about.
FOLDERS_A_TASK = 100


def scan_images(spark: SparkSession, directory: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Decoded images of a directory; files that are no images are left out."""
    reader = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _decoded(reader.load(directory))


def _decoded(loaded: DataFrame) -> DataFrame:
    image = F.col("image")
    return loaded.select(
        image["origin"].alias("path"), image["height"].alias("height"), image["width"].alias("width"), image["nChannels"].alias("n_channels"), image["data"].alias("data")
    )


def _changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are not known, or are by another length or time.

    Files come in many small tasks, so what is known is dealt out by key too, not held whole in each.
    """
    return files.join(known.hint("merge"), ["path", "length", "modificationTime"], "left_anti")


def scan_new_images(
    spark: SparkSession, directory: str, state: str, recursive: bool = False, glob: str | None = None, made: Callable[[DataFrame], DataFrame] = lambda decoded: decoded
) -> tuple[DataFrame, Callable[[], int]]:
    """What ``made`` makes of the decoded images of files that are new or have changed since they were marked (the images themselves, if it is not given), and a function that marks these.

    ``state`` is a folder of ours: a log of versions that name path, length and
    time of every file marked so far. Files are compared with it by these alone,
    before any is opened; no others are decoded. Mark them once their results
    are stored (the function returns how many there were): a job that breaks off
    before decodes them again. Files that are gone stay known; of two jobs at
    once each marks its own files.

    Up to FILES_AT_ONCE new files are decoded as the result is read. Of more,
    one part is decoded after the other and what ``made`` gives is written to
    the shared folder, so that the driver never holds the paths of all:
    ``made`` should leave no more of an image than is needed, and look at each
    by itself.
    """
    listing, folder = (f"{state}/data/{kind}-{uuid.uuid4().hex}" for kind in ("listing", "files"))
    files = _listed(spark, directory, listing, recursive, glob)
    _, content = versions.read_version(spark, state)
    known = spark.read.schema(FILES).parquet(*[f"{state}/data/{f}" for f in content["folders"]]) if content else files.limit(0)
    _changed(files, known).repartition(1 + files.count() // FILES_A_TASK).write.parquet(folder)  # dealt anew: to merge the tasks would have one compare all files
    delete_path(spark, listing)
    fresh = spark.read.schema(FILES).parquet(folder)
    n_fresh = fresh.count()

    def mark() -> int:
        if not n_fresh:
            delete_path(spark, folder)
        while n_fresh:
            number, now = versions.read_version(spark, state)
            try:
                versions.commit(spark, state, number, {"folders": [*now.get("folders", []), folder.rpartition("/")[2]]})
                break
            except versions.Conflict:
                continue
        return n_fresh

    if not n_fresh:
        return made(spark.createDataFrame([], IMAGES).limit(0)), mark
    paths = (r["path"] for r in fresh.select("path").toLocalIterator())
    if n_fresh <= FILES_AT_ONCE:
        return made(_loaded(spark, list(paths))), mark
    session, results = _for_many_files(spark), f"{own_folder(spark)}/decoded-{uuid.uuid4().hex}"
    while part := list(islice(paths, FILES_AT_ONCE)):
        found = made(_loaded(session, part))
        found.write.mode("append").parquet(results)
        gc.collect()  # what Python has not collected yet, the driver's JVM holds too
    return spark.read.schema(found.schema).parquet(results), mark


def _loaded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The decoded images of files, whatever characters their names have."""
    return _decoded(spark.read.format("image").option("dropInvalid", "true").load([re.sub(r"([{}\[\]*?\\])", r"\\\1", p) for p in paths]))


def _for_many_files(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one, but for files that are named one by one.

    Else each is a task of its own when they are looked up and stays in a cache
    of the driver, and 32 small ones are a task when they are read.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if session.conf.get(key, None) != value and (spark.conf.isModifiable(key) or not key.startswith("spark.")):
            session.conf.set(key, value)
    session.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(spark.sparkContext.defaultParallelism))
    session.conf.set("spark.sql.hive.filesourcePartitionFileCacheSize", "0")
    session.conf.set("spark.sql.files.openCostInBytes", "64k")
    return session


def _passed_over(name: str, is_folder: bool) -> bool:
    """Whether Spark's readers leave out files or folders of that name."""
    hidden = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
    return hidden and not (is_folder and name.startswith(("_metadata", "_common_metadata")))


def _listed(spark: SparkSession, directory: str, where: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """The rows of :func:`scan_files`, written to ``where``.

    Spark's readers hold a row for every file in the driver. A folder of a
    mounted file system is listed by tasks, one level of folders after the
    other, and no more than a batch of it is in memory; folders of other stores,
    single files and patterns are left to Spark's reader.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    root = store.makeQualified(path).toString()
    if not root.startswith("file:") or any(c in directory for c in "{}[]*?\\") or not store.exists(path) or not store.getFileStatus(path).isDirectory():
        scan_files(spark, directory, recursive, glob).write.parquet(where)
        return spark.read.schema(FILES).parquet(where)
    pattern = re.compile(spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(glob).pattern(), re.DOTALL) if glob else None

    def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (f for batch in batches for f in batch.column("path").to_pylist()):
            with os.scandir("/" + folder.removeprefix("file:").lstrip("/")) as entries:
                while some := list(islice(entries, 10_000)):
                    found = []
                    for e in some:
                        try:
                            e.name.encode()
                            is_folder, stat = e.is_dir(), e.stat()
                        except (FileNotFoundError, UnicodeEncodeError):  # gone, a link to nothing, or a name that is no text
                            continue
                        wanted = recursive or "=" in e.name if is_folder else stat.st_size > 0 and (pattern is None or pattern.fullmatch(e.name))
                        if wanted and not _passed_over(e.name, is_folder):
                            found.append((f"{folder.rstrip('/')}/{e.name}", stat.st_size, stat.st_mtime_ns // 1_000_000, is_folder))
                    columns = zip(*found, strict=True) if found else [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["path", "length", "millis", "is_folder"])

    levels, folders, n_folders = [], spark.createDataFrame([(root,)], "path string").coalesce(1), 1
    while n_folders:
        levels.append(f"{where}/{len(levels)}")
        folders.mapInArrow(list_folders, "path string, length long, millis long, is_folder boolean").write.parquet(levels[-1])
        folders = spark.read.parquet(levels[-1]).where("is_folder").select("path")
        n_folders = folders.count()
        folders = folders.repartition(1 + n_folders // FOLDERS_A_TASK)
    return spark.read.parquet(*levels).where("not is_folder").select("path", "length", F.timestamp_millis("millis").alias("modificationTime"))


def scan_files(spark: SparkSession, directory: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Paths and lengths only: the contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(directory).select("path", "length", "modificationTime")


def bitmap(x: np.ndarray) -> bytes:
    """An H x W x 3 BGR array as a 24-bit BMP file."""
    h, w = x.shape[:2]
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), dtype=np.uint8)
    rows[:, : 3 * w] = x[::-1].reshape(h, 3 * w)
    header = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return header + rows.tobytes()


def write_images(images: DataFrame, directory: str, name_col: str = "path") -> DataFrame:
    """Write images as BMP files under ``directory``, named by ``name_col`` (which may hold folders); returns a row a file: path and length.

    Files are written as the result is read, and a task that runs again writes
    the same. Images without pixels or a name are left out; of two of one name one stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(directory)
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["name"] is None or not has_pixels(r):
                    continue
                path = f"{base}/{r['name']}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                content = bitmap(as_array(r["data"], r["height"], r["width"], r["n_channels"]))
                with store.open_output_stream(path, compression=None) as out:
                    out.write(content)
                done.append((f"{directory}/{r['name']}", len(content)))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "length"])

    return images.select(F.col(name_col).alias("name"), "height", "width", "n_channels", "data").mapInArrow(run, "path string, length long")


def image_metadata(images: DataFrame) -> DataFrame:
    """path, width, height of the images as they were read; take it before preprocessing."""
    return images.select("path", "width", "height")


def has_pixels(row: dict) -> bool:
    """Whether an image's row has anything to look at."""
    return bool(row["data"]) and all(row[c] is not None and row[c] == row[c] and row[c] > 0 for c in ("height", "width", "n_channels"))


def as_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """H x W x 3 BGR; grey is repeated, a fourth channel dropped."""
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, :3]


def _mapped(images: DataFrame, change: Callable[[np.ndarray], tuple[np.ndarray, float, float]]) -> DataFrame:
    """Each image changed in one map; all other columns are kept, and scale_x and scale_y tell how much larger it became."""
    carried = [c for c in images.columns if c not in ("height", "width", "n_channels", "data", "scale_x", "scale_y")]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*carried).schema)
    schema = f"{kept}, height int, width int, n_channels int, data binary, scale_x double, scale_y double"

    def made(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*carried, "height", "width", "n_channels", "data", "scale_x", "scale_y"])
        return out.astype({c: "Int32" for c in ("height", "width", "n_channels")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for r in batch.to_dict("records"):
                if held >= OUT_BYTES:
                    yield made(rows)
                    rows, held = [], 0
                if not has_pixels(r):
                    rows.append((*(r[c] for c in carried), *(None if r[c] != r[c] else r[c] for c in ("height", "width", "n_channels")), None, 1.0, 1.0))
                    continue
                x, scale_x, scale_y = change(as_array(r["data"], *(int(r[c]) for c in ("height", "width", "n_channels"))))
                rows.append((*(r[c] for c in carried), x.shape[0], x.shape[1], 3, np.ascontiguousarray(x).tobytes(), scale_x, scale_y))
                held += x.size
            yield made(rows)

    return images.select(*carried, "height", "width", "n_channels", "data").mapInPandas(run, schema)


def _resized(x: np.ndarray, size: tuple[int, int] | None) -> tuple[np.ndarray, float, float]:
    if size is None:
        return x, 1.0, 1.0
    return pixels.resize(x, *size), size[0] / x.shape[1], size[1] / x.shape[0]


def preprocess_images(images: DataFrame, with_denoise: bool = True, target_size: tuple[int, int] | None = None) -> DataFrame:
    """The images enhanced for detection and, if asked, resized to (width, height); scale_x and scale_y map coordinates back (divide by them).
    """

    def change(x: np.ndarray) -> tuple[np.ndarray, float, float]:
        out, scale = pixels.preprocess(x, with_denoise)
        out, scale_x, scale_y = _resized(out, target_size)
        return out, scale * scale_x, scale * scale_y

    return _mapped(images, change)


def normalize_images(images: DataFrame, target_size: tuple[int, int] | None = None, convert_to_rgb: bool = True) -> DataFrame:
    """Resized to (width, height) if given, and in RGB order if asked; scale_x and scale_y as for :func:`preprocess_images`."""

    def change(x: np.ndarray) -> tuple[np.ndarray, float, float]:
        out, scale_x, scale_y = _resized(x, target_size)
        return pixels.bgr_to_rgb(out) if convert_to_rgb else out, scale_x, scale_y

    return _mapped(images, change)
