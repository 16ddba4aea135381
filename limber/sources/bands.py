"""Images cut into bands of rows, so that one image can be worked on by many tasks.

A band has its own rows and, above and below, as many more (its halo) as the
operation looks at; what comes out are the band's own rows. Bands are cut in the
JVM from the pixels' bytes, without decoding the rest. The results equal those
of the whole image to the last bit (see :mod:`limber.functions.pixels`).

Contrast takes two passes: bands give histograms of the tiles, an image's sums
become its tiles' maps, and bands are mapped with these. Its output is wanted
with a halo by the denoiser, so contrast and noise are one map over a band.

Rows of one path are one image here, so paths must tell images apart (of two
images of one path the result is undefined); a null path is one. Images without
pixels have no bands and come out of nothing here; no images give none. Other
columns are not carried: join them by path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limber.functions import pixels
from limber.operators.boxes import MIN_SIDE, upsample_dims
from limber.sources.images import as_array

#: Rows of a band.
ROWS = 256
#: Bytes of bands that a task hands on at once, about, and bands whose histograms it does.
OUT_BYTES, COUNTED = 16 << 20, 64
BAND = "path string, height int, width int, band int, data binary"
_STRUCTURE = ("path", "height", "width", "n_channels", "band", "first", "n_rows", "top", "data")


def _cut(images: DataFrame, n_rows: Column, rows: int, span: Callable[[Column, Column], tuple[Column, Column]], extra: tuple[str, ...] = ()) -> DataFrame:
    """Bands of ``rows`` of the ``n_rows`` rows that are wanted; ``span`` tells which rows of the image a band needs (from, to)."""
    seen = images.where((F.length("data") > 0) & (F.col("height") > 0) & (F.col("width") > 0) & (F.col("n_channels") > 0))
    numbered = seen.select("path", "height", "width", "n_channels", "data", *extra, n_rows.alias("wanted"), F.explode(F.sequence(F.lit(0), F.floor((n_rows - 1) / rows).cast("int"))).alias("band"))
    first = (F.col("band") * rows).cast("int")
    placed = numbered.select("*", first.alias("first"), F.least(F.lit(rows), F.col("wanted") - first).alias("n_rows"))
    top, bottom = span(F.col("first"), F.col("first") + F.col("n_rows"))
    top, bottom = F.greatest(top, F.lit(0)).cast("int"), F.least(bottom, F.col("height")).cast("int")
    line = F.col("width") * F.col("n_channels")
    return placed.withColumn("top", top).withColumn("data", F.substring("data", (F.col("top") * line + 1).cast("int"), ((bottom - F.col("top")) * line).cast("int"))).select(*_STRUCTURE, *extra)


def bands_of(images: DataFrame, rows: int = ROWS, halo: int = 0) -> DataFrame:
    """path, height, width, n_channels, band, first and n_rows (its own rows), top (the first row it has) and data."""
    return _cut(images, F.col("height"), rows, lambda first, end: (first - halo, end + halo))


def joined(bands: DataFrame) -> DataFrame:
    """Images of bands (BAND): an image is put together in one task, which has room for it."""

    def put(group: pa.Table) -> pa.Table:
        order = np.argsort(group["band"].to_numpy())
        data = b"".join(group["data"][int(i)].as_py() for i in order)
        one = group.slice(0, 1)
        return pa.table({"path": one["path"], "height": one["height"], "width": one["width"], "n_channels": pa.array([3], pa.int32()), "data": pa.array([data], pa.binary())})

    return bands.groupBy("path").applyInArrow(put, "path string, height int, width int, n_channels int, data binary")


def _mapped(bands: DataFrame, change: Callable[[np.ndarray, dict], np.ndarray], extra: tuple[str, ...] = ()) -> DataFrame:
    """Each band's own rows after ``change`` of the rows it has; height and width become those of the result."""

    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    made = lambda out: pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=["path", "height", "width", "band", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for i in range(batch.num_rows):  # a row at a time: as Python numbers, maps are many times their size
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                r = {c: v.values.to_numpy() if isinstance(v, pa.ListScalar) else v.as_py() for c, v in r.items()}
                lines = len(r["data"]) // (r["width"] * r["n_channels"])
                x = change(as_array(r["data"], lines, r["width"], r["n_channels"]), r)
                out.append((r["path"], r.get("new_height") or r["height"], x.shape[1], r["band"], np.ascontiguousarray(x).tobytes()))
                held += x.size
                if held >= OUT_BYTES:
                    yield made(out)
                    out, held = [], 0
            if out:
                yield made(out)

    return bands.select(*_STRUCTURE, *extra).mapInArrow(run, BAND)


def _own(x: np.ndarray, r: dict) -> np.ndarray:
    return x[r["first"] - r["top"] : r["first"] - r["top"] + r["n_rows"]]


def denoise_bands(images: DataFrame, rows: int = ROWS, strength: float = pixels.DENOISE_H, template: int = pixels.TEMPLATE, search: int = pixels.SEARCH) -> DataFrame:
    """Non-local means by bands with a halo of half the search window and half a patch."""
    bands = bands_of(images, rows, template // 2 + search // 2)
    return _mapped(bands, lambda x, r: _own(pixels.denoise(x, strength, template, search), r))


def tile_maps(images: DataFrame, rows: int = ROWS, clip_limit: float = pixels.CLIP_LIMIT, tiles: int = pixels.TILES) -> DataFrame:
    """path and the maps of its tiles (tiles x tiles x 256, flat), of histograms summed over its bands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, COUNTED):
                part, found = batch.slice(lo, COUNTED), []
                for r in part.to_pylist():
                    plane = pixels.lightness(as_array(r["data"], r["n_rows"], r["width"], r["n_channels"]))
                    found.append(pixels.tile_histograms(plane, r["height"], r["first"], tiles).ravel())
                counts = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * tiles * tiles * 256), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column("path"), part.column("height"), part.column("width"), counts], names=["path", "height", "width", "counts"])

    def levelled(group: pa.Table) -> pa.Table:
        total = np.zeros(tiles * tiles * 256, dtype=np.int64)
        for counts in group["counts"]:
            total += counts.values.to_numpy()
        h, w = group["height"][0].as_py(), group["width"][0].as_py()
        maps = pixels.tile_levels(total.reshape(tiles, tiles, 256), -(-h // tiles) * -(-w // tiles), clip_limit)
        return pa.table({"path": group["path"].slice(0, 1), "maps": pa.array([maps.ravel()], pa.list_(pa.float64()))})

    counted = bands_of(images, rows).mapInArrow(count, "path string, height int, width int, counts array<long>")
    return counted.groupBy("path").applyInArrow(levelled, "path string, maps array<double>")


def enhance_bands(images: DataFrame, rows: int = ROWS, with_denoise: bool = False, tiles: int = pixels.TILES) -> DataFrame:
    """Contrast by bands and, if asked for, noise after it."""
    halo = pixels.TEMPLATE // 2 + pixels.SEARCH // 2 if with_denoise else 0
    maps = tile_maps(images, rows, tiles=tiles).withColumnRenamed("path", "of_path")
    bands = bands_of(images, rows, halo).join(maps, F.col("path").eqNullSafe(F.col("of_path")))

    def change(x: np.ndarray, r: dict) -> np.ndarray:
        levels = r["maps"].reshape(tiles, tiles, 256)
        out = pixels.relight(x, lambda plane: pixels.apply_levels(plane, levels, r["height"], r["top"]))
        return _own(pixels.denoise(out) if with_denoise else out, r)

    return _mapped(bands, change, ("maps",))


def resize_bands(images: DataFrame, new_width: Column, new_height: Column, rows: int = ROWS) -> DataFrame:
    """Bicubic by bands of the result, whose sizes are columns of the images."""
    sized = images.withColumns({"new_width": new_width.cast("int"), "new_height": new_height.cast("int")})
    base = lambda o: F.floor((o + 0.5) * F.col("height") / F.col("new_height") - 0.5)
    bands = _cut(sized, F.col("new_height"), rows, lambda first, end: (F.least(base(first) - 1, F.col("height") - 1), base(end - 1) + 3), ("new_width", "new_height"))

    def change(x: np.ndarray, r: dict) -> np.ndarray:
        return pixels.resize_rows(x, r["top"], r["height"], r["new_width"], r["new_height"], r["first"], r["first"] + r["n_rows"])

    return _mapped(bands, change, ("new_width", "new_height"))


def preprocess_bands(images: DataFrame, with_denoise: bool = True, min_side: int = MIN_SIDE, rows: int = ROWS) -> DataFrame:
    """Contrast, noise, size, in this order, each by bands: path, height, width, n_channels, data, as :func:`limber.functions.pixels.preprocess` has them."""
    clean = joined(enhance_bands(images, rows, with_denoise))
    new_w, new_h, _ = upsample_dims(F.col("width"), F.col("height"), min_side)
    return joined(resize_bands(clean, new_w, new_h, rows))
