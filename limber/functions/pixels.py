"""Pixel operations on one image (H x W x 3, uint8, BGR) in numpy, for use inside tasks.

They follow the published definitions; agreement to the bit with any other
library's rounding is not claimed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

CLIP_LIMIT, TILES = 2.0, 8
DENOISE_H, TEMPLATE, SEARCH = 3.0, 7, 21
MIN_SIDE = 512

#: sRGB primaries and the D65 white point.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def bgr_to_rgb(image: np.ndarray) -> np.ndarray:
    return image[:, :, ::-1]


def to_lab(image: np.ndarray) -> np.ndarray:
    """L in 0..100, a and b, as floats."""
    rgb = image[:, :, ::-1].astype(np.float64) / 255
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    t = linear @ _XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=2)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], axis=2)
    t = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * _WHITE
    linear = np.clip(t @ np.linalg.inv(_XYZ).T, 0, 1)
    rgb = np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear)
    return np.clip(np.rint(rgb[:, :, ::-1] * 255), 0, 255).astype(np.uint8)


def _virtual(n: int, tiles: int, other: int) -> np.ndarray:
    """Where each place of a side of n lies when it is filled up to whole tiles: mirrored at its end, or repeated where the image is small."""
    room = -(-n // tiles) * tiles - n
    small = min(n, other) <= max(-(-n // tiles), -(-other // tiles))
    return np.pad(np.arange(n), (0, room), mode="edge" if small else "reflect")


def tile_histograms(plane: np.ndarray, height: int | None = None, first: int = 0, tiles: int = TILES) -> np.ndarray:
    """tiles x tiles x 256: how often each level occurs in each tile, of a plane or of the rows from ``first`` on of one of ``height`` rows."""
    rows, w = plane.shape
    height = height or rows
    at_y, at_x = _virtual(height, tiles, w), _virtual(w, tiles, height)
    mine = np.flatnonzero((at_y >= first) & (at_y < first + rows))
    tile = (mine // -(-height // tiles))[:, None] * tiles + (np.arange(len(at_x)) // -(-w // tiles))[None]
    levels = plane[at_y[mine] - first][:, at_x]
    return np.bincount((tile * 256 + levels).ravel(), minlength=tiles * tiles * 256).reshape(tiles, tiles, 256)


def tile_levels(counts: np.ndarray, area: int, clip_limit: float = CLIP_LIMIT) -> np.ndarray:
    """What each level becomes in each tile: histograms clipped, what was cut off spread evenly (the rest over the lowest levels), summed up."""
    limit = max(1, int(clip_limit * area / 256))
    over = np.maximum(counts - limit, 0).sum(axis=2, keepdims=True)
    levelled = np.minimum(counts, limit) + over // 256 + (np.arange(256) < over % 256)
    return np.cumsum(levelled, axis=2) * 255 / area


def apply_levels(plane: np.ndarray, levels: np.ndarray, height: int | None = None, first: int = 0) -> np.ndarray:
    """Each pixel by the maps of the four tiles around it; of a plane, or of the rows from ``first`` on of one of ``height`` rows."""
    rows, w = plane.shape
    height, tiles = height or rows, len(levels)
    y, x = (np.arange(first, first + rows) + 0.5) / -(-height // tiles) - 0.5, (np.arange(w) + 0.5) / -(-w // tiles) - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, tiles - 1), np.clip(np.floor(x).astype(int), 0, tiles - 1)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None]
    at = lambda a, b: levels[a[:, None], b[None], plane]
    top = at(y0, x0) * (1 - fx) + at(y0, x1) * fx
    low = at(y1, x0) * (1 - fx) + at(y1, x1) * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def equalize_tiles(plane: np.ndarray, clip_limit: float = CLIP_LIMIT, tiles: int = TILES) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of a uint8 plane: a clipped, levelled map per tile, interpolated between tile centres."""
    area = -(-plane.shape[0] // tiles) * -(-plane.shape[1] // tiles)
    return apply_levels(plane, tile_levels(tile_histograms(plane, tiles=tiles), area, clip_limit))


def _plane(lab: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(lab[..., 0] * 2.55), 0, 255).astype(np.uint8)


def lightness(image: np.ndarray) -> np.ndarray:
    """L of an image, as uint8."""
    return _plane(to_lab(image))


def relight(image: np.ndarray, change: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The image with its lightness (uint8) changed, its colours as they are."""
    lab = to_lab(image)
    lab[..., 0] = change(_plane(lab)) / 2.55
    return from_lab(lab)


def enhance_contrast(image: np.ndarray) -> np.ndarray:
    """The lightness channel alone is equalised."""
    return relight(image, equalize_tiles)


def denoise(image: np.ndarray, strength: float = DENOISE_H, template: int = TEMPLATE, search: int = SEARCH) -> np.ndarray:
    """Non-local means: each pixel becomes the mean of its search window, weighted by how alike the patches are."""
    x = image.astype(np.float64)
    r, s = template // 2, search // 2
    wide = np.pad(x, ((s + r, s + r), (s + r, s + r), (0, 0)), mode="symmetric")
    h, w = image.shape[:2]
    own = wide[s : s + h + 2 * r, s : s + w + 2 * r]
    total, weights = np.zeros_like(x), np.zeros((h, w, 1))
    for dy in range(2 * s + 1):
        for dx in range(2 * s + 1):
            other = wide[dy : dy + h + 2 * r, dx : dx + w + 2 * r]
            d = ((own - other) ** 2).sum(axis=2)  # whole numbers, so that sums are exact
            c = np.pad(d, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
            patch = (c[template:, template:] - c[:-template, template:] - c[template:, :-template] + c[:-template, :-template]) / (3 * template**2)
            k = np.exp(-patch / strength**2)[:, :, None]
            total += k * other[r : r + h, r : r + w]
            weights += k
    return np.clip(np.rint(total / weights), 0, 255).astype(np.uint8)


def _cubic(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """For each output place the four input places and their weights (a = -0.75)."""
    a = -0.75
    at = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
    base = np.floor(at).astype(int)
    t = np.abs(at[:, None] - (base[:, None] + np.arange(-1, 3)))
    near = ((a + 2) * t - (a + 3)) * t * t + 1
    far = ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
    return np.clip(base[:, None] + np.arange(-1, 3), 0, n_in - 1), np.where(t <= 1, near, np.where(t < 2, far, 0.0))


def resize_rows(part: np.ndarray, top: int, height: int, new_width: int, new_height: int, first: int, end: int) -> np.ndarray:
    """Rows ``first`` to ``end`` of the resized image, of the rows from ``top`` on of one of ``height`` rows; they must hold what these need."""
    rows, wy = _cubic(height, new_height)
    cols, wx = _cubic(part.shape[1], new_width)
    x = part.astype(np.float64)
    x = np.einsum("hkwc,hk->hwc", x[rows[first:end] - top], wy[first:end])
    return np.clip(np.rint(np.einsum("hwkc,wk->hwc", x[:, cols], wx)), 0, 255).astype(np.uint8)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bicubic."""
    return resize_rows(image, 0, image.shape[0], width, height, 0, height)


def upsample(image: np.ndarray, min_side: int = MIN_SIDE) -> tuple[np.ndarray, float]:
    """The image with its short side brought up to ``min_side``, and the scale."""
    h, w = image.shape[:2]
    if min(h, w) >= min_side:
        return image, 1.0
    scale = min_side / min(h, w)
    return resize(image, int(w * scale), int(h * scale)), scale


def preprocess(image: np.ndarray, with_denoise: bool = True) -> tuple[np.ndarray, float]:
    """Contrast, noise, size, in this order."""
    out = enhance_contrast(image)
    return upsample(denoise(out) if with_denoise else out)
