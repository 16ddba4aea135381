"""Gradient-orientation histograms of one image in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np

CELLS, BINS = 8, 9
#: Most that one bin may have of its block's length, and what keeps even blocks from being blown up (in grey levels).
CLIP, FLOOR = 0.2, 1e-3
#: The luma weights of red, green and blue.
LUMA = np.array([0.299, 0.587, 0.114])


def cell_histograms(grey: np.ndarray) -> np.ndarray:
    """CELLS x CELLS x BINS: the mean gradient length of a cell's pixels by orientation (without sign), shared between the two nearest bins. Cells without a pixel are 0."""
    h, w = grey.shape
    wide = np.pad(grey, 1, mode="edge")
    gy, gx = (wide[2:, 1:-1] - wide[:-2, 1:-1]) / 2, (wide[1:-1, 2:] - wide[1:-1, :-2]) / 2
    at = np.mod(np.arctan2(gy, gx), np.pi) * (BINS / np.pi) - 0.5
    low = np.floor(at)
    share, low, length = at - low, low.astype(np.int64), np.hypot(gx, gy)
    cell = (np.arange(h) * CELLS // h)[:, None] * CELLS + (np.arange(w) * CELLS // w)[None]
    found = np.zeros(CELLS * CELLS * BINS)
    for bin_, weight in ((low % BINS, length * (1 - share)), ((low + 1) % BINS, length * share)):
        found += np.bincount((cell * BINS + bin_).ravel(), weights=weight.ravel(), minlength=len(found))
    pixels = np.bincount(cell.ravel(), minlength=CELLS * CELLS)
    return (found.reshape(-1, BINS) / np.maximum(pixels, 1)[:, None]).reshape(CELLS, CELLS, BINS)


def gradient_histograms(rgb: np.ndarray) -> np.ndarray:
    """576 numbers of unit length (all 0 for an image without any edge).

    Each cell's histogram is divided by the length of each 2 x 2 block that the
    cell is in, clipped, and averaged over its blocks.
    """
    cells = cell_histograms(rgb[:, :, :3].astype(np.float64) @ LUMA)
    energy = (cells**2).sum(axis=2)
    block = np.sqrt(energy[:-1, :-1] + energy[1:, :-1] + energy[:-1, 1:] + energy[1:, 1:] + FLOOR**2)
    total, n = np.zeros_like(cells), np.zeros((CELLS, CELLS, 1))
    for dy in (0, 1):
        for dx in (0, 1):
            mine = slice(dy, CELLS - 1 + dy), slice(dx, CELLS - 1 + dx)
            total[mine] += np.minimum(cells[mine] / block[:, :, None], CLIP)
            n[mine] += 1
    flat = (total / n).ravel()
    length = np.linalg.norm(flat)
    return flat / length if length else flat
