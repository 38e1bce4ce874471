"""Image features from plain arrays: perceptual hashes and page layout. Decoding is left to what supplies the array."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Sizes of the hashes and of the layout's grids, and the grey below which a pixel is ink.
AVERAGE, LAYOUT_GRID, LAYOUT_BANDS, COARSE, INK = 16, 8, 16, (4, 8), 235


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of an RGB array; a grey one stays."""
    return pixels.astype(np.float64) if pixels.ndim == 2 else pixels[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def shrink(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over equal areas; a pixel on a border counts in parts on both sides."""

    def weights(n: int, parts: int) -> np.ndarray:
        edges = np.arange(parts + 1) * n / parts
        at = np.arange(n)
        part = np.clip(np.minimum(at + 1, edges[1:, None]) - np.maximum(at, edges[:-1, None]), 0, None)
        return part / part.sum(axis=1, keepdims=True)

    return weights(image.shape[0], rows) @ image @ weights(image.shape[1], columns).T


def perceptual_hash(pixels: np.ndarray) -> dict:
    """hash (512 bits as 128 hex digits: above the mean, and falling to the right), mean tone and aspect."""
    g = grey(pixels)
    small, wide = shrink(g, AVERAGE, AVERAGE).round(), shrink(g, AVERAGE, AVERAGE + 1).round()
    bits = np.concatenate([(small > small.mean()).ravel(), (wide[:, :-1] > wide[:, 1:]).ravel()])
    return {"hash": np.packbits(bits).tobytes().hex(), "tone": int(round(small.mean())), "aspect": round(g.shape[1] / max(g.shape[0], 1), 3)}


def blurred(image: np.ndarray, sigma: tuple[float, float]) -> np.ndarray:
    for axis, s in enumerate(sigma):
        reach = int(4 * s + 0.5)
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / s) ** 2)
        padded = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in range(2)], mode="reflect" if image.shape[axis] > reach else "edge")
        image = np.apply_along_axis(np.convolve, axis, padded, kernel / kernel.sum(), "valid")
    return image


def layout(pixels: np.ndarray, boxes: Sequence) -> np.ndarray:
    """128 features of unit length: text occupancy of 8 by 8 cells, ink by 16 rows and columns, coarse blurred ink."""
    height, width = pixels.shape[:2]
    known = [np.asarray(box, float).reshape(-1, 2) for box in boxes if len(box)]
    corners = np.array([[p.min(axis=0), p.max(axis=0)] for p in known]).reshape(-1, 2, 2)
    x0, y0, x1, y1 = np.clip(corners / (max(width, 1), max(height, 1)) * LAYOUT_GRID, 0, LAYOUT_GRID - 1).astype(int).reshape(-1, 4).T[..., None]
    at = np.arange(LAYOUT_GRID)
    cells = ((y0 <= at) & (at <= y1)).T.astype(float) @ ((x0 <= at) & (at <= x1)).astype(float)
    ink = (grey(pixels) < INK).astype(float)
    rows, columns = shrink(ink.mean(axis=1)[:, None], LAYOUT_BANDS, 1).ravel(), shrink(ink.mean(axis=0)[None, :], 1, LAYOUT_BANDS).ravel()
    coarse = shrink(blurred(ink, (max(2, height / 80), max(2, width / 80))), *COARSE).ravel()
    out = np.concatenate([np.log1p(cells).ravel(), rows, columns, coarse]).astype(np.float32)
    n = float(np.linalg.norm(out))
    return out / n if n else out
