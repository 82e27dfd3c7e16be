"""Whole-image steps on grey rasters (image_id, height, width, data), in numpy, one image at a time in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RASTER = "image_id long, height int, width int, data array<double>"


def from_pixels(pixels: DataFrame) -> DataFrame:
    """Rasters from a pixel table; an image is as large as its largest coordinates."""
    g = pixels.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"), F.sort_array(F.collect_list(F.struct("y", "x", F.col("v").cast("double").alias("v")))).alias("p"))
    return g.select("image_id", "height", "width", F.transform("p", lambda s: s["v"]).alias("data"))


def to_pixels(rasters: DataFrame) -> DataFrame:
    p = rasters.select("image_id", "width", F.posexplode("data").alias("i", "v"))
    return p.select("image_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), "v")


def each(rasters: DataFrame, step: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """step over every image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [step(np.asarray(d, float).reshape(h, w)) for d, h, w in zip(b["data"], b["height"], b["width"], strict=True)]
            yield pd.DataFrame({"image_id": b["image_id"], "height": [o.shape[0] for o in out], "width": [o.shape[1] for o in out], "data": [o.ravel().tolist() for o in out]})

    return rasters.mapInPandas(run, RASTER)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned, edges repeated."""
    at = lambda n, m: np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
    y, x = at(height, image.shape[0]), at(width, image.shape[1])
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], x - x0
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian, cut at three spreads, edges reflected."""
    r = max(1, int(3 * sigma + 0.5))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (0, 1):
        wide = np.pad(image, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        image = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, wide)
    return image


def sharpened(image: np.ndarray, sigma: float = 3.0, amount: float = 1.5) -> np.ndarray:
    """Unsharp mask, clipped to the range of bytes."""
    return np.clip(amount * image + (1 - amount) * blurred(image, sigma), 0, 255)


def equalized(image: np.ndarray, clip: float = 3.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalization over a grid of tiles, their mappings blended bilinearly."""
    v = np.clip(image, 0, 255).astype(int)
    ny, nx = min(tiles, v.shape[0]), min(tiles, v.shape[1])
    ys, xs = np.linspace(0, v.shape[0], ny + 1).astype(int), np.linspace(0, v.shape[1], nx + 1).astype(int)
    maps = np.empty((ny, nx, 256))
    for i in range(ny):
        for j in range(nx):
            h = np.bincount(v[ys[i] : ys[i + 1], xs[j] : xs[j + 1]].ravel(), minlength=256).astype(float)
            top = max(1.0, clip * h.sum() / 256)
            h = np.minimum(h, top) + np.maximum(h - top, 0).sum() / 256
            maps[i, j] = np.cumsum(h) * 255 / h.sum()
    place = lambda n, edges: np.interp(np.arange(n) + 0.5, (edges[:-1] + edges[1:]) / 2, np.arange(len(edges) - 1))
    py, px = place(v.shape[0], ys), place(v.shape[1], xs)
    y0, x0 = np.floor(py).astype(int), np.floor(px).astype(int)
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    fy, fx = (py - y0)[:, None], px - x0
    pick = lambda a, b: maps[a[:, None], b[None, :], v]
    return (pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx) * (1 - fy) + (pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx) * fy


def darkest(image: np.ndarray, k: int = 2, seed: int = 7, turns: int = 20) -> np.ndarray:
    """1 where a pixel is in the darkest of k clusters of grey values, else 0."""
    values = image.ravel()
    r = np.random.Generator(np.random.PCG64(seed))
    centres = np.sort(r.choice(np.unique(values), min(k, len(np.unique(values))), replace=False))
    for _ in range(turns):
        own = np.abs(values[:, None] - centres).argmin(1)
        new = np.array([values[own == c].mean() if (own == c).any() else centres[c] for c in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    own = np.abs(values[:, None] - centres).argmin(1)
    return (own == centres.argmin()).astype(float).reshape(image.shape)


def without_hairs(image: np.ndarray, size: int = 17, least: float = 10.0) -> np.ndarray:
    """Thin dark lines (black-hat above `least`) replaced by the local median of what is no line."""
    r = size // 2
    windows = lambda a: np.lib.stride_tricks.sliding_window_view(np.pad(a, r, mode="edge"), (size, size))
    closed = windows(windows(image).max((2, 3))).min((2, 3))
    hair = closed - image > least
    clear = np.where(hair, np.nan, image)
    fill = np.nanmedian(windows(clear).reshape(*image.shape, -1), axis=2) if (~hair).any() else image
    return np.where(hair, np.where(np.isnan(fill), closed, fill), image)


def denoised(image: np.ndarray, strength: float = 10.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: weights fall with the mean squared difference of patches."""
    p, s = patch // 2, search // 2
    wide = np.pad(image, p + s, mode="reflect" if min(image.shape) > p + s else "edge")
    h, w = image.shape
    total, weight = np.zeros_like(image), np.zeros_like(image)
    core = wide[s : s + h + 2 * p, s : s + w + 2 * p]
    for dy in range(-s, s + 1):
        for dx in range(-s, s + 1):
            moved = wide[s + dy : s + dy + h + 2 * p, s + dx : s + dx + w + 2 * p]
            d = np.lib.stride_tricks.sliding_window_view((core - moved) ** 2, (patch, patch)).mean((2, 3))
            k = np.exp(-np.maximum(d, 0) / strength**2)
            total += k * moved[p : p + h, p : p + w]
            weight += k
    return total / weight


def blurred_by_five(image: np.ndarray) -> np.ndarray:
    """Five by five by the binomial weights, rounded, edges mirrored without repeating them."""
    k = np.array([1.0, 4.0, 6.0, 4.0, 1.0])
    wide = np.pad(image, 2, mode="reflect") if min(image.shape) > 2 else np.pad(image, 2, mode="edge")
    rows = sum(w * wide[i : i + image.shape[0], :] for i, w in enumerate(k))
    return np.floor(sum(w * rows[:, j : j + image.shape[1]] for j, w in enumerate(k)) / 256 + 0.5)


# ---- colour: rasters (image_id, height, width, data) of three channels, height x width x 3 bytes

COLOUR = "image_id long, height int, width int, data binary"


def coloured(grey: DataFrame) -> DataFrame:
    """Colour rasters of grey ones, with a tint that grows to the right, to try steps on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, h, w in zip(b["data"], b["height"], b["width"], strict=True):
                a = np.asarray(d, float).reshape(h, w)
                tint = np.linspace(0, 60, w)
                out.append(np.clip(np.stack((a + tint, a, a - tint / 2), 2), 0, 255).round().astype(np.uint8).tobytes())
            yield pd.DataFrame({"image_id": b["image_id"], "height": b["height"], "width": b["width"], "data": out})

    return grey.mapInPandas(run, COLOUR)


def each_colour(rasters: DataFrame, step: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """step over every image; a step that returns one channel returns a mask of 0 and 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, h, w in zip(b["data"], b["height"], b["width"], strict=True):
                a = step(np.frombuffer(d, np.uint8).reshape(h, w, 3))
                out.append(np.ascontiguousarray(a if a.ndim == 3 else np.repeat(a[:, :, None], 3, 2)).astype(np.uint8).tobytes())
            yield pd.DataFrame({"image_id": b["image_id"], "height": b["height"], "width": b["width"], "data": out})

    return rasters.mapInPandas(run, COLOUR)


def channel_sums(rasters: DataFrame) -> DataFrame:
    """(image_id, channel, total)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = [np.frombuffer(d, np.uint8).reshape(-1, 3).sum(0).astype(np.int64) for d in b["data"]]
            yield pd.DataFrame({"image_id": np.repeat(b["image_id"].to_numpy(), 3), "channel": np.tile([0, 1, 2], len(b)).astype(np.int32), "total": np.concatenate(sums) if sums else np.zeros(0, np.int64)})

    return rasters.mapInPandas(run, "image_id long, channel int, total long")


#: The conversion between sRGB and CIE XYZ under D65, and that white; fixed values.
_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def to_lab(image: np.ndarray) -> np.ndarray:
    """Bytes of red, green and blue as CIE L (0 to 100), a and b."""
    c = image / 255.0
    line = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = line @ _TO_XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    lightness = np.where(t[..., 1] > 0.008856, 116 * np.cbrt(t[..., 1]) - 16, 903.3 * t[..., 1])
    return np.stack((lightness, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])), -1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    """The bytes of L, a and b."""
    fy = (lab[..., 0] + 16) / 116
    f = np.stack((fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200), -1)
    t = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787)
    t[..., 1] = np.where(lab[..., 0] > 8, fy**3, lab[..., 0] / 903.3)
    line = np.clip((t * _WHITE) @ np.linalg.inv(_TO_XYZ).T, 0, 1)
    return np.clip(np.where(line > 0.0031308, 1.055 * line ** (1 / 2.4) - 0.055, 12.92 * line) * 255, 0, 255).round().astype(np.uint8)


def equalized_light(image: np.ndarray, clip: float = 3.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalization of the lightness alone; the colours stay."""
    lab = to_lab(image)
    lab[..., 0] = equalized(np.round(lab[..., 0] * 255 / 100), clip, tiles) * 100 / 255
    return from_lab(lab)


def darkest_colour(image: np.ndarray, k: int = 2, seed: int = 7, turns: int = 20) -> np.ndarray:
    """1 where a pixel is in the cluster of colours whose centre is darkest, else 0."""
    points, r = image.reshape(-1, 3).astype(float), np.random.Generator(np.random.PCG64(seed))
    kinds = np.unique(points, axis=0)
    centres = kinds[r.choice(len(kinds), min(k, len(kinds)), replace=False)]
    own = np.zeros(len(points), int)
    for _ in range(turns):
        own = ((points[:, None, :] - centres) ** 2).sum(2).argmin(1)
        new = np.array([points[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    return (own == centres.sum(1).argmin()).astype(float).reshape(image.shape[:2])


def inpainted(image: np.ndarray, hole: np.ndarray) -> np.ndarray:
    """Holes filled from their edges inwards: each turn, a pixel beside known ones gets their mean, nearer ones counting more."""
    out, known = image.astype(float), ~hole
    if not known.any():
        return image
    steps = [(dy, dx, 1 / np.hypot(dy, dx)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    h, w = hole.shape
    while not known.all():
        total, weight = np.zeros_like(out), np.zeros((h, w))
        wide, there = np.pad(out, [(1, 1), (1, 1), (0, 0)]), np.pad(known, 1)
        for dy, dx, k in steps:
            m = there[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] * k
            total += wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] * m[:, :, None]
            weight += m
        now = ~known & (weight > 0)
        out[now] = total[now] / weight[now][:, None]
        known |= now
    return out.round().astype(np.uint8)


def _grey(image: np.ndarray) -> np.ndarray:
    return np.floor(image @ np.array([0.299, 0.587, 0.114]) + 0.5)


def without_hairs_in_colour(image: np.ndarray, size: int = 17, least: float = 10.0) -> np.ndarray:
    """Thin dark lines (black-hat of the grey image above `least`) painted over from their edges."""
    grey, r = _grey(image), size // 2
    windows = lambda a: np.lib.stride_tricks.sliding_window_view(np.pad(a, r, mode="edge"), (size, size))
    closed = windows(windows(grey).max((2, 3))).min((2, 3))
    return inpainted(image, closed - grey > least)


def denoised_colour(image: np.ndarray, strength: float = 10.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means of the lightness and of both colour channels, each with the strength."""
    lab = to_lab(image)
    scale = np.array([2.55, 1.0, 1.0])
    return from_lab(np.stack([denoised(lab[..., c] * scale[c], strength, patch, search) / scale[c] for c in range(3)], -1))
