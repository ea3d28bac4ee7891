"""Blurs and adaptive thresholds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenframe.functions.color import half_up
from lumenframe.operators import arrays, grid


def _odd(k: int) -> int:
    if k < 3 or k % 2 == 0:
        raise ValueError(f"a kernel size is odd and at least 3, not {k}")
    return k


def gaussian_weights(k: int, sigma: float = 0) -> list[float]:
    sigma = sigma or 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    w = [math.exp(-((i - k // 2) ** 2) / (2 * sigma * sigma)) for i in range(_odd(k))]
    return [x / sum(w) for x in w]


def average_blur(gray: DataFrame, kernel_size: tuple[int, int] = (5, 5)) -> DataFrame:
    """Box mean: integer sums, one division."""
    kx, ky = map(_odd, kernel_size)
    out = grid.separable(grid.sized(gray), [1] * kx, [1] * ky)
    return out.withColumn("v", half_up(F.col("v") / (kx * ky))).drop("height", "width")


def gaussian_blur(gray: DataFrame, kernel_size: tuple[int, int] = (15, 15), sigma: float = 0, sigma_y: float | None = None, border: str = "reflect") -> DataFrame:
    kx, ky = kernel_size
    out = grid.separable(grid.sized(gray), gaussian_weights(kx, sigma), gaussian_weights(ky, sigma if sigma_y is None else sigma_y), border)
    return out.withColumn("v", half_up(F.col("v"))).drop("height", "width")


def _square(r: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def _median(image: np.ndarray, k: int) -> np.ndarray:
    """The median of k x k pixels, borders replicated. Bytes under large kernels: histograms of columns move down a row at a
    time, and their running sums give each pixel's histogram, whatever k is. Else some rows at a time are partitioned."""
    padded = np.pad(image, k // 2, mode="edge")
    height, width = image.shape
    out = np.empty(image.shape)
    if k > 7 and image.min() >= 0 and image.max() <= 255 and (image == np.floor(image)).all():
        padded = padded.astype(np.uint8)
        at = np.arange(padded.shape[1])
        columns = np.zeros((len(at) + 1, 256), np.int32)  # the first row stays 0
        for row in padded[: k - 1]:
            columns[at + 1, row] += 1
        for y in range(height):
            columns[at + 1, padded[y + k - 1]] += 1
            sums = np.cumsum(columns, axis=0)
            out[y] = (np.cumsum(sums[k:] - sums[:-k], axis=1) > k * k // 2).argmax(axis=1)
            columns[at + 1, padded[y]] -= 1
        return out
    near = np.lib.stride_tricks.sliding_window_view(padded, (k, k))
    step = max(1, 2_000_000 // (width * k * k))
    for y in range(0, height, step):
        out[y : y + step] = np.partition(near[y : y + step].reshape(-1, width, k * k), k * k // 2, axis=-1)[..., k * k // 2]
    return out


def _on_arrays(gray: DataFrame, function) -> DataFrame:
    """image_id, y, x, v: function(image as an array) at the pixels that the image has; those it lacks count as 0."""

    def run(table: pa.Table) -> dict[str, np.ndarray]:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        return {"y": y, "x": x, "v": function(arrays.image(table))[y, x].astype(np.int32)}

    cells = gray.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")
    return arrays.per_image(cells, run, "y int, x int, v int")


def median_blur(gray: DataFrame, kernel_size: int = 5) -> DataFrame:
    """The median of the square around each pixel, borders replicated; an image is one array in its task."""
    k = _odd(kernel_size)
    return _on_arrays(gray, lambda image: _median(image, k))


def bilateral_filter(gray: DataFrame, d: int = 9, sigma_color: float = 75, sigma_space: float = 75) -> DataFrame:
    """Weights fall with distance (inside a disc of diameter d) and with the difference in value. A neighbour's place at a time
    is weighed for the whole image, so that nothing is held for pairs of pixels."""
    r = d // 2
    disc = [(dy, dx) for dy, dx in _square(r) if dy * dy + dx * dx <= r * r]

    def run(image: np.ndarray) -> np.ndarray:
        padded = np.pad(image, r, mode="reflect")
        total, weights = np.zeros(image.shape), np.zeros(image.shape)
        for dy, dx in disc:
            u = padded[r + dy : r + dy + image.shape[0], r + dx : r + dx + image.shape[1]]
            w = np.exp((dy * dy + dx * dx) / (-2.0 * sigma_space**2) + (u - image) ** 2 / (-2.0 * sigma_color**2))
            total += w * u
            weights += w
        return np.floor(total / weights + 0.5)

    return _on_arrays(gray, run)


def motion_kernel(k: int, angle: float) -> list[tuple[int, int]]:
    """The cells of a line one pixel wide through the centre."""
    r, a = k // 2, math.radians(angle)
    steps = [i / 2 for i in range(-2 * r, 2 * r + 1)]
    return sorted({(round(s * math.sin(a)), round(s * math.cos(a))) for s in steps})


def motion_blur(gray: DataFrame, kernel_size: int = 15, angle: float = 0) -> DataFrame:
    cells = motion_kernel(kernel_size, angle)
    near = grid.neighbours(grid.sized(gray), cells)
    return near.groupBy("image_id", "y", "x").agg(half_up(F.sum("v") / len(cells)).alias("v"))


def _below(gray: DataFrame, mean: DataFrame, c: int) -> DataFrame:
    """mean: of _with_own(gray), which carries each pixel's own value along, so that nothing is joined."""
    return mean.withColumn("v", F.when(F.col("__own") > F.col("v") - int(c), 255).otherwise(0)).select(gray.columns)


def _with_own(gray: DataFrame) -> DataFrame:
    return gray.withColumn("__own", F.col("v"))


def mean_adapt_bin(gray: DataFrame, block_size: int = 11, c: int = 2) -> DataFrame:
    k = _odd(block_size)
    mean = grid.separable(grid.sized(_with_own(gray)), [1] * k, [1] * k, "replicate")
    return _below(gray, mean.withColumn("v", half_up(F.col("v") / (k * k))), c)


def mean_adapt_bin_stack(stack: np.ndarray, block_size: int = 11, c: int = 2) -> np.ndarray:
    """mean_adapt_bin of images (n, height, width)."""
    k = _odd(block_size)
    out = np.pad(stack, ((0, 0), (k // 2, k // 2), (k // 2, k // 2)), mode="edge")
    for axis in (1, 2):
        sums = np.cumsum(out, axis=axis)
        sums = np.concatenate([np.zeros_like(sums.take([0], axis)), sums], axis=axis)
        n = sums.shape[axis]
        out = sums.take(range(k, n), axis) - sums.take(range(n - k), axis)
    return np.where(stack > np.floor(out / (k * k) + 0.5) - int(c), 255, 0)


def gauss_adapt_bin(gray: DataFrame, block_size: int = 11, c: int = 2) -> DataFrame:
    return _below(gray, gaussian_blur(_with_own(gray), (block_size, block_size), border="replicate"), c)
