"""Texture features: co-occurrence, local binary patterns, higher-order local auto-correlation."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenframe.functions import color
from lumenframe.operators import arrays, grid


def glcm_offsets(distances: tuple[int, ...], angles: tuple[float, ...]) -> list[tuple[int, int, int, int]]:
    """(distance, truncated angle for the name, dy, dx), down and right positive."""
    out = []
    for d, a in itertools.product(distances, angles):
        t = math.radians(a)
        out.append((d, int(math.degrees(t)), round(d * math.sin(t)), round(d * math.cos(t))))
    return out


def glcm_counts(gray: DataFrame, distances=(1, 2, 3), angles=(0, 45, 90, 135), levels: int = 256) -> DataFrame:
    """image_id, d, angle, lo, hi, n: unordered pairs of gray levels at each offset. Neighbours come from windows along
    rows, columns and diagonals of the dense grid; other directions from one join by coordinates."""
    df = gray.select("image_id", "y", "x", color.quantize(levels).alias("v"))
    by = {(0, 1): Window.partitionBy("image_id", "y").orderBy("x"), (1, 0): Window.partitionBy("image_id", "x").orderBy("y"), (1, 1): Window.partitionBy("image_id", F.col("y") - F.col("x")).orderBy("y"), (1, -1): Window.partitionBy("image_id", F.col("y") + F.col("x")).orderBy("y")}
    pairs, odd = [], []
    for d, a, dy, dx in glcm_offsets(distances, angles):
        k = max(abs(dy), abs(dx))
        step = (dy // k, dx // k) if k and abs(dy) in (0, k) and abs(dx) in (0, k) else None
        if step in by:
            pairs.append(F.struct(F.lit(d).alias("d"), F.lit(a).alias("angle"), F.lead("v", k).over(by[step]).alias("j")))
        elif step and (-step[0], -step[1]) in by:
            pairs.append(F.struct(F.lit(d).alias("d"), F.lit(a).alias("angle"), F.lag("v", k).over(by[-step[0], -step[1]]).alias("j")))
        else:
            odd.append((d, a, dy, dx))
    out = None
    if pairs:
        out = df.withColumn("p", F.array(*pairs)).select("image_id", F.col("v").alias("i"), F.explode("p").alias("p")).select("image_id", "p.d", "p.angle", "i", "p.j")
    if odd:
        to = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(a).alias("angle"), (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x")) for d, a, dy, dx in odd)))
        near = df.select("image_id", F.col("v").alias("j"), to.alias("t")).select("image_id", "t.*", "j")
        near = near.join(df.withColumnRenamed("v", "i"), ["image_id", "y", "x"]).select("image_id", "d", "angle", "i", "j")
        out = near if out is None else out.unionByName(near)
    out = out.where("j IS NOT NULL")
    return out.groupBy("image_id", "d", "angle", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(F.count("*").alias("n"))


def glcm(gray: DataFrame, distances=(1, 2, 3), angles=(0, 45, 90, 135), levels: int = 256) -> DataFrame:
    """image_id, d, angle and the six properties of the symmetric normalised matrix, from integer sums."""
    c = glcm_counts(gray, distances, angles, levels)
    i, j, n = F.col("lo").cast("long"), F.col("hi").cast("long"), F.col("n")
    sums = c.groupBy("image_id", "d", "angle").agg(
        F.sum(n).alias("t"),
        F.sum(n * (i - j) * (i - j)).alias("con"),
        F.sum(n * (j - i)).alias("dis"),
        F.sum(n / ((i - j) * (i - j) + 1)).alias("hom"),
        F.sum(F.when(i == j, n * n * 4).otherwise(n * n * 2)).alias("sq"),
        F.sum(n * (i + j)).alias("s"),
        F.sum(n * (i * i + j * j)).alias("q"),
        F.sum(n * i * j).alias("ij"),
    )
    t = F.col("t")
    asm = F.col("sq") / (t * t * 4)
    var = t * 2 * F.col("q") - F.col("s") * F.col("s")
    corr = F.when(var == 0, 1.0).otherwise((t * 4 * F.col("ij") - F.col("s") * F.col("s")) / var)
    return sums.select("image_id", "d", "angle", (F.col("con") / t).alias("contrast"), (F.col("dis") / t).alias("dissimilarity"), (F.col("hom") / t).alias("homogeneity"), asm.alias("asm"), F.sqrt(asm).alias("energy"), corr.alias("correlation"))


def lbp_samples(p: int, r: int) -> list[list[tuple[int, int, float]]]:
    """For each of p points on the circle the pixels (dy, dx) around it with their bilinear weights."""
    out = []
    for k in range(p):
        y, x = round(-r * math.sin(2 * math.pi * k / p), 5) + 0.0, round(r * math.cos(2 * math.pi * k / p), 5) + 0.0
        y0, x0 = math.floor(y), math.floor(x)
        fy, fx = y - y0, x - x0
        cells = [(y0, x0, (1 - fy) * (1 - fx)), (y0, x0 + 1, (1 - fy) * fx), (y0 + 1, x0, fy * (1 - fx)), (y0 + 1, x0 + 1, fy * fx)]
        out.append([c for c in cells if c[2]])
    return out


#: The weights of lbp_samples are products of two numbers of five digits: as whole multiples of 1e-10 they make sums exact, so
#: that a sample equal to the centre counts as at least the centre.
_UNIT = 10**10


def _far_samples(gray: DataFrame, p: int, r: float, variance: bool) -> DataFrame:
    """image_id, y, x, mask (bit k: sample k is at least the centre), code (the samples' variance, if asked), from shifted slices
    of the image's array."""
    if p > 62:
        raise ValueError(f"{p} points do not fit a mask")
    circle, pad = lbp_samples(p, r), math.ceil(r)

    def run(table: pa.Table) -> dict[str, np.ndarray]:
        image = arrays.image(table)
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        padded = np.pad(image, pad)
        at = lambda dy, dx: padded[pad + dy : pad + dy + image.shape[0], pad + dx : pad + dx + image.shape[1]]
        mask, total, squares = np.zeros(image.shape, np.int64), np.zeros(image.shape), np.zeros(image.shape)
        for k, cells in enumerate(circle):
            sample = sum(at(dy, dx) * float(round(w * _UNIT)) for dy, dx, w in cells)
            mask |= (sample >= image * _UNIT).astype(np.int64) << k
            total += sample / _UNIT
        if variance:
            for cells in circle:
                squares += (sum(at(dy, dx) * w for dy, dx, w in cells) - total / p) ** 2
        return {"y": y, "x": x, "mask": mask[y, x], "code": squares[y, x] / p}

    cells = gray.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")
    return arrays.per_image(cells, run, "y int, x int, mask long, code double")


def lbp_codes(gray: DataFrame, p: int = 8, r: float = 1, method: str = "uniform") -> DataFrame:
    """image_id, y, x, code. Pixels outside the image are 0; a bit is set where the sample is at least the centre."""
    if r <= 0:
        raise ValueError(f"a radius of {r}")
    if r > 1:
        near = _far_samples(gray, p, r, method == "var")
        if method == "var":
            return near.select("image_id", "y", "x", "code")
        near = near.withColumn("bits", F.array(*(F.shiftright("mask", k).bitwiseAND(1).cast("int") for k in range(p))))
    else:
        near = grid.around(grid.sized(gray), "zero")
        at = lambda dy, dx: F.col(f"n{3 * (dy + 1) + dx + 1}")
        circle = lbp_samples(p, r)
        if method == "var":
            samples = [grid.total([at(dy, dx) * F.lit(w) for dy, dx, w in cells]) for cells in circle]
            mean = grid.total(samples) / p
            code = grid.total([(s - mean) * (s - mean) for s in samples]) / p
            return near.select("image_id", "y", "x", code.alias("code"))
        samples = [grid.total([at(dy, dx) * F.lit(round(w * _UNIT)).cast("long") for dy, dx, w in cells]) for cells in circle]
        near = near.withColumn("bits", F.array(*((s >= F.col("v") * F.lit(_UNIT)).cast("int") for s in samples)))
    bit = lambda k: F.col("bits")[k % p]
    value = lambda shift: grid.total([bit(k + shift) * (1 << k) for k in range(p)])
    changes = grid.total([F.abs(bit(k) - bit(k + 1)) for k in range(p)])
    ones = grid.total([bit(k) for k in range(p)])
    if method == "default":
        code = value(0)
    elif method == "ror":
        code = F.least(*(value(s) for s in range(p)))
    elif method == "uniform":
        code = F.when(changes <= 2, ones).otherwise(p + 1)
    elif method == "nri_uniform":
        patterns = sorted({sum(1 << (s + k) % p for k in range(n)) for n in range(p + 1) for s in range(p)})
        names = F.create_map(*(F.lit(x) for pair in zip(patterns, range(len(patterns)), strict=True) for x in pair))
        code = F.coalesce(F.element_at(names, value(0)), F.lit(len(patterns)))
    else:
        raise ValueError(f"method {method!r}")
    return near.select("image_id", "y", "x", code.cast("int").alias("code"))


def lbp_bins(p: int, method: str) -> int:
    return {"uniform": p + 2, "nri_uniform": p * (p - 1) + 3, "var": 256}.get(method, 1 << p)


def lbp_histogram(gray: DataFrame, p: int = 8, r: float = 1, method: str = "uniform") -> DataFrame:
    return lbp_codes(gray, p, r, method).groupBy("image_id", "code").agg(F.count("*").alias("n"))


def lbp(gray: DataFrame, p: int = 8, r: float = 1, method: str = "uniform", resize_shape: tuple[int, int] | None = None, include_histogram: bool = False) -> DataFrame:
    """image_id, mean, std, skewness, kurtosis of the codes; entropy and energy of their histogram, and with
    include_histogram the share of each code as lbp_bin_0 and so on. resize_shape: height and width to resize to first."""
    from lumenframe.operators import geometry

    if resize_shape:
        gray = geometry.resize(gray, resize_shape[1], resize_shape[0], preserve_aspect_ratio=False)
    if include_histogram and method == "var":
        raise ValueError("variances have no bins of their own")
    h = lbp_histogram(gray, p, r, method).withColumn("total", F.sum("n").over(Window.partitionBy("image_id")))
    c, n, share = F.col("code").cast("double"), F.col("n"), F.col("n") / F.col("total")
    s = h.groupBy("image_id").agg(*(F.sum(n * F.pow(c, k)).alias(f"s{k}") for k in range(5)), F.count("*").alias("used"), F.sum(share * share).alias("energy"), F.sum(share * F.log2(share)).alias("e"))
    m1, m2, m3, m4 = (F.col(f"s{k}") / F.col("s0") for k in range(1, 5))
    var = m2 - m1 * m1
    flat = var <= 1e-12
    third = m3 - m1 * 3 * m2 + m1 * m1 * m1 * 2
    fourth = m4 - m1 * 4 * m3 + m1 * m1 * 6 * m2 - m1 * m1 * m1 * m1 * 3
    guard = lambda x: F.when(flat, 0.0).otherwise(x)
    entropy = F.when(F.col("used") <= 1, 0.0).otherwise(-F.col("e") / math.log2(lbp_bins(p, method)))
    out = s.select("image_id", m1.alias("lbp_mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("lbp_std"), guard(third / F.pow(var, 1.5)).alias("lbp_skewness"), guard(fourth / (var * var) - 3).alias("lbp_kurtosis"), entropy.alias("lbp_entropy"), F.col("energy").alias("lbp_energy"))
    if not include_histogram:
        return out
    bins = list(range(lbp_bins(p, method)))
    shares = h.groupBy("image_id").pivot("code", bins).agg(F.first(share))
    return out.join(shares.select("image_id", *(F.coalesce(F.col(str(k)), F.lit(0.0)).alias(f"lbp_bin_{k}") for k in bins)), "image_id")


#: The eight neighbours in the order left, up-left, up, up-right, right, down-right, down, down-left, as bits of the 3x3
#: neighbourhood read row by row (fixed values).
_RING = (3, 0, 1, 2, 5, 8, 7, 6)


def hlac_kernels(order: int = 2, rotate_invariant: bool = False) -> list[int]:
    """9-bit masks: the centre, the centre with one neighbour, with two. Rotation-invariant: of the masks that are turns of
    one another by 90 degrees one remains, the first in the order of its cells as bytes."""
    centre = 1 << 4
    masks = [centre] + [centre | 1 << a for a in _RING]
    if order == 2:
        masks += [centre | 1 << a | 1 << b for a, b in itertools.combinations(_RING, 2)]
    if not rotate_invariant:
        return masks
    turn = lambda m: sum(1 << (3 * (i % 3) + 2 - i // 3) for i in range(9) if m >> i & 1)
    cells = lambda m: [m >> i & 1 for i in range(9)]
    out = []
    for m in masks:
        orbit = [m, turn(m), turn(turn(m)), turn(turn(turn(m)))]
        best = min(orbit, key=cells)
        if best not in out:
            out.append(best)
    return out


def hlac_masks(binary: DataFrame) -> DataFrame:
    """image_id, mask, n: how often each 3x3 pattern of set pixels occurs in the interior; at most 512 rows an image."""
    near = grid.around(grid.sized(binary), "zero").where("y > 0 AND x > 0 AND y < height - 1 AND x < width - 1")
    mask = grid.total([F.when(F.col(f"n{i}") > 0, 1 << i).otherwise(0) for i in range(9)])
    return near.groupBy("image_id", mask.alias("mask")).agg(F.count("*").alias("n"))


def hlac(binary: DataFrame, order: int = 2, rotate_invariant: bool = False, normalize: bool = False) -> DataFrame:
    """image_id, k, count: positions where all cells of kernel k are set; normalised to a sum of 1."""
    masks = hlac_kernels(order, rotate_invariant)
    hits = [F.struct(F.lit(k).alias("k"), F.sum(F.when(F.col("mask").bitwiseAND(m) == m, F.col("n")).otherwise(0)).alias("count")) for k, m in enumerate(masks)]
    out = hlac_masks(binary).groupBy("image_id").agg(F.array(*hits).alias("h")).select("image_id", F.explode("h").alias("h")).select("image_id", "h.*")
    if normalize:
        whole = F.sum("count").over(Window.partitionBy("image_id"))
        out = out.withColumn("count", F.when(whole > 0, F.col("count") / whole).otherwise(0.0))
    return out


def _hlac_counts(binary: np.ndarray, kernels: np.ndarray) -> np.ndarray:
    """(images, kernels): positions of the interior where all cells of a kernel are set. kernels: (512, k), whether a pattern has
    all of a kernel's cells."""
    n, h, w = binary.shape
    mask = np.zeros((n, h - 2, w - 2), np.int64)
    for i in range(9):
        mask |= (binary[:, i // 3 : h - 2 + i // 3, i % 3 : w - 2 + i % 3] > 0).astype(np.int64) << i
    patterns = np.bincount((mask + np.arange(n)[:, None, None] * 512).ravel(), minlength=n * 512).reshape(n, 512)
    return patterns @ kernels


def hlac_multiscale(gray: DataFrame, scales=(1.0, 0.75, 0.5), binarization_method: str = "adaptive", block_size: int = 11, c: int = 2, order: int = 2, rotate_invariant: bool = False, normalize: bool = True) -> DataFrame:
    """Counts summed over scaled copies, each made binary by its own threshold; a scale that leaves no pixel is skipped. gray:
    pixels or whole images; an image's copies are arrays in the task that has it."""
    from lumenframe.operators import geometry, histogram, stencil

    masks = np.array(hlac_kernels(order, rotate_invariant))
    has = (np.arange(512)[:, None] & masks[None, :] == masks[None, :]).astype(np.int64)
    binary = histogram.otsu_bin_stack if binarization_method == "otsu" else lambda stack: stencil.mean_adapt_bin_stack(stack, block_size, c)

    def run(stack: np.ndarray, h: int, w: int) -> dict[str, np.ndarray]:
        sides = [(s, math.floor(h * s), math.floor(w * s)) for s in scales]
        found = [_hlac_counts(binary(stack if s == 1 else geometry.resized_stack(stack, th, tw)), has) for s, th, tw in sides if th > 2 and tw > 2]
        count = sum(found) if found else np.zeros((len(stack), 0), np.int64)
        k = np.tile(np.arange(count.shape[1]), (len(stack), 1))
        if not normalize:
            return {"k": k, "count": count}
        total = count.sum(axis=1, keepdims=True)
        return {"k": k, "count": count / np.maximum(total, 1)}

    return arrays.per_stack(arrays.sized(gray), run, f"k int, count {'double' if normalize else 'long'}")


def named(features: DataFrame, prefix: str, key: Column, value: str) -> DataFrame:
    """Long rows: image_id, feature_name, feature_value."""
    return features.select("image_id", F.concat(F.lit(prefix), key).alias("feature_name"), F.col(value).cast("double").alias("feature_value"))
