"""Operators over an image's histogram: thresholds and equalisation. At most 256 rows an image after the first grouping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from lumenframe.functions import color
from lumenframe.functions.color import half_up


def std_bin(gray: DataFrame, threshold: int = 128) -> DataFrame:
    return gray.withColumn("v", F.when(F.col("v") > threshold, 255).otherwise(0))


def otsu_threshold(gray: DataFrame) -> DataFrame:
    """image_id, threshold: the least gray value that maximises the variance between the two sides."""
    hist = gray.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    up = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    image = Window.partitionBy("image_id")
    h = hist.select("image_id", "v", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("v")).over(up).alias("m0"), F.sum("n").over(image).alias("n"), F.sum(F.col("n") * F.col("v")).over(image).alias("m"))
    d = (F.col("m0") * F.col("n") - F.col("m") * F.col("w0")).cast("double")
    h = h.withColumn("score", F.when(F.col("w0") < F.col("n"), d * d / (F.col("w0") * (F.col("n") - F.col("w0")))).otherwise(0.0))
    return h.groupBy("image_id").agg(F.max_by("v", F.struct("score", -F.col("v"))).alias("threshold"))


def otsu_bin(gray: DataFrame) -> DataFrame:
    t = otsu_threshold(gray)
    return gray.join(t, "image_id").withColumn("v", F.when(F.col("v") > F.col("threshold"), 255).otherwise(0)).drop("threshold")


def otsu_bin_stack(stack: np.ndarray) -> np.ndarray:
    """otsu_bin of images (n, height, width)."""
    out = np.zeros(stack.shape)
    for image, white in zip(stack, out, strict=True):
        v, n = np.unique(image, return_counts=True)
        w0, m0 = np.cumsum(n), np.cumsum(n * v)
        d = m0 * w0[-1] - m0[-1] * w0
        score = np.where(w0 < w0[-1], d * d / np.maximum(w0 * (w0[-1] - w0), 1), 0.0)
        white[image > v[score.argmax()]] = 255
    return out


def _equalized(gray: DataFrame) -> DataFrame:
    hist = gray.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    up = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    image = Window.partitionBy("image_id")
    h = hist.withColumn("c", F.sum("n").over(up)).withColumn("t", F.sum("n").over(image))
    h = h.withColumn("c0", F.min("c").over(image))
    new = F.when(F.col("t") == F.col("c0"), F.col("v")).otherwise(half_up((F.col("c") - F.col("c0")) * 255.0 / (F.col("t") - F.col("c0"))))
    return gray.join(h.select("image_id", "v", new.alias("__v")), ["image_id", "v"]).withColumn("v", F.col("__v").cast("int")).drop("__v")


def _channels(images: DataFrame, color_mode: str, op) -> DataFrame:
    """op on gray, on L* of lab, or on each channel; an unknown mode is gray."""
    if "v" in images.columns:
        return op(images)
    if color_mode == "lab":
        lab = color.lab(images)
        new = op(lab.select("image_id", "y", "x", F.col("l").alias("v")))
        return color.from_lab(lab.drop("l").join(new.withColumnRenamed("v", "l"), ["image_id", "y", "x"]))
    if color_mode == "bgr":
        out = None
        for c in "bgr":
            one = op(images.select("image_id", "y", "x", F.col(c).alias("v"))).select("image_id", "y", "x", F.col("v").alias(c))
            out = one if out is None else out.join(one, ["image_id", "y", "x"])
        return out
    return color.to_bgr(op(color.to_gray(images)))


def equalize(images: DataFrame, color_mode: str = "gray") -> DataFrame:
    return _channels(images, color_mode, _equalized)


def clahe(images: DataFrame, color_mode: str = "gray", clip_limit: float = 2.0, tiles: tuple[int, int] = (8, 8)) -> DataFrame:
    """Tiles' clipped histograms become look-up tables; each pixel blends the four nearest."""
    return _channels(images, color_mode, lambda g: _clahe(g, clip_limit, *tiles))


def _clahe(gray: DataFrame, clip_limit: float, across: int, down: int) -> DataFrame:
    from lumenframe.operators.grid import padded, sized

    g = sized(gray.select("image_id", "y", "x", "v"))
    more = lambda n, k: F.pmod(k - F.pmod(n, F.lit(k)), F.lit(k))  # noqa: E731  pixels to the next multiple
    g = g.withColumn("tw", (F.col("width") + more(F.col("width"), across)) / across).withColumn("th", (F.col("height") + more(F.col("height"), down)) / down)
    wide = padded(padded(g, "x", across - 1, "reflect"), "y", down - 1, "reflect")
    wide = wide.where("x >= 0 AND y >= 0 AND x < tw * {0} AND y < th * {1}".format(across, down))
    wide = wide.withColumn("tx", F.floor(F.col("x") / F.col("tw")).cast("int")).withColumn("ty", F.floor(F.col("y") / F.col("th")).cast("int"))
    hist = wide.groupBy("image_id", "ty", "tx", "tw", "th", "v").agg(F.count("*").alias("n"))
    area = F.col("tw") * F.col("th")
    clip = F.greatest(F.lit(1), F.floor(area * clip_limit / 256).cast("int"))
    tile = Window.partitionBy("image_id", "ty", "tx")
    hist = hist.withColumn("cut", F.least("n", clip)).withColumn("over", F.sum(F.col("n") - F.least("n", clip)).over(tile))
    # the excess goes to all 256 values evenly: below value v lie v + 1 shares of it
    up = tile.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("c", F.sum("cut").over(up))
    steps = hist.groupBy("image_id", "ty", "tx", "tw", "th").agg(F.max("over").alias("over"), F.sort_array(F.collect_list(F.struct("v", "c"))).alias("steps"))
    values = g.select("image_id", "v", "y", "x", "tw", "th")
    fx, fy = (F.col("x") + 0.5) / F.col("tw") - 0.5, (F.col("y") + 0.5) / F.col("th") - 0.5
    values = values.withColumn("x0", F.floor(fx).cast("int")).withColumn("y0", F.floor(fy).cast("int")).withColumn("ax", fx - F.floor(fx)).withColumn("ay", fy - F.floor(fy))
    corner = F.array(*(F.struct((F.col("y0") + i).alias("ty"), (F.col("x0") + j).alias("tx"), ((F.col("ay") if i else 1 - F.col("ay")) * (F.col("ax") if j else 1 - F.col("ax"))).alias("w")) for i in (0, 1) for j in (0, 1)))
    four = values.select("image_id", "y", "x", "v", F.explode(corner).alias("k"))
    clamp = lambda c, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.col(f"k.{c}")))
    four = four.select("image_id", "y", "x", "v", clamp("ty", down).alias("ty"), clamp("tx", across).alias("tx"), F.col("k.w").alias("w"))
    four = four.join(steps, ["image_id", "ty", "tx"])
    below = F.coalesce(F.try_element_at(F.filter("steps", lambda s: s["v"] <= F.col("v")), F.lit(-1))["c"], F.lit(0))
    lut = F.least(F.lit(255), half_up((below + F.col("over") * (F.col("v") + 1) / 256) * 255 / (F.col("tw") * F.col("th"))))
    return four.groupBy("image_id", "y", "x").agg(half_up(F.sum(F.col("w") * lut)).alias("v"))
