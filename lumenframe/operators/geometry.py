"""Resizing, cropping, masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.color import half_up
from lumenframe.operators import arrays, grid


def target_size(width: int, height: int, preserve_aspect_ratio: bool = True, aspect_ratio_mode: str = "width") -> tuple[Column, Column]:
    """New width and height over the columns width and height: one side given, the other rounded."""
    if not preserve_aspect_ratio:
        return F.lit(width), F.lit(height)
    if aspect_ratio_mode == "width":
        return F.lit(width), F.greatest(F.lit(1), half_up(F.col("height") * (width / 1.0) / F.col("width")))
    return F.greatest(F.lit(1), half_up(F.col("width") * (height / 1.0) / F.col("height"))), F.lit(height)


def _weights(n: int, to: int, area: bool) -> np.ndarray:
    """(to, n): each pixel's weight in the new pixels along one axis. area: by overlap, else linear between centres."""
    scale = n / to
    d, at = np.arange(to)[:, None], np.arange(n)[None, :]
    if area:
        w = (np.minimum(at + 1.0, (d + 1) * scale) - np.maximum(at + 0.0, d * scale)) / scale
    else:
        w = 1 - np.abs(np.clip((d + 0.5) * scale - 0.5, 0, n - 1) - at)
    return np.where(w > 1e-12, w, 0.0)


def resized_stack(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """Images (n, h, w) as (n, height, width)."""
    _, h, w = stack.shape
    area = height * width < h * w
    return np.floor(np.round(_weights(h, height, area) @ (stack @ _weights(w, width, area).T), 9) + 0.5)


def resize_to(gray: DataFrame, width: Column, height: Column) -> DataFrame:
    """gray (pixels or whole images) resized: area weights when the new area is smaller, else bilinear. width and height: over the
    columns width and height."""
    return _resized(arrays.sized(gray).withColumn("tw", width).withColumn("th", height))


def _resized(df: DataFrame) -> DataFrame:
    """df: image_id, y, x, v (or cells) with height and width, and those to come as th and tw. Images are arrays in the task that
    has them."""

    def run(stack: np.ndarray, _h: int, _w: int, th: int, tw: int) -> dict[str, np.ndarray]:
        n = len(stack)
        return {"y": np.tile(np.repeat(np.arange(th), tw), (n, 1)), "x": np.tile(np.arange(tw), (n, th)), "v": resized_stack(stack, th, tw).reshape(n, -1).astype(np.int32)}

    return arrays.per_stack(df, run, "y int, x int, v int", ("th", "tw"))


def resize(gray: DataFrame, width: int = 1600, height: int = 1200, preserve_aspect_ratio: bool = True, aspect_ratio_mode: str = "width") -> DataFrame:
    return resize_to(gray, *target_size(width, height, preserve_aspect_ratio, aspect_ratio_mode))


def scaled(gray: DataFrame, scale: float) -> DataFrame:
    """Both sides times scale, truncated; images of which nothing would be left are dropped."""
    side = lambda n: F.floor(F.col(n) * scale).cast("int")
    df = arrays.sized(gray).where((side("width") > 0) & (side("height") > 0))
    return _resized(df.withColumn("tw", side("width")).withColumn("th", side("height")))


def fit_within(gray: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """Shrunk by the smaller ratio, sides truncated; smaller images stay."""
    ratio = F.least(F.lit(1.0), F.lit(width) / F.col("width"), F.lit(height) / F.col("height"))
    return resize_to(gray, F.greatest(F.lit(1), F.floor(F.col("width") * ratio).cast("int")), F.greatest(F.lit(1), F.floor(F.col("height") * ratio).cast("int")))


def letterbox(gray: DataFrame, width: int, height: int, padding: int = 114) -> DataFrame:
    """Resized by the smaller ratio and centred on a canvas of width x height."""
    d = gray.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    ratio = F.least(F.lit(width) / F.col("w"), F.lit(height) / F.col("h"))
    d = d.select("image_id", F.greatest(F.lit(1), F.floor(F.col("w") * ratio).cast("int")).alias("nw"), F.greatest(F.lit(1), F.floor(F.col("h") * ratio).cast("int")).alias("nh"))
    r = F.least(F.lit(width) / F.col("width"), F.lit(height) / F.col("height"))
    small = resize_to(gray, F.greatest(F.lit(1), F.floor(F.col("width") * r).cast("int")), F.greatest(F.lit(1), F.floor(F.col("height") * r).cast("int")))
    small = small.join(d, "image_id").select("image_id", (F.col("y") + F.expr(f"({height} - nh) DIV 2")).cast("int").alias("y"), (F.col("x") + F.expr(f"({width} - nw) DIV 2")).cast("int").alias("x"), "v")
    canvas = d.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return canvas.join(small, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.coalesce("v", F.lit(padding)).alias("v"))


def _boxed(images: DataFrame, x: Column, y: Column, w: Column, h: Column) -> DataFrame:
    """The part of each image inside its box, moved to the origin; images with height and width."""
    x0, y0 = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    x1, y1 = F.least(F.col("width"), x + w), F.least(F.col("height"), y + h)
    some = F.coalesce((x1 > x0) & (y1 > y0), F.lit(False))
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    out = images.where(~some | inside)
    return out.withColumn("__x", F.when(some, F.col("x") - x0).otherwise(F.col("x"))).withColumn("y", F.when(some, F.col("y") - y0).otherwise(F.col("y"))).withColumn("x", F.col("__x")).drop("height", "width", "__x")


def roi_crop(images: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The part of each image inside the box, clamped to it and moved to the origin; an empty or outside box keeps all."""
    return _boxed(grid.sized(images), *map(F.lit, (x, y, w, h)))


def roi_by_table(images: DataFrame, boxes: DataFrame, on: tuple[str, ...] = ("camera",), most_broadcast: int = 100_000) -> DataFrame:
    """roi_crop with each image's own box. boxes: the columns of `on`, x, y, w, h; of several for one key the first in order,
    those with a null left out. An image without a box stays whole. Up to most_broadcast boxes go to all tasks; more are joined by
    key."""
    key = [F.col(k) for k in on]
    own = boxes.dropna(subset=[*on, "x", "y", "w", "h"]).groupBy(*key).agg(F.min(F.struct("x", "y", "w", "h")).alias("__box"))
    own = F.broadcast(own) if own.limit(most_broadcast + 1).count() <= most_broadcast else own
    df = grid.sized(images).join(own, list(on), "left")
    return _boxed(df, *(F.col(f"__box.{c}") for c in "xywh")).select(images.columns)


def fitted(target: DataFrame, mask: DataFrame) -> DataFrame:
    """target with the images whose size is not their mask's resized to it; the others, and those without a mask, as they are."""
    values = [c for c in target.columns if c not in ("image_id", "y", "x")]
    side = lambda df, h, w: df.groupBy("image_id").agg((F.max("y") + 1).alias(h), (F.max("x") + 1).alias(w))
    other = side(target, "h", "w").join(side(mask, "th", "tw"), "image_id").where("h <> th OR w <> tw").select("image_id", "th", "tw")
    odd, out = target.join(other, "image_id"), None
    for c in values:
        sized = grid.sized(odd.select("image_id", "y", "x", F.col(c).alias("v"), "th", "tw"))
        new = _resized(sized).select("image_id", "y", "x", F.col("v").cast(target.schema[c].dataType).alias(c))
        out = new if out is None else out.join(new, ["image_id", "y", "x"])
    return target.join(other, "image_id", "left_anti").unionByName(out.select(*(F.col(c).cast(target.schema[c].dataType).alias(c) for c in target.columns)))


def mask_composition(target: DataFrame, mask: DataFrame, use_white_pixels: bool = True, enable_cropping: bool = False, crop_margin: int = 5, resize_target: bool = False) -> DataFrame:
    """target where the mask is white (or where it is not), 0 elsewhere; the crop box bounds the white pixels in any case.
    resize_target: targets of another size than their mask are resized to it first; else the two meet by position."""
    target = fitted(target, mask) if resize_target else target
    values = [c for c in target.columns if c not in ("image_id", "y", "x")]
    m = mask.select("image_id", "y", "x", (F.col("v") > 0).alias("__w"))
    keep = F.col("__w") if use_white_pixels else ~F.col("__w")
    both = target.join(m, ["image_id", "y", "x"])
    out = both.select("image_id", "y", "x", "__w", *(F.when(keep, F.col(c)).otherwise(0).alias(c) for c in values))
    if not enable_cropping:
        return out.drop("__w")
    box = out.groupBy("image_id").agg(*(f(F.when(F.col("__w"), F.col(c))).alias(f"__{n}{c}") for c in "yx" for n, f in (("a", F.min), ("b", F.max))))
    out = out.join(box, "image_id")
    low = {c: F.greatest(F.lit(0), F.coalesce(F.col(f"__a{c}") - crop_margin, F.lit(0))) for c in "yx"}
    inside = [(F.col(c) >= low[c]) & (F.col(f"__b{c}").isNull() | (F.col(c) <= F.col(f"__b{c}") + crop_margin)) for c in "yx"]
    return out.where(inside[0] & inside[1]).select("image_id", *((F.col(c) - low[c]).alias(c) for c in "yx"), *values)
