"""Brightness, colour and circular hue statistics. Sums are exact integers, divided last."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions import color


def moments(v: Column, prefix: str = "") -> list[Column]:
    """mean, median, variance (population), std_dev, cv (infinite where the mean is 0) of the non-null values."""
    n, s, q = F.count(v), F.sum(v.cast("long")), F.sum(v.cast("long") * v.cast("long"))
    mean, var = s / n, (n * q - s * s) / (n * n)
    std = F.sqrt(var)
    none = lambda x: F.when(n == 0, 0.0).otherwise(x)
    cv = F.when((n == 0) | (s == 0), float("inf")).otherwise(std / mean)
    return [none(mean).alias(f"{prefix}mean"), none(F.percentile(v, 0.5)).alias(f"{prefix}median"), none(var).alias(f"{prefix}variance"), none(std).alias(f"{prefix}std_dev"), cv.alias(f"{prefix}cv")]


def brightness(images: DataFrame, color_mode: str = "gray", exclude_zero_pixels: bool = True) -> DataFrame:
    """image_id and five statistics of gray values, of L* (`lab_l`) or of V (`hsv_v`); images without pixels left have
    0, and an infinite cv."""
    if color_mode == "gray":
        gray = color.to_gray(images)
    elif color_mode == "lab_l":
        gray = color.lab(color.to_bgr(images)).withColumnRenamed("l", "v")
    elif color_mode == "hsv_v":
        gray = color.hsv(color.to_bgr(images)).withColumnRenamed("val", "v")
    else:
        raise ValueError(f"color_mode {color_mode!r}")
    v = F.when(F.col("v") != 0, F.col("v")) if exclude_zero_pixels else F.col("v")
    return gray.groupBy("image_id").agg(*moments(v))


def rgb(pixels: DataFrame, exclude_black_pixels: bool = True) -> DataFrame:
    keep = (F.col("b") + F.col("g") + F.col("r")) > 0 if exclude_black_pixels else F.lit(True)
    return pixels.groupBy("image_id").agg(*(m for c, n in (("r", "red_"), ("g", "green_"), ("b", "blue_")) for m in moments(F.when(keep, F.col(c)), n)))


def hsv(pixels: DataFrame, exclude_black_pixels: bool = True) -> DataFrame:
    """Circular statistics of hue; the five of saturation and value."""
    h = color.hsv(pixels)
    if exclude_black_pixels:
        h = h.where((F.col("b") + F.col("g") + F.col("r")) > 0)
    angle = F.col("h") * (2 * math.pi / 180)
    # opposite hues cancel to exact zeros, and a mean a rounding error below 180 is 0
    part = lambda x: F.round(F.avg(x), 13) + 0.0
    base = h.groupBy("image_id").agg(part(F.sin(angle)).alias("__s"), part(F.cos(angle)).alias("__c"), *moments(F.col("s"), "saturation_"), *moments(F.col("val"), "value_"))
    mean = F.pmod(F.round(F.pmod(F.atan2("__s", "__c") + 2 * math.pi, F.lit(2 * math.pi)) * (180 / (2 * math.pi)), 9), F.lit(180.0))
    r = F.least(F.lit(1.0), F.sqrt(F.col("__s") * F.col("__s") + F.col("__c") * F.col("__c")))
    std = F.sqrt(F.log(F.greatest(r, F.lit(1e-12))) * -2) * (180 / (2 * math.pi))
    base = base.withColumn("hue_mean", mean).withColumn("hue_std_dev", std).withColumn("hue_variance", std * std)
    # the half circle around the mean, in whole hues: those beyond its ends are a turn away, so the median is exact
    ahead = F.round(F.col("h") - F.col("hue_mean"), 9)
    turned = F.col("h") + F.when(ahead < -90, 180).when(ahead >= 90, -180).otherwise(0)
    shifted = h.join(base.select("image_id", "hue_mean"), "image_id").withColumn("t", turned)
    median = shifted.groupBy("image_id").agg(F.percentile("t", 0.5).alias("t")).select("image_id", F.pmod("t", F.lit(180.0)).alias("hue_median"))
    out = base.join(median, "image_id").withColumn("hue_cv", F.when(F.col("hue_mean") == 0, float("inf")).otherwise(F.col("hue_std_dev") / F.col("hue_mean")))
    return out.drop("__s", "__c")
