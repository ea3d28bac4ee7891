"""Data-quality checks: rows (image_id, operator, message) instead of errors.

The functions each make one check of a relation. CHECKS are the same ones by name, as registered operators declare them;
`split` makes all of an operator's checks in one pass over each image and parts good images from bad ones.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F


class Check(NamedTuple):
    """wrong(values, over) tells whether an image fails, from its pixels' value columns; over turns an aggregate into one of
    the image."""

    wrong: Callable[[list[str], Callable[[Column], Column]], Column]
    message: str


def _any(values: list[str], test: Callable[[Column], Column]) -> Column:
    out = F.lit(False)
    for c in values:
        out = out | F.coalesce(test(F.col(c)), F.lit(True))  # a missing value fails
    return out.cast("int")


CHECKS: dict[str, Check] = {
    "eight_bit": Check(lambda v, over: over(F.max(_any(v, lambda c: (c < 0) | (c > 255) | (c != F.floor(c))))) > 0, "values must be integers from 0 to 255"),
    "binary": Check(lambda v, over: over(F.max(_any(v, lambda c: ~c.isin(0, 255)))) > 0, "values must be 0 or 255"),
    "equal_channels": Check(lambda v, over: over(F.max(_any(v[1:], lambda c: c != F.col(v[0])))) > 0, "the channels of a mask must be equal"),
    "four_by_four": Check(lambda v, over: (over(F.max("y")) < 3) | (over(F.max("x")) < 3), "image must be at least 4x4"),
}


def split(pixels: DataFrame, operator: str, checks: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """The pixels of images that pass, and (image_id, operator, message) of the others, with the first check that fails; None
    without checks. The checks are windows over image_id, so that dealt images stay where they are."""
    if not checks:
        return pixels, None
    values = [c for c in ("v", "b", "g", "r") if c in pixels.columns]
    image = Window.partitionBy("image_id")
    failed = F.coalesce(*(F.when(CHECKS[c].wrong(values, lambda x: x.over(image)), F.lit(f"[{operator}] {CHECKS[c].message}")) for c in checks))
    judged = pixels.withColumn("__failed", failed)
    bad = judged.where("__failed IS NOT NULL").groupBy("image_id").agg(F.first("__failed").alias("message"))
    return judged.where("__failed IS NULL").drop("__failed"), bad.select("image_id", F.lit(operator).alias("operator"), "message")


def _bad(df: DataFrame, operator: str, wrong: Column, message: str) -> DataFrame:
    return df.where(wrong).select("image_id", F.lit(operator).alias("operator"), F.lit(f"[{operator}] {message}").alias("message"))


def empty(images: DataFrame, pixels: DataFrame, operator: str) -> DataFrame:
    """images (image_id) without a pixel."""
    return _bad(images.join(pixels.select("image_id").distinct(), "image_id", "left_anti"), operator, F.lit(True), "image is empty")


def channels(images: DataFrame, operator: str, allowed: tuple[int, ...] = (1, 3, 4)) -> DataFrame:
    return _bad(images, operator, ~F.col("n_channels").isin(list(allowed)), f"channels must be one of {list(allowed)}")


def eight_bit(gray: DataFrame, operator: str) -> DataFrame:
    r = gray.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max((F.col("v") != F.floor("v")).cast("int")).alias("part"))
    return _bad(r, operator, (F.col("lo") < 0) | (F.col("hi") > 255) | (F.col("part") > 0), "values must be integers from 0 to 255")


def binary(gray: DataFrame, operator: str) -> DataFrame:
    r = gray.groupBy("image_id").agg(F.count_if(~F.col("v").isin(0, 255)).alias("n"))
    return _bad(r, operator, F.col("n") > 0, "values must be 0 or 255")


def gray_channels(pixels: DataFrame, operator: str) -> DataFrame:
    r = pixels.groupBy("image_id").agg(F.count_if((F.col("b") != F.col("g")) | (F.col("g") != F.col("r"))).alias("n"))
    return _bad(r, operator, F.col("n") > 0, "the channels of a mask must be equal")


def few_values(gray: DataFrame, operator: str, most: int = 3) -> DataFrame:
    r = gray.groupBy("image_id").agg(F.count_distinct("v").alias("n"))
    return _bad(r, operator, F.col("n") > most, f"at most {most} values are allowed")


def too_small(gray: DataFrame, operator: str, least: int = 4) -> DataFrame:
    r = gray.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return _bad(r, operator, (F.col("h") < least) | (F.col("w") < least), f"image must be at least {least}x{least}")
