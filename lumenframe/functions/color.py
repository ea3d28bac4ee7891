"""Colour arithmetic on 8-bit channels. Roundings are half up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def gray_value(b: Column | str = "b", g: Column | str = "g", r: Column | str = "r") -> Column:
    """299 r + 587 g + 114 b thousandths."""
    b, g, r = (F.col(c) if isinstance(c, str) else c for c in (b, g, r))
    return F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000).cast("int")


def to_gray(pixels: DataFrame) -> DataFrame:
    """Colour to gray; a relation that has v already is returned unchanged."""
    return pixels if "v" in pixels.columns else pixels.select("image_id", "y", "x", gray_value().alias("v"))


def to_bgr(gray: DataFrame) -> DataFrame:
    """Gray replicated into three channels; other columns (alpha) are dropped."""
    if "v" not in gray.columns:
        return gray.select("image_id", "y", "x", "b", "g", "r")
    return gray.select("image_id", "y", "x", F.col("v").alias("b"), F.col("v").alias("g"), F.col("v").alias("r"))


def to_rgb(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "y", "x", "r", "g", "b")


def hsv(pixels: DataFrame) -> DataFrame:
    """image_id, y, x, h (0..179), s, val (0..255)."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    top, d = F.greatest(b, g, r), F.greatest(b, g, r) - F.least(b, g, r)
    h = F.when(d == 0, 0.0).when(top == r, (g - b) * 60.0 / d).when(top == g, (b - r) * 60.0 / d + 120).otherwise((r - g) * 60.0 / d + 240)
    h = F.pmod(half_up(F.when(h < 0, h + 360).otherwise(h) / 2), F.lit(180))
    s = F.when(top == 0, 0).otherwise(half_up(d * 255.0 / top))
    return pixels.select("image_id", "y", "x", h.alias("h"), s.alias("s"), top.alias("val"), "b", "g", "r")


_LINEAR = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_INVERSE = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
_WHITE = (0.950456, 1.0, 1.088754)


def lab(pixels: DataFrame) -> DataFrame:
    """image_id, y, x, l, a, lb: 8-bit L*a*b* from sRGB."""
    lin = [F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4)) for c in (F.col(n) / 255.0 for n in "rgb")]
    xyz = [sum((w * c for w, c in zip(row, lin, strict=True)), F.lit(0.0)) / white for row, white in zip(_LINEAR, _WHITE, strict=True)]
    f = [F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16 / 116) for t in xyz]
    light = F.when(xyz[1] > 0.008856, F.cbrt(xyz[1]) * 116 - 16).otherwise(xyz[1] * 903.3)
    clip = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), half_up(x)))
    return pixels.select("image_id", "y", "x", clip(light * 2.55).alias("l"), clip((f[0] - f[1]) * 500 + 128).alias("a"), clip((f[1] - f[2]) * 200 + 128).alias("lb"))


def from_lab(values: DataFrame) -> DataFrame:
    """The inverse of lab, up to rounding."""
    fy = (F.col("l") / 2.55 + 16) / 116
    f = ((F.col("a") - 128) / 500.0 + fy, fy, fy - (F.col("lb") - 128) / 200.0)
    xyz = [F.when(t > 0.206893, t * t * t).otherwise((t - 16 / 116) / 7.787) * white for t, white in zip(f, _WHITE, strict=True)]
    lin = [sum((w * c for w, c in zip(row, xyz, strict=True)), F.lit(0.0)) for row in _INVERSE]
    out = [F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(F.greatest(c, F.lit(0.0)), 1 / 2.4) * 1.055 - 0.055) * 255 for c in lin]
    r, g, b = (F.greatest(F.lit(0), F.least(F.lit(255), half_up(c))) for c in out)
    return values.select("image_id", "y", "x", b.alias("b"), g.alias("g"), r.alias("r"))


def quantize(levels: int, v: Column | str = "v") -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return v if levels >= 256 else F.floor(v / (256 // levels)).cast("int")


def min_max(gray: DataFrame, v: str = "v") -> DataFrame:
    """Each image stretched to 0..255, truncated; a constant image becomes 0."""
    from pyspark.sql import Window

    image = Window.partitionBy("image_id")
    low, high = F.min(v).over(image), F.max(v).over(image)
    out = F.when(high > low, F.floor((F.col(v) - low) * 255.0 / (high - low))).otherwise(0).cast("int")
    return gray.withColumn("v", out)


def normalize_dtype(gray: DataFrame, v: str = "v") -> DataFrame:
    """Any numbers to 0..255 integers: NaN and infinities count as 0, an image with max <= 1 is scaled by 255, one beyond
    255 is stretched from its min..max, others are truncated and clipped."""
    from pyspark.sql import Window

    image = Window.partitionBy("image_id")
    x = F.col(v).cast("double")
    x = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    high, low = F.max(x).over(image), F.min(x).over(image)
    scaled = F.when(high <= 1, x * 255).when(high > 255, (x - low) * 255 / (high - low)).otherwise(x)
    return gray.withColumn("v", F.greatest(F.lit(0), F.least(F.lit(255), scaled.cast("int"))))
