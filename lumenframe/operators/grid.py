"""Neighbourhoods of pixels: borders, windows along rows and columns, scattered offsets.

All window partitions begin with image_id, so one repartition by it serves a whole chain of operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def rows() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def columns() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def by_image(df: DataFrame) -> DataFrame:
    """df dealt by image_id; one that was kept so (see kept_by_image) stays as it is."""
    return df if getattr(df, "_by_image", False) else _dealt(df)


def _dealt(df: DataFrame) -> DataFrame:
    """df over all shuffle partitions: pixels shrink to little in a shuffle, and by its size adaptive execution would put the images
    of many partitions into one task, whose sorts and windows hold them at full size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")


def kept_by_image(df: DataFrame) -> DataFrame:
    """df dealt by image_id once and kept (on disk if need be), for several operators that each ask for it."""
    out = _dealt(df).persist()
    out._by_image = True
    return out


def sized(gray: DataFrame) -> DataFrame:
    """Adds height and width, from the image's own pixels."""
    image = Window.partitionBy("image_id")
    return gray.withColumn("height", F.max("y").over(image) + 1).withColumn("width", F.max("x").over(image) + 1)


def padded(gray: DataFrame, axis: str, k: int, border: str) -> DataFrame:
    """gray with height and width, plus k pixels beyond both ends of an axis: `reflect` (without the edge pixel itself),
    `replicate` or `zero`. One reflection: k must be smaller than the axis, else the rest is replicated edge-on."""
    n = F.col("width" if axis == "x" else "height")
    at = F.col(axis)
    if border == "reflect":
        low = F.when((at >= 1) & (at <= k), F.array(-at))
        high = F.when((at >= n - 1 - k) & (at <= n - 2), F.array((n - 1) * 2 - at))
    else:
        low = F.when(at == 0, F.array(*(F.lit(-i) for i in range(1, k + 1))))
        high = F.when(at == n - 1, F.array(*(n - 1 + i for i in range(1, k + 1))))
    none = F.array().cast("array<int>")
    every = F.concat(F.array(at.cast("int")), F.coalesce(low, none), F.coalesce(high, none))
    out = gray.withColumn("__at", F.explode(every))
    value = F.when(F.col("__at") == at, F.col("v")).otherwise(F.lit(0)) if border == "zero" else F.col("v")
    return out.withColumn("v", value).drop(axis).withColumnRenamed("__at", axis)


def cropped(df: DataFrame, axis: str) -> DataFrame:
    return df.where((F.col(axis) >= 0) & (F.col(axis) < F.col("width" if axis == "x" else "height")))


def along(gray: DataFrame, axis: str, weights: list[float], border: str) -> DataFrame:
    """The weighted sum of 2k+1 pixels along an axis, into v."""
    k = len(weights) // 2
    w = rows() if axis == "x" else columns()
    terms = [F.lit(c) * F.lead("v", i - k).over(w) if i > k else F.lit(c) * F.lag("v", k - i).over(w) if i < k else F.lit(c) * F.col("v") for i, c in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return cropped(padded(gray, axis, k, border).withColumn("v", total), axis)


def separable(gray: DataFrame, across: list[float], down: list[float], border: str = "reflect") -> DataFrame:
    """across along rows, then down along columns. gray: with height and width."""
    return along(along(gray, "x", across, border), "y", down, border)


def around(gray: DataFrame, border: str = "replicate", name: str = "n") -> DataFrame:
    """The eight neighbours and the pixel itself as n0..n8, row by row. gray: with height and width."""
    df = padded(gray, "x", 1, border)
    df = cropped(df.withColumn("__l", F.lag("v").over(rows())).withColumn("__r", F.lead("v").over(rows())), "x")
    df = df.withColumn("v", F.struct(F.col("__l").alias("l"), F.col("v").alias("c"), F.col("__r").alias("r"))).drop("__l", "__r")
    edge = "replicate" if border == "zero" else border
    df = padded(df, "y", 1, edge)
    above, below = F.lag("v").over(columns()), F.lead("v").over(columns())
    df = cropped(df.withColumn("__a", above).withColumn("__b", below), "y")
    cells = {f"{name}{3 * i + j}": F.col(s)[p] for i, s in enumerate(("__a", "v", "__b")) for j, p in enumerate("lcr")}
    if border == "zero":
        top, bottom = F.col("y") == 0, F.col("y") == F.col("height") - 1
        cells = {c: F.when(top if int(c[len(name) :]) < 3 else bottom, 0).otherwise(e) if int(c[len(name) :]) // 3 != 1 else e for c, e in cells.items()}
    out = df.select("*", *(e.alias(c) for c, e in cells.items())).drop("__a", "__b")
    return out.withColumn("v", F.col("v")["c"])


def neighbours(gray: DataFrame, offsets: list[tuple], border: str = "reflect") -> DataFrame:
    """image_id, y, x, one row for each offset (dy, dx, ...) with the neighbour's value v and the offset's number k.
    gray: with height and width; scattered from the neighbour, so that no join is needed."""
    reach = max(max(abs(o[0]), abs(o[1])) for o in offsets)
    df = padded(padded(gray, "x", reach, border), "y", reach, border)
    to = F.array(*(F.struct((F.col("y") - o[0]).alias("y"), (F.col("x") - o[1]).alias("x"), F.lit(i).alias("k")) for i, o in enumerate(offsets)))
    df = df.select("image_id", "height", "width", "v", F.explode(to).alias("t")).select("image_id", "t.*", "height", "width", "v")
    return cropped(cropped(df, "x"), "y")


def patches(gray: DataFrame, r: int, border: str | None = "reflect") -> DataFrame:
    """gray with p: the pixels at most r rows and columns away, as an array of (dy, dx, u); without a border those inside the
    image alone. Two window frames collect them, so
    that no row is made for a pair of pixels and nothing is joined. gray: with height and width."""
    across = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-r, r)
    down = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-r, r)
    more = (lambda df, axis: padded(df, axis, r, border)) if border else (lambda df, axis: df)
    df = cropped(more(gray, "x").withColumn("__row", F.collect_list(F.struct("x", "v")).over(across)), "x")
    df = cropped(more(df, "y").withColumn("__rows", F.collect_list(F.struct("y", "__row")).over(down)), "y")
    cell = lambda a: lambda b: F.struct((a["y"] - F.col("y")).alias("dy"), (b["x"] - F.col("x")).alias("dx"), b["v"].alias("u"))
    return df.withColumn("p", F.flatten(F.transform("__rows", lambda a: F.transform(a["__row"], cell(a))))).drop("__row", "__rows")


def total(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out
