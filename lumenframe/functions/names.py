"""File names: capture counters, classes, time stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def capture_names(captures: DataFrame, interval: int = 1, extension: str = "png") -> DataFrame:
    """Adds n (the capture's number of its camera and prefix, in time order, from 1), id ((n - 1) div interval + 1) and
    name. captures: camera, prefix, ts, label (null: NA_NA), and anything that breaks ties of ts in `event_id`."""
    if interval < 1:
        raise ValueError("interval is at least 1")
    order = [F.col("ts"), *([F.col("event_id")] if "event_id" in captures.columns else [])]
    df = captures.withColumn("n", F.row_number().over(Window.partitionBy("camera", "prefix").orderBy(*order)))
    df = df.withColumn("id", F.expr(f"CAST((n - 1) DIV {int(interval)} + 1 AS INT)"))
    parts = (F.col("prefix"), F.date_format("ts", "yyyyMMddHHmmss"), F.coalesce("label", F.lit("NA_NA")), F.concat(F.lit("id"), F.col("id")), F.concat(F.lit("image"), F.col("n")))
    return df.withColumn("name", F.concat(F.concat_ws("_", *parts), F.lit(f".{extension}")))


def stem(path: Column | str) -> Column:
    """The file's name without folders and without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def class_from_name(name: Column, delimiter: str, position: int) -> Column:
    """The part of the stem at a position, counted from the end if negative; '' where there is none."""
    return F.split_part(stem(name), F.lit(delimiter), F.lit(position + 1 if position >= 0 else position))


def stamp(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
