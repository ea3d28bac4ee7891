"""Image files, listings, feature and image sinks, capture collection plans."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one (spark.checkpoint.dir). Where that is unset, one under /tmp, but on a local master
    only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/lumenframe-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tiff", "tif")


def listing(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, case_insensitive: bool = True, recursive: bool = False) -> DataFrame:
    """path, length, modificationTime, sorted and each once; contents are not read. Case-insensitive matches extensions
    all in lower or all in upper case."""
    ends = [e.lower().lstrip(".") for e in extensions]
    ends += [e.upper() for e in ends] if case_insensitive else []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length", "modificationTime")
    return files.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(ends)).dropDuplicates(["path"]).orderBy("path")


def images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Decoded images (origin, height, width, channels, data) and the quarantine: origin of those that could not be."""
    raw = spark.read.format("image").load(path).select("image.*")
    good = raw.where("height > 0").select("origin", "height", "width", F.col("nChannels").alias("channels"), "data")
    return good, raw.where("height < 0").select("origin")


def pixels(good: DataFrame) -> DataFrame:
    """image_id (a hash of origin), origin, y, x, b, g, r. Rows are cut off the bytes first (a character a byte, in Latin-1), then
    pixels off the rows."""
    df = good.withColumn("image_id", F.xxhash64("origin"))
    row = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.decode(F.substring("data", y * F.col("width") * F.col("channels") + 1, F.col("width") * F.col("channels")), "ISO-8859-1"))
    df = df.select("image_id", "origin", "channels", "width", F.posexplode(row).alias("y", "row")).withColumn("c", F.split("row", ""))
    byte = lambda x, k: F.ascii(F.get("c", x * F.col("channels") + F.least(F.lit(k), F.col("channels") - 1)))
    cell = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda x: F.struct(x.alias("x"), *(byte(x, k).alias(n) for k, n in enumerate("bgr"))))
    return df.select("image_id", "origin", "y", F.explode(cell).alias("p")).select("image_id", "origin", "y", "p.x", "p.b", "p.g", "p.r")


PACKED = "height int, width int, channels int, data binary"


def packed(df: DataFrame) -> DataFrame:
    """image_id, height, width, channels, data: the pixels (v, or b, g, r) of each image as the bytes that `pixels` reads, row by
    row. Pixels that are missing are 0; values must be bytes. Each image is put together in the task of its group."""
    values = ["v"] if "v" in df.columns else ["b", "g", "r"]
    kind = df.schema["image_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        out = np.zeros((int(y.max()) + 1, int(x.max()) + 1, len(values)), np.uint8)
        for k, c in enumerate(values):
            v = table[c].to_numpy()
            if len(v) and (v.min() < 0 or v.max() > 255):
                raise ValueError(f"{c} of image {table['image_id'][0]} is no byte")
            out[y, x, k] = v
        h, w, n = out.shape
        return pa.table({"image_id": table["image_id"][:1]} | {c: pa.array([v], pa.int32()) for c, v in (("height", h), ("width", w), ("channels", n))} | {"data": pa.array([out.tobytes()], pa.binary())})

    cells = df.select("image_id", *(F.col(c).cast("int").alias(c) for c in ("y", "x", *values)))
    return cells.groupBy("image_id").applyInArrow(run, f"image_id {kind}, {PACKED}")


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A PNG file of gray (1 channel) or blue-green-red pixels (3)."""
    rows = np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, ::-1].reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()  # filter 0 before each row
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_images(df: DataFrame, path: str, name: str = "image_id") -> DataFrame:
    """Writes each image as path/{name}.png and returns image_id, path of what was written. df: pixels, with the column `name`.

    Tasks write by pyarrow's file systems (local and shared folders, HDFS, object stores), each file under a name of its own
    that is moved to the last one when it is whole, so that lost tasks leave no half a file."""
    files_ = packed(df) if name == "image_id" else packed(df).join(df.select("image_id", F.col(name).cast("string").alias("__name")).distinct(), "image_id")
    label = F.col("image_id").cast("string") if name == "image_id" else F.col("__name")
    kind = df.schema["image_id"].dataType.simpleString()
    uri = path if "://" in path else f"file://{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        system.create_dir(base, recursive=True)
        for batch in batches:
            written = []
            for r in batch.to_pylist():
                at = f"{base}/{r['label']}.png"
                part = f"{base}/_{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(png(r["height"], r["width"], r["channels"], r["data"]))
                system.move(part, at)
                written.append(f"{path.rstrip('/')}/{r['label']}.png")
            yield pa.RecordBatch.from_arrays([batch["image_id"], pa.array(written)], names=["image_id", "path"])

    spark = df.sparkSession
    done = files_.select("image_id", "height", "width", "channels", "data", label.alias("label")).mapInArrow(run, f"image_id {kind}, path string")
    log = shared_path(spark, "images-written")
    done.write.parquet(log)
    return spark.read.schema(done.schema).parquet(log)


def write_features(wide: DataFrame, path: str, output_format: str = "csv", separator: str = ",", enable_long_format: bool = False, config: dict | None = None) -> None:
    """`csv`: the wide table (and the long one beside it, if asked); `long_csv`: the long one alone. Empty tables leave no
    rows. config: kept as a manifest beside the features."""
    from lumenframe.operators import features

    write = lambda df, to: df.write.mode("overwrite").option("header", True).option("sep", separator).csv(to)
    if output_format not in ("csv", "long_csv"):
        raise ValueError(f"output_format {output_format!r}")
    if output_format == "csv":
        write(features.ordered(wide), f"{path}/features")
    if output_format == "long_csv" or enable_long_format:
        write(features.to_long(wide), f"{path}/features_long")
    if config is not None:
        write_manifest(wide.sparkSession, f"{path}/manifest", "features", config)


def write_stages(stages: dict[str, DataFrame], path: str, save_original: DataFrame | None = None, as_images: bool = False) -> None:
    """Each stage's pixels in a folder of their own; the input as stage `original` if given. as_images: PNG files instead of
    tables of pixels."""
    every = {**({"original": save_original} if save_original is not None else {}), **stages}
    for name, df in every.items():
        if as_images:
            write_images(df, f"{path}/stage={name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/stage={name}")


def write_manifest(spark: SparkSession, path: str, profile: str, config: dict) -> None:
    row = spark.createDataFrame([(profile, json.dumps(config, sort_keys=True))], "profile string, config string")
    row.withColumn("created", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(path)


def next_run(existing: DataFrame, date: str) -> int:
    """The next number of folders {date}_{n} among the last parts of existing paths; other dates and names don't count."""
    n = existing.select(F.regexp_extract(F.element_at(F.split("path", "/"), -1), rf"^{date}_(\d+)$", 1).alias("n")).where("n <> ''")
    return (n.agg(F.max(F.col("n").cast("int"))).first()[0] or 0) + 1


def captures(files: DataFrame) -> DataFrame:
    """path, date, type, name of files exactly two folders below the base: base/<date>/<type>/<file>. files: path, base."""
    parts = F.split(F.expr("substring(path, length(base) + 2)"), "/")
    return files.where(F.expr("startswith(path, concat(base, '/'))")).withColumn("p", parts).where(F.size("p") == 3).select("path", *(F.col("p")[k].alias(n) for k, n in enumerate(("date", "type", "name"))))


def collect_plan(found: DataFrame, operation: str = "copy") -> DataFrame:
    """path, type, destination (type/name, with _1, _2, ... before the extension for names that are taken), delete_source.
    A suffixed name that exists itself is passed over until every destination is its own."""
    if operation not in ("copy", "move"):
        raise ValueError(f"operation {operation!r}")
    df = found.dropDuplicates(["path"]).select("path", "type", F.regexp_replace("name", r"(?<=.)\.[^.]*$", "").alias("s"), F.regexp_extract("name", r"(?<=.)\.[^.]*$", 0).alias("e"), "name")
    k = F.row_number().over(Window.partitionBy("type", "name").orderBy("path")) - 1
    df = df.withColumn("k", k)
    # numbers of suffixes already used by real names of the same stem and extension
    used = df.select("type", F.regexp_extract("s", r"^(.*)_\d+$", 1).alias("s"), "e", F.regexp_extract("s", r"_(\d+)$", 1).alias("u")).where("u <> ''")
    used = used.groupBy("type", "s", "e").agg(F.collect_set(F.col("u").cast("int")).alias("used"))
    df = df.join(used, ["type", "s", "e"], "left")
    used = F.coalesce("used", F.array().cast("array<int>"))
    free = F.filter(F.sequence(F.lit(1), F.col("k") + F.size(used) + 1), lambda n: ~F.array_contains(used, n))
    new = F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat("s", F.lit("_"), F.element_at(free, F.greatest(F.col("k"), F.lit(1))), "e"))
    return df.select("path", "type", F.concat_ws("/", "type", new).alias("destination"), F.lit(operation == "move").alias("delete_source"))
