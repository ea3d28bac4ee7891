"""Pixel relations made from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _value(x):
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.5) * 256))).cast("int")


def gray_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v, class: each embedding as an 8x8 image."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("class"), F.posexplode("embedding").alias("i", "e"))
    return e.select("image_id", F.expr("CAST(i DIV 8 AS INT)").alias("y"), F.expr("i % 8").alias("x"), _value(F.col("e")).alias("v"), "class")


def whole_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gray_tile with a row for each image: image_id, height, width, cells."""
    e = table(spark, sf_dir, "embeddings").where("size(embedding) > 0")
    rest = F.expr("array_repeat(0, CAST(pmod(-size(embedding), least(8, size(embedding))) AS INT))")
    cells = F.concat(F.transform("embedding", _value), rest)
    return e.select(F.col("vec_id").alias("image_id"), F.expr("CAST((size(embedding) + 7) DIV 8 AS INT)").alias("height"), F.expr("least(8, size(embedding))").alias("width"), cells.alias("cells"))


def _filled(df: DataFrame, cells: int, values: list[str]) -> DataFrame:
    """image_id, i and values with a row for every i below cells of every image: what is missing is 0. The cells are merged, not
    broadcast: Spark takes them for as few as the images, and may where a filter for values that are not 0 makes the join an inner one."""
    whole = df.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("i")).hint("merge")
    return whole.join(df, ["image_id", "i"], "left").select("image_id", "i", *(F.coalesce(c, F.lit(0)).alias(c) for c in values))


def gray_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v: 64 embeddings are the rows of a 64x64 image; rows that are missing are 0."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id DIV 64").alias("image_id"), F.expr("CAST(vec_id % 64 AS INT)").alias("y"), F.posexplode("embedding").alias("x", "e"))
    full = _filled(e.select("image_id", (F.col("y") * 64 + F.col("x")).alias("i"), _value(F.col("e")).alias("v")), 4096, ["v"])
    return full.select("image_id", F.expr("CAST(i DIV 64 AS INT)").alias("y"), F.expr("i % 64").alias("x"), "v")


def bgr_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, b, g, r: orders as 32x32 colour images; orders that are missing are black."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("p"))
    o = o.withColumn("image_id", F.expr("o_orderkey DIV 1024")).withColumn("i", F.expr("CAST(o_orderkey % 1024 AS INT)"))
    o = o.select("image_id", "i", *(F.expr(e).cast("int").alias(n) for e, n in (("o_custkey % 256", "b"), ("(p DIV 256) % 256", "g"), ("p % 256", "r"))))
    return _filled(o, 1024, ["b", "g", "r"]).select("image_id", F.expr("CAST(i DIV 32 AS INT)").alias("y"), F.expr("i % 32").alias("x"), "b", "g", "r")


def gray_docs(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """image_id, y, x, v: the UTF-8 bytes of each document as rows of 64 pixels; the last row may be shorter. Rows are cut
    off the bytes first, then pixels off the rows (one character a byte in Latin-1)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.encode("text", "UTF-8").alias("t")).where(F.length("t") > 0)
    rows = F.sequence(F.lit(0), F.expr(f"CAST((length(t) - 1) DIV {width} AS INT)"))
    cut = F.transform(rows, lambda y: F.decode(F.substring("t", y * width + 1, F.lit(width)), "ISO-8859-1"))
    d = d.select("image_id", F.posexplode_outer(cut).alias("y", "row"))
    return d.select("image_id", "y", F.posexplode_outer(F.split("row", "")).alias("x", "c")).select("image_id", "y", "x", F.ascii("c").alias("v"))


def byte_counts(docs: DataFrame) -> DataFrame:
    """v, n: how often each byte occurs in all texts of the column text. Each text's characters are counted in place, as
    64 KB pieces of Latin-1, so that counts and not bytes are shuffled."""
    t = docs.select(F.encode("text", "UTF-8").alias("t")).where(F.length("t") > 0)
    rows = F.sequence(F.lit(0), F.expr("CAST((length(t) - 1) DIV 65536 AS INT)"))
    piece = t.select(F.explode_outer(F.transform(rows, lambda y: F.decode(F.substring("t", y * 65536 + 1, F.lit(65536)), "ISO-8859-1"))).alias("s"))
    return piece.select(F.explode_outer(F.split("s", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).select(F.ascii("c").alias("v"), "n")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """camera, ts, event_id, total_ms, class_name, class_id, confidence: events as frames with a classification."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("user_id").alias("camera"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("total_ms"), F.col("event_type").alias("class_name"), k.alias("class_id"), (k / 100.0).alias("confidence"))


def dims(gray: DataFrame) -> DataFrame:
    """image_id, height, width."""
    return gray.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
