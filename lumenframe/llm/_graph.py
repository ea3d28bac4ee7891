"""Connected components of an edge table by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenframe.llm._shared import discard, written


def components(edges: DataFrame, name: str) -> DataFrame:
    """edges: a long, b long (direction, loops and repeats don't matter; rows with a null are dropped).
    Returns node, component (the smallest node of its component) for every node of an edge between two nodes."""
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = written(edges.where("a <> b").select(a, b).distinct(), name)
    state = None
    while True:
        count = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if count["n"] == 0 or (count["n"], count["s"]) == state:
            break
        state = (count["n"], count["s"])
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, written(small.union(least).distinct(), name)
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
