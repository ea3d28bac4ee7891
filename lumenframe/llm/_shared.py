"""What the operators of this subpackage share: the shared folder, partition counts and id columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's spark.checkpoint.dir. Where that is unset, one under /tmp, but on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/lumenframe-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table behind what written() returned, once nothing will read it again: a round whose next one is there."""
    spark, path = df.sparkSession, df._written
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: let Arrow batches hold fewer rows than Spark's default 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m: the split of learned and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, with dots and backticks in it or not."""
    return df["`" + name.replace("`", "``") + "`"]


def row_hash(rows: DataFrame, by: str, seed: int) -> Column:
    """63 bits of a hash of all columns but `by`."""
    return F.xxhash64(F.lit(seed), *(c for c in rows.columns if c != by)).bitwiseAND(F.lit((1 << 63) - 1))


def sampled(rows: DataFrame, groups: DataFrame, by: str, seed: int, size: str | None = None) -> DataFrame:
    """Rows of each group with the smallest hashes, equal rows once, as many as `groups` (by, n: about how many different rows
    the group has, by row_hash; most; most_bytes) allows: at most `most`, and with the text column `size` as many as stay
    within most_bytes one after the other, but for the first. A threshold of 63 bits leaves about eight times as many before
    anything is shuffled."""
    share = F.least(F.lit(1.0), 8.0 * F.col("most") / F.greatest(F.col("n"), F.lit(1)))
    some = rows.withColumn("__h", row_hash(rows, by, seed)).join(F.broadcast(groups), by).where(F.col("__h") <= share * float(1 << 63))
    some = some.select(*rows.columns, "__h", "most", "most_bytes").distinct()
    order = Window.partitionBy(by).orderBy("__h", *(c for c in rows.columns if c != by))
    some = some.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= F.col("most"))
    if size:
        some = some.withColumn("__b", F.sum(F.octet_length(size).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        some = some.where((F.col("__r") == 1) | (F.col("__b") <= F.col("most_bytes")))
    return some.select(*rows.columns)
