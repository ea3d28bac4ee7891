"""Operators over frames in time order, for streams and, with the same results, for recorded tables.

frames: camera, ts (TIMESTAMP), event_id (breaks ties of ts) and more. Streams drop rows later than the watermark from
windows and sessions; samplers take each batch's rows in the order of ts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenframe.streaming import inference

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def marked(frames: DataFrame, late: str = "10 seconds") -> DataFrame:
    return frames.withWatermark("ts", late) if frames.isStreaming else frames


def fps(frames: DataFrame, seconds: int = 2) -> DataFrame:
    """camera, start, fps: frames of each window of some seconds, per second."""
    w = marked(frames).groupBy("camera", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return w.select("camera", F.col("w.start").alias("start"), (F.col("n") / seconds).alias("fps"))


def throttle(frames: DataFrame, interval_us: int, busy: str | None = None) -> DataFrame:
    """camera, ts, event_id of the frames that are taken: the first, then each at least interval_us after the last taken
    and, with busy (a column of milliseconds), not before the last taken one was answered. interval_us <= 0 does not
    hold anything back. A greedy walk in time order over each camera's sorted frames, which keeps only the time until which
    they are held back; a camera's frames are sorted in one task, on disk if need be. Frames without a time are all taken and
    hold nothing back."""
    return _taken(_walked(_asking(frames, busy), interval_us).where("frame"))


def _taken(walked: DataFrame) -> DataFrame:
    return walked.select("camera", F.timestamp_micros("t").alias("ts"), "event_id")


def _asking(frames: DataFrame, busy: str | None) -> DataFrame:
    answered = F.coalesce((F.col(busy) * 1000).cast("long"), F.lit(0)) if busy else F.lit(0)
    return frames.select("camera", F.unix_micros("ts").alias("t"), F.col("event_id").cast("long").alias("event_id"), answered.cast("long").alias("b"), F.lit(True).alias("frame"))


def _walk_schema(camera: str) -> str:
    return f"camera {camera}, t long, event_id long, frame boolean"


def _walked(f: DataFrame, interval_us: int) -> DataFrame:
    """The frames taken, and for each camera a row that is no frame, with the time t until which it is held back at the end. Such
    rows in f say until when cameras are held back at the beginning."""
    least = max(0, interval_us)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        camera, until, seen, schema = None, None, False, None

        def given(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            schema = pa.schema([pa.field(n, batch.schema.field(n).type) for n in ("camera", "t", "event_id", "frame")])
            rows = []
            for own, t, event_id, b, frame in zip(*(batch.column(c).to_pylist() for c in ("camera", "t", "event_id", "b", "frame")), strict=True):
                if not seen or own != camera:
                    if seen:
                        rows.append((camera, until, None, False))
                    camera, until, seen = own, None, True
                if not frame:
                    until = t
                elif t is None or until is None or t >= until:
                    rows.append((camera, t, event_id, True))
                    until = until if t is None else t + max(least, b)
            yield given(rows)
        if seen:
            yield given([(camera, until, None, False)])

    order = f.repartition("camera").sortWithinPartitions("camera", "frame", "t", "event_id", "b")
    return order.mapInArrow(walk, _walk_schema(f.schema["camera"].dataType.simpleString()))


def throttle_log(stream: DataFrame, path: str, checkpoint: str, interval_us: int, busy: str | None = None):
    """throttle over a stream, into Parquet files below `path` that `throttled` reads. Each batch is sorted by camera and time, on
    disk if need be, and walked in pieces, so memory does not grow with what one camera sends in a batch (limits of the source,
    as maxFilesPerTrigger, bound the batch itself). The times until which cameras are held back lie beside each batch's frames: a
    batch that is run again begins with those of the batch before and replaces what it wrote, so each frame is there once. A
    batch without rows keeps them; frames of a batch that are older than those times are not taken."""

    def put(df: DataFrame, n: int) -> None:
        spark, schema = df.sparkSession, _walk_schema(df.schema["camera"].dataType.simpleString())
        if n:
            held = spark.read.schema(schema).parquet(f"{path}/batch={n - 1}").where("NOT frame")
            df = df.unionByName(held.select("camera", "t", "event_id", F.lit(0).cast("long").alias("b"), "frame"))
        _walked(df, interval_us).write.mode("overwrite").partitionBy("frame").parquet(f"{path}/batch={n}")
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n - 2}/frame=false")  # no batch reads it again
        done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)

    return _asking(stream, busy).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def throttled(spark: SparkSession, path: str, camera: str = "long") -> DataFrame:
    """camera, ts, event_id of the frames that throttle_log took; camera: the type of that column."""
    log = spark.read.schema(f"{_walk_schema(camera)}, batch long").parquet(path)
    return _taken(log.where("frame"))


class _Sampler(StatefulProcessor):
    def __init__(self, interval_us: int):
        self.interval_us = max(0, interval_us)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["t", "event_id"])
        until = self.until.get()[0] if self.until.exists() else None
        taken = []
        for t, event_id, answered in zip(pdf.t, pdf.event_id, pdf.b, strict=True):
            if until is None or t >= until:
                until = int(t + max(self.interval_us, answered))
                taken.append((int(t), event_id))
        if until is not None:
            self.until.update((until,))
        yield pd.DataFrame({"camera": [key[0]] * len(taken), "t": [t for t, _ in taken], "event_id": [e for _, e in taken]})

    def close(self) -> None:
        pass


def throttle_stream(frames: DataFrame, interval_us: int, busy: str | None = None) -> DataFrame:
    """throttle over a stream: the time until which a camera's frames are held back is kept as state (RocksDB)."""
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    answered = F.coalesce((F.col(busy) * 1000).cast("long"), F.lit(0)) if busy else F.lit(0)
    f = frames.select("camera", F.unix_micros("ts").alias("t"), F.col("event_id").cast("long").alias("event_id"), answered.cast("long").alias("b"))
    out = f.groupBy("camera").transformWithStateInPandas(_Sampler(interval_us), outputStructType="camera long, t long, event_id long", outputMode="Append", timeMode="None")
    return out.select("camera", F.timestamp_micros("t").alias("ts"), "event_id")


def sampler(frames: DataFrame, interval_us: int) -> DataFrame:
    """The metrics sampler: as throttle, but an interval of 0 takes nothing."""
    if interval_us <= 0:
        return frames.select("camera", "ts", "event_id").where("false")
    return (throttle_stream if frames.isStreaming else throttle)(frames, interval_us)


def latest(frames: DataFrame) -> DataFrame:
    """camera with its last result or error: an update of one clears the other. frames: result, error (one of them null)."""
    last = F.max_by(F.struct("ts", "result", "error"), F.struct("ts", "event_id"))
    return frames.where(F.col("result").isNotNull() | F.col("error").isNotNull()).groupBy("camera").agg(last.alias("l")).select("camera", "l.*")


def sessions(frames: DataFrame, gap: str) -> DataFrame:
    """camera, start, duration_s, frames, fps of recordings: frames less than gap apart."""
    s = marked(frames).groupBy("camera", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("frames"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    d = (F.unix_micros("b") - F.unix_micros("a")) / 1e6
    return s.select("camera", F.col("a").alias("start"), d.alias("duration_s"), "frames", F.when(d > 0, F.col("frames") / d).otherwise(0.0).alias("fps"))


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream's rows to Parquet files, each row once; a retry after an error goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def append_classifications(responses: DataFrame, path: str, checkpoint: str):
    """The classification log of a stream of responses (body, ts, total_ms, rtt_ms, maybe image_file) as CSV files with a header,
    each response once, also after a restart: Spark's file sink lists what a checkpointed batch has committed, and readers of
    the folder see that alone. Responses that lack a required key are not logged; `inference.classifications` has them."""
    good, _ = inference.classifications(responses)
    log = inference.log_rows(good)
    return log.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
