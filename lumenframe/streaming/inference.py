"""Recorded classification and detection responses as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_GPU = "gpu_clock_mhz INT, gpu_vram_used_mb INT, gpu_temperature_c INT"
CLASSIFICATION = f"class_id INT, class_name STRING, confidence DOUBLE, probabilities ARRAY<DOUBLE>, e2e_time_ms DOUBLE, backend STRING, phase_times_ms MAP<STRING, DOUBLE>, {_GPU}"
DETECTION = f"detections ARRAY<STRUCT<class_id: INT, class_name: STRING, confidence: DOUBLE, bbox: ARRAY<DOUBLE>>>, e2e_time_ms DOUBLE, backend STRING, phase_times_ms MAP<STRING, DOUBLE>, {_GPU}"
#: Phases that become columns (fixed values).
PHASES = ("api_base64_decode_ms", "api_image_decode_ms", "pipeline_preprocess_ms", "pipeline_inference_ms", "pipeline_postprocess_ms")


def _parsed(responses: DataFrame, schema: str, good: Column) -> tuple[DataFrame, DataFrame]:
    rest = [c for c in responses.columns if c != "body"]
    df = responses.select("*", F.explode(F.array(F.from_json("body", schema))).alias("r"))  # the generator keeps one parse
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok).select(*rest, "r.*"), df.where(~ok).select(*rest, "body")


def classifications(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """responses: body (JSON) and more. Parsed rows, and the quarantine of those that lack a required key."""
    r = F.col("r")
    return _parsed(responses, CLASSIFICATION, r["class_id"].isNotNull() & r["class_name"].isNotNull() & r["confidence"].isNotNull() & r["probabilities"].isNotNull() & r["e2e_time_ms"].isNotNull() & r["backend"].isNotNull())


def detections(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed rows with a bbox of four numbers in every detection, and the quarantine."""
    whole = F.forall(F.col("r.detections"), lambda d: d["class_id"].isNotNull() & d["class_name"].isNotNull() & d["confidence"].isNotNull() & (F.size(d["bbox"]) == 4) & F.forall(d["bbox"], lambda x: x.isNotNull()))
    return _parsed(responses, DETECTION, F.col("r.detections").isNotNull() & whole & F.col("r.e2e_time_ms").isNotNull())


def boxes(parsed: DataFrame) -> DataFrame:
    """One row for each detection; a response without any keeps one row of nulls."""
    rest = [c for c in parsed.columns if c != "detections"]
    df = parsed.select(*rest, F.explode_outer("detections").alias("d"))
    return df.select(*rest, "d.class_id", "d.class_name", "d.confidence", *(F.col("d.bbox")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))


def phases(df: DataFrame) -> DataFrame:
    """The phase map's known keys as columns phase_*, null where absent."""
    return df.select(*(c for c in df.columns if c != "phase_times_ms"), *(F.try_element_at("phase_times_ms", F.lit(p)).alias(f"phase_{p}") for p in PHASES))


def frame_rows(parsed: DataFrame, start: Column | None = None) -> DataFrame:
    """Adds num_detections and elapsed_s, seconds since the recording's (or the table's camera's) first frame."""
    if start is None:  # a row a camera: Spark broadcasts it while it is small
        least = parsed.groupBy("camera").agg(F.min("ts").alias("__first"))
        parsed = parsed.join(least, parsed["camera"].eqNullSafe(least["camera"])).drop(least["camera"])
    first = start if start is not None else F.col("__first")
    s = F.round(F.unix_micros("ts") / 1e6 - F.unix_micros(first) / 1e6, 3)
    return parsed.withColumn("num_detections", F.size("detections")).withColumn("elapsed_s", s).drop("__first")


def valid_boxes(b: DataFrame, width: Column | int, height: Column | int, scale: float = 1.0) -> DataFrame:
    """Boxes that are finite, not inverted and not wholly outside the frame; corners scaled and truncated."""
    w, h = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))
    corner = ("x1", "y1", "x2", "y2")
    finite = F.lit(True)
    for c in corner:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    inside = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (F.col("x2") > 0) & (F.col("y2") > 0) & (F.col("x1") < w) & (F.col("y1") < h)
    good = b.where(finite & inside)
    return good.select(*(c for c in good.columns if c not in corner), *((F.col(c) * scale).cast("int").alias(c) for c in corner))


def tier(confidence: Column | str) -> Column:
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c >= 0.7, "high").when(c >= 0.4, "medium").otherwise("low")


def palette_index(class_id: Column | str, size: int = 8) -> Column:
    return F.pmod(F.col(class_id) if isinstance(class_id, str) else class_id, F.lit(size))


def above(parsed: DataFrame, threshold: float = 0.5) -> DataFrame:
    return parsed.withColumn("detections", F.filter("detections", lambda d: d["confidence"] >= threshold))


def time_parts(df: DataFrame) -> DataFrame:
    """total contains rtt contains e2e: adds encode_ms and network_ms; rtt and total rounded to 3 places."""
    out = df.withColumn("rtt_ms", F.round("rtt_ms", 3)).withColumn("total_ms", F.round("total_ms", 3))
    return out.withColumn("encode_ms", F.col("total_ms") - F.col("rtt_ms")).withColumn("network_ms", F.col("rtt_ms") - F.col("e2e_time_ms"))


#: The columns of the classification log and where they come from (fixed names).
LOG = {
    "timestamp": None, "class_id": None, "class_name": None, "confidence": None, "total_ms": None, "e2e_time_ms": None, "rtt_ms": None, "backend": None,
    "api_preprocess_ms": "api_preprocess_ms", "phase_preprocess_ms": "pipeline_preprocess_ms", "phase_inference_ms": "pipeline_inference_ms", "phase_inference_gpu_ms": "pipeline_inference_gpu_ms",
    "phase_postprocess_ms": "pipeline_postprocess_ms", "api_postprocess_ms": "api_postprocess_ms", "gpu_clock_mhz": None, "gpu_vram_used_mb": None, "gpu_temperature_c": None, "image_file": None,
}


def log_rows(parsed: DataFrame) -> DataFrame:
    """The 18 columns of the classification log. parsed: classifications() with ts, total_ms, rtt_ms and, where a frame was saved,
    image_file; phases that a response lacks are null, an image_file that it lacks is empty."""
    made = {
        "timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "image_file": F.coalesce(F.col("image_file"), F.lit("")) if "image_file" in parsed.columns else F.lit(""),
    }
    phase = lambda p: F.try_element_at("phase_times_ms", F.lit(p))
    return parsed.select(*((phase(p) if p else made[c] if c in made else F.col(c)).alias(c) for c, p in LOG.items()))
