"""Names, feature tables, files, recorded results, streams."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import names
from lumenframe.operators import features
from lumenframe.plans import pipeline
from lumenframe.sources import files
from lumenframe.streaming import inference, streams


def test_capture_ids(spark):
    t = dt.datetime(2024, 1, 2, 3, 4, 5)
    rows = [(0, "p", t + dt.timedelta(seconds=i), None) for i in range(7)]
    out = names.capture_names(spark.createDataFrame(rows, "camera int, prefix string, ts timestamp, label string"), 3).orderBy("n").collect()
    assert [r["id"] for r in out] == [1, 1, 1, 2, 2, 2, 3]
    assert out[0]["name"] == "p_20240102030405_NA_NA_id1_image1.png"
    with pytest.raises(ValueError):
        names.capture_names(spark.createDataFrame(rows, "camera int, prefix string, ts timestamp, label string"), 0)


def test_class_from_name(spark):
    df = spark.createDataFrame([("a/b/x_cat_1.png",), ("nodelim.png",)], "n string")
    pick = lambda p: [r[0] for r in df.select(names.class_from_name(F.col("n"), "_", p)).collect()]
    assert pick(1) == ["cat", ""] and pick(-1) == ["1", "nodelim"] and pick(0) == ["x", "nodelim"] and pick(-9) == ["", ""]


def test_wide_and_long(spark):
    wide = spark.createDataFrame([("a", "c1", 1.0, 2.0), ("b", "c2", 3.0, None)], "filename string, class string, z double, k double")
    long = features.to_long(wide)
    assert long.columns == ["filename", "class", "feature_name", "feature_value"] and long.count() == 4
    assert sorted(map(tuple, features.to_wide(long, ["k", "z"]).collect())) == [("a", "c1", 2.0, 1.0), ("b", "c2", None, 3.0)]
    assert features.label("rgb", "red_mean") == "rgb_red_mean[intensity]" and features.unit_of("rgb", "x") == "unknown"
    with pytest.raises(ValueError):
        features.select_extractors([], ["x"], ["brightness"])


def test_collect_plan_avoids_names_that_exist(spark):
    rows = [(f"b/{d}/t/{n}", "b") for d, n in (("1", "a.png"), ("2", "a.png"), ("3", "a.png"), ("1", "a_1.png"))] + [("b/1/t/x/deep.png", "b"), ("b/1/t/a", "b")]
    plan = files.collect_plan(files.captures(spark.createDataFrame(rows, "path string, base string")), "move").collect()
    assert sorted(r["destination"] for r in plan) == ["t/a", "t/a.png", "t/a_1.png", "t/a_2.png", "t/a_3.png"] and all(r["delete_source"] for r in plan)


def test_listing_features_and_next_run(spark, tmp_path):
    for n in ("b.PNG", "a.png", "c.Png", "d.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r["path"].rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path)).collect()] == ["a.png", "b.PNG"]
    wide = spark.createDataFrame([("a", 1.0)], "filename string, f double")
    files.write_features(wide, f"{tmp_path}/out", enable_long_format=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/features_long").first()["feature_name"] == "f"
    runs = spark.createDataFrame([("w/20240101_2",), ("w/20240101_10",), ("w/20240102_99",), ("w/20240101_x",)], "path string")
    assert files.next_run(runs, "20240101") == 11 and files.next_run(runs.limit(0), "20240101") == 1


def test_png_scan(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes([10 * x, 20 * y, 7]) if x == 0 else bytes([10 * x, 20 * y, 7]) for y in range(2) for x in range(3))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "bad.png").write_bytes(b"no image")
    good, bad = files.images(spark, str(tmp_path))
    assert bad.count() == 1
    px = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in files.pixels(good).collect()}
    assert px[1, 2] == (20, 20, 7) and len(px) == 6


def test_responses(spark):
    ok = {"detections": [{"class_id": 1, "class_name": "a", "confidence": 0.8, "bbox": [0, 0, 5, 5]}, {"class_id": 9, "class_name": "b", "confidence": 0.3, "bbox": [9, 9, 1, 1]}], "e2e_time_ms": 1.0, "phase_times_ms": {"pipeline_inference_ms": 2.0}}
    short = {"detections": [{"class_id": 1, "class_name": "a", "confidence": 0.8, "bbox": [0, 0, 5]}], "e2e_time_ms": 1.0}
    df = spark.createDataFrame([(1, json.dumps(ok)), (2, json.dumps(short)), (3, "{"), (4, json.dumps({"detections": [], "e2e_time_ms": 2.0}))], "id int, body string")
    good, bad = inference.detections(df)
    assert sorted(r["id"] for r in bad.collect()) == [2, 3]
    assert inference.valid_boxes(inference.boxes(good), 100, 100).count() == 1
    assert {r["id"]: r["phase_pipeline_inference_ms"] for r in inference.phases(good).collect()} == {1: 2.0, 4: None}
    assert [len(r["detections"]) for r in inference.above(good).orderBy("id").collect()] == [1, 0]


def _walk(rows, interval, busy=False):
    out, until = [], {}
    for c, t, e, b in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if c not in until or t >= until[c]:
            out.append((c, e))
            until[c] = t + dt.timedelta(milliseconds=max(interval, b if busy else 0))
    return sorted(out)


def _frames():
    t = dt.datetime(2024, 1, 1)
    return [(i % 3, t + dt.timedelta(milliseconds=(i * i * 37) % 5000), i, float((i * 13) % 400)) for i in range(200)]


@pytest.mark.parametrize("busy", [False, True])
def test_throttle_equals_a_walk(spark, busy):
    rows = _frames()
    df = spark.createDataFrame(rows, "camera long, ts timestamp, event_id long, total_ms double")
    got = sorted((r["camera"], r["event_id"]) for r in streams.throttle(df, 200_000, "total_ms" if busy else None).collect())
    assert got == _walk(rows, 200, busy)
    assert streams.sampler(df, 0).count() == 0 and streams.throttle(df, 0).count() == 200


def test_throttle_stream_keeps_state_between_batches(spark, tmp_path):
    rows = sorted(_frames(), key=lambda r: r[1])
    schema = "camera long, ts timestamp, event_id long, total_ms double"
    for k in range(2):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streams.append_log(streams.throttle_stream(source, 200_000), f"{tmp_path}/out", f"{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["camera"], r["event_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == _walk(rows, 200)


def test_throttle_log_keeps_state_between_batches_and_replaces_what_is_run_again(spark, tmp_path):
    rows = sorted(_frames(), key=lambda r: r[1])
    schema = "camera long, ts timestamp, event_id long, total_ms double"

    def feed(some):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        streams.throttle_log(source, f"{tmp_path}/out", f"{tmp_path}/log", 100_000, "total_ms").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["camera"], r["event_id"]) for r in streams.throttled(spark, f"{tmp_path}/out").collect())

    for k in range(3):
        feed(rows[k * 40 : k * 40 + 40])
    assert run() == _walk(rows[:120], 100, True) == run()
    last = max(tmp_path.glob("log/commits/[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the driver had been lost before the last batch was noted
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == _walk(rows[:120], 100, True)
    feed([])
    feed(rows[120:])
    assert run() == _walk(rows, 100, True)
    assert len(list(tmp_path.glob("out/batch=*/frame=false"))) == 2  # older times are deleted


def test_one_camera_of_many_frames_in_a_stream(spark, tmp_path):
    f = spark.range(1_000_000).select(F.lit("c").alias("camera"), F.timestamp_micros((F.col("id") * 7919) % 1_000_003).alias("ts"), F.col("id").alias("event_id"))
    f.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(f.schema).parquet(f"{tmp_path}/in")
    streams.throttle_log(source, f"{tmp_path}/out", f"{tmp_path}/log", 1000).trigger(availableNow=True).start().awaitTermination()
    got = streams.throttled(spark, f"{tmp_path}/out", "string")
    want = streams.throttle(f, 1000)
    assert want.count() > 900 and want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_entry_imports_and_names_are_unique():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "brightness_stats" in e.queries()


def test_throttle_walks_in_batches(spark):
    f = spark.range(3000).select((F.col("id") % 3 == 0).cast("long").alias("camera"), F.timestamp_micros(F.col("id") * 7 % 3000).alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 5 / 1000.0).alias("ms"))
    f = f.withColumn("camera", F.when(F.col("event_id") % 11 != 0, F.col("camera")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = streams.throttle(f, 3, "ms")
        got = {(r["camera"], r["event_id"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, until = set(), {}
    for i in sorted(range(3000), key=lambda i: (i * 7 % 3000, i)):
        c, t = None if i % 11 == 0 else int(i % 3 == 0), i * 7 % 3000
        if t >= until.get(c, t):
            want.add((c, i))
            until[c] = t + max(3, int(i % 5 / 1000.0 * 1000))
    assert got == want
    assert "collect_list" not in out._jdf.queryExecution().toString()  # no array of a whole camera


def test_units_of_features_with_parameters():
    want = {("glcm", "contrast_1_0"): "intensity_squared", ("glcm", "ASM_2_45"): "ratio", ("swt", "L2_energy_ll"): "coefficient_squared", ("swt", "energy_ratio_h"): "ratio", ("swt", "L1_total_energy"): "coefficient_squared", ("swt", "std_hh"): "coefficient", ("fft", "band_1_0.00_0.10"): "ratio", ("fft", "band_1_0.00_0.10_entropy"): "normalized", ("fft", "num_peaks"): "count", ("hlac", "hlac_feature_07"): "correlation_coefficient", ("fft", "other"): "unknown", ("none", "mean"): "unknown"}
    assert {k: features.unit_of(*k) for k in want} == want


def test_wide_features_read_and_deal_images_once(spark):
    gray = spark.range(3).selectExpr("id AS image_id", "explode(sequence(0, 63)) AS i").selectExpr("image_id", "CAST(i DIV 8 AS INT) AS y", "CAST(i % 8 AS INT) AS x", "CAST((i * 37 + image_id * 11) % 256 AS INT) AS v")
    meta = spark.range(3).selectExpr("id AS image_id", "concat('f', id) AS filename")
    wide = pipeline.extract(gray, meta, ["brightness", "lbp", "fft", "glcm", "swt"])
    assert "fft_band_1_0.00_0.10_entropy[normalized]" in wide.columns and not [c for c in wide.columns if c.endswith("[unknown]")]
    assert wide.count() == 3
    wide.collect()
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") >= 5  # every extractor reads the kept images, which are dealt by image_id already


def test_images_round_trip(spark, tmp_path):
    """scan -> operator -> sink -> scan, byte by byte, in gray and in colour."""
    rng = np.random.default_rng(5)
    shapes = {1: (5, 7), 2: (1, 1), 3: (33, 20)}
    colour = {i: rng.integers(0, 256, (*s, 3)) for i, s in shapes.items()}
    rows = [(i, y, x, *(int(v) for v in colour[i][y, x])) for i, s in shapes.items() for y in range(s[0]) for x in range(s[1])]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, b int, g int, r int").repartition(3)
    done = files.write_images(px, f"{tmp_path}/in")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in done.collect()) == ["1.png", "2.png", "3.png"]
    good, bad = files.images(spark, f"{tmp_path}/in")
    assert bad.count() == 0 and good.count() == 3
    scanned = files.pixels(good).withColumn("name", F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("long"))
    back = {(r["name"], r["y"], r["x"]): (r["b"], r["g"], r["r"]) for r in scanned.collect()}
    assert back == {(i, y, x): (b, g, r) for i, y, x, b, g, r in rows}
    inverted = scanned.select(F.col("name").alias("image_id"), "y", "x", (255 - F.col("g")).alias("v"), F.concat(F.lit("n"), F.col("name")).alias("file"))
    files.write_images(inverted, f"{tmp_path}/out", "file")
    again, _ = files.images(spark, f"{tmp_path}/out")
    gray = files.pixels(again).withColumn("name", F.regexp_extract("origin", r"n(\d+)\.png$", 1).cast("long")).collect()
    assert {(r["name"], r["y"], r["x"]): (r["b"], r["g"], r["r"]) for r in gray} == {(i, y, x): (255 - g,) * 3 for i, y, x, b, g, r in rows}
    whole = {r["image_id"]: r for r in files.packed(px).collect()}
    assert all(bytes(whole[i]["data"]) == colour[i].astype("uint8").tobytes() and (whole[i]["height"], whole[i]["width"], whole[i]["channels"]) == (*shapes[i], 3) for i in shapes)
    files.write_stages({"a": inverted.select("image_id", "y", "x", "v")}, f"{tmp_path}/stages", as_images=True)
    assert files.images(spark, f"{tmp_path}/stages/stage=a")[0].count() == 3


def test_the_classification_log_survives_a_restart(spark, tmp_path):
    schema = "ts timestamp, total_ms double, rtt_ms double, image_file string, body string"
    answer = {"class_id": 1, "class_name": "a", "confidence": 0.5, "probabilities": [0.5], "e2e_time_ms": 3.0, "backend": "cpu", "phase_times_ms": {"pipeline_inference_ms": 2.0}}

    def feed(name, ids):
        lines = [json.dumps({"ts": f"2024-01-01T00:00:{i:02d}.000123Z", "total_ms": 5.0 + i, "rtt_ms": 4.0, "body": json.dumps(answer | {"class_id": i}) if i % 4 else "{}"} | ({"image_file": f"{i}.png"} if i % 2 else {})) for i in ids]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(lines))

    def run():
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        streams.append_classifications(stream, f"{tmp_path}/log", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    feed("a.json", range(10))
    run()
    run()  # nothing new
    feed("b.json", range(10, 17))
    run()
    log = spark.read.option("header", True).csv(f"{tmp_path}/log")
    assert log.columns == list(inference.LOG) and len(log.columns) == 18
    rows = sorted(log.collect(), key=lambda r: int(r["class_id"]))
    assert [int(r["class_id"]) for r in rows] == [i for i in range(17) if i % 4]
    assert rows[0]["timestamp"] == "2024-01-01 00:00:01.000123" and rows[0]["phase_inference_ms"] == "2.0" and rows[0]["phase_preprocess_ms"] is None
    assert [r["image_file"] or "" for r in rows] == [f"{i}.png" if i % 2 else "" for i in range(17) if i % 4]


def test_boxes_and_masks_of_their_own(spark):
    from lumenframe.operators import geometry

    px = spark.createDataFrame([(i, y, x, 10 * y + x, i % 3) for i in range(4) for y in range(6) for x in range(8)], "image_id long, y int, x int, v int, camera int")
    boxes = spark.createDataFrame([(0, 1, 2, 3, 4), (0, 5, 0, 1, 1), (1, 2, 0, None, 3), (None, 0, 0, 1, 1)], "camera int, x int, y int, w int, h int")
    for most in (100_000, 0):
        out = geometry.roi_by_table(px, boxes, most_broadcast=most)
        got = {(r["image_id"], r["y"], r["x"]): r["v"] for r in out.collect()}
        assert out.columns == px.columns
        assert {k[1:]: v for k, v in got.items() if k[0] == 3} == {(y, x): 10 * (y + 2) + x + 1 for y in range(4) for x in range(3)}
        assert sum(k[0] == 1 for k in got) == sum(k[0] == 2 for k in got) == 48
    mask = spark.createDataFrame([(0, y, x, 255 * (x > 1)) for y in range(3) for x in range(4)] + [(1, y, x, 255) for y in range(6) for x in range(8)], "image_id long, y int, x int, v int")
    colour = px.select("image_id", "y", "x", F.col("v").alias("b"), F.lit(7).alias("g"), (F.col("v") * 2).alias("r"))
    got = {(r["image_id"], r["y"], r["x"]): (r["b"], r["g"], r["r"]) for r in geometry.mask_composition(colour, mask, resize_target=True).collect()}
    assert len(got) == 12 + 48 and got[0, 0, 0] == (0, 0, 0) and got[1, 5, 7] == (57, 7, 114)
    block = [10 * y + x for y in (2, 3) for x in (4, 5)]
    assert got[0, 1, 2] == (math.floor(sum(block) / 4 + 0.5), 7, math.floor(sum(block) / 2 + 0.5))


def test_the_configuration_lies_beside_the_features(spark, tmp_path):
    wide = spark.createDataFrame([("a", 1.0)], "filename string, f double")
    files.write_features(wide, f"{tmp_path}/out", "long_csv", config={"glcm": {"levels": 16}})
    row = spark.read.json(f"{tmp_path}/out/manifest").first()
    assert row["profile"] == "features" and json.loads(row["config"]) == {"glcm": {"levels": 16}}
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/features_long").first()["feature_value"] == "1.0"
