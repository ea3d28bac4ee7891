"""Queries on regions, feature tables, names, recorded results, streams and profiles; see queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import names
from lumenframe.operators import features, histogram, regions, statistics, texture
from lumenframe.operators.grid import by_image
from lumenframe.plans import pipeline, quality
from lumenframe.plans.queries import _CHECKSUM, _OTSU, BGR, MOSAIC, TILE, _checksum, _lbp_sql, _near, _replicate, _rounded, _sq, _stats_sql, query
from lumenframe.sources import files, tables
from lumenframe.streaming import inference, streams

# Regions


@query(
    "components",
    f"""WITH RECURSIVE {TILE}, px AS (SELECT image_id, y, x, y::BIGINT * 2147483648 + x AS id FROM tile WHERE v > 140),
reach AS (SELECT image_id, id, y, x, id AS root FROM px UNION SELECT q.image_id, q.id, q.y, q.x, r.root FROM reach r JOIN px q ON q.image_id = r.image_id AND abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1 WHERE r.root < q.id),
lb AS (SELECT image_id, id, any_value(y) AS y, any_value(x) AS x, min(root) AS region FROM reach GROUP BY ALL)
SELECT image_id, region, count(*) AS n_pixels, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM lb GROUP BY ALL""",
)
def components(spark, sf_dir):
    return regions.components(histogram.std_bin(by_image(tables.gray_tile(spark, sf_dir)), 140))


@query(
    "contour_areas",
    f"""WITH RECURSIVE {TILE}, px AS (SELECT image_id, y, x, y::BIGINT * 2147483648 + x AS id FROM tile WHERE v > 140),
reach AS (SELECT image_id, id, y, x, id AS root FROM px UNION SELECT q.image_id, q.id, q.y, q.x, r.root FROM reach r JOIN px q ON q.image_id = r.image_id AND abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1 WHERE r.root < q.id),
lb AS (SELECT image_id, id, any_value(y) AS y, any_value(x) AS x, min(root) AS region FROM reach GROUP BY ALL),
cell AS (SELECT image_id, region, y + dy AS y, x + dx AS x, count(*) AS n FROM lb, (VALUES (0, 0), (0, -1), (-1, 0), (-1, -1)) AS o(dy, dx) GROUP BY ALL)
SELECT image_id, region, sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0 END)::DOUBLE AS area FROM cell GROUP BY ALL""",
)
def contour_areas(spark, sf_dir):
    return regions.contours(histogram.std_bin(by_image(tables.gray_tile(spark, sf_dir)), 140), fill=False).select("image_id", "region", "area")


@query(
    "contour_lengths",
    f"""WITH RECURSIVE {TILE}, px AS (SELECT image_id, y, x, y::BIGINT * 2147483648 + x AS id FROM tile WHERE v > 140),
reach AS (SELECT image_id, id, y, x, id AS root FROM px UNION SELECT q.image_id, q.id, q.y, q.x, r.root FROM reach r JOIN px q ON q.image_id = r.image_id AND abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1 WHERE r.root < q.id),
lb AS (SELECT image_id, id, any_value(y) AS y, any_value(x) AS x, min(root) AS region FROM reach GROUP BY ALL),
cell AS (SELECT image_id, region, y + dy AS y, x + dx AS x, count(*) AS n, sum(bit)::INT AS m FROM lb, (VALUES (0, 0, 1), (0, -1, 2), (-1, 0, 4), (-1, -1, 8)) AS o(dy, dx, bit) GROUP BY ALL)
SELECT image_id, region, round(sum(CASE WHEN n = 3 THEN sqrt(2::DOUBLE) WHEN m IN (6, 9) THEN 2 * sqrt(2::DOUBLE) WHEN n = 2 THEN 1 ELSE 0 END), 6) AS perimeter FROM cell GROUP BY ALL""",
)
def contour_lengths(spark, sf_dir):
    """Lengths of all borders of each region, its holes' included."""
    found = regions.contours(histogram.std_bin(by_image(tables.gray_tile(spark, sf_dir)), 140), fill=False)
    return found.select("image_id", "region", F.round("perimeter", 6).alias("perimeter"))


def _region_sql(source: str, side: int, threshold: int = 140) -> str:
    """rl: runs (s: set or not) with their region; node: regions and holes with parent; anc: all around each, itself included."""
    return f"""rn AS (SELECT image_id, y, s, min(x) AS x0, max(x) AS x1, y::BIGINT * 2147483648 + min(x) AS run
  FROM (SELECT image_id, y, x, v > {threshold} AS s, x - row_number() OVER (PARTITION BY image_id, y, v > {threshold} ORDER BY x) AS g FROM {source}) GROUP BY image_id, y, s, g),
tc AS (SELECT a.image_id, a.run AS u, b.run AS w FROM rn a JOIN rn b ON a.image_id = b.image_id AND a.s = b.s AND abs(a.y - b.y) = 1 AND b.x0 <= a.x1 + a.s::INT AND b.x1 >= a.x0 - a.s::INT),
reach AS (SELECT image_id, run, run AS root FROM rn UNION SELECT t.image_id, t.w, r.root FROM reach r JOIN tc t ON t.image_id = r.image_id AND t.u = r.run WHERE r.root < t.w),
rl AS (SELECT rn.*, region FROM rn JOIN (SELECT image_id, run, min(root) AS region FROM reach GROUP BY ALL) USING (image_id, run)),
hl AS (SELECT image_id, region FROM rl WHERE NOT s GROUP BY ALL HAVING NOT bool_or(y IN (0, {side - 1}) OR x0 = 0 OR x1 = {side - 1})),
node AS (SELECT f.image_id, f.region, l.region AS parent, true AS is_hole FROM rl f JOIN hl USING (image_id, region) JOIN rl l ON l.image_id = f.image_id AND l.y = f.y AND l.x1 = f.x0 - 1 WHERE f.run = f.region
  UNION ALL SELECT f.image_id, f.region, l.region, false FROM rl f LEFT JOIN (SELECT * FROM rl JOIN hl USING (image_id, region)) l ON l.image_id = f.image_id AND l.y = f.y AND l.x1 = f.x0 - 1 WHERE f.run = f.region AND f.s),
anc AS (SELECT image_id, region, region AS over, 0 AS up FROM node UNION ALL SELECT a.image_id, a.region, n.parent, up + 1 FROM anc a JOIN node n ON n.image_id = a.image_id AND n.region = a.over WHERE n.parent IS NOT NULL)"""


@query(
    "contour_rank",
    f"""WITH RECURSIVE {TILE}, {_region_sql("tile", 8)},
top AS (SELECT image_id, region FROM node WHERE parent IS NULL), px AS (SELECT image_id, region, y, unnest(range(x0, x1 + 1))::INT AS x FROM rl),
full_ AS (SELECT image_id, over AS region, y, x FROM px JOIN anc USING (image_id, region) JOIN top ON top.image_id = px.image_id AND top.region = over),
cell AS (SELECT image_id, region, y + dy AS y, x + dx AS x, count(*) AS n FROM full_, (VALUES (0, 0), (0, -1), (-1, 0), (-1, -1)) AS o(dy, dx) GROUP BY ALL),
ar AS (SELECT image_id, region, sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0 END) AS area FROM cell GROUP BY ALL HAVING area >= 2),
best AS (SELECT image_id, region FROM ar QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, region) = 1)
SELECT image_id, {_CHECKSUM} FROM (SELECT t.image_id, t.y, t.x, CASE WHEN f.image_id IS NULL THEN 0 ELSE 255 END AS v FROM tile t LEFT JOIN (SELECT * FROM full_ JOIN best USING (image_id, region)) f USING (image_id, y, x)) GROUP BY image_id""",
)
def contour_rank(spark, sf_dir):
    return _checksum(regions.contour(histogram.std_bin(by_image(tables.gray_tile(spark, sf_dir)).drop("class"), 140), min_area=2))


@query("region_tree", f"WITH RECURSIVE {MOSAIC}, {_region_sql('mosaic', 64)} SELECT n.image_id, n.region, n.parent, n.is_hole, max(up)::INT AS level FROM node n JOIN anc USING (image_id, region) GROUP BY ALL")
def region_tree(spark, sf_dir):
    return regions.hierarchy(histogram.std_bin(by_image(tables.gray_mosaic(spark, sf_dir)), 140))


@query(
    "retrieval_modes",
    f"""WITH RECURSIVE {MOSAIC}, {_region_sql("mosaic", 64)}, few AS (SELECT 'list' AS mode, *, NULL::BIGINT AS p, 0 AS level FROM node UNION ALL SELECT 'external', *, NULL, 0 FROM node WHERE parent IS NULL
  UNION ALL SELECT 'ccomp', *, CASE WHEN is_hole THEN parent END, is_hole::INT FROM node) SELECT mode, image_id, region, p AS parent, is_hole, level FROM few""",
)
def retrieval_modes(spark, sf_dir):
    binary = histogram.std_bin(by_image(tables.gray_mosaic(spark, sf_dir)), 140)
    one, *more = (regions.hierarchy(binary, m).withColumn("mode", F.lit(m)) for m in ("list", "external", "ccomp"))
    return one.unionByName(more[0]).unionByName(more[1])


_TRACE = f"""WITH RECURSIVE {TILE}, {_region_sql("tile", 8)}, px AS (SELECT image_id, y, x FROM tile WHERE v > 140),
way(d, sy, sx, ty, tx) AS (VALUES (0, 0, 1, -1, 0), (1, 1, 0, 0, 1), (2, 0, -1, 1, 0), (3, -1, 0, 0, -1)),
edge AS (SELECT p.image_id, p.y, p.x, w.* FROM px p CROSS JOIN way w WHERE NOT EXISTS (SELECT 1 FROM px q WHERE q.image_id = p.image_id AND q.y = p.y + w.ty AND q.x = p.x + w.tx)),
nx AS (SELECT e.image_id, (e.y * 8 + e.x) * 4 + e.d AS id, CASE WHEN o.y IS NOT NULL THEN (o.y * 8 + o.x) * 4 + (e.d + 3) % 4 WHEN a.y IS NOT NULL THEN (a.y * 8 + a.x) * 4 + e.d ELSE (e.y * 8 + e.x) * 4 + (e.d + 1) % 4 END AS after
  FROM edge e LEFT JOIN px o ON o.image_id = e.image_id AND o.y = e.y + sy + ty AND o.x = e.x + sx + tx LEFT JOIN px a ON a.image_id = e.image_id AND a.y = e.y + sy AND a.x = e.x + sx),
lp AS (SELECT image_id, id AS root, id FROM nx UNION SELECT l.image_id, l.root, n.after FROM lp l JOIN nx n USING (image_id, id) WHERE l.root < n.after),
lo AS (SELECT image_id, id, min(root) AS root FROM lp GROUP BY ALL),
st AS (SELECT image_id, root, root % 4 <> 0 AS is_hole, min(id) FILTER (id % 4 = (root % 4 <> 0)::INT) AS start FROM lo GROUP BY ALL),
walk AS (SELECT image_id, root, is_hole, start AS id, start, 0 AS k FROM st UNION ALL SELECT w.image_id, root, is_hole, n.after, start, k + 1 FROM walk w JOIN nx n USING (image_id, id) WHERE n.after <> start),
kept AS (SELECT * FROM (SELECT *, id // 4 AS p, lag(id // 4) OVER (PARTITION BY image_id, root ORDER BY k) AS q FROM walk) WHERE q IS NULL OR p <> q),
numbered AS (SELECT *, row_number() OVER (PARTITION BY image_id, root ORDER BY k) - 1 AS j, count(*) OVER (PARTITION BY image_id, root) AS n FROM kept),
ring AS (SELECT *, count(*) OVER (PARTITION BY image_id, root) AS m FROM numbered WHERE j = 0 OR j < n - 1 OR p <> start // 4),
vx AS (SELECT image_id, root, is_hole, start, ((m - j) % m)::INT AS k, (p // 8)::INT AS y, (p % 8)::INT AS x, m FROM ring),
named AS (SELECT v.*, rl.region FROM vx v JOIN rl ON rl.image_id = v.image_id AND rl.y = start // 4 // 8 AND (start // 4) % 8 + v.is_hole::INT BETWEEN rl.x0 AND rl.x1 AND rl.s <> v.is_hole),
turn AS (SELECT a.*, a.m = 1 OR b.y - a.y <> a.y - c.y OR b.x - a.x <> a.x - c.x AS corner FROM named a JOIN named b ON b.image_id = a.image_id AND b.root = a.root AND b.k = (a.k + 1) % a.m JOIN named c ON c.image_id = a.image_id AND c.root = a.root AND c.k = (a.k + a.m - 1) % a.m)
SELECT 'none' AS method, image_id, region, is_hole, k, y, x FROM turn UNION ALL
SELECT 'simple', image_id, region, is_hole, (row_number() OVER (PARTITION BY image_id, root ORDER BY k) - 1)::INT, y, x FROM turn WHERE corner"""


@query("contour_trace", _TRACE)
def contour_trace(spark, sf_dir):
    binary = histogram.std_bin(by_image(tables.gray_tile(spark, sf_dir)), 140)
    every, few = (regions.trace(binary, approximation=m).withColumn("method", F.lit(m)) for m in ("none", "simple"))
    return every.unionByName(few)


def _sobel(axis: int) -> list[tuple]:
    return [(dy, dx, (dx, dy)[axis] * (2 if (dy, dx)[axis] == 0 else 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


@query(
    "canny",
    f"""WITH RECURSIVE {MOSAIC}, {_near("mosaic", _sobel(0), 64, _replicate)}, gx AS (SELECT image_id, y, x, sum(w * u)::INT AS gx FROM nb GROUP BY ALL),
{_near("mosaic", _sobel(1), 64, _replicate).replace("nb AS", "nc AS", 1)}, g AS (SELECT image_id, y, x, gx, sum(w * u)::INT AS gy FROM nc JOIN gx USING (image_id, y, x) GROUP BY ALL),
m AS (SELECT *, abs(gx) + abs(gy) AS m FROM g),
way AS (SELECT *, CASE WHEN abs(gy) < 0.41421356237309503::DOUBLE * abs(gx) THEN (0, 1) WHEN abs(gy) > 2.414213562373095::DOUBLE * abs(gx) THEN (1, 0) WHEN gx::BIGINT * gy < 0 THEN (1, -1) ELSE (1, 1) END AS o FROM m),
kind AS (SELECT a.image_id, a.y, a.x, CASE WHEN a.m <= coalesce(b.m, 0) OR a.m < coalesce(c.m, 0) THEN 0 WHEN a.m > 400 THEN 2 WHEN a.m > 200 THEN 1 ELSE 0 END AS k FROM way a
  LEFT JOIN m b ON b.image_id = a.image_id AND b.y = a.y - a.o[1] AND b.x = a.x - a.o[2] LEFT JOIN m c ON c.image_id = a.image_id AND c.y = a.y + a.o[1] AND c.x = a.x + a.o[2]),
e AS (SELECT image_id, y, x FROM kind WHERE k = 2 UNION SELECT q.image_id, q.y, q.x FROM e JOIN kind q ON q.image_id = e.image_id AND abs(q.y - e.y) <= 1 AND abs(q.x - e.x) <= 1 AND q.k > 0)
SELECT image_id, {_CHECKSUM} FROM (SELECT k.image_id, k.y, k.x, CASE WHEN e.image_id IS NULL THEN 0 ELSE 255 END AS v FROM kind k LEFT JOIN e USING (image_id, y, x)) GROUP BY image_id""",
)
def canny(spark, sf_dir):
    return _checksum(regions.canny(by_image(tables.gray_mosaic(spark, sf_dir)), 200, 400))


@query("circle_features")
def circle_features(spark, sf_dir):
    return _rounded(regions.circle_counter(by_image(tables.gray_mosaic(spark, sf_dir)), min_radius=5))


# Feature tables


@query(
    "features_long",
    f"""WITH {TILE}, s AS (SELECT image_id, class, {_stats_sql("nullif(v, 0)")} FROM tile GROUP BY ALL)
SELECT 'img_' || image_id || '.png' AS filename, class, n AS feature_name, round(x, 6) AS feature_value FROM (
  SELECT image_id, class::VARCHAR AS class, unnest(['brightness_mean[intensity]', 'brightness_median[intensity]', 'brightness_variance[intensity2]', 'brightness_std_dev[intensity]', 'brightness_cv[ratio]']) AS n, unnest([mean, median, variance, std_dev, cv]) AS x FROM s)""",
)
def features_long(spark, sf_dir):
    return _rounded(features.to_long(features.assemble(_meta(spark, sf_dir), {"brightness": statistics.brightness(tables.gray_tile(spark, sf_dir))})))


def _meta(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), F.concat(F.lit("img_"), "vec_id", F.lit(".png")).alias("filename"), F.col("label").cast("string").alias("class"))


@query("features_wide")
def features_wide(spark, sf_dir):
    tile = by_image(tables.gray_tile(spark, sf_dir))
    wide = _rounded(pipeline.extract(tile, _meta(spark, sf_dir), ["brightness", "lbp", "fft", "glcm", "hlac", "swt"], {"glcm": {"distances": (1,)}}))
    return wide.toDF(*(c.replace(".", "p") for c in wide.columns))  # so that any reader can name the columns


@query("features_round_trip", f"WITH {TILE}, s AS (SELECT image_id, {_stats_sql('nullif(v, 0)')} FROM tile GROUP BY ALL) SELECT 'img_' || image_id || '.png' AS filename, round(cv, 6) AS cv, round(mean, 6) AS mean FROM s")
def features_round_trip(spark, sf_dir):
    long = features.to_long(features.assemble(_meta(spark, sf_dir).drop("class"), {"brightness": statistics.brightness(tables.gray_tile(spark, sf_dir))}))
    wide = features.to_wide(long, ["brightness_mean[intensity]", "brightness_cv[ratio]"])
    return wide.select("filename", F.round("`brightness_cv[ratio]`", 6).alias("cv"), F.round("`brightness_mean[intensity]`", 6).alias("mean"))


# Names and collections

_CAPTURE = """cap AS (SELECT user_id AS camera, event_type AS prefix, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INT AS n FROM events)"""


@query("capture_ids", f"WITH {_CAPTURE} SELECT camera, prefix, event_id, n, (n - 1) // 3 + 1 AS id, prefix || '_' || strftime(ts, '%Y%m%d%H%M%S') || '_NA_NA_id' || ((n - 1) // 3 + 1) || '_image' || n || '.png' AS name FROM cap")
def capture_ids(spark, sf_dir):
    f = tables.frames(spark, sf_dir).select("camera", F.col("class_name").alias("prefix"), "ts", "event_id", F.lit(None).cast("string").alias("label"))
    return names.capture_names(f, interval=3).select("camera", "prefix", "event_id", "n", "id", "name")


@query(
    "class_from_name",
    """WITH n AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'x' || vec_id || '_' || label || '_a' WHEN 1 THEN label || '-b_' || vec_id WHEN 2 THEN '_' || label ELSE 'v' || vec_id END AS s FROM embeddings),
p AS (SELECT vec_id, string_split(s, '_') AS p FROM n) SELECT vec_id, coalesce(p[2], '') AS a, p[len(p)] AS b, coalesce(p[3], '') AS c FROM p""",
)
def class_from_name(spark, sf_dir):
    k, v, label = F.col("vec_id") % 4, F.col("vec_id").cast("string"), F.col("label").cast("string")
    stem = F.when(k == 0, F.concat(F.lit("x"), v, F.lit("_"), label, F.lit("_a"))).when(k == 1, F.concat(label, F.lit("-b_"), v)).when(k == 2, F.concat(F.lit("_"), label)).otherwise(F.concat(F.lit("v"), v))
    n = tables.table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("in/s_1/"), stem, F.when(k == 1, ".JPG").otherwise(".png")).alias("n"))
    return n.select("vec_id", names.class_from_name(F.col("n"), "_", 1).alias("a"), names.class_from_name(F.col("n"), "_", -1).alias("b"), names.class_from_name(F.col("n"), "_", 2).alias("c"))


@query("time_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS stamp FROM events")
def time_stamps(spark, sf_dir):
    return tables.frames(spark, sf_dir).select("event_id", names.stamp("ts").alias("stamp"))


_FILES = "fl AS (SELECT DISTINCT 'base/' || strftime(ts, '%Y-%m-%d') || '/' || event_type || '/u' || (user_id % 50) || '.png' AS path, event_type AS type, 'u' || (user_id % 50) AS s FROM events)"


@query("collect_plan", f"WITH {_FILES}, k AS (SELECT *, row_number() OVER (PARTITION BY type, s ORDER BY path) - 1 AS k FROM fl) SELECT path, type, type || '/' || s || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.png' AS destination, false AS delete_source FROM k")
def collect_plan(spark, sf_dir):
    f = tables.frames(spark, sf_dir)
    path = F.concat(F.lit("base/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), "class_name", F.lit("/u"), (F.col("camera") % 50).cast("string"), F.lit(".png"))
    return files.collect_plan(files.captures(f.select(path.alias("path"), F.lit("base").alias("base"))))


@query("collect_counts", f"WITH {_FILES} SELECT type, count(*) AS n FROM fl GROUP BY 1")
def collect_counts(spark, sf_dir):
    return collect_plan(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


# Recorded results


def _bodies(spark, sf_dir):
    """Detection responses in JSON: as many boxes as class_id modulo 3; a class_id of 7 lacks its time."""
    f = tables.frames(spark, sf_dir)
    d = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct((F.col("class_id") + i).alias("class_id"), F.col("class_name").alias("class_name"), (F.pmod(F.col("class_id") * i, F.lit(100)) / 100.0).alias("confidence"), F.array((i - 2) * 10.0, F.lit(5.0), F.col("class_id") * 1.0 - 20, F.lit(50.0)).alias("bbox")))
    body = F.to_json(F.struct(F.slice(d, F.lit(1), F.col("class_id") % 3).alias("detections"), F.when(F.col("class_id") != 7, F.col("total_ms")).alias("e2e_time_ms"), F.create_map(F.lit("pipeline_inference_ms"), F.col("total_ms") / 2).alias("phase_times_ms")))
    return f.select("camera", "ts", "event_id", body.alias("body"))


_EV = "ev AS (SELECT event_id, user_id AS camera, ts, value, event_type, json_extract_string(props, '$.k')::INT AS k FROM events)"
_BOX = f"{_EV}, bx AS (SELECT event_id, k, event_type, i, (k * i % 100) / 100.0 AS confidence, (i - 2) * 10.0 AS x1, 5.0 AS y1, k - 20.0 AS x2, 50.0 AS y2 FROM ev, unnest(range(1, 4)) AS r(i) WHERE i <= k % 3 AND k <> 7)"


@query("detection_rows", f"WITH {_EV} SELECT event_id, camera, (k % 3)::INT AS num_detections, round((epoch_us(ts) / 1e6::DOUBLE - epoch_us(min(ts) OVER (PARTITION BY camera)) / 1e6::DOUBLE), 3) AS elapsed_s, value / 2 AS phase_pipeline_inference_ms FROM ev WHERE k <> 7")
def detection_rows(spark, sf_dir):
    good, _ = inference.detections(_bodies(spark, sf_dir))
    rows = inference.phases(inference.frame_rows(good))
    return rows.select("event_id", "camera", "num_detections", "elapsed_s", "phase_pipeline_inference_ms")


@query("detection_quarantine", f"WITH {_EV} SELECT event_id FROM ev WHERE k = 7")
def detection_quarantine(spark, sf_dir):
    return inference.detections(_bodies(spark, sf_dir))[1].select("event_id")


@query("valid_boxes", f"WITH {_BOX} SELECT event_id, (k + i)::INT AS class_id, ((k + i) % 8)::INT AS palette, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS tier, trunc(x1 * 0.5)::INT AS x1, trunc(y1 * 0.5)::INT AS y1, trunc(x2 * 0.5)::INT AS x2, trunc(y2 * 0.5)::INT AS y2 FROM bx WHERE x2 > x1 AND x2 > 0 AND x1 < 640")
def valid_boxes(spark, sf_dir):
    good, _ = inference.detections(_bodies(spark, sf_dir))
    b = inference.valid_boxes(inference.boxes(good), 640, 480, 0.5)
    return b.select("event_id", "class_id", inference.palette_index("class_id").alias("palette"), inference.tier("confidence").alias("tier"), "x1", "y1", "x2", "y2")


@query("score_threshold", f"WITH {_EV}, n AS (SELECT event_id, i FROM ev, unnest(range(1, 4)) AS r(i) WHERE i <= k % 3 AND (k * i % 100) / 100.0 >= 0.5 AND k <> 7) SELECT event_id, count(i) AS n FROM ev LEFT JOIN n USING (event_id) WHERE k <> 7 GROUP BY event_id")
def score_threshold(spark, sf_dir):
    good, _ = inference.detections(_bodies(spark, sf_dir))
    return inference.above(good, 0.5).select("event_id", F.size("detections").cast("long").alias("n"))


@query("classification_log", f"WITH {_EV} SELECT event_id, event_type AS class_name, k / 100.0 AS confidence, CASE WHEN k >= 70 THEN 'high' WHEN k >= 40 THEN 'medium' ELSE 'low' END AS tier FROM ev WHERE k % 10 <> 0")
def classification_log(spark, sf_dir):
    f = tables.frames(spark, sf_dir)
    body = F.to_json(F.struct("class_id", F.when(F.col("class_id") % 10 != 0, F.col("class_name")).alias("class_name"), "confidence", F.array("confidence").alias("probabilities"), F.col("total_ms").alias("e2e_time_ms"), F.lit("cpu").alias("backend")))
    good, _ = inference.classifications(f.select("event_id", body.alias("body")))
    return good.select("event_id", "class_name", "confidence", inference.tier("confidence").alias("tier"))


_LOG_SQL = f"""WITH {_EV} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, k AS class_id, event_type AS class_name, k / 100.0 AS confidence, value + 2 AS total_ms, value AS e2e_time_ms, value + 1 AS rtt_ms, 'cpu' AS backend,
  CASE WHEN k % 2 = 0 THEN 0.5 END::DOUBLE AS api_preprocess_ms, CASE WHEN k % 2 = 1 THEN 1.5 END::DOUBLE AS phase_preprocess_ms, 2.5::DOUBLE AS phase_inference_ms, NULL::DOUBLE AS phase_inference_gpu_ms, NULL::DOUBLE AS phase_postprocess_ms, NULL::DOUBLE AS api_postprocess_ms,
  k + 900 AS gpu_clock_mhz, NULL::INT AS gpu_vram_used_mb, NULL::INT AS gpu_temperature_c, CASE WHEN k % 3 = 0 THEN 'f' || event_id || '.png' ELSE '' END AS image_file FROM ev WHERE k % 10 <> 0"""


@query("classification_log_rows", _LOG_SQL)
def classification_log_rows(spark, sf_dir):
    """The 18 columns of responses with phases and GPU values, without those that lack a key."""
    f, k = tables.frames(spark, sf_dir), F.col("class_id")
    phases = F.map_from_arrays(F.array(F.when(k % 2 == 0, "api_preprocess_ms").otherwise("pipeline_preprocess_ms"), F.lit("pipeline_inference_ms")), F.array(F.when(k % 2 == 0, 0.5).otherwise(1.5), F.lit(2.5)))
    parts = ["class_id", F.when(k % 10 != 0, F.col("class_name")).alias("class_name"), "confidence", F.array("confidence").alias("probabilities"), F.col("total_ms").alias("e2e_time_ms"), F.lit("cpu").alias("backend"), phases.alias("phase_times_ms"), (k + 900).alias("gpu_clock_mhz")]
    image_file = F.when(k % 3 == 0, F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(".png"))).alias("image_file")
    good, _ = inference.classifications(f.select("ts", (F.col("total_ms") + 2).alias("total_ms"), (F.col("total_ms") + 1).alias("rtt_ms"), image_file, F.to_json(F.struct(*parts)).alias("body")))
    return inference.log_rows(good)


@query("time_parts", "SELECT event_id, round(value + 2, 3) - round(value + 1, 3) AS encode_ms, round(value + 1, 3) - value AS network_ms FROM events")
def time_parts(spark, sf_dir):
    f = tables.frames(spark, sf_dir).select("event_id", F.col("total_ms").alias("e2e_time_ms"), (F.col("total_ms") + 1).alias("rtt_ms"), (F.col("total_ms") + 2).alias("total_ms"))
    return inference.time_parts(f).select("event_id", "encode_ms", "network_ms")


# Streams, over recorded tables

_DAY = 86_400_000_000


@query("fps_windows", "SELECT user_id AS camera, (epoch_us(ts) // 7200000000 * 7200000000)::BIGINT AS start_us, count(*) / 7200.0::DOUBLE AS fps FROM events GROUP BY ALL")
def fps_windows(spark, sf_dir):
    return streams.fps(tables.frames(spark, sf_dir), 7200).select("camera", F.unix_micros("start").alias("start_us"), "fps")


_WALK = f"""WITH RECURSIVE ev AS (SELECT user_id AS camera, epoch_us(ts) AS t, min(event_id) AS event_id FROM events GROUP BY ALL),
walk AS (SELECT camera, min(t) AS t FROM ev GROUP BY camera UNION ALL SELECT ev.camera, min(ev.t) FROM walk JOIN ev ON ev.camera = walk.camera AND ev.t >= walk.t + {_DAY} GROUP BY ev.camera)
SELECT camera, t AS ts_us, event_id FROM walk JOIN ev USING (camera, t)"""


@query("throttle", _WALK)
def throttle(spark, sf_dir):
    return streams.throttle(tables.frames(spark, sf_dir), _DAY).select("camera", F.unix_micros("ts").alias("ts_us"), "event_id")


@query("throttle_stream", _WALK)
def throttle_stream(spark, sf_dir):
    """The stateful operator over the events as a stream, run to the end of what is there."""
    path = files.shared_path(spark, "throttle")
    source = spark.readStream.schema(tables.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    f = source.select(F.col("user_id").alias("camera"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    out = streams.throttle_stream(f, _DAY).select("camera", F.unix_micros("ts").alias("ts_us"), "event_id")
    streams.append_log(out, f"{path}/out", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


_GUARD = """WITH RECURSIVE ev AS (SELECT user_id AS camera, epoch_us(ts) AS t, event_id, greatest(0, trunc(value * 10000 * 1000))::BIGINT AS b FROM events),
walk AS (SELECT camera, min(t) AS t, arg_min(event_id, (t, event_id)) AS event_id, arg_min(b, (t, event_id)) AS b FROM ev GROUP BY camera
UNION ALL SELECT ev.camera, min(ev.t), arg_min(ev.event_id, (ev.t, ev.event_id)), arg_min(ev.b, (ev.t, ev.event_id)) FROM walk w JOIN ev ON ev.camera = w.camera AND ev.t >= w.t + w.b AND (ev.t, ev.event_id) > (w.t, w.event_id) GROUP BY ev.camera)
SELECT camera, t AS ts_us, event_id FROM walk"""


@query("in_flight_guard", _GUARD)
def in_flight_guard(spark, sf_dir):
    f = tables.frames(spark, sf_dir).withColumn("busy_ms", F.col("total_ms") * 10_000)
    return streams.throttle(f, 0, "busy_ms").select("camera", F.unix_micros("ts").alias("ts_us"), "event_id")


@query("throttle_log", _GUARD)
def throttle_log(spark, sf_dir):
    """The guard over the events as a stream, with a log whose memory one camera's frames don't fill."""
    path = files.shared_path(spark, "throttle-log")
    source = spark.readStream.schema(tables.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    f = source.select(F.col("user_id").alias("camera"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") * 10_000).alias("busy_ms"))
    streams.throttle_log(f, f"{path}/out", f"{path}/log", 0, "busy_ms").trigger(availableNow=True).start().awaitTermination()
    return streams.throttled(spark, f"{path}/out", f.schema["camera"].dataType.simpleString()).select("camera", F.unix_micros("ts").alias("ts_us"), "event_id")


@query("latest_state", "SELECT user_id AS camera, epoch_us(arg_max(ts, (ts, event_id))) AS ts_us, CASE WHEN arg_max(event_type, (ts, event_id)) <> 'error' THEN arg_max(event_type, (ts, event_id)) END AS result FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    f = tables.frames(spark, sf_dir).withColumn("result", F.when(F.col("class_name") != "error", F.col("class_name"))).withColumn("error", F.when(F.col("class_name") == "error", F.col("class_name")))
    return streams.latest(f).select("camera", F.unix_micros("ts").alias("ts_us"), "result")


@query(
    "sessions",
    """WITH e AS (SELECT user_id AS camera, epoch_us(ts) AS t, event_id FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w >= 43200000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY camera ORDER BY t, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY camera ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT camera, min(t) AS start_us, round((max(t) - min(t)) / 1e6::DOUBLE, 6) AS duration_s, count(*) AS frames FROM s GROUP BY camera, s""",
)
def sessions(spark, sf_dir):
    return streams.sessions(tables.frames(spark, sf_dir), "12 hours").select("camera", F.unix_micros("start").alias("start_us"), F.round("duration_s", 6).alias("duration_s"), "frames")


# Profiles and checks


@query(
    "pipeline_profile",
    f"""WITH {TILE}, h AS (SELECT image_id, v, count(*) AS n FROM tile GROUP BY ALL), c AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS c, sum(n) OVER (PARTITION BY image_id) AS t FROM h),
c0 AS (SELECT *, min(c) OVER (PARTITION BY image_id) AS c0 FROM c), lut AS (SELECT image_id, v, CASE WHEN t = c0 THEN v ELSE floor((c - c0)::DOUBLE * 255.0::DOUBLE / (t - c0) + 0.5)::INT END AS e FROM c0)
SELECT image_id, {_CHECKSUM} FROM (SELECT image_id, y, x, CASE WHEN e > 100 THEN 255 ELSE 0 END AS v FROM tile JOIN lut USING (image_id, v)) GROUP BY image_id""",
)
def pipeline_profile(spark, sf_dir):
    p = pipeline.Profile(["equalize", "std_bin"], {"std_bin": {"threshold": 100}}, "pipeline")
    return _checksum(pipeline.run(by_image(tables.gray_tile(spark, sf_dir)).select("image_id", "y", "x", "v"), p)["pipeline"])


_STAGE = "SELECT '{0}' AS stage, count(*) AS n, sum(v)::BIGINT AS sum_v FROM {1}"
_PARALLEL = [("original", "tile"), ("average_blur", "av"), ("otsu_bin", "ot"), ("median_blur", "md")]


@query(
    "parallel_profile",
    f"""WITH {TILE}, {_near("tile", _sq(2), 8)}, av AS (SELECT image_id, y, x, floor(sum(u)::DOUBLE / 25 + 0.5)::INT AS v FROM nb GROUP BY ALL),
{_near("tile", _sq(1), 8, _replicate).replace("nb AS", "n3 AS", 1)}, md AS (SELECT image_id, y, x, quantile_cont(u, 0.5)::INT AS v FROM n3 GROUP BY image_id, y, x),
{_OTSU.format("tile")}, ot AS (SELECT CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM tile JOIN otsu USING (image_id)) {" UNION ALL ".join(_STAGE.format(*x) for x in _PARALLEL)}""",
)
def parallel_profile(spark, sf_dir):
    p = pipeline.Profile(["average_blur", "otsu_bin", "median_blur"], {"median_blur": {"kernel_size": 3}}, "parallel")
    s = pipeline.together(pipeline.run(by_image(tables.gray_tile(spark, sf_dir)), p))
    return s.groupBy("stage").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("long")).alias("sum_v"))


#: Tiles of which some have values beyond 8 bits and some are smaller than 4x4.
_ODD = f"{TILE}, odd AS (SELECT image_id, y, x, v + CASE WHEN image_id % 11 = 0 THEN 100 ELSE 0 END AS v FROM tile WHERE image_id % 13 <> 0 OR (y < 3 AND x < 3))"


def _odd_tiles(spark, sf_dir):
    tile = by_image(tables.gray_tile(spark, sf_dir)).where("image_id % 13 <> 0 OR (y < 3 AND x < 3)")
    return tile.select("image_id", "y", "x", (F.col("v") + F.when(F.col("image_id") % 11 == 0, 100).otherwise(0)).alias("v"))


@query(
    "quality_report",
    f"""WITH {_ODD}, i AS (SELECT image_id, count(DISTINCT v) AS kinds, count(*) FILTER (v NOT IN (0, 255)) AS other, max(y) AS y, max(x) AS x, max(v) AS hi FROM odd GROUP BY image_id)
SELECT image_id, 'contour' AS operator, '[contour] at most 30 values are allowed' AS message FROM i WHERE kinds > 30 UNION ALL SELECT image_id, 'mask_composition', '[mask_composition] values must be 0 or 255' FROM i WHERE other > 0
UNION ALL SELECT image_id, 'fft', '[fft] image must be at least 4x4' FROM i WHERE y < 3 OR x < 3 UNION ALL SELECT image_id, 'clahe', '[clahe] values must be integers from 0 to 255' FROM i WHERE hi > 255""",
)
def quality_report(spark, sf_dir):
    tile = _odd_tiles(spark, sf_dir)
    found = quality.few_values(tile, "contour", 30).unionByName(quality.binary(tile, "mask_composition"))
    return found.unionByName(quality.too_small(tile, "fft")).unionByName(quality.eight_bit(tile, "clahe"))


@query(
    "checked_chain",
    f"""WITH {_ODD}, wide AS (SELECT image_id FROM odd GROUP BY image_id HAVING max(v) > 255), bin AS (SELECT image_id, y, x, CASE WHEN v > 100 THEN 255 ELSE 0 END AS v FROM odd),
bad AS (SELECT image_id, 'average_blur' AS operator, '[average_blur] values must be integers from 0 to 255' AS message FROM wide),
size AS (SELECT image_id, max(y) + 1 AS n FROM odd GROUP BY image_id), near AS (SELECT p.image_id, p.y, p.x, floor(sum(q.v)::DOUBLE / 9 + 0.5)::INT AS v FROM odd p JOIN size s USING (image_id) CROSS JOIN (VALUES (-1), (0), (1)) a(dy) CROSS JOIN (VALUES (-1), (0), (1)) b(dx)
  JOIN odd q ON q.image_id = p.image_id AND q.y = {"CASE WHEN p.y + dy < 0 THEN 1 WHEN p.y + dy >= n THEN n - 2 ELSE p.y + dy END"} AND q.x = {"CASE WHEN p.x + dx < 0 THEN 1 WHEN p.x + dx >= n THEN n - 2 ELSE p.x + dx END"} WHERE p.image_id NOT IN (SELECT image_id FROM wide) GROUP BY p.image_id, p.y, p.x)
SELECT image_id, 'pipeline' AS stage, NULL AS message, sum(CASE WHEN near.v > 100 THEN o.v ELSE 0 END)::BIGINT AS total FROM near JOIN odd o USING (image_id, y, x) GROUP BY image_id
UNION ALL SELECT image_id, operator, message, NULL FROM bad""",
)
def checked_chain(spark, sf_dir):
    """A blur that images beyond 8 bits don't pass, a threshold, and its mask on the original."""
    p = pipeline.Profile(["average_blur", "std_bin", "mask_composition"], {"average_blur": {"kernel_size": (3, 3)}, "std_bin": {"threshold": 100}}, "pipeline")
    stages, bad = pipeline.checked(_odd_tiles(spark, sf_dir), p)
    done = stages["pipeline"].groupBy("image_id").agg(F.sum("v").cast("long").alias("total")).select("image_id", F.lit("pipeline").alias("stage"), F.lit(None).cast("string").alias("message"), "total")
    return done.unionByName(bad.select("image_id", F.col("operator").alias("stage"), "message", F.lit(None).cast("long").alias("total")))


@query("image_checks", "SELECT vec_id AS image_id, 'clahe' AS operator, '[clahe] image is empty' AS message FROM embeddings WHERE vec_id % 7 = 3 UNION ALL SELECT vec_id, 'resize', '[resize] channels must be one of [1, 3, 4]' FROM embeddings WHERE vec_id % 5 NOT IN (1, 3, 4)")
def image_checks(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), (F.col("vec_id") % 5).cast("int").alias("n_channels"))
    found = quality.empty(e, tables.gray_tile(spark, sf_dir).where("image_id % 7 <> 3"), "clahe")
    return found.unionByName(quality.channels(e, "resize"))


@query("run_summary", f"WITH {TILE}, b AS (SELECT image_id, count(DISTINCT v) > 45 AS bad FROM tile GROUP BY image_id) SELECT status, sum(n)::BIGINT AS n FROM (SELECT unnest(CASE WHEN bad THEN ['failed', 'skipped_due_to_earlier_failure'] ELSE ['ok', 'ok'] END) AS status, 1 AS n FROM b) GROUP BY status")
def run_summary(spark, sf_dir):
    tile = tables.gray_tile(spark, sf_dir)
    p = pipeline.Profile(["contour", "std_bin"], mode="pipeline")
    return pipeline.summary(pipeline.statuses(tile, p, quality.few_values(tile, "contour", 45)))


def _codes_sql() -> str:
    turned = [" + ".join(f"(b{(k + s) % 8} << {k})" for k in range(8)) for s in range(8)]
    patterns = sorted({sum(1 << (s + k) % 8 for k in range(n)) for n in range(9) for s in range(8)})
    nri = " ".join(f"WHEN {p} THEN {i}" for i, p in enumerate(patterns))
    parts = {"default": turned[0], "ror": f"least({', '.join(turned)})", "nri_uniform": f"CASE {turned[0]} {nri} ELSE {len(patterns)} END"}
    return " UNION ALL ".join(f"SELECT image_id, {code} AS code, '{m}' AS method FROM bt" for m, code in parts.items())


@query("lbp_methods", f"WITH {TILE}, {_lbp_sql()} SELECT image_id, code, count(*) AS n, method FROM ({_codes_sql()}) GROUP BY ALL")
def lbp_methods(spark, sf_dir):
    tile = by_image(tables.gray_tile(spark, sf_dir))
    parts = [texture.lbp_histogram(tile, method=m).withColumn("method", F.lit(m)) for m in ("default", "ror", "nri_uniform")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "brightness_lab",
    f"""WITH {BGR}, li AS (SELECT image_id, {", ".join(f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE power(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS {c}" for c in "rgb")} FROM bgr),
yy AS (SELECT image_id, 0.212671 * r + 0.715160 * g + 0.072169 * b AS t FROM li), lv AS (SELECT image_id, greatest(0, least(255, floor((CASE WHEN t > 0.008856 THEN cbrt(t) * 116 - 16 ELSE t * 903.3 END) * 2.55 + 0.5)))::INT AS v FROM yy),
st AS (SELECT image_id, {_stats_sql("nullif(v, 0)")} FROM lv GROUP BY image_id) SELECT image_id, {", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "median", "variance", "std_dev", "cv"))} FROM st""",
)
def brightness_lab(spark, sf_dir):
    return _rounded(statistics.brightness(tables.bgr_orders(spark, sf_dir), "lab_l"))
