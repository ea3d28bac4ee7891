"""The registered queries over the tables of a data folder, and SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenframe.functions import color
from lumenframe.operators import geometry, histogram, spectral, statistics, stencil, texture
from lumenframe.operators.grid import by_image
from lumenframe.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and the SQL for the same rows if there is any."""

    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# Views of the tables, in SQL

TILE = """tile AS (SELECT vec_id AS image_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x,
  greatest(0, least(255, floor((embedding[i]::DOUBLE + 0.5) * 256)))::INT AS v, label AS class FROM embeddings, unnest(range(1, 65)) AS r(i))"""
MOSAIC = """mosaic AS (SELECT image_id, (g // 64)::INT AS y, (g % 64)::INT AS x, coalesce(v, 0)::INT AS v
  FROM (SELECT DISTINCT vec_id // 64 AS image_id FROM embeddings) CROSS JOIN unnest(range(0, 4096)) AS u(g) LEFT JOIN
  (SELECT vec_id // 64 AS image_id, (vec_id % 64) * 64 + i - 1 AS g, greatest(0, least(255, floor((embedding[i]::DOUBLE + 0.5) * 256)))::INT AS v FROM embeddings, unnest(range(1, 65)) AS r(i)) USING (image_id, g))"""
BGR = """bgr AS (SELECT image_id, (g // 32)::INT AS y, (g % 32)::INT AS x, coalesce(o_custkey % 256, 0)::INT AS b, coalesce((floor(o_totalprice)::BIGINT // 256) % 256, 0)::INT AS g, coalesce(floor(o_totalprice)::BIGINT % 256, 0)::INT AS r
  FROM (SELECT DISTINCT o_orderkey // 1024 AS image_id FROM orders) CROSS JOIN unnest(range(0, 1024)) AS u(g) LEFT JOIN orders ON o_orderkey = image_id * 1024 + u.g)"""


def _reflect(c: str, n: str) -> str:
    return f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} >= {n} THEN 2 * ({n} - 1) - ({c}) ELSE {c} END"


def _replicate(c: str, n: str) -> str:
    return f"greatest(0, least({n} - 1, {c}))"


def _near(source: str, offsets: list[tuple], n: int, border=_reflect) -> str:
    """nb: image_id, y, x, the neighbour's value u and the offset's weight w; square images of side n."""
    rows = ", ".join(f"({o[0]}, {o[1]}, {o[2] if len(o) > 2 else 1})" for o in offsets)
    return f"""nb AS (SELECT p.image_id, p.y, p.x, p.v, o.dy, o.dx, o.w::DOUBLE AS w, q.v AS u FROM {source} p, (VALUES {rows}) AS o(dy, dx, w)
  JOIN {source} q ON q.image_id = p.image_id AND q.y = {border("p.y + o.dy", str(n))} AND q.x = {border("p.x + o.dx", str(n))})"""


def _stats_sql(c: str, prefix: str = "") -> str:
    n, s, q = f"count({c})", f"sum({c}::BIGINT)", f"sum({c}::BIGINT * {c})"
    var = f"(({n} * {q} - {s} * {s})::DOUBLE / ({n} * {n}))"
    none = lambda x: f"CASE WHEN {n} = 0 THEN 0.0 ELSE {x} END"
    return f"""{none(f"{s}::DOUBLE / {n}")}::DOUBLE AS {prefix}mean, {none(f"quantile_cont({c}, 0.5)")}::DOUBLE AS {prefix}median, {none(var)}::DOUBLE AS {prefix}variance,
  {none(f"sqrt({var})")}::DOUBLE AS {prefix}std_dev, CASE WHEN {n} = 0 OR {s} = 0 THEN 'inf'::DOUBLE ELSE sqrt({var}) / ({s}::DOUBLE / {n}) END AS {prefix}cv"""


def _rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, without negative zeros, so that the order of summing does not show."""
    own = lambda c: F.col(f"`{c}`")
    return df.select(*((F.round(own(c), digits) + 0.0).alias(c) if t == "double" and c not in keep else own(c) for c, t in df.dtypes))


_CHECKSUM = "count(*) AS n_pixels, sum(v)::BIGINT AS sum_v, sum((v + 1)::BIGINT * (y * 131 + x + 1))::BIGINT AS checksum"


def _checksum(gray: DataFrame) -> DataFrame:
    """One row an image: enough to tell two images apart."""
    v, y, x = F.col("v").cast("long"), F.col("y").cast("long"), F.col("x").cast("long")
    return gray.groupBy("image_id").agg(F.count("*").alias("n_pixels"), F.sum(v).alias("sum_v"), F.sum((v + 1) * (y * 131 + x + 1)).alias("checksum"))


# Statistics


@query("brightness_stats", f"WITH {TILE} SELECT image_id, class, {_stats_sql('nullif(v, 0)')} FROM tile GROUP BY ALL")
def brightness_stats(spark, sf_dir):
    tile = tables.gray_tile(spark, sf_dir)
    classes = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("class"))
    return statistics.brightness(tile).join(classes, "image_id").select("image_id", "class", "mean", "median", "variance", "std_dev", "cv")


_HSV = """hsv0 AS (SELECT *, greatest(b, g, r) AS t, greatest(b, g, r) - least(b, g, r) AS d FROM bgr),
hsv1 AS (SELECT *, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN t = r THEN (g - b) * 60.0::DOUBLE / d WHEN t = g THEN (b - r) * 60.0::DOUBLE / d + 120 ELSE (r - g) * 60.0::DOUBLE / d + 240 END AS h0 FROM hsv0),
hsv AS (SELECT image_id, y, x, b, g, r, (floor((CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END) / 2 + 0.5)::INT % 180) AS h,
  CASE WHEN t = 0 THEN 0 ELSE floor(d * 255.0::DOUBLE / t + 0.5)::INT END AS s, t AS val FROM hsv1)"""


@query("to_gray", f"WITH {BGR} SELECT image_id, {_CHECKSUM} FROM (SELECT image_id, y, x, (299 * r + 587 * g + 114 * b + 500) // 1000 AS v FROM bgr) GROUP BY image_id")
def to_gray(spark, sf_dir):
    return _checksum(color.to_gray(tables.bgr_orders(spark, sf_dir)))


@query("bgr_to_hsv", f"WITH {BGR}, {_HSV} SELECT image_id, count(*) AS n, sum(h)::BIGINT AS h, sum(s)::BIGINT AS s, sum(val)::BIGINT AS val, sum(h::BIGINT * (y * 32 + x))::BIGINT AS hp FROM hsv GROUP BY image_id")
def bgr_to_hsv(spark, sf_dir):
    h = color.hsv(tables.bgr_orders(spark, sf_dir))
    return h.groupBy("image_id").agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in ("h", "s", "val")), F.sum(F.col("h").cast("long") * (F.col("y") * 32 + F.col("x"))).alias("hp"))


@query("rgb_stats", f"WITH {BGR} SELECT image_id, {', '.join(_stats_sql(f'CASE WHEN b + g + r > 0 THEN {c} END', n) for c, n in (('r', 'red_'), ('g', 'green_'), ('b', 'blue_')))} FROM bgr GROUP BY image_id")
def rgb_stats(spark, sf_dir):
    return statistics.rgb(tables.bgr_orders(spark, sf_dir))


@query(
    "hsv_stats",
    f"""WITH {BGR}, {_HSV}, base AS (SELECT image_id, round(avg(sin(h * 2 * pi() / 180)), 13) + 0.0 AS s_, round(avg(cos(h * 2 * pi() / 180)), 13) + 0.0 AS c_, {_stats_sql("s", "saturation_")}, {_stats_sql("val", "value_")} FROM hsv WHERE b + g + r > 0 GROUP BY image_id),
m AS (SELECT *, round(((atan2(s_, c_) + 2 * pi()) % (2 * pi())) * 90 / pi(), 9) % 180 AS hue_mean, sqrt(-2 * ln(greatest(1e-12, least(1.0, sqrt(s_ * s_ + c_ * c_))))) * 90 / pi() AS hue_std_dev FROM base),
t AS (SELECT hsv.image_id, hue_mean, quantile_cont(h + CASE WHEN round(h - hue_mean, 9) < -90 THEN 180 WHEN round(h - hue_mean, 9) >= 90 THEN -180 ELSE 0 END, 0.5) AS q FROM hsv JOIN m USING (image_id) WHERE b + g + r > 0 GROUP BY ALL)
SELECT image_id, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for p in ("saturation_", "value_") for c in (p + "mean", p + "median", p + "variance", p + "std_dev", p + "cv"))},
  round(m.hue_mean, 6) AS hue_mean, round(hue_std_dev, 6) AS hue_std_dev, round(hue_std_dev * hue_std_dev, 6) AS hue_variance, round((q + 180) % 180, 6) AS hue_median,
  CASE WHEN m.hue_mean = 0 THEN 'inf'::DOUBLE ELSE round(hue_std_dev / m.hue_mean, 6) END AS hue_cv FROM m JOIN t USING (image_id)""",
)
def hsv_stats(spark, sf_dir):
    return _rounded(statistics.hsv(tables.bgr_orders(spark, sf_dir)))


@query("docs_byte_histogram", "WITH h AS (SELECT hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE text <> '') SELECT ('0x' || substr(h, 2 * i + 1, 2))::INT AS v, count(*) AS n FROM h, unnest(range(0, n)) AS r(i) GROUP BY 1")
def docs_byte_histogram(spark, sf_dir):
    return tables.byte_counts(tables.table(spark, sf_dir, "documents"))


@query("docs_rows", "WITH h AS (SELECT doc_id AS image_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE text <> '') SELECT image_id, count(*) AS n_pixels, max(i // 64)::INT AS y, sum(('0x' || substr(h, 2 * i + 1, 2))::INT * (i % 64 + 1))::BIGINT AS s FROM h, unnest(range(0, n)) AS r(i) GROUP BY 1")
def docs_rows(spark, sf_dir):
    d = tables.gray_docs(spark, sf_dir)
    return d.groupBy("image_id").agg(F.count("*").alias("n_pixels"), F.max("y").alias("y"), F.sum(F.col("v").cast("long") * (F.col("x") + 1)).alias("s"))


@query("to_bgr", f"WITH {TILE} SELECT image_id, count(*) AS n, sum(v)::BIGINT AS b, sum(v * (x + 1))::BIGINT AS g, sum(v * (y + 1))::BIGINT AS r FROM tile GROUP BY 1")
def to_bgr(spark, sf_dir):
    p = color.to_bgr(tables.gray_tile(spark, sf_dir))
    return p.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("b").cast("long")).alias("b"), F.sum(F.col("g").cast("long") * (F.col("x") + 1)).alias("g"), F.sum(F.col("r").cast("long") * (F.col("y") + 1)).alias("r"))


@query("to_rgb", f"WITH {BGR} SELECT image_id, r, count(*) AS n, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b FROM bgr GROUP BY ALL")
def to_rgb(spark, sf_dir):
    p = color.to_rgb(tables.bgr_orders(spark, sf_dir)).toDF("image_id", "y", "x", "first", "second", "third")
    return p.groupBy("image_id", F.col("first").alias("r")).agg(F.count("*").alias("n"), F.sum(F.col("second").cast("long")).alias("g"), F.sum(F.col("third").cast("long")).alias("b"))


@query(
    "normalize_dtype",
    f"""WITH {TILE}, d AS (SELECT image_id, y, x, CASE WHEN image_id % 3 = 0 THEN v / 256.0::DOUBLE WHEN image_id % 3 = 1 THEN v * 1.5::DOUBLE - 20 ELSE v * 0.5::DOUBLE - 10 END AS d FROM tile),
m AS (SELECT *, min(d) OVER (PARTITION BY image_id) AS lo, max(d) OVER (PARTITION BY image_id) AS hi FROM d)
SELECT image_id, {_CHECKSUM} FROM (SELECT image_id, y, x, greatest(0, least(255, trunc(CASE WHEN hi <= 1 THEN d * 255 WHEN hi > 255 THEN (d - lo) * 255 / (hi - lo) ELSE d END)))::INT AS v FROM m) GROUP BY image_id""",
)
def normalize_dtype(spark, sf_dir):
    v, kind = F.col("v").cast("double"), F.col("image_id") % 3
    d = tables.gray_tile(spark, sf_dir).select("image_id", "y", "x", F.when(kind == 0, v / 256).when(kind == 1, v * 1.5 - 20).otherwise(v * 0.5 - 10).alias("v"))
    return _checksum(color.normalize_dtype(d))


@query("quantize_levels", f"WITH {TILE} SELECT v // 32 AS q, count(*) AS n FROM tile GROUP BY 1")
def quantize_levels(spark, sf_dir):
    return tables.gray_tile(spark, sf_dir).groupBy(color.quantize(8).alias("q")).agg(F.count("*").alias("n"))


@query("min_max_normalize", f"WITH {TILE}, m AS (SELECT image_id, y, x, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM tile WINDOW w AS (PARTITION BY image_id)) SELECT image_id, {_CHECKSUM} FROM (SELECT image_id, y, x, CASE WHEN hi > lo THEN floor((v - lo) * 255.0::DOUBLE / (hi - lo))::INT ELSE 0 END AS v FROM m) GROUP BY image_id")
def min_max_normalize(spark, sf_dir):
    return _checksum(color.min_max(tables.gray_tile(spark, sf_dir)))


# Histograms


@query("std_bin", f"WITH {TILE} SELECT image_id, {_CHECKSUM} FROM (SELECT image_id, y, x, CASE WHEN v > 128 THEN 255 ELSE 0 END AS v FROM tile) GROUP BY image_id")
def std_bin(spark, sf_dir):
    return _checksum(histogram.std_bin(tables.gray_tile(spark, sf_dir)))


_OTSU = """h AS (SELECT image_id, v, count(*) AS n FROM {0} GROUP BY ALL),
cum AS (SELECT image_id, v, sum(n) OVER up AS w0, sum(n * v) OVER up AS m0, sum(n) OVER im AS n, sum(n * v) OVER im AS m FROM h WINDOW up AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING), im AS (PARTITION BY image_id)),
sc AS (SELECT image_id, v, CASE WHEN w0 < n THEN (m0 * n - m * w0)::DOUBLE * (m0 * n - m * w0)::DOUBLE / (w0 * (n - w0))::DOUBLE ELSE 0.0 END AS s FROM cum),
otsu AS (SELECT image_id, arg_max(v, (s, -v)) AS threshold FROM sc GROUP BY image_id)"""


@query("otsu_threshold", f"WITH {TILE}, {_OTSU.format('tile')} SELECT image_id, threshold, sum(CASE WHEN v > threshold THEN 1 ELSE 0 END)::BIGINT AS white FROM tile JOIN otsu USING (image_id) GROUP BY ALL")
def otsu_threshold(spark, sf_dir):
    tile = tables.gray_tile(spark, sf_dir)
    white = histogram.otsu_bin(tile).groupBy("image_id").agg(F.sum((F.col("v") > 0).cast("long")).alias("white"))
    return histogram.otsu_threshold(tile).join(white, "image_id")


@query(
    "equalize",
    f"""WITH {TILE}, h AS (SELECT image_id, v, count(*) AS n FROM tile GROUP BY ALL), c AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS c, sum(n) OVER (PARTITION BY image_id) AS t FROM h),
c0 AS (SELECT *, min(c) OVER (PARTITION BY image_id) AS c0 FROM c), lut AS (SELECT image_id, v, CASE WHEN t = c0 THEN v ELSE floor((c - c0)::DOUBLE * 255.0::DOUBLE / (t - c0) + 0.5)::INT END AS e FROM c0)
SELECT image_id, {_CHECKSUM} FROM (SELECT image_id, y, x, e AS v FROM tile JOIN lut USING (image_id, v)) GROUP BY image_id""",
)
def equalize(spark, sf_dir):
    return _checksum(histogram.equalize(tables.gray_tile(spark, sf_dir).drop("class")))


@query("clahe")
def clahe(spark, sf_dir):
    return _checksum(histogram.clahe(tables.gray_mosaic(spark, sf_dir)))


# Stencils


def _sq(r: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def _blur_sql(offsets, value: str, border=_reflect) -> str:
    return f"WITH {TILE}, {_near('tile', offsets, 8, border)}, o AS (SELECT image_id, y, x, {value} AS v FROM nb GROUP BY image_id, y, x) SELECT image_id, {_CHECKSUM} FROM o GROUP BY image_id"


@query("average_blur", _blur_sql(_sq(2), "floor(sum(u)::DOUBLE / 25 + 0.5)::INT"))
def average_blur(spark, sf_dir):
    return _checksum(stencil.average_blur(by_image(tables.gray_tile(spark, sf_dir)), (5, 5)))


_G5 = stencil.gaussian_weights(5)


@query("gaussian_blur", _blur_sql([(dy, dx, _G5[dy + 2] * _G5[dx + 2]) for dy, dx in _sq(2)], "floor(sum(u * w) + 0.5)::INT"))
def gaussian_blur(spark, sf_dir):
    return _checksum(stencil.gaussian_blur(by_image(tables.gray_tile(spark, sf_dir)), (5, 5)))


@query("median_blur", _blur_sql(_sq(1), "quantile_cont(u, 0.5)::INT", _replicate))
def median_blur(spark, sf_dir):
    return _checksum(stencil.median_blur(by_image(tables.gray_tile(spark, sf_dir)), 3))


_DISC = [(dy, dx, math.exp(-(dy * dy + dx * dx) / (2 * 75.0**2))) for dy, dx in _sq(2) if dy * dy + dx * dx <= 4]


@query("bilateral", _blur_sql(_DISC, "floor(sum(w * exp(-power(u - v, 2) / (2 * 75.0::DOUBLE * 75)) * u) / sum(w * exp(-power(u - v, 2) / (2 * 75.0::DOUBLE * 75))) + 0.5)::INT"))
def bilateral(spark, sf_dir):
    return _checksum(stencil.bilateral_filter(by_image(tables.gray_tile(spark, sf_dir)), d=5))


@query("motion_blur", _blur_sql(stencil.motion_kernel(5, 45), f"floor(sum(u)::DOUBLE / {len(stencil.motion_kernel(5, 45))} + 0.5)::INT"))
def motion_blur(spark, sf_dir):
    return _checksum(stencil.motion_blur(by_image(tables.gray_tile(spark, sf_dir)), 5, 45))


@query("mean_adaptive", f"WITH {TILE}, {_near('tile', _sq(2), 8, _replicate)}, o AS (SELECT image_id, y, x, CASE WHEN any_value(v) > floor(sum(u)::DOUBLE / 25 + 0.5)::INT - 2 THEN 255 ELSE 0 END AS v FROM nb GROUP BY image_id, y, x) SELECT image_id, {_CHECKSUM} FROM o GROUP BY image_id")
def mean_adaptive(spark, sf_dir):
    return _checksum(stencil.mean_adapt_bin(by_image(tables.gray_tile(spark, sf_dir)), 5, 2))


@query("gauss_adaptive", f"WITH {TILE}, {_near('tile', [(dy, dx, _G5[dy + 2] * _G5[dx + 2]) for dy, dx in _sq(2)], 8, _replicate)}, o AS (SELECT image_id, y, x, CASE WHEN any_value(v) > floor(sum(u * w) + 0.5)::INT - 2 THEN 255 ELSE 0 END AS v FROM nb GROUP BY image_id, y, x) SELECT image_id, {_CHECKSUM} FROM o GROUP BY image_id")
def gauss_adaptive(spark, sf_dir):
    return _checksum(stencil.gauss_adapt_bin(by_image(tables.gray_tile(spark, sf_dir)), 5, 2))


# Texture

_GLCM_ROWS = ", ".join(f"({d}, {a}, {dy}, {dx})" for d, a, dy, dx in texture.glcm_offsets((1, 2, 3), (0, 45, 90, 135)))
_PAIRS = f"pr AS (SELECT p.image_id, d, angle, least(p.v, q.v) AS lo, greatest(p.v, q.v) AS hi, count(*) AS n FROM {{0}} p, (VALUES {_GLCM_ROWS}) AS o(d, angle, dy, dx) JOIN {{0}} q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL)"


@query("glcm_counts", f"WITH {TILE}, t8 AS (SELECT image_id, y, x, v // 32 AS v FROM tile), {_PAIRS.format('t8')} SELECT * FROM pr")
def glcm_counts(spark, sf_dir):
    return texture.glcm_counts(by_image(tables.gray_tile(spark, sf_dir)), levels=8)


@query(
    "glcm_props",
    f"""WITH {MOSAIC}, {_PAIRS.format("mosaic")}, s AS (SELECT image_id, d, angle, sum(n) AS t, sum(n * (hi - lo) * (hi - lo)) AS con, sum(n * (hi - lo)) AS dis, sum(n::DOUBLE / (1 + (hi - lo) * (hi - lo))) AS hom,
  sum(CASE WHEN lo = hi THEN 4 * n * n ELSE 2 * n * n END) AS sq, sum(n * (lo + hi)) AS s, sum(n * (lo * lo + hi * hi)) AS q, sum(n * lo * hi) AS ij FROM pr GROUP BY ALL)
SELECT image_id, d, angle, round(con::DOUBLE / t, 6) AS contrast, round(dis::DOUBLE / t, 6) AS dissimilarity, round(hom / t, 6) AS homogeneity, round(sq::DOUBLE / (4 * t * t), 6) AS asm, round(sqrt(sq::DOUBLE / (4 * t * t)), 6) AS energy,
  round(CASE WHEN 2 * t * q - s * s = 0 THEN 1.0 ELSE (4 * t * ij - s * s)::DOUBLE / (2 * t * q - s * s)::DOUBLE END, 6) + 0.0 AS correlation FROM s""",
)
def glcm_props(spark, sf_dir):
    return _rounded(texture.glcm(by_image(tables.gray_mosaic(spark, sf_dir))))


def _lbp_sql() -> str:
    samples = texture.lbp_samples(8, 1)
    rows = ", ".join(f"({k}, {dy}, {dx}, {w!r}::DOUBLE)" for k, cells in enumerate(samples) for dy, dx, w in cells)
    bits = ", ".join(f"max(CASE WHEN k = {k} THEN bit END) AS b{k}" for k in range(8))
    ones, changes = " + ".join(f"b{k}" for k in range(8)), " + ".join(f"abs(b{k} - b{(k + 1) % 8})" for k in range(8))
    return f"""smp AS (SELECT p.image_id, p.y, p.x, k, (round(sum(coalesce(q.v, 0) * w), 9) >= any_value(p.v))::INT AS bit FROM tile p CROSS JOIN (VALUES {rows}) AS o(k, dy, dx, w)
  LEFT JOIN tile q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.image_id, p.y, p.x, k),
bt AS (SELECT image_id, y, x, {bits} FROM smp GROUP BY ALL), cd AS (SELECT image_id, CASE WHEN {changes} <= 2 THEN {ones} ELSE 9 END AS code FROM bt), lh AS (SELECT image_id, code, count(*) AS n FROM cd GROUP BY ALL)"""


@query("lbp_hist", f"WITH {TILE}, {_lbp_sql()} SELECT image_id, code, n FROM lh")
def lbp_hist(spark, sf_dir):
    return texture.lbp_histogram(by_image(tables.gray_tile(spark, sf_dir)))


@query(
    "lbp_stats",
    f"""WITH {TILE}, {_lbp_sql()}, x AS (SELECT image_id, sum(n) AS n, count(*) AS used, sum(n * code)::DOUBLE / sum(n) AS m FROM lh GROUP BY image_id),
y AS (SELECT image_id, any_value(x.n) AS n, any_value(used) AS used, any_value(m) AS m, sum(lh.n * power(code - m, 2)) / any_value(x.n) AS v2, sum(lh.n * power(code - m, 3)) / any_value(x.n) AS v3, sum(lh.n * power(code - m, 4)) / any_value(x.n) AS v4,
  sum(power(lh.n::DOUBLE / x.n, 2)) AS en, -sum(lh.n::DOUBLE / x.n * log2(lh.n::DOUBLE / x.n)) AS e FROM lh JOIN x USING (image_id) GROUP BY image_id)
SELECT image_id, round(m, 6) AS lbp_mean, round(sqrt(v2), 6) AS lbp_std, CASE WHEN v2 < 1e-12 THEN 0.0 ELSE round(v3 / power(v2, 1.5), 6) END + 0.0 AS lbp_skewness, CASE WHEN v2 < 1e-12 THEN 0.0 ELSE round(v4 / (v2 * v2) - 3, 6) END + 0.0 AS lbp_kurtosis,
  CASE WHEN used <= 1 THEN 0.0 ELSE round(e / log2(10), 6) END AS lbp_entropy, round(en, 6) AS lbp_energy FROM y""",
)
def lbp_stats(spark, sf_dir):
    return _rounded(texture.lbp(by_image(tables.gray_tile(spark, sf_dir))))


_HLAC = ", ".join(f"({k}, {m})" for k, m in enumerate(texture.hlac_kernels()))


@query(
    "hlac",
    f"""WITH {TILE}, bin AS (SELECT image_id, y, x, (v > 128)::INT AS v FROM tile), mk AS (SELECT p.image_id, p.y, p.x, sum(q.v << (3 * (q.y - p.y + 1) + q.x - p.x + 1)) AS mask FROM bin p JOIN bin q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1
  WHERE p.y BETWEEN 1 AND 6 AND p.x BETWEEN 1 AND 6 GROUP BY ALL) SELECT image_id, k, sum(CASE WHEN (mask::BIGINT & m) = m THEN 1 ELSE 0 END)::BIGINT AS count FROM mk, (VALUES {_HLAC}) AS o(k, m) GROUP BY ALL""",
)
def hlac(spark, sf_dir):
    return texture.hlac(histogram.std_bin(by_image(tables.gray_tile(spark, sf_dir))))


@query("hlac_multiscale")
def hlac_multiscale(spark, sf_dir):
    return _rounded(texture.hlac_multiscale(tables.whole_tiles(spark, sf_dir)))


# Frequencies

_DFT8 = """hn AS (SELECT image_id, y, x, v * (0.5 - 0.5 * cos(2 * pi() * y / 7)) * (0.5 - 0.5 * cos(2 * pi() * x / 7)) AS v FROM tile),
rp AS (SELECT image_id, y, kx, sum(v * cos(2 * pi() * kx * x / 8)) AS re, -sum(v * sin(2 * pi() * kx * x / 8)) AS im FROM hn, unnest(range(0, 8)) AS r(kx) GROUP BY ALL),
cp AS (SELECT image_id, ky, kx, sum(re * cos(2 * pi() * ky * y / 8) + im * sin(2 * pi() * ky * y / 8)) AS re, sum(im * cos(2 * pi() * ky * y / 8) - re * sin(2 * pi() * ky * y / 8)) AS im FROM rp, unnest(range(0, 8)) AS r(ky) GROUP BY ALL),
sp AS (SELECT image_id, CASE WHEN ky < 4 THEN ky ELSE ky - 8 END AS ky, CASE WHEN kx < 4 THEN kx ELSE kx - 8 END AS kx, CASE WHEN kx = 0 AND ky = 0 THEN 0.0 ELSE sqrt(re * re + im * im) END AS mag FROM cp),
mp AS (SELECT *, mag * mag AS p, sqrt((kx * kx + ky * ky)::DOUBLE) / 8 AS f, ((degrees(atan2(ky::DOUBLE, kx::DOUBLE)) + 360) % 180) AS a FROM sp)"""


@query(
    "fft_features",
    f"""WITH {TILE}, {_DFT8}, e AS (SELECT *, least(abs(a - 90), 180 - abs(a - 90)) <= 10 AS ver, least(a, 180 - a) <= 10 AS hor FROM mp)
SELECT image_id, round(sum(CASE WHEN f < 0.1 THEN p ELSE 0 END) / sum(p), 6) AS band_1, round(sum(CASE WHEN f >= 0.1 AND f < 0.3 THEN p ELSE 0 END) / sum(p), 6) AS band_2, round(sum(CASE WHEN f >= 0.3 THEN p ELSE 0 END) / sum(p), 6) AS band_3,
  round(sum(CASE WHEN f >= 0.2 THEN p ELSE 0 END) / sum(CASE WHEN f < 0.2 THEN p ELSE 0 END), 4) AS high_low_ratio, round(sum(mag * f) / sum(mag), 6) AS spectral_centroid,
  round(sqrt(sum(mag * f * f) / sum(mag) - power(sum(mag * f) / sum(mag), 2)), 6) AS spectral_std, round(sum(CASE WHEN hor THEN p ELSE 0 END) / sum(p), 6) AS horizontal_energy, round(sum(CASE WHEN ver THEN p ELSE 0 END) / sum(p), 6) AS vertical_energy,
  round((log2(sum(mag)) - sum(CASE WHEN mag > 0 THEN mag * log2(mag) ELSE 0 END) / sum(mag)) / log2(64), 6) AS spectral_entropy FROM e GROUP BY image_id""",
)
def fft_features(spark, sf_dir):
    f = spectral.fft_features(by_image(tables.gray_tile(spark, sf_dir)))
    f = f.withColumnsRenamed({"band_1_0.00_0.10": "band_1", "band_2_0.10_0.30": "band_2", "band_3_0.30_0.50": "band_3"})
    cols = ["band_1", "band_2", "band_3", "spectral_centroid", "spectral_std", "horizontal_energy", "vertical_energy", "spectral_entropy"]
    return f.select("image_id", *((F.round(c, 6) + 0.0).alias(c) for c in cols), F.round("high_low_ratio", 4).alias("high_low_ratio"))


def _entropy_sql(inside: str) -> str:
    n, t = f"count(*) FILTER ({inside})", f"coalesce(sum(mag) FILTER ({inside}), 0)"
    return f"CASE WHEN {n} <= 1 OR {t} <= 0 THEN 0.0 ELSE round((log2({t}) - coalesce(sum(mag * log2(mag)) FILTER (({inside}) AND mag > 0), 0) / {t}) / log2({n}), 6) END"


@query(
    "fft_peaks_entropies",
    f"""WITH {TILE}, {_DFT8}, e AS (SELECT *, least(abs(a - 90), 180 - abs(a - 90)) <= 10 AS ver, least(a, 180 - a) <= 10 AS hor, max(mag) OVER (PARTITION BY image_id) AS top FROM mp),
nb AS (SELECT p.image_id, p.ky, p.kx, max(q.mag) AS m FROM mp p JOIN mp q ON q.image_id = p.image_id AND abs(q.ky - p.ky) <= 1 AND abs(q.kx - p.kx) <= 1 GROUP BY ALL),
k AS (SELECT e.*, mag = m AND mag > top * 0.1 AS peak FROM e JOIN nb USING (image_id, ky, kx))
SELECT image_id, count(*) FILTER (peak) AS num_peaks, round(coalesce(max(mag) FILTER (peak), 0), 6) AS max_peak_amp, {_entropy_sql("hor")} AS horizontal_entropy, {_entropy_sql("ver")} AS vertical_entropy,
  {_entropy_sql("f < 0.1")} AS low_entropy, {_entropy_sql("f >= 0.1 AND f < 0.3")} AS middle_entropy, {_entropy_sql("f >= 0.3")} AS high_entropy FROM k GROUP BY image_id""",
)
def fft_peaks_entropies(spark, sf_dir):
    f = spectral.fft_features(by_image(tables.gray_tile(spark, sf_dir)))
    bands = {"band_1_0.00_0.10_entropy": "low_entropy", "band_2_0.10_0.30_entropy": "middle_entropy", "band_3_0.30_0.50_entropy": "high_entropy"}
    return _rounded(f.withColumnsRenamed(bands).select("image_id", "num_peaks", "max_peak_amp", "horizontal_entropy", "vertical_entropy", *bands.values()))


@query("fft_all")
def fft_all(spark, sf_dir):
    f = spectral.fft_features(by_image(tables.gray_tile(spark, sf_dir)))
    return _rounded(f.toDF(*(c.replace(".", "p") for c in f.columns)))


@query(
    "swt_features",
    f"""WITH {TILE}, t AS (SELECT image_id, y, x, v / (CASE WHEN max(v) OVER (PARTITION BY image_id) > 1 THEN 255.0::DOUBLE ELSE 1 END) AS v FROM tile),
q AS (SELECT a.image_id, a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM t a JOIN t b ON b.image_id = a.image_id AND b.y = a.y AND b.x = (a.x + 1) % 8 JOIN t c ON c.image_id = a.image_id AND c.y = (a.y + 1) % 8 AND c.x = a.x JOIN t d ON d.image_id = a.image_id AND d.y = (a.y + 1) % 8 AND d.x = (a.x + 1) % 8),
k AS (SELECT image_id, 'll' AS band, (a + b + c + d) / 2 AS c FROM q UNION ALL SELECT image_id, 'hl', (a - b + c - d) / 2 FROM q UNION ALL SELECT image_id, 'lh', (a + b - c - d) / 2 FROM q UNION ALL SELECT image_id, 'hh', (a - b - c + d) / 2 FROM q),
f AS (SELECT image_id, band, avg(c) AS m, sum(c * c) AS e FROM k GROUP BY ALL), dt AS (SELECT image_id, sum(e) AS t FROM f WHERE band <> 'll' GROUP BY 1)
SELECT image_id, 1 AS level, band, round(m, 6) + 0.0 AS mean, round(e, 6) AS energy, CASE WHEN band <> 'll' THEN round(CASE WHEN t > 0 THEN e / t ELSE 0 END, 6) END AS energy_ratio FROM f JOIN dt USING (image_id)""",
)
def swt_features(spark, sf_dir):
    f = spectral.swt_features(by_image(tables.gray_tile(spark, sf_dir)))
    return _rounded(f.select("image_id", "level", "band", "mean", "energy", "energy_ratio"))


@query(
    "swt_spread",
    f"""WITH {TILE}, t AS (SELECT image_id, y, x, v / (CASE WHEN max(v) OVER (PARTITION BY image_id) > 1 THEN 255.0::DOUBLE ELSE 1 END) AS v FROM tile),
q AS (SELECT a.image_id, a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM t a JOIN t b ON b.image_id = a.image_id AND b.y = a.y AND b.x = (a.x + 1) % 8 JOIN t c ON c.image_id = a.image_id AND c.y = (a.y + 1) % 8 AND c.x = a.x JOIN t d ON d.image_id = a.image_id AND d.y = (a.y + 1) % 8 AND d.x = (a.x + 1) % 8),
k AS (SELECT image_id, 'll' AS band, round((a + b + c + d) / 2, 9) AS c FROM q UNION ALL SELECT image_id, 'hl', round((a - b + c - d) / 2, 9) FROM q UNION ALL SELECT image_id, 'lh', round((a + b - c - d) / 2, 9) FROM q UNION ALL SELECT image_id, 'hh', round((a - b - c + d) / 2, 9) FROM q),
m AS (SELECT *, min(c) OVER w AS lo, max(c) OVER w AS hi FROM k WINDOW w AS (PARTITION BY image_id, band)),
h AS (SELECT image_id, band, CASE WHEN hi > lo THEN floor((c - lo) / (hi - lo) * 255) ELSE 0 END AS bin, count(*) AS n, sum(c) AS s, sum(c * c) AS q FROM m GROUP BY ALL)
SELECT image_id, band, round(sqrt(greatest(sum(q) / sum(n) - power(sum(s) / sum(n), 2), 0)), 6) AS std, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS entropy FROM h GROUP BY ALL""",
)
def swt_spread(spark, sf_dir):
    f = spectral.swt_features(by_image(tables.gray_tile(spark, sf_dir)))
    return _rounded(f.select("image_id", "band", "std", "entropy"))


_PLAIN8 = """rp AS (SELECT image_id, y, kx, sum(v * cos(2 * pi() * kx * x / 8)) AS re, -sum(v * sin(2 * pi() * kx * x / 8)) AS im FROM tile, unnest(range(0, 8)) AS r(kx) GROUP BY ALL),
cp AS (SELECT image_id, ky, kx, sum(re * cos(2 * pi() * ky * y / 8) + im * sin(2 * pi() * ky * y / 8)) AS re, sum(im * cos(2 * pi() * ky * y / 8) - re * sin(2 * pi() * ky * y / 8)) AS im FROM rp, unnest(range(0, 8)) AS r(ky) GROUP BY ALL)"""
_STRETCH = "st AS (SELECT image_id, y, x, CASE WHEN max(v) OVER w > min(v) OVER w THEN floor((v - min(v) OVER w) * 255.0::DOUBLE / (max(v) OVER w - min(v) OVER w))::INT ELSE 0 END AS v FROM raw WINDOW w AS (PARTITION BY image_id))"


@query("log_spectrum", f"WITH {TILE}, {_PLAIN8}, raw AS (SELECT image_id, (ky + 4) % 8 AS y, (kx + 4) % 8 AS x, round(20 * ln(sqrt(re * re + im * im) + 1), 6) AS v FROM cp), {_STRETCH} SELECT image_id, {_CHECKSUM} FROM st GROUP BY image_id")
def log_spectrum(spark, sf_dir):
    return _checksum(spectral.log_spectrum(by_image(tables.gray_tile(spark, sf_dir))))


@query(
    "lowpass",
    f"""WITH {TILE}, {_PLAIN8}, kp AS (SELECT * FROM cp WHERE power(least(ky, 8 - ky), 2) + power(least(kx, 8 - kx), 2) <= 4),
rb AS (SELECT image_id, ky, x, sum(re * cos(2 * pi() * kx * x / 8) - im * sin(2 * pi() * kx * x / 8)) AS re, sum(re * sin(2 * pi() * kx * x / 8) + im * cos(2 * pi() * kx * x / 8)) AS im FROM kp, unnest(range(0, 8)) AS r(x) GROUP BY ALL),
cb AS (SELECT image_id, y, x, sum(re * cos(2 * pi() * ky * y / 8) - im * sin(2 * pi() * ky * y / 8)) AS re, sum(re * sin(2 * pi() * ky * y / 8) + im * cos(2 * pi() * ky * y / 8)) AS im FROM rb, unnest(range(0, 8)) AS r(y) GROUP BY ALL),
raw AS (SELECT image_id, y, x, round(sqrt(re * re + im * im) / 64, 6) AS v FROM cb), {_STRETCH} SELECT image_id, {_CHECKSUM} FROM st GROUP BY image_id""",
)
def lowpass(spark, sf_dir):
    return _checksum(spectral.ideal_filter(by_image(tables.gray_tile(spark, sf_dir)), "lowpass", 2))


@query(
    "highpass",
    f"""WITH {TILE}, {_PLAIN8}, kp AS (SELECT * FROM cp WHERE power(least(ky, 8 - ky), 2) + power(least(kx, 8 - kx), 2) > 4),
rb AS (SELECT image_id, ky, x, sum(re * cos(2 * pi() * kx * x / 8) - im * sin(2 * pi() * kx * x / 8)) AS re, sum(re * sin(2 * pi() * kx * x / 8) + im * cos(2 * pi() * kx * x / 8)) AS im FROM kp, unnest(range(0, 8)) AS r(x) GROUP BY ALL),
cb AS (SELECT image_id, y, x, sum(re * cos(2 * pi() * ky * y / 8) - im * sin(2 * pi() * ky * y / 8)) AS re, sum(re * sin(2 * pi() * ky * y / 8) + im * cos(2 * pi() * ky * y / 8)) AS im FROM rb, unnest(range(0, 8)) AS r(y) GROUP BY ALL),
raw AS (SELECT image_id, y, x, round(sqrt(re * re + im * im) / 64, 6) AS v FROM cb), {_STRETCH} SELECT image_id, {_CHECKSUM} FROM st GROUP BY image_id""",
)
def highpass(spark, sf_dir):
    return _checksum(spectral.ideal_filter(by_image(tables.gray_tile(spark, sf_dir)), "highpass", 2))


# Geometry


@query("resize_area", f"WITH {TILE} SELECT image_id, {_CHECKSUM} FROM (SELECT image_id, y // 2 AS y, x // 2 AS x, floor(sum(v) / 4.0 + 0.5)::INT AS v FROM tile GROUP BY ALL) GROUP BY image_id")
def resize_area(spark, sf_dir):
    return _checksum(geometry.resize(tables.whole_tiles(spark, sf_dir), 4, 4, preserve_aspect_ratio=False))


@query("fit_within", f"WITH {TILE} SELECT image_id, {_CHECKSUM} FROM (SELECT image_id, y // 2 AS y, x // 2 AS x, floor(sum(v) / 4.0 + 0.5)::INT AS v FROM tile GROUP BY ALL) GROUP BY image_id")
def fit_within(spark, sf_dir):
    return _checksum(geometry.fit_within(tables.whole_tiles(spark, sf_dir), 6, 4))


@query(
    "resize_linear",
    f"""WITH {TILE}, d AS (SELECT t AS d, greatest(0.0, least(7.0, (t + 0.5) * 0.5 - 0.5))::DOUBLE AS s FROM unnest(range(0, 16)) AS r(t)), w AS (SELECT d, i, greatest(0.0, 1 - abs(s - i)) AS w FROM d, unnest(range(0, 8)) AS r(i))
SELECT image_id, {_CHECKSUM} FROM (SELECT image_id, wy.d AS y, wx.d AS x, floor(round(sum(v * wy.w * wx.w), 9) + 0.5)::INT AS v FROM tile JOIN w wy ON wy.i = y AND wy.w > 0 JOIN w wx ON wx.i = x AND wx.w > 0 GROUP BY ALL) GROUP BY image_id""",
)
def resize_linear(spark, sf_dir):
    return _checksum(geometry.resize(tables.whole_tiles(spark, sf_dir), 16, 16, preserve_aspect_ratio=False))


@query("roi_crop", f"WITH {MOSAIC} SELECT image_id, {_CHECKSUM} FROM (SELECT image_id, y - 8 AS y, x - 16 AS x, v FROM mosaic WHERE y BETWEEN 8 AND 63 AND x BETWEEN 16 AND 47) GROUP BY image_id")
def roi_crop(spark, sf_dir):
    return _checksum(geometry.roi_crop(by_image(tables.gray_mosaic(spark, sf_dir)), 16, 8, 32, 100))


@query(
    "roi_by_table",
    f"""WITH {MOSAIC}, box AS (SELECT * FROM (VALUES (0, 4, 10, 20, 30), (0, 9, 0, 3, 3), (1, 60, 60, 99, 99), (2, 0, 0, 0, 5)) AS b(camera, bx, by_, bw, bh) QUALIFY row_number() OVER (PARTITION BY camera ORDER BY bx, by_, bw, bh) = 1),
placed AS (SELECT m.*, CASE WHEN least(64, bx + bw) > bx AND least(64, by_ + bh) > by_ THEN bx END AS bx, by_, bw, bh FROM mosaic m LEFT JOIN box ON image_id % 4 = camera)
SELECT image_id, {_CHECKSUM} FROM (SELECT image_id, CASE WHEN bx IS NULL THEN y ELSE y - by_ END AS y, CASE WHEN bx IS NULL THEN x ELSE x - bx END AS x, v FROM placed WHERE bx IS NULL OR (x >= bx AND x < bx + bw AND y >= by_ AND y < by_ + bh)) GROUP BY image_id""",
)
def roi_by_table(spark, sf_dir):
    boxes = spark.createDataFrame([(0, 4, 10, 20, 30), (0, 9, 0, 3, 3), (1, 60, 60, 99, 99), (2, 0, 0, 0, 5)], "camera int, x int, y int, w int, h int")
    m = by_image(tables.gray_mosaic(spark, sf_dir)).withColumn("camera", (F.col("image_id") % 4).cast("int"))
    return _checksum(geometry.roi_by_table(m, boxes))


@query("mask_of_another_size", f"WITH {TILE}, small AS (SELECT image_id, y // 2 AS y, x // 2 AS x, floor(avg(v) + 0.5)::INT AS v FROM tile GROUP BY ALL) SELECT image_id, {_CHECKSUM} FROM (SELECT image_id, y, x, CASE WHEN v > 130 THEN v ELSE 0 END AS v FROM small) GROUP BY image_id")
def mask_of_another_size(spark, sf_dir):
    """Masks of half the size: the targets shrink to them."""
    tile = by_image(tables.gray_tile(spark, sf_dir)).select("image_id", "y", "x", "v")
    mask = histogram.std_bin(geometry.resize(tile, 4, 4, preserve_aspect_ratio=False), 130)
    return _checksum(geometry.mask_composition(tile, mask, resize_target=True))


@query("mask_compose", f"WITH {TILE}, w AS (SELECT image_id, greatest(0, min(y) FILTER (v > 150) - 1) AS ay, max(y) FILTER (v > 150) + 1 AS by_, greatest(0, min(x) FILTER (v > 150) - 1) AS ax, max(x) FILTER (v > 150) + 1 AS bx FROM tile GROUP BY image_id) SELECT image_id, {_CHECKSUM} FROM (SELECT image_id, y - coalesce(ay, 0) AS y, x - coalesce(ax, 0) AS x, CASE WHEN v > 150 THEN v ELSE 0 END AS v FROM tile JOIN w USING (image_id) WHERE by_ IS NULL OR (y BETWEEN ay AND by_ AND x BETWEEN ax AND bx)) GROUP BY image_id")
def mask_compose(spark, sf_dir):
    tile = by_image(tables.gray_tile(spark, sf_dir)).drop("class")
    return _checksum(geometry.mask_composition(tile, histogram.std_bin(tile, 150), enable_cropping=True, crop_margin=1))


@query("letterbox", f"WITH {TILE}, im AS (SELECT DISTINCT image_id FROM tile), g AS (SELECT image_id, y, x FROM im, unnest(range(0, 8)) AS a(y), unnest(range(0, 12)) AS b(x)) SELECT image_id, {_CHECKSUM} FROM (SELECT g.image_id, g.y, g.x, coalesce(t.v, 114) AS v FROM g LEFT JOIN tile t ON t.image_id = g.image_id AND t.y = g.y AND t.x = g.x - 2) GROUP BY image_id")
def letterbox(spark, sf_dir):
    return _checksum(geometry.letterbox(by_image(tables.gray_tile(spark, sf_dir)), 12, 8))
