"""Edges, connected regions, contours and circles. Each image is labelled, traced and searched as one array in the task of its
group, so an operator deals its pixels once, by image; label_runs and components can take bands of rows instead, for images
that are larger than a task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lumenframe.operators import arrays, borders, grid, stencil
from lumenframe.sources.tables import dims

RETRIEVAL = ("external", "list", "ccomp", "tree")


def runs(binary: DataFrame, value: str = "v > 0") -> DataFrame:
    """image_id, y, x0, x1, run: maximal horizontal stretches of set pixels; run orders them within the image."""
    on = binary.where(value).select("image_id", "y", "x")
    on = on.withColumn("__g", F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x")))
    out = on.groupBy("image_id", "y", "__g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return out.select("image_id", "y", "x0", "x1", (F.col("y").cast("long") * (1 << 31) + F.col("x0")).alias("run"))


def label_runs(r: DataFrame, diagonal: bool = True, band_rows: int | None = None) -> DataFrame:
    """Adds region: the least run that touches a run over any number of steps.

    An image's runs are united in one task. With band_rows each band of so many rows is, and the regions that meet at
    the bands' edges are united by image afterwards: of those only names are held at once.
    """
    kind = arrays.id_type(r)

    def united(table: pa.Table) -> pa.Table:
        table = table.sort_by("run")
        y, x0, x1, run = (table[c].to_numpy() for c in ("y", "x0", "x1", "run"))
        root = borders.label(borders.Runs(y, x0, x1), diagonal)
        return table.select(["image_id", "y", "x0", "x1", "run"]).append_column("region", pa.array(run[root]))

    r = r.select("image_id", F.col("y").cast("int").alias("y"), F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"), "run")
    schema = f"image_id {kind}, y int, x0 int, x1 int, run long, region long"
    if band_rows is None:
        return r.groupBy("image_id").applyInArrow(united, schema)
    band = F.floor(F.col("y") / band_rows)
    parts = r.groupBy("image_id", band.alias("band")).applyInArrow(united, schema)
    reach = 1 if diagonal else 0
    upper = parts.where(F.pmod(F.col("y"), F.lit(band_rows)) == band_rows - 1).select("image_id", (band + 1).alias("band"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("region").alias("u"))
    lower = parts.where(F.pmod(F.col("y"), F.lit(band_rows)) == 0).select("image_id", band.alias("band"), "x0", "x1", F.col("region").alias("w"))
    met = upper.join(lower, ["image_id", "band"]).where((F.col("x0") <= F.col("u1") + reach) & (F.col("x1") >= F.col("u0") - reach)).select("image_id", "u", "w").distinct()

    def joined(table: pa.Table) -> dict[str, np.ndarray]:
        names, ends = np.unique(np.concatenate([table["u"].to_numpy(), table["w"].to_numpy()]), return_inverse=True)
        root = borders.connected(len(names), *np.split(ends, 2))
        return {"region": names, "whole": names[root]}

    whole = arrays.per_image(met, joined, "region long, whole long")
    return parts.join(whole, ["image_id", "region"], "left").select("image_id", "y", "x0", "x1", "run", F.coalesce("whole", "region").alias("region"))


def pixels_of(labelled: DataFrame) -> DataFrame:
    """image_id, y, x, region of labelled runs."""
    return labelled.select("image_id", "y", "region", F.explode(F.sequence("x0", "x1")).alias("x"))


def components(binary: DataFrame, diagonal: bool = True, band_rows: int | None = None) -> DataFrame:
    """image_id, region, n_pixels, y0, y1, x0, x1 of each connected region of set pixels. band_rows: see label_runs."""
    if band_rows is not None:
        l = label_runs(runs(binary), diagonal, band_rows)
        return l.groupBy("image_id", "region").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("n_pixels"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))

    def found(table: pa.Table) -> dict[str, np.ndarray]:
        r = borders.runs(arrays.image(table, kind=bool))
        first, of = np.unique(borders.label(r, diagonal), return_inverse=True)
        low, high = (lambda x: (np.minimum.reduceat(x[order], at) if len(at) else x[:0])), (lambda x: (np.maximum.reduceat(x[order], at) if len(at) else x[:0]))
        order = np.argsort(of, kind="stable")
        at = np.searchsorted(of[order], np.arange(len(first)))
        n = np.bincount(of, r.x1 - r.x0 + 1, len(first)).astype(np.int64)
        box = {"y0": low(r.y), "y1": high(r.y), "x0": low(r.x0), "x1": high(r.x1)}
        return {"region": r.names()[first], "n_pixels": n} | {k: x.astype(np.int32) for k, x in box.items()}

    return arrays.per_image(_set(binary), found, "region long, n_pixels long, y0 int, y1 int, x0 int, x1 int")


def _set(binary: DataFrame, *more: str) -> DataFrame:
    """image_id, y, x, v: whether a pixel is set."""
    return binary.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), (F.col("v") > 0).alias("v"), *more)


def _retrieval(mode: str) -> None:
    if mode == "floodfill":
        raise ValueError("floodfill needs a labelled image")
    if mode not in RETRIEVAL:
        raise ValueError(f"retrieval {mode!r}")


def _tree(mask: np.ndarray, retrieval: str) -> dict[str, np.ndarray]:
    """region, parent (-1: none), is_hole, level under a retrieval mode."""
    r = borders.regions(mask)
    above, within = r.levels()
    out = {"region": np.concatenate([r.region, r.hole]), "parent": np.concatenate([r.region_parent, r.hole_parent]), "is_hole": np.arange(len(r.region) + len(r.hole)) >= len(r.region), "level": np.concatenate([above, within])}
    if retrieval == "external":
        out = {k: x[:len(above)][above == 0] for k, x in out.items()}
    if retrieval == "ccomp":
        out |= {"parent": np.where(out["is_hole"], out["parent"], -1), "level": out["is_hole"].astype(np.int64)}
    if retrieval == "list":
        out |= {"parent": np.full(len(out["region"]), -1), "level": np.zeros(len(out["region"]), np.int64)}
    return out


def hierarchy(binary: DataFrame, retrieval: str = "tree") -> DataFrame:
    """image_id, region, parent, is_hole, level. Holes are unset regions (4 neighbours) that don't touch the frame; they lie in
    the region left of them, regions in the hole around them or in none. retrieval: `tree` all levels; `ccomp` two, regions
    and their holes; `list` all without parents; `external` the regions that lie in no hole."""
    _retrieval(retrieval)

    def found(table: pa.Table) -> dict[str, np.ndarray]:
        out = _tree(arrays.image(table, kind=bool), retrieval)
        parent = out["parent"]
        return {"region": out["region"], "parent": pa.array(parent, pa.int64(), mask=parent < 0), "is_hole": out["is_hole"], "level": out["level"].astype(np.int32)}

    return arrays.per_image(_set(binary), found, "region long, parent long, is_hole boolean, level int")


def _names(b: borders.Borders, r: borders.Regions) -> np.ndarray:
    """The region or hole of each border; a hole lies right of its border's first pixel."""
    y, x = b.y[b.first[:-1]], b.x[b.first[:-1]]
    return np.where(b.is_hole, r.back[y, np.minimum(x + 1, r.back.shape[1] - 1)], r.front[y, x])


def trace(binary: DataFrame, retrieval: str = "list", approximation: str = "simple") -> DataFrame:
    """image_id, region, is_hole, k, y, x: the borders of regions and holes as set pixels in order, k from 0. A region's border
    begins at its first pixel and goes down, a hole's at the pixel left of it and goes up. approximation `none`: all pixels;
    `simple`: without those inside straight stretches; `tc89_l1` and `tc89_kcos` are taken as `simple`."""
    _retrieval(retrieval)
    if approximation not in ("none", "simple", "tc89_l1", "tc89_kcos"):
        raise ValueError(f"approximation {approximation!r}")

    def found(table: pa.Table) -> dict[str, np.ndarray]:
        mask = arrays.image(table, kind=bool)
        b = borders.borders(mask)
        name = _names(b, borders.regions(mask))
        keep = np.ones(len(b.y), bool) if approximation == "none" else borders.corners(b)
        keep &= np.isin(name, _tree(mask, retrieval)["region"])[b.border]
        of = b.border[keep]
        k = np.arange(len(of)) - np.searchsorted(of, of)
        return {"region": name[of], "is_hole": b.is_hole[of], "k": k.astype(np.int32), "y": b.y[keep].astype(np.int32), "x": b.x[keep].astype(np.int32)}

    return arrays.per_image(_set(binary), found, "region long, is_hole boolean, k int, y int, x int")


def contours(binary: DataFrame, fill: bool = True) -> DataFrame:
    """image_id, region, area, perimeter of the polygon through the border pixels' centres: a border step is 1 along an axis,
    sqrt(2) across. Without fill the holes' areas are taken off and their borders added."""

    def found(table: pa.Table) -> dict[str, np.ndarray]:
        mask = arrays.image(table, kind=bool)
        b, r = borders.borders(mask), borders.regions(mask)
        area, length = borders.measures(b)
        own = r.front[b.y[b.first[:-1]], b.x[b.first[:-1]]]
        sign = np.where(b.is_hole, 0.0 if fill else -1.0, 1.0)
        name, of = np.unique(own, return_inverse=True)
        return {"region": name, "area": np.bincount(of, area * sign, len(name)), "perimeter": np.bincount(of, length * np.abs(sign), len(name))}

    return arrays.per_image(_set(binary), found, "region long, area double, perimeter double")


def contour(binary: DataFrame, min_area: float = 100, select_mode: str = "rank", contour_rank: int = 0, inside: int = 255, outside: int = 0, retrieval: str = "external") -> DataFrame:
    """image_id, y, x, v: selected borders painted, filled inside on outside. `rank`: the border of that place by area (the
    largest if there are fewer); `all`: every one of at least min_area. An image with more than three values is returned as
    it is. retrieval `external`: borders of regions that lie in no hole; else those of all regions and holes, and with `all`
    what lies inside an even number of them is not painted, so holes stay."""
    _retrieval(retrieval)

    def found(table: pa.Table) -> dict[str, np.ndarray]:
        v, y, x = table["v"].to_numpy(), table["y"].to_numpy(), table["x"].to_numpy()
        if len(np.unique(v)) <= 3:
            mask = arrays.image(table, kind=float) > 0
            b, r = borders.borders(mask), borders.regions(mask)
            name, area = _names(b, r), borders.measures(b)[0]
            able = np.isin(name, _tree(mask, retrieval)["region"]) & (area >= min_area)
            chosen = np.flatnonzero(able)
            if select_mode == "rank" and len(chosen):
                chosen = chosen[np.lexsort((name[chosen], -area[chosen]))]
                chosen = chosen[[contour_rank if contour_rank < len(chosen) else 0]]
            paint = _inside(r, name[chosen])
            line = np.isin(b.border, chosen)
            paint[b.y[line], b.x[line]] = True
            v = np.where(paint[y, x], inside, outside).astype(np.int32)
        return {"y": y, "x": x, "v": v}

    df = binary.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("int").alias("v"))
    return arrays.per_image(df, found, "y int, x int, v int")


def _inside(r: borders.Regions, chosen: np.ndarray) -> np.ndarray:
    """The pixels inside an odd number of the chosen borders (by the names of their regions and holes)."""
    name = np.concatenate([r.region, r.hole])
    parent = np.concatenate([r.region_parent, r.hole_parent])
    order = np.argsort(name)
    up = np.full(len(name) + 1, len(name))
    some = parent >= 0
    up[:-1][some] = order[np.searchsorted(name[order], parent[some])]
    count = np.append(np.isin(name, chosen), False).astype(np.int64)
    while (up != len(name)).any():  # counts of all around, by pointer doubling
        count, up = count + np.where(up != len(name), count[up], 0), up[up]
    at = np.where(r.front >= 0, r.front, r.back)
    odd = np.append(name[count[:-1] % 2 == 1], -2)
    return np.isin(at, odd)


def gradients(gray: DataFrame, aperture_size: int = 3) -> DataFrame:
    """image_id, y, x, v, height, width, gx, gy: Sobel, borders replicated. Larger apertures smooth by binomial weights."""
    if aperture_size not in (3, 5, 7):
        raise ValueError(f"aperture_size {aperture_size}")
    if aperture_size > 3:
        k = aperture_size - 1
        smooth, inner = [math.comb(k, i) for i in range(k + 1)], [math.comb(k - 2, i) for i in range(k - 1)]
        slope = [(inner[i - 2] if i >= 2 else 0) - (inner[i] if i < len(inner) else 0) for i in range(k + 1)]
        sized, keys = grid.sized(gray.select("image_id", "y", "x", "v")), ["image_id", "y", "x"]
        gx = grid.separable(sized, slope, smooth, "replicate").select(*keys, F.col("v").cast("int").alias("gx"))
        gy = grid.separable(sized, smooth, slope, "replicate").select(*keys, F.col("v").cast("int").alias("gy"))
        return sized.join(gx, keys).join(gy, keys)
    near = grid.around(grid.sized(gray), "replicate")
    n = lambda i: F.col(f"n{i}")
    gx = (n(2) + n(5) * 2 + n(8)) - (n(0) + n(3) * 2 + n(6))
    gy = (n(6) + n(7) * 2 + n(8)) - (n(0) + n(1) * 2 + n(2))
    return near.select("image_id", "y", "x", "v", "height", "width", gx.alias("gx"), gy.alias("gy"))


def _kinds(gray: DataFrame, threshold1: float, threshold2: float, l2_gradient: bool = False, aperture_size: int = 3) -> DataFrame:
    """image_id, y, x, kind, gx, gy. Sobel and thinning across the gradient's direction (one of four): kind 2 for ridges above
    the higher threshold, 1 above the lower one, else 0."""
    low, high = sorted((int(threshold1), int(threshold2)))
    g = gradients(gray, aperture_size)
    gx, gy = F.col("gx"), F.col("gy")
    mag = F.sqrt((gx * gx + gy * gy).cast("double")) if l2_gradient else (F.abs(gx) + F.abs(gy)).cast("double")
    near = grid.around(g.withColumn("v", mag).select("image_id", "y", "x", "v", "height", "width", "gx", "gy"), "zero")
    slope = F.abs(gy) / F.greatest(F.abs(gx), F.lit(1e-9))
    m = lambda i: F.col(f"n{i}")
    flat, steep = slope < math.tan(math.pi / 8), slope > math.tan(3 * math.pi / 8)
    rising = gx * gy < 0
    before = F.when(flat, m(3)).when(steep, m(1)).when(rising, m(2)).otherwise(m(0))
    after = F.when(flat, m(5)).when(steep, m(7)).when(rising, m(6)).otherwise(m(8))
    peak = (F.col("v") > before) & (F.col("v") >= after)
    kind = F.when(peak & (F.col("v") > high), 2).when(peak & (F.col("v") > low), 1).otherwise(0)
    return near.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), kind.alias("kind"), F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"))


def _edges(table: pa.Table) -> np.ndarray:
    """The edge pixels: ridges whose region has one above the higher threshold."""
    kind = arrays.image(table, "kind", np.int8)
    r = borders.runs(kind > 0)
    root = borders.label(r, True)
    front = borders.painted(kind.shape, r, root)
    return np.isin(front, np.append(np.unique(front[kind == 2]), -2))


def canny(gray: DataFrame, threshold1: float = 100, threshold2: float = 200, l2_gradient: bool = False, keep_gradient: bool = False, aperture_size: int = 3) -> DataFrame:
    """image_id, y, x, v: 255 on edges. Sobel, thinning across the gradient's direction (one of four), then weak pixels
    stay if they are connected to strong ones."""
    more = ["gx", "gy"] if keep_gradient else []

    def found(table: pa.Table) -> dict[str, np.ndarray]:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        return {"y": y, "x": x, "v": np.where(_edges(table)[y, x], 255, 0).astype(np.int32)} | {c: table[c].to_numpy() for c in more}

    kinds = _kinds(gray, threshold1, threshold2, l2_gradient, aperture_size)
    return arrays.per_image(kinds, found, ", ".join(f"{c} int" for c in ["y", "x", "v", *more]))


_CIRCLE = "cx int, cy int, r int, votes long"


def _most(height: int, width: int, max_radius: int) -> int:
    return min(height, width) // 4 if max_radius == 0 else min(max_radius, min(height, width) // 2)


def _circles(table: pa.Table, min_radius: int, max_radius: int, min_dist_ratio: float, param2: int) -> list[tuple[int, int, int, int]]:
    """cx, cy, r, votes of one image's circles, from its ridges and gradients."""
    edges, gx, gy = _edges(table), arrays.image(table, "gx"), arrays.image(table, "gy")
    h, w = edges.shape
    most = _most(h, w, max_radius)
    y, x = np.nonzero(edges & ((gx != 0) | (gy != 0)))
    if most < min_radius or not len(y):
        return []
    norm = np.hypot(gx[y, x], gy[y, x])
    ux, uy = gx[y, x] / norm, gy[y, x] / norm
    half_up = lambda v: (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)
    # votes with a frame of one, because those of the 3x3 around a cell are summed: rounding does not split a centre
    votes = np.zeros((h + 4, w + 4), np.int64)
    for r in range(min_radius, most + 1):
        for s in (r, -r):
            cx, cy = half_up(x + s * ux), half_up(y + s * uy)
            ok = (cx >= 0) & (cy >= 0) & (cx < w) & (cy < h)
            np.add.at(votes, (cy[ok] + 2, cx[ok] + 2), 1)
    sums = np.lib.stride_tricks.sliding_window_view(votes, (3, 3)).sum((2, 3))  # of the cells from -1 on
    cy, cx = np.nonzero(sums > param2)
    order = np.lexsort((cx, cy, -sums[cy, cx]))
    apart = max(1, math.floor(most * min_dist_ratio))
    free, out = np.ones(sums.shape, bool), []
    yy, xx = np.mgrid[-apart : apart + 1, -apart : apart + 1]
    disc = yy**2 + xx**2 < apart * apart
    for a, b in zip(cy[order].tolist(), cx[order].tolist(), strict=True):  # best first; a centre clears what is near it
        if not free[a, b]:
            continue
        top, left = max(0, a - apart), max(0, b - apart)
        part = free[top : a + apart + 1, left : b + apart + 1]
        part &= ~disc[top - a + apart : top - a + apart + part.shape[0], left - b + apart : left - b + apart + part.shape[1]]
        far = half_up(np.hypot(x - (b - 1), y - (a - 1)))
        n = np.bincount(far[(far >= min_radius) & (far <= most)], minlength=most + 1)
        if n.any():
            out.append((b - 1, a - 1, most - int(np.argmax(n[::-1])), int(sums[a, b])))
    return out


def _round(edges: np.ndarray, cx: int, cy: int, r: int, threshold: float) -> bool:
    """Whether the largest contour among the edges around a circle has a circularity of at least threshold."""
    m = max(r // 4, 2)
    reach, limit = r + m, r + m // 2
    top, left = max(0, cy - reach), max(0, cx - reach)
    part = edges[top : max(0, cy + reach + 1), left : max(0, cx + reach + 1)]
    yy, xx = np.ogrid[top : top + part.shape[0], left : left + part.shape[1]]
    b = borders.borders(part & ((yy - cy) ** 2 + (xx - cx) ** 2 <= limit * limit))
    area, length = borders.measures(b)
    area = np.where(b.is_hole, -1, area)
    if not len(area):
        return False
    k = int(np.argmax(area))
    return bool(area[k] * (4 * math.pi) / max(length[k] ** 2, 1e-9) >= threshold)


def _columns(found: list[tuple[int, int, int, int]]) -> dict[str, np.ndarray]:
    a = np.array(found, np.int64).reshape(-1, 4)
    return {"cx": a[:, 0].astype(np.int32), "cy": a[:, 1].astype(np.int32), "r": a[:, 2].astype(np.int32), "votes": a[:, 3]}


def _blurred_kinds(gray: DataFrame, param1: int, blur_kernel_size: int) -> DataFrame:
    return _kinds(stencil.gaussian_blur(gray, (blur_kernel_size, blur_kernel_size)) if blur_kernel_size else gray, param1 // 2, param1)


def circles(gray: DataFrame, min_radius: int = 5, max_radius: int = 0, min_dist_ratio: float = 0.8, param1: int = 50, param2: int = 30, blur_kernel_size: int = 5) -> DataFrame:
    """image_id, cx, cy, r, votes: edge pixels vote along their gradient for centres in an array of the image; centres with more
    than param2 votes suppress those near them in the order of their votes; the radius is the commonest distance of edge pixels."""
    find = lambda t: _columns(_circles(t, min_radius, max_radius, min_dist_ratio, param2))
    return arrays.per_image(_blurred_kinds(gray, param1, blur_kernel_size), find, _CIRCLE)


def round_circles(found: DataFrame, gray: DataFrame, threshold: float = 0.7, param1: int = 50) -> DataFrame:
    """Those circles whose surroundings hold a contour of circularity 4 pi area / perimeter^2 of at least threshold."""

    def keep(some: pa.Table, kinds: pa.Table) -> dict[str, np.ndarray]:
        edges = _edges(kinds)
        rows = zip(*(some[c].to_pylist() for c in ("cx", "cy", "r", "votes")), strict=True)
        return _columns([c for c in rows if _round(edges, *c[:3], threshold)])

    some = found.select("image_id", *(F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in _CIRCLE.split(", ")))
    return arrays.per_image_pair(some, _kinds(gray, param1 // 2, param1), keep, _CIRCLE)


def circle_features(found: DataFrame, gray: DataFrame, max_radius: int = 0) -> DataFrame:
    """image_id, circle_count, small/medium/large_circle_count, circle_density, avg_circle_radius, radius_std; zeros where
    there is none."""
    size = dims(gray).withColumn("most", F.expr("CASE WHEN {0} = 0 THEN least(height, width) DIV 4 ELSE least({0}, least(height, width) DIV 2) END".format(max_radius)))
    c = size.join(found.select("image_id", "r"), "image_id", "left")
    r, third = F.col("r"), F.col("most") / 3
    n = F.count("r")
    none = lambda x: F.coalesce(x, F.lit(0.0))
    return c.groupBy("image_id", "height", "width").agg(n.alias("circle_count"), F.count_if(r < third).alias("small_circle_count"), F.count_if((r >= third) & (r < third * 2)).alias("medium_circle_count"), F.count_if(r >= third * 2).alias("large_circle_count"), none(F.avg("r")).alias("avg_circle_radius"), none(F.stddev_pop("r")).alias("radius_std")).withColumn("circle_density", F.col("circle_count") / (F.col("height") * F.col("width"))).drop("height", "width")


def circle_counter(gray: DataFrame, enable_circularity_filter: bool = True, circularity_threshold: float = 0.7, min_radius: int = 5, max_radius: int = 0, min_dist_ratio: float = 0.8, param1: int = 50, param2: int = 30, blur_kernel_size: int = 5) -> DataFrame:
    """circle_features of the circles found; with the filter, of those that round_circles would keep, found and judged at once."""
    if not enable_circularity_filter:
        return circle_features(circles(gray, min_radius, max_radius, min_dist_ratio, param1, param2, blur_kernel_size), gray, max_radius)

    def find(blurred: pa.Table, plain: pa.Table) -> dict[str, np.ndarray]:
        edges = _edges(plain)
        return _columns([c for c in _circles(blurred, min_radius, max_radius, min_dist_ratio, param2) if _round(edges, *c[:3], circularity_threshold)])

    found = arrays.per_image_pair(_blurred_kinds(gray, param1, blur_kernel_size), _kinds(gray, param1 // 2, param1), find, _CIRCLE)
    return circle_features(found, gray, max_radius)
