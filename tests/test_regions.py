"""Regions, borders and circles against plain Python that goes pixel by pixel."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import regions

RNG = np.random.default_rng(2)
SHAPES = {1: (12, 12), 2: (1, 9), 3: (9, 1), 4: (17, 30), 5: (5, 5), 6: (4, 4), 7: (25, 13)}
MASKS = {i: RNG.random(s) < (0.45, 0.7, 0.6)[i % 3] for i, s in SHAPES.items()}
MASKS[5][:], MASKS[6][:] = True, False
MASKS[8] = np.maximum.outer(abs(np.arange(19) - 9), abs(np.arange(19) - 9)) % 3 == 0  # rings in rings


@pytest.fixture(scope="module")
def binary(spark):
    rows = [(i, y, x, 255 * int(v)) for i, m in MASKS.items() for (y, x), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v int").repartition(4).cache()


def _fill(mask, diagonal):
    """Sets of pixels, each from its first pixel on."""
    seen, out = set(), []
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (diagonal or a * b == 0)]
    for y, x in map(tuple, np.argwhere(mask)):
        if (y, x) in seen:
            continue
        part, todo = {(y, x)}, [(y, x)]
        while todo:
            p = todo.pop()
            for a, b in near:
                q = (p[0] + a, p[1] + b)
                if q not in part and 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q]:
                    part.add(q)
                    todo.append(q)
        seen |= part
        out.append(part)
    return out


def _name(part):
    y, x = min(part)
    return (int(y) << 31) + int(x)


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(binary, diagonal):
    want = set()
    for i, m in MASKS.items():
        for p in _fill(m, diagonal):
            y, x = [q[0] for q in p], [q[1] for q in p]
            want.add((i, _name(p), len(p), min(y), max(y), min(x), max(x)))
    for band in (None, 1, 4, 100):
        got = regions.components(binary, diagonal, band).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want, band
    assert regions.components(binary.limit(0)).count() == 0


def _tree(mask):
    """name -> (parent, is_hole, level)"""
    front, back = _fill(mask, True), _fill(~mask, False)
    h, w = mask.shape
    holes = [p for p in back if not any(y in (0, h - 1) or x in (0, w - 1) for y, x in p)]
    at = {q: _name(p) for p in front + holes for q in p}
    left = lambda p: at.get((min(p)[0], min(p)[1] - 1))
    out = {_name(p): (left(p), kind) for kind, parts in ((False, front), (True, holes)) for p in parts}
    level = lambda n: 0 if out[n][0] is None else 1 + level(out[n][0])
    return {n: (*v, level(n)) for n, v in out.items()}


def test_hierarchy_and_levels(binary):
    trees = {i: _tree(m) for i, m in MASKS.items()}
    got = {(r["image_id"], r["region"]): (r["parent"], r["is_hole"], r["level"]) for r in regions.hierarchy(binary).collect()}
    assert got == {(i, n): v for i, t in trees.items() for n, v in t.items()}
    assert max(v[2] for v in got.values()) >= 4
    two = {(r["image_id"], r["region"]): (r["parent"], r["level"]) for r in regions.hierarchy(binary, "ccomp").collect()}
    assert two == {k: (p if hole else None, int(hole)) for k, (p, hole, _) in got.items()}
    assert {(r["image_id"], r["region"]) for r in regions.hierarchy(binary, "external").collect()} == {k for k, v in got.items() if v[2] == 0}
    with pytest.raises(ValueError):
        regions.hierarchy(binary, "floodfill")


def test_borders_walk_around_each_region(binary):
    rows: dict = {}
    for r in regions.trace(binary, "list", "none").orderBy("k").collect():
        rows.setdefault((r["image_id"], r["region"], r["is_hole"]), []).append((r["y"], r["x"]))
    trees = {i: _tree(m) for i, m in MASKS.items()}
    assert set(rows) == {(i, n, v[1]) for i, t in trees.items() for n, v in t.items()}
    area = {(r["image_id"], r["region"]): r for r in regions.contours(binary).collect()}
    for (i, name, hole), p in rows.items():
        m = MASKS[i]
        steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(p, p[1:] + p[:1], strict=True)]
        assert len(p) == 1 or all(max(abs(a), abs(b)) == 1 for a, b in steps)
        part = next(q for q in (_fill(m, True) if not hole else _fill(~m, False)) if _name(q) == name)
        outside = {(y + a, x + b) for y, x in part for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))} - part
        if hole:  # the set pixels beside the hole, from the one left of it
            around = next(q for q in _fill(m, True) if p[0] in q)  # without what lies in the hole
            assert set(p) == outside & around and p[0] == (min(part)[0], min(part)[1] - 1)
        else:
            assert set(p) <= part and p[0] == min(part)
            shoelace = abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2
            assert area[i, name]["area"] == shoelace and abs(area[i, name]["perimeter"] - sum(math.hypot(*s) for s in steps if s != (0, 0))) < 1e-9
    simple = regions.trace(binary.where("image_id = 5"), approximation="simple").orderBy("k").collect()
    assert [(r["y"], r["x"]) for r in simple] == [(0, 0), (4, 0), (4, 4), (0, 4)]
    thin = regions.trace(binary, "external", "tc89_l1")
    assert thin.count() < sum(len(p) for p in rows.values()) and thin.where("is_hole").count() == 0


def test_area_without_holes_counts_cells(binary):
    got = {(r["image_id"], r["region"]): r for r in regions.contours(binary, fill=False).collect()}
    for i, m in MASKS.items():
        for p in _fill(m, True):
            area = length = 0.0
            for y in range(-1, m.shape[0]):
                for x in range(-1, m.shape[1]):
                    c = [(y + a, x + b) in p for a in (0, 1) for b in (0, 1)]
                    area += {4: 1.0, 3: 0.5}.get(sum(c), 0.0)
                    length += math.sqrt(2) if sum(c) == 3 else 0 if sum(c) != 2 else 2 * math.sqrt(2) if c[0] == c[3] else 1
            assert got[i, _name(p)]["area"] == area and abs(got[i, _name(p)]["perimeter"] - length) < 1e-9


def test_rings_are_painted_by_parity(spark, binary):
    rings = binary.where("image_id = 8")
    every = regions.contour(rings, min_area=0, select_mode="all", retrieval="list").where("v = 255")
    assert {(r["y"], r["x"]) for r in every.collect()} == {tuple(p) for p in np.argwhere(MASKS[8])}
    outer = regions.contour(rings, min_area=0, select_mode="all").where("v = 255").count()
    assert outer == 361
    # of the borders by area the second is the outer ring's hole: all that lies inside it, with its border
    second = regions.contour(rings, min_area=0, contour_rank=1, retrieval="tree").where("v = 255").count()
    assert second == 19 * 19 - 4  # the corners of the ring are no neighbours of the hole
    many = spark.createDataFrame([(1, 0, x, x) for x in range(4)], "image_id long, y int, x int, v int")
    assert [r["v"] for r in regions.contour(many).orderBy("x").collect()] == [0, 1, 2, 3]


def _circles(edges, gx, gy, low, most, apart, votes_over):
    up = lambda v: math.copysign(math.floor(abs(v) + 0.5), v)
    h, w = edges.shape
    votes: dict = {}
    points = [(y, x) for y, x in map(tuple, np.argwhere(edges)) if gx[y, x] or gy[y, x]]
    for y, x in points:
        n = math.hypot(gx[y, x], gy[y, x])
        for r in range(low, most + 1):
            for s in (1, -1):
                cx, cy = up(x + s * r * gx[y, x] / n), up(y + s * r * gy[y, x] / n)
                if 0 <= cx < w and 0 <= cy < h:
                    votes[cy, cx] = votes.get((cy, cx), 0) + 1
    sums: dict = {}
    for (cy, cx), n in votes.items():
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                sums[cy + a, cx + b] = sums.get((cy + a, cx + b), 0) + n
    found = []
    for (cy, cx), n in sorted(sums.items(), key=lambda k: (-k[1], k[0])):
        if n > votes_over and all((cy - b) ** 2 + (cx - a) ** 2 >= apart**2 for a, b, _, _ in found):
            far: dict = {}
            for y, x in points:
                d = up(math.hypot(x - cx, y - cy))
                if low <= d <= most:
                    far[d] = far.get(d, 0) + 1
            found.append((int(cx), int(cy), int(max(far, key=lambda d: (far[d], d))) if far else None, n))
    return {c for c in found if c[2] is not None}


def test_circles_on_drawn_discs(spark):
    discs = [(20, 24, 8), (50, 20, 11), (45, 52, 7), (15, 60, 9)]
    noise = RNG.integers(0, 30, (70, 80))
    rows = []
    for y in range(70):
        for x in range(80):
            rows.append((1, y, x, 220 if any((y - b) ** 2 + (x - a) ** 2 <= r * r for b, a, r in discs) else int(noise[y, x])))
    for y in range(40):
        rows += [(2, y, x, 200 * (10 < y < 30 and 10 < x < 30)) for x in range(40)]  # a square
    gray = spark.createDataFrame(rows, "image_id long, y int, x int, v int")
    found = {(r["cx"], r["cy"], r["r"]) for r in regions.circles(gray, param2=30).where("image_id = 1").collect()}
    for b, a, r in discs:
        assert any(abs(x - a) <= 1 and abs(y - b) <= 1 and abs(q - r) <= 1 for x, y, q in found)
    edges = regions.canny(regions.stencil.gaussian_blur(gray, (5, 5)), 25, 50, keep_gradient=True).toPandas()
    for i, (h, w) in {1: (70, 80), 2: (40, 40)}.items():
        some = edges[edges.image_id == i]
        grid = {c: np.zeros((h, w), int) for c in ("v", "gx", "gy")}
        for c, g in grid.items():
            g[some.y, some.x] = some[c]
        most = min(h, w) // 4
        want = _circles(grid["v"] > 0, grid["gx"], grid["gy"], 5, most, max(1, int(most * 0.8)), 30)
        got = {tuple(r)[1:] for r in regions.circles(gray, param2=30).where(F.col("image_id") == i).collect()}
        assert got == want, i
    counted = {r["image_id"]: r["circle_count"] for r in regions.circle_counter(gray).collect()}
    assert counted[1] >= len(discs)
    kept = regions.round_circles(regions.circles(gray), gray).groupBy("image_id").count().collect()
    assert {r["image_id"]: r["count"] for r in kept} == {k: v for k, v in counted.items() if v}


def test_one_exchange_by_image(spark):
    from lumenframe.operators.grid import by_image

    gray = by_image(spark.createDataFrame([(1, 0, 0, 255)], "image_id long, y int, x int, v int"))
    for df in (regions.hierarchy(gray), regions.contour(gray), regions.canny(gray), regions.trace(gray), regions.circles(gray)):
        assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
