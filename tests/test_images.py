"""Analytic images: what each operator must give on closed-form inputs."""

import math

import numpy as np
import pytest

from lumenframe.functions import color
from lumenframe.operators import geometry, histogram, regions, spectral, statistics, stencil, texture
from lumenframe.plans import pipeline, quality, registry


def image(spark, value, n=16, image_id=1):
    rows = [(image_id, y, x, int(value(y, x))) for y in range(n) for x in range(n)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v int")


def grid(df):
    return {(r["y"], r["x"]): r["v"] for r in df.collect()}


CHECKER = lambda y, x: 255 * ((x + y) % 2 == 0)
STRIPES = lambda y, x: 255 * (y % 4 < 2)


def test_brightness_of_uniform_and_black(spark):
    both = image(spark, lambda y, x: 128).union(image(spark, lambda y, x: 0, image_id=2))
    a, b = statistics.brightness(both).orderBy("image_id").collect()
    assert (a["mean"], a["variance"], a["cv"]) == (128.0, 0.0, 0.0)
    assert b["mean"] == 0.0 and math.isinf(b["cv"])


def test_hue_is_circular(spark):
    px = spark.createDataFrame([(1, 0, x, b, 0, 255) for x, b in enumerate([40, 0])] + [(1, 1, 0, 0, 40, 255)], "image_id long, y int, x int, b int, g int, r int")
    row = statistics.hsv(px).first()
    assert (row["hue_mean"] < 10 or row["hue_mean"] > 170) and row["hue_std_dev"] < 30


def test_hue_median_and_mean_are_hues(spark):
    """Two reds and a hue of 3: their median is 0, not a rounding error before a full turn; 15 and 165 turn to 0."""
    rows = [(1, 0, 0, 0, 0, 255), (1, 0, 1, 0, 0, 255), (1, 0, 2, 0, 26, 255), (2, 0, 0, 0, 128, 255), (2, 0, 1, 128, 0, 255), (3, 0, 0, 0, 255, 255), (3, 0, 1, 255, 0, 0)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, b int, g int, r int")
    one, two, three = statistics.hsv(px).orderBy("image_id").collect()
    assert one["hue_median"] == 0.0 and one["hue_mean"] == pytest.approx(0.9996, abs=1e-4)
    assert (two["hue_mean"], two["hue_median"]) == (0.0, 0.0) and math.isinf(two["hue_cv"])
    assert (three["hue_mean"], three["hue_median"]) == (0.0, 165.0)  # opposite hues (30, 120) have no mean; 120 lies 60 before 0


def test_glcm_anchors(spark):
    rows = {(r["d"], r["angle"]): r for r in texture.glcm(image(spark, CHECKER), (1,)).collect()}
    assert rows[1, 0]["contrast"] == 65025 and rows[1, 45]["contrast"] == 0 and rows[1, 0]["correlation"] < -0.9
    flat = texture.glcm(image(spark, lambda y, x: 7), (1, 2)).first()
    assert (flat["contrast"], flat["energy"], flat["homogeneity"], flat["correlation"]) == (0, 1, 1, 1)


def test_glcm_other_angles_equal_brute_force(spark):
    df = image(spark, lambda y, x: (y * 7 + x * x) % 5, 8)
    v = grid(df)
    got = {(r["angle"], r["lo"], r["hi"]): r["n"] for r in texture.glcm_counts(df, (3,), (20,)).collect()}
    dy, dx = round(3 * math.sin(math.radians(20))), round(3 * math.cos(math.radians(20)))
    want = {}
    for (y, x), i in v.items():
        if (y + dy, x + dx) in v:
            j = v[y + dy, x + dx]
            key = (19 if int(math.degrees(math.radians(20))) == 19 else 20, min(i, j), max(i, j))
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_lbp_of_black_and_checker(spark):
    black = texture.lbp(image(spark, lambda y, x: 0)).first()
    assert (black["lbp_energy"], black["lbp_entropy"], black["lbp_std"]) == (1, 0, 0)
    checker = texture.lbp(image(spark, CHECKER, 64)).first()
    assert checker["lbp_std"] > 3 and abs(checker["lbp_energy"] - 0.5) < 0.05 and abs(checker["lbp_entropy"] - 0.3) < 0.02


def test_hlac_of_white(spark):
    rows = {r["k"]: r["count"] for r in texture.hlac(image(spark, lambda y, x: 255, 32)).collect()}
    assert rows[0] == 900 and len(rows) == 37 and set(rows.values()) == {900}
    assert len(texture.hlac_kernels(2, True)) == 11 and len(texture.hlac_kernels(1)) == 9


def test_fft_of_stripes(spark):
    r = spectral.fft_features(image(spark, STRIPES, 64)).first()
    assert abs(r["horizontal_energy"] - 0.14) < 0.01 and abs(r["vertical_energy"] - 0.78) < 0.01 and 0.1 < r["spectral_centroid"] < 0.3
    assert abs(r["band_1_0.00_0.10"] + r["band_2_0.10_0.30"] + r["band_3_0.30_0.50"] - 1) < 1e-9


def test_swt_of_stripes(spark):
    e = {r["band"]: r for r in spectral.swt_features(image(spark, STRIPES, 64)).collect()}
    assert abs(e["lh"]["energy"] - 2048) < 1e-6 and e["hl"]["energy"] < 1e-9 and e["lh"]["energy_ratio"] > 0.95
    assert {(r["level"], r["band"]) for r in spectral.swt_features(image(spark, STRIPES), "db2", 2).collect()} == {(k, b) for k in (1, 2) for b in ("ll", "lh", "hl", "hh")}


def test_inverse_transform_gives_the_image_back(spark):
    df = image(spark, lambda y, x: (y * 31 + x * 17) % 256, 8)
    assert grid(spectral.ideal_filter(df, "lowpass", 100)) == grid(color.min_max(df))


def test_blurs_keep_a_uniform_image(spark):
    df = image(spark, lambda y, x: 90, 9)
    for out in (stencil.average_blur(df, (3, 3)), stencil.gaussian_blur(df, (5, 5)), stencil.median_blur(df, 3), stencil.bilateral_filter(df, 5), stencil.motion_blur(df, 3, 45), histogram.equalize(df), geometry.resize(df, 5, 7, False)):
        assert {r["v"] for r in out.select("v").distinct().collect()} == {90}


def test_clahe_stays_in_range_and_keeps_order(spark):
    out = grid(histogram.clahe(image(spark, lambda y, x: 16 * y, 16), tiles=(2, 2)))
    assert len(out) == 256 and all(0 <= v <= 255 for v in out.values())


def test_lab_round_trip(spark):
    px = spark.createDataFrame([(1, 0, i, (i * 37) % 256, (i * 91) % 256, (i * 53) % 256) for i in range(100)], "image_id long, y int, x int, b int, g int, r int")
    back = {r["x"]: r for r in color.from_lab(color.lab(px)).collect()}
    assert sum(max(abs(back[r["x"]][c] - r[c]) for c in "bgr") <= 8 for r in px.collect()) >= 90


def test_area_follows_pick(spark):
    disc = lambda y, x: 255 * ((y - 10) ** 2 + (x - 10) ** 2 <= 49)
    df = image(spark, disc, 21)
    px = {p for p, v in grid(df).items() if v}
    border = sum(any((y + a, x + b) not in px for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))) for y, x in px)
    row = regions.contours(df).first()
    assert row["area"] == len(px) - border / 2 - 1


def test_spiral_is_one_region_and_a_ring_has_a_hole(spark):
    spiral = ["#########", "........#", "#######.#", "#.....#.#", "#.###.#.#", "#.#...#.#", "#.#####.#", "#.......#", "#########"]
    one = regions.components(image(spark, lambda y, x: 255 * (spiral[y][x] == "#"), 9), diagonal=False)
    assert one.count() == 1
    ring = image(spark, lambda y, x: 255 * (max(abs(y - 8), abs(x - 8)) == 5), 17)
    tree = regions.hierarchy(ring).collect()
    assert sorted(r["is_hole"] for r in tree) == [False, True]
    filled = regions.contour(ring, min_area=10)
    assert filled.where("v = 255").count() == 121


def test_canny_finds_the_square(spark):
    out = grid(regions.canny(image(spark, lambda y, x: 255 * (5 <= y < 12 and 5 <= x < 12), 18), 100, 200))
    on = {p for p, v in out.items() if v}
    assert on and all(3 <= y <= 13 and 3 <= x <= 13 for y, x in on) and (8, 8) not in on


def test_one_circle_is_counted(spark):
    disc = image(spark, lambda y, x: 255 * ((y - 20) ** 2 + (x - 24) ** 2 <= 64), 48)
    found = regions.circles(disc, min_radius=6, max_radius=12, param2=40).collect()
    assert len(found) == 1 and abs(found[0]["cx"] - 24) <= 1 and abs(found[0]["cy"] - 20) <= 1 and abs(found[0]["r"] - 8) <= 1


def test_roi_outside_keeps_the_frame(spark):
    df = image(spark, CHECKER, 6)
    assert geometry.roi_crop(df, 10, 10, 3, 3).count() == 36
    assert grid(geometry.roi_crop(df, 4, -2, 9, 4)).keys() == {(y, x) for y in range(2) for x in range(2)}


def test_chain_uses_one_exchange(spark):
    from lumenframe.operators.grid import by_image

    tile = by_image(image(spark, CHECKER))
    plan = stencil.gaussian_blur(stencil.average_blur(tile, (3, 3)), (3, 3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_profiles_and_registry(spark):
    df = image(spark, CHECKER)
    p = pipeline.profile({"a": {"processors": ["std_bin", "mask_composition"], "mode": "pipeline"}}, "a")
    out = pipeline.run(df, p)
    assert set(out) == {"original", "std_bin", "mask_composition", "pipeline"} and grid(out["pipeline"]) == grid(df)
    assert set(pipeline.fan(df, p)) == {"original", "std_bin"}
    with pytest.raises(KeyError):
        pipeline.profile({}, "a")
    with pytest.raises(ValueError):
        registry.get(registry.PROCESSORS, "median_blur", {"kernel_size": 4})
    with pytest.raises(ValueError):
        registry.processor("std_bin")(lambda g: g)


def test_quality_rows(spark):
    df = image(spark, lambda y, x: 7, 3)
    assert {r["message"] for r in quality.too_small(df, "fft").union(quality.binary(df, "m")).collect()} == {"[fft] image must be at least 4x4", "[m] values must be 0 or 255"}
    images = spark.createDataFrame([(1, 3), (2, 2)], "image_id long, n_channels int")
    assert [r["image_id"] for r in quality.empty(images, df, "x").collect()] == [2]
    assert quality.channels(images, "x").count() == 1


def test_dtype_normalisation(spark):
    rows = [(1, 0, 0, 0.5), (1, 0, 1, float("nan")), (2, 0, 0, 0.0), (2, 0, 1, 65535.0), (3, 0, 0, 300.0), (3, 0, 1, -5.0), (4, 0, 0, 12.7)]
    out = color.normalize_dtype(spark.createDataFrame(rows, "image_id long, y int, x int, v double"))
    assert {(r["image_id"], r["x"]): r["v"] for r in out.collect()} == {(1, 0): 127, (1, 1): 0, (2, 0): 0, (2, 1): 255, (3, 0): 255, (3, 1): 0, (4, 0): 12}


def test_letterbox_and_scaling(spark):
    out = grid(geometry.letterbox(image(spark, lambda y, x: 9, 4), 8, 4, 114))
    assert out[0, 0] == 114 and out[0, 2] == 9 and len(out) == 32
    assert geometry.scaled(image(spark, CHECKER, 4), 0.5).count() == 4


def test_wavelet_taps_are_orthogonal():
    assert spectral.lowpass_taps("haar") == pytest.approx([2**-0.5] * 2)
    assert spectral.lowpass_taps("db2") == pytest.approx([-0.12940952255126034, 0.2241438680420134, 0.8365163037378079, 0.48296291314453416])
    for n in range(1, 11):
        lo = spectral.lowpass_taps(f"db{n}")
        assert len(lo) == 2 * n
        for shift in range(n):
            assert sum(a * b for a, b in zip(lo, lo[2 * shift :], strict=False)) == pytest.approx(float(shift == 0), abs=1e-6)
    with pytest.raises(ValueError):
        spectral.lowpass_taps("db11")


def test_larger_radius_and_aperture(spark):
    ramp = image(spark, lambda y, x: x * 10, 12)
    for size, gain in ((3, 8), (5, 16 * 8), (7, 64 * 32)):
        g = regions.gradients(ramp, size).where("y = 6 AND x = 6").first()
        weights = {3: ([1, 2, 1], [-1, 0, 1]), 5: ([1, 4, 6, 4, 1], [-1, -2, 0, 2, 1]), 7: ([1, 6, 15, 20, 15, 6, 1], [-1, -4, -5, 0, 5, 4, 1])}[size]
        assert g["gy"] == 0 and g["gx"] == sum(weights[0]) * sum(w * 10 * (i - size // 2) for i, w in enumerate(weights[1]))
    with pytest.raises(ValueError):
        regions.gradients(ramp, 4)
    near = {(r["y"], r["x"]): r["code"] for r in texture.lbp_codes(ramp, 8, 2, "default").collect()}
    # two to the right is larger, two to the left smaller, two up and down equal; the diagonals lie between
    assert near[6, 6] == sum(1 << k for k in (0, 1, 2, 6, 7))
    h = texture.lbp(ramp, include_histogram=True, resize_shape=(8, 8)).first()
    assert sum(h[f"lbp_bin_{k}"] for k in range(10)) == pytest.approx(1)


def test_more_wavelets():
    sym4 = [-0.07576571478927333, -0.02963552764599851, 0.49761866763201545, 0.8037387518059161, 0.29785779560527736, -0.09921954357684722, -0.012603967262037833, 0.0322231006040427]
    assert spectral.lowpass_taps("sym4") == pytest.approx(sym4, abs=1e-6)
    for n in range(2, 11):
        lo = spectral.lowpass_taps(f"sym{n}")
        for shift in range(n):
            assert sum(a * b for a, b in zip(lo, lo[2 * shift :], strict=False)) == pytest.approx(float(shift == 0), abs=1e-6)
        assert sum(k**1 * (-1) ** k * a for k, a in enumerate(lo)) == pytest.approx(0, abs=1e-5)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (64, 64))
    for r, d in ((1, 1), (1, 3), (1, 5), (2, 2), (2, 4), (2, 6), (2, 8), (3, 1), (3, 3), (3, 5), (3, 7), (3, 9)):
        lo, hi = spectral.filters(f"bior{r}.{d}")
        assert sum(lo) == pytest.approx(math.sqrt(2)) and sum(hi) == pytest.approx(0, abs=1e-9)
        # analysis low-pass and synthesis low-pass (behind the high-pass) are each other's dual
        dual = [a if k % 2 == 0 else -a for k, a in enumerate(hi)]
        products = [sum(lo[k] * dual[k + s] for k in range(len(lo)) if 0 <= k + s < len(lo)) for s in range(-len(lo), len(lo))]
        even, odd = products[len(lo) % 2 :: 2], products[1 - len(lo) % 2 :: 2]
        assert any(sorted(abs(v) for v in half)[-1] == pytest.approx(1) and sorted(abs(v) for v in half)[-2] == pytest.approx(0, abs=1e-9) for half in (even, odd)), (r, d)
        back = spectral.filters(f"rbio{r}.{d}")
        assert sum(back[0]) == pytest.approx(math.sqrt(2))
        bands = spectral._swt(x, lo, hi, 2)
        assert all(np.isfinite(b).all() for level in bands for b in level.values())
    assert spectral.filters("bior1.1")[0] == pytest.approx(spectral.lowpass_taps("haar"))
    for bad in ("sym11", "coif1", "bior4.4", "bior2.3", "haar2"):
        with pytest.raises(ValueError):
            spectral.filters(bad)


def test_wavelets_keep_energy_and_follow_each_tap(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (8, 16)).astype(float)
    for name in ("db2", "sym5"):
        lo, hi = spectral.filters(name)
        levels = spectral._swt(x, lo, hi, 2)
        assert sum((b**2).sum() for b in levels[0].values()) == pytest.approx(4 * (x**2).sum())
        slow = sum(lo[a] * hi[b] * x[(3 + a) % 8, (5 + b) % 16] for a in range(len(lo)) for b in range(len(lo)))
        assert levels[0]["hl"][3, 5] == pytest.approx(slow)
    rows = [(i, y, c, int(x[y, c])) for i in (1, 2) for y in range(8) for c in range(16)] + [(3, 0, 0, 1)]
    got = spectral.swt(spark.createDataFrame(rows, "image_id long, y int, x int, v int"), "sym5", 2)
    assert {r["image_id"] for r in got.select("image_id").distinct().collect()} == {1, 2}
    one = got.where("image_id = 1 AND level = 2 AND band = 'hl' AND y = 3 AND x = 4").first()
    assert one["c"] == pytest.approx(levels[1]["hl"][3, 4])


def test_order_statistics_of_any_kernel(spark):
    rng = np.random.default_rng(7)
    small, big, floats = rng.integers(0, 256, (9, 13)), rng.integers(0, 256, (70, 90)), rng.normal(0, 1, (20, 15))
    for image_, k in ((small, 3), (big, 9), (big, 31), (floats, 9), (small, 31)):
        padded = np.pad(image_, k // 2, mode="edge")
        want = np.array([[np.median(padded[y : y + k, x : x + k]) for x in range(image_.shape[1])] for y in range(image_.shape[0])])
        assert (stencil._median(image_.astype(float), k) == want).all()
    rows = [(1, y, x, int(v)) for (y, x), v in np.ndenumerate(small)]
    df = spark.createDataFrame(rows[:-3], "image_id long, y int, x int, v int")
    out = grid(stencil.bilateral_filter(df, 5, 20, 2))
    assert len(out) == len(rows) - 3
    padded = np.pad(np.where(np.arange(9 * 13).reshape(9, 13) < 9 * 13 - 3, small, 0), 2, mode="reflect").astype(float)
    for y, x in ((0, 0), (4, 6), (8, 3)):
        cells = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4]
        w = [math.exp(-(a * a + b * b) / 8 - (padded[y + 2 + a, x + 2 + b] - padded[y + 2, x + 2]) ** 2 / 800) for a, b in cells]
        assert out[y, x] == math.floor(sum(f * padded[y + 2 + a, x + 2 + b] for f, (a, b) in zip(w, cells, strict=True)) / sum(w) + 0.5)


@pytest.mark.parametrize("r", [1, 2])
def test_lbp_samples_equal_to_the_centre_count(spark, r):
    """Flat images of every gray value: no sample falls below the centre by a rounding error of its weights."""
    n = 2 * r + 1
    flat = spark.range(256).selectExpr("id AS image_id", f"explode(sequence(0, {n * n - 1})) AS i", "CAST(id AS INT) AS v").selectExpr("image_id", f"CAST(i DIV {n} AS INT) AS y", f"i % {n} AS x", "v")
    codes = texture.lbp_codes(flat, 8, r, "default").where(f"y = {r} AND x = {r}").collect()
    assert len(codes) == 256 and {c["code"] for c in codes} == {255}


def test_whole_images_and_pixels_give_the_same(spark):
    """Copies at three scales and resizing: images of two sizes, one of more pixels than an Arrow batch holds, from both forms; whole
    images are neither dealt nor sorted."""
    size = {1: (8, 8), 2: (5, 7), 3: (130, 120), 4: (8, 8), 5: (2, 2)}
    value = lambda i, y, x: (y * y * 31 + x * 17 * i + y * x) % 256
    px = spark.createDataFrame([(i, y, x, value(i, y, x)) for i, (h, w) in size.items() for y in range(h) for x in range(w)], "image_id long, y int, x int, v int")
    whole = spark.createDataFrame([(i, h, w, [value(i, y, x) for y in range(h) for x in range(w)]) for i, (h, w) in size.items()], "image_id long, height int, width int, cells array<int>")
    for f in (texture.hlac_multiscale, lambda g: texture.hlac_multiscale(g, binarization_method="otsu", normalize=False), lambda g: geometry.resize(g, 6, 9, False), lambda g: geometry.scaled(g, 0.3)):
        a, b = f(px), f(whole)
        assert sorted(a.collect()) == sorted(b.collect())
        plan = b._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Exchange", "Sort", "Window"))
    got = {i for (i,) in texture.hlac_multiscale(px).select("image_id").distinct().collect()}
    assert got == {1, 2, 3, 4}  # 2 x 2 has no interior at any scale
    one = px.where("image_id = 3")  # step by step: each copy made binary, then counted
    parts = [texture.hlac(stencil.mean_adapt_bin(g, 11, 2)) for g in (one, geometry.scaled(one, 0.75), geometry.scaled(one, 0.5))]
    want = {}
    for part in parts:
        for r in part.collect():
            want[r["k"]] = want.get(r["k"], 0) + r["count"]
    assert {r["k"]: r["count"] for r in texture.hlac_multiscale(one, normalize=False).collect()} == want


def test_spectra_run_over_stacks_and_images_are_dealt_over_all_partitions(spark):
    """No call for each small image, the same spectrum as an image alone has; few bytes of pixels are not put into few tasks."""
    from lumenframe.operators.grid import by_image

    both = image(spark, lambda y, x: (y * 7 + x * x) % 50, 6, 1).union(image(spark, lambda y, x: (y * 3 + x) % 9, 9, 2)).union(image(spark, lambda y, x: y * x, 6, 3))
    s = spectral.spectrum(both)
    assert "FlatMapGroupsInArrow" not in s._jdf.queryExecution().executedPlan().toString()
    got = {(r["image_id"], r["ky"], r["kx"]): complex(r["re"], r["im"]) for r in s.collect()}
    own = np.array([[(y * 3 + x) % 9 for x in range(9)] for y in range(9)]) * np.hanning(9)[:, None] * np.hanning(9)[None, :]
    assert len(got) == 36 + 81 + 36 and all(abs(got[2, ky, kx] - np.fft.fft2(own)[ky, kx]) < 1e-9 for ky in range(-4, 5) for kx in range(-4, 5))
    assert "REPARTITION_BY_NUM" in by_image(both)._jdf.queryExecution().executedPlan().toString()


def test_cells_of_images_are_not_broadcast(spark, tmp_path):
    """Where black pixels are left out, Spark makes the join with all cells an inner one and takes the cells for as few as the
    images: it must not send them to all tasks."""
    import re

    from lumenframe.sources import tables

    spark.createDataFrame([(k, k * 37, float(k * 997)) for k in range(0, 4000, 3)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    px = tables.bgr_orders(spark, str(tmp_path))
    df = statistics.hsv(px)
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[image_id#\d+L?, i#\d+", plan) and re.search(r"SortMergeJoin \[image_id#\d+L?, i#\d+", plan)
    assert len(rows) == 4 and px.count() == 4 * 1024
