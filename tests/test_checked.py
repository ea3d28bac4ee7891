"""Chains that check their own data, defaults and user extractors."""

import numpy as np
import pytest

from lumenframe.plans import pipeline, quality, registry


@pytest.fixture(scope="module")
def images(spark):
    value = {1: lambda y, x: 20 * x, 2: lambda y, x: 300 if x == y == 0 else 5, 3: lambda y, x: 255 * (x > 2), 4: lambda y, x: None if x == 1 else 7}
    rows = [(i, y, x, value[i](y, x)) for i in value for y in range(6) for x in range(6)]
    return spark.createDataFrame(rows + [(5, 0, 0, 9)], "image_id long, y int, x int, v int")


def test_bad_images_leave_at_their_stage(images):
    p = pipeline.Profile(["std_bin", "equalize", "median_blur"], {"median_blur": {"kernel_size": 3}}, "pipeline")
    stages, bad = pipeline.checked(images.where("image_id <> 4"), p)
    assert bad.count() == 0  # a threshold makes all of them binary
    p = pipeline.Profile(["equalize", "std_bin"], mode="pipeline")
    stages, bad = pipeline.checked(images, p)
    assert {tuple(r) for r in bad.collect()} == {(i, "equalize", "[equalize] values must be integers from 0 to 255") for i in (2, 4)}
    left = lambda s: {r["image_id"] for r in stages[s].select("image_id").distinct().collect()}
    assert left("original") == {1, 2, 3, 4, 5} and left("equalize") == left("pipeline") == {1, 3, 5}
    assert set(pipeline.run(images, p)) == {"original", "equalize", "std_bin", "pipeline"}


def test_masks_must_be_binary_and_a_given_quarantine_counts(images, spark):
    p = pipeline.Profile(["mask_composition"], mode="pipeline")
    stages, bad = pipeline.checked(images, p, spark.createDataFrame([(3, "mask_composition", "by hand"), (3, "clahe", "later"), (99, "mask_composition", "unknown")], "image_id long, operator string, message string"))
    assert {(r["image_id"], r["message"]) for r in bad.collect()} == {(3, "by hand")} | {(i, "[mask_composition] values must be 0 or 255") for i in (1, 2, 4, 5)}
    assert stages["pipeline"].count() == 0
    px = spark.createDataFrame([(1, 0, 0, 0, 0, 255), (2, 0, 0, 255, 255, 255)], "image_id long, y int, x int, b int, g int, r int")
    good, bad = quality.split(px, "mask", ("binary", "equal_channels"))
    assert good.select("image_id").collect()[0][0] == 2 and bad.collect()[0]["message"] == "[mask] the channels of a mask must be equal"
    small = quality.split(images, "fft", ("four_by_four",))[1].collect()
    assert [(r["image_id"], r["message"]) for r in small] == [(5, "[fft] image must be at least 4x4")]


def test_checks_need_no_exchange_of_their_own(images):
    from lumenframe.operators.grid import by_image

    good, _ = quality.split(by_image(images), "x", ("eight_bit", "binary", "four_by_four"))
    assert good._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_defaults_are_merged_and_unknown_names_refused():
    canny = registry.PROCESSORS["canny_edge"]
    assert canny.config(threshold1=5)["threshold2"] == 200 and canny.config(threshold1=5)["threshold1"] == 5
    assert registry.EXTRACTORS["circle_counter"].config()["param2"] == 30
    for table in (registry.PROCESSORS, registry.EXTRACTORS):
        assert all(o.defaults is not None for n, o in table.items() if n not in ("mask_composition", "resize", "hlac", "glcm", "brightness")), {n for n, o in table.items() if o.defaults is None}
    with pytest.raises(ValueError, match="no parameter"):
        registry.get(registry.PROCESSORS, "median_blur", {"kernel": 3})


def test_a_users_extractor_beside_built_in_ones(images, spark):
    @registry.image_extractor("corner", "top double, n long", checks={"k": lambda k: k > 0})
    def corner(image: np.ndarray, k: int = 1) -> dict:
        return {"top": image[:k, :k].mean(), "n": image.size}

    try:
        meta = spark.createDataFrame([(i, f"i{i}.png", "c") for i in (1, 3, 5)], "image_id long, filename string, class string")
        wide = pipeline.extract(images.where("image_id IN (1, 3, 5)"), meta, ["brightness", "corner"], {"brightness": {}, "corner": {"k": 2}})
        rows = {r["filename"]: r for r in wide.collect()}
        name = next(c for c in wide.columns if "top" in c)
        assert rows["i1.png"][name] == 10 and rows["i5.png"][name] == 9
        with pytest.raises(ValueError):
            registry.get(registry.EXTRACTORS, "corner", {"k": 0})
        with pytest.raises(ValueError):
            registry.image_extractor("corner", "a double")(lambda image: {})
    finally:
        del registry.EXTRACTORS["corner"]


def test_unknown_extractors_are_named():
    from lumenframe.operators import features

    with pytest.warns(UserWarning, match="nope"):
        assert features.select_extractors([], ["nope", "brightness"], ["brightness"]) == ["brightness"]


def test_adaptive_thresholds_join_nothing(images):
    from lumenframe.operators import stencil

    some = images.where("image_id IN (1, 3)")
    for f in (stencil.mean_adapt_bin, stencil.gauss_adapt_bin):
        out = f(some, 3, 2)
        assert out.columns == some.columns and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert {r["v"] for r in out.where("image_id = 1").collect()} <= {0, 255}
