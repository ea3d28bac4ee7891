"""Registries of image operators and feature extractors: their functions, defaults, checks of parameters and checks of data."""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from lumenframe.functions import color
from lumenframe.operators import arrays, geometry, histogram, regions, spectral, statistics, stencil, texture
from lumenframe.operators.grid import by_image


@dataclass(frozen=True)
class Operator:
    """name, the function (images, **parameters) -> DataFrame, checks of parameters by name, the default parameters, and the
    names of the data checks (quality.CHECKS) that its images must pass."""

    name: str
    run: Callable[..., DataFrame]
    checks: dict[str, Callable[[Any], bool]]
    needs_gray: bool = True
    defaults: dict[str, Any] | None = None
    data: tuple[str, ...] = ()

    def config(self, **parameters) -> dict[str, Any]:
        """The defaults with the user's parameters over them, checked; unknown names are errors where the defaults are known."""
        for k, v in parameters.items():
            if self.defaults is not None and k not in self.defaults:
                raise ValueError(f"[{self.name}] no parameter {k!r}; there are {sorted(self.defaults)}")
            if k in self.checks and not self.checks[k](v):
                raise ValueError(f"[{self.name}] {k} can't be {v!r}")
        if "threshold1" in parameters and "threshold2" in parameters and parameters["threshold1"] > parameters["threshold2"]:
            raise ValueError(f"[{self.name}] threshold1 is above threshold2")
        return {**(self.defaults or {}), **parameters}

    def bind(self, **parameters) -> Callable[[DataFrame], DataFrame]:
        """Checks the parameters now, before any plan is made."""
        merged = self.config(**parameters)
        return lambda images: self.run(color.to_gray(images) if self.needs_gray else images, **merged)


PROCESSORS: dict[str, Operator] = {}
EXTRACTORS: dict[str, Operator] = {}


def _defaults(f: Callable) -> dict[str, Any] | None:
    """The parameters after the images, if they are all named and have defaults."""
    own = list(inspect.signature(f).parameters.values())[1:]
    return {p.name: p.default for p in own} if all(p.default is not p.empty for p in own) else None


def _register(table: dict[str, Operator], name: str, override: bool, checks: dict | None, needs_gray: bool, of: Callable | None, data: tuple[str, ...]):
    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in table:
            if not override:
                raise ValueError(f"{name} is registered already")
            warnings.warn(f"{name} is replaced", stacklevel=2)
        table[name] = Operator(name, f, checks or {}, needs_gray, _defaults(of or f), data)
        return f

    return keep


def processor(name: str, override: bool = False, checks: dict | None = None, needs_gray: bool = True, of: Callable | None = None, data: tuple[str, ...] = ()):
    """of: the function whose defaults count, if the registered one only passes them on; data: names of quality.CHECKS."""
    return _register(PROCESSORS, name, override, checks, needs_gray, of, data)


def extractor(name: str, override: bool = False, checks: dict | None = None, needs_gray: bool = True, of: Callable | None = None, data: tuple[str, ...] = ()):
    """The function returns image_id and a column for each feature."""
    return _register(EXTRACTORS, name, override, checks, needs_gray, of, data)


def image_extractor(name: str, columns: str, override: bool = False, checks: dict | None = None):
    """Registers a Python function (one gray image as an array, **parameters) -> {feature: value}. columns: the features with
    their types, `mean double, n long`. It runs image by image, in the task of the image's group."""

    def keep(f: Callable[..., dict[str, Any]]) -> Callable[..., dict[str, Any]]:
        def run(gray: DataFrame, **parameters) -> DataFrame:
            def features(table) -> dict[str, list]:
                out = f(arrays.image(table), **parameters)
                return {c.split(" ")[0]: [out[c.split(" ")[0]]] for c in columns.split(", ")}

            return arrays.per_image(gray.select("image_id", "y", "x", "v"), features, columns)

        _register(EXTRACTORS, name, override, checks, True, f, ())(run)
        return f

    return keep


def get(table: dict[str, Operator], name: str, config: dict | None = None) -> Callable[[DataFrame], DataFrame]:
    if name not in table:
        raise KeyError(f"unknown: {name}")
    return table[name].bind(**(config or {}))


def _odd(k: Any) -> bool:
    return all(isinstance(x, int) and x >= 3 and x % 2 == 1 for x in (k if isinstance(k, (list, tuple)) else [k]))


def _positive(x: Any) -> bool:
    return x > 0


EIGHT = ("eight_bit",)
processor("grayscale", needs_gray=False)(color.to_gray)
processor("gaussian_blur", checks={"kernel_size": _odd}, of=stencil.gaussian_blur, data=EIGHT)(lambda g, **k: stencil.gaussian_blur(by_image(g), **k))
processor("average_blur", checks={"kernel_size": _odd}, of=stencil.average_blur, data=EIGHT)(lambda g, **k: stencil.average_blur(by_image(g), **k))
processor("median_blur", checks={"kernel_size": _odd}, of=stencil.median_blur, data=EIGHT)(lambda g, **k: stencil.median_blur(by_image(g), **k))
processor("bilateral_filter", checks={"d": _positive, "sigma_color": _positive, "sigma_space": _positive}, of=stencil.bilateral_filter, data=EIGHT)(lambda g, **k: stencil.bilateral_filter(by_image(g), **k))
processor("motion_blur", checks={"kernel_size": _positive}, of=stencil.motion_blur, data=EIGHT)(lambda g, **k: stencil.motion_blur(by_image(g), **k))
processor("std_bin", checks={"threshold": lambda t: 0 <= t <= 255})(histogram.std_bin)
processor("otsu_bin")(histogram.otsu_bin)
processor("gauss_adapt_bin", checks={"block_size": _odd}, of=stencil.gauss_adapt_bin)(lambda g, **k: stencil.gauss_adapt_bin(by_image(g), **k))
processor("mean_adapt_bin", checks={"block_size": _odd}, of=stencil.mean_adapt_bin)(lambda g, **k: stencil.mean_adapt_bin(by_image(g), **k))
processor("resize", checks={"width": _positive, "height": _positive}, of=geometry.resize)(lambda g, **k: geometry.resize(by_image(g), **k))
processor("canny_edge", checks={"aperture_size": lambda a: a in (3, 5, 7)}, of=regions.canny)(lambda g, **k: regions.canny(by_image(g), **k))
processor("contour", checks={"min_area": lambda a: a >= 0})(regions.contour)
processor("clahe", checks={"clip_limit": _positive}, needs_gray=False, data=EIGHT)(histogram.clahe)
processor("equalize", needs_gray=False, data=EIGHT)(histogram.equalize)
processor("mask_composition", needs_gray=False, data=("binary", "equal_channels"))(geometry.mask_composition)

extractor("brightness", needs_gray=False)(statistics.brightness)
extractor("rgb", needs_gray=False, of=statistics.rgb)(lambda p, **k: statistics.rgb(color.to_bgr(p), **k))
extractor("hsv", needs_gray=False, of=statistics.hsv)(lambda p, **k: statistics.hsv(color.to_bgr(p), **k))
extractor("lbp", of=texture.lbp)(lambda g, **k: texture.lbp(by_image(g), **k))
extractor("fft", of=spectral.fft_features, data=("four_by_four",))(lambda g, **k: spectral.fft_features(by_image(g), **k))
extractor("circle_counter", of=regions.circle_counter)(lambda g, **k: regions.circle_counter(by_image(g), **k))


@extractor("glcm")
def glcm(gray: DataFrame, distances=(1, 2, 3), angles=(0, 45, 90, 135), levels: int = 256, properties=("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "ASM")) -> DataFrame:
    """image_id and {property}_{distance}_{angle}."""
    rows = texture.glcm(by_image(gray), distances, angles, levels)
    names = [f"{p}_{d}_{a}" for p in properties for d, a, _, _ in texture.glcm_offsets(distances, angles)]
    cells = F.explode(F.array(*(F.struct(F.concat_ws("_", F.lit(p), "d", "angle").alias("n"), F.col(p.lower()).alias("v")) for p in properties)))
    long = rows.select("image_id", cells.alias("c")).select("image_id", F.col("c.n").alias("__n"), F.col("c.v").alias("__v"))
    return long.groupBy("image_id").pivot("__n", names).agg(F.first("__v"))


@extractor("hlac")
def hlac(gray: DataFrame, order: int = 2, rotate_invariant: bool = False, **options) -> DataFrame:
    """image_id and hlac_feature_00 and so on."""
    rows = texture.hlac_multiscale(by_image(gray), order=order, rotate_invariant=rotate_invariant, **options)
    names = [f"hlac_feature_{k:02d}" for k in range(len(texture.hlac_kernels(order, rotate_invariant)))]
    return rows.select("image_id", F.format_string("hlac_feature_%02d", "k").alias("__n"), F.col("count").cast("double").alias("__v")).groupBy("image_id").pivot("__n", names).agg(F.first("__v"))


@extractor("swt", data=("four_by_four",))
def swt(gray: DataFrame, wavelet: str = "db1", max_level: int = 1, multiscale: bool = True) -> DataFrame:
    """image_id and, for each level (or the finest alone, without prefix), the statistics of each band."""
    rows = spectral.swt_features(by_image(gray), wavelet, max_level)
    if not multiscale:
        rows = rows.where("level = 1")
    prefix = F.concat(F.lit("L"), "level", F.lit("_")) if multiscale else F.lit("")
    direction = F.when(F.col("band") == "lh", "h").when(F.col("band") == "hl", "v").otherwise("d")
    cells = [F.struct(F.concat(prefix, F.lit(f"{m}_"), "band").alias("n"), F.col(m).alias("v")) for m in ("mean", "energy", "entropy", "std")]
    cells.append(F.struct(F.concat(prefix, F.lit("energy_ratio_"), direction).alias("n"), F.col("energy_ratio").alias("v")))
    total = rows.groupBy("image_id", "level").agg(F.sum("energy").alias("v")).select("image_id", F.concat(prefix, F.lit("total_energy")).alias("__n"), F.col("v").alias("__v"))
    long = rows.select("image_id", F.explode(F.array(*cells)).alias("c")).select("image_id", F.col("c.n").alias("__n"), F.col("c.v").alias("__v")).where("__v IS NOT NULL")
    levels = [f"L{k}_" for k in range(1, max_level + 1)] if multiscale else [""]
    names = [p + n for p in levels for n in (*(f"{m}_{b}" for m in ("mean", "energy", "entropy", "std") for b in ("ll", "lh", "hl", "hh")), "energy_ratio_h", "energy_ratio_v", "energy_ratio_d", "total_energy")]
    return long.unionByName(total).groupBy("image_id").pivot("__n", names).agg(F.first("__v"))
