"""Feature tables: wide and long forms, header order, units."""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

META = ("filename", "class", "timestamp")

#: Units of the features of each extractor (fixed values); a feature that is missing here is "unknown".
UNITS = {
    "brightness": {"mean": "intensity", "median": "intensity", "variance": "intensity2", "std_dev": "intensity", "cv": "ratio"},
    "rgb": {f"{c}_{k}": u for c in ("red", "green", "blue") for k, u in (("mean", "intensity"), ("median", "intensity"), ("variance", "intensity2"), ("std_dev", "intensity"), ("cv", "ratio"))},
    "hsv": {f"{c}_{k}": u for c, base in (("hue", "degree"), ("saturation", "intensity"), ("value", "intensity")) for k, u in (("mean", base), ("median", base), ("variance", base + "2"), ("std_dev", base), ("cv", "ratio"))},
    "lbp": {"lbp_mean": "code", "lbp_std": "code", "lbp_skewness": "ratio", "lbp_kurtosis": "ratio", "lbp_entropy": "ratio", "lbp_energy": "ratio"},
    "circle_counter": {"circle_count": "count", "small_circle_count": "count", "medium_circle_count": "count", "large_circle_count": "count", "circle_density": "per_pixel", "avg_circle_radius": "pixel", "radius_std": "pixel"},
}


#: Units of features whose names carry parameters, by the part of the name that does not (fixed values).
FAMILIES = {
    "glcm": [(r"contrast_.*", "intensity_squared"), (r"dissimilarity_.*", "intensity"), (r"correlation_.*", "correlation_coefficient"), (r"(homogeneity|energy|ASM)_.*", "ratio")],
    "fft": [
        (r"high_low_ratio|horizontal_energy|vertical_energy|band_\d+_[\d.]+_[\d.]+", "ratio"), (r"spectral_(centroid|std)", "cycle/mm_or_cycle/pixel"),
        (r"num_peaks", "count"), (r"max_peak_amp", "amplitude"), (r"(spectral|horizontal|vertical|band_\d+_[\d.]+_[\d.]+)_entropy", "normalized"),
    ],
    "swt": [(r"(L\d+_)?energy_ratio_\w+", "ratio"), (r"(L\d+_)?(total_energy|energy_\w+)", "coefficient_squared"), (r"(L\d+_)?entropy_\w+", "bits"), (r"(L\d+_)?(mean|std)_\w+", "coefficient")],
    "hlac": [(r"hlac_feature_\d+", "correlation_coefficient"), (r"normalized_hlac_feature_\d+", "normalized_correlation")],
    "lbp": [(r"lbp_bin_\d+", "ratio")],
}


def unit_of(extractor: str, feature: str) -> str:
    own = UNITS.get(extractor, {}).get(feature)
    return own or next((u for pattern, u in FAMILIES.get(extractor, []) if re.fullmatch(pattern, feature)), "unknown")


def label(extractor: str, feature: str) -> str:
    return f"{extractor}_{feature}[{unit_of(extractor, feature)}]"


def catalog(spark: SparkSession) -> DataFrame:
    """extractor, feature_name, unit."""
    return spark.createDataFrame([(e, f, u) for e, own in UNITS.items() for f, u in own.items()], "extractor string, feature_name string, unit string")


def assemble(meta: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """meta: image_id, filename, perhaps class and timestamp. Joins the extractors' wide rows on image_id; columns get their
    extractor and unit."""
    named = [df.select("image_id", *(F.col(f"`{c}`").cast("double").alias(label(e, c)) for c in df.columns if c != "image_id")) for e, df in parts.items()]
    return ordered(reduce(lambda a, b: a.join(b, "image_id", "left"), named, meta).drop("image_id"))


def ordered(wide: DataFrame) -> DataFrame:
    """filename, class, timestamp (those there are), then the features by name."""
    return wide.select(*(c for c in META if c in wide.columns), *sorted(f"`{c}`" for c in wide.columns if c not in META))


def to_long(wide: DataFrame) -> DataFrame:
    """A row for each feature: filename, perhaps class and timestamp, feature_name, feature_value."""
    own = [c for c in META if c in wide.columns]
    return wide.unpivot(own, [f"`{c}`" for c in sorted(wide.columns) if c not in META], "feature_name", "feature_value")


def to_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """The inverse of to_long; the names are known from the configuration, so no pass over the data finds them."""
    own = [c for c in META if c in long.columns]
    return ordered(long.groupBy(*own).pivot("feature_name", names).agg(F.first("feature_value")))


def select_extractors(configured: list[str], wanted: list[str] | None, known: list[str]) -> list[str]:
    """The wanted ones, else all configured; unknown ones are skipped with a warning; none left is an error."""
    out = [e for e in (wanted or configured) if e in known]
    if skipped := [e for e in (wanted or configured) if e not in known]:
        warnings.warn(f"unknown extractors are skipped: {', '.join(skipped)}", stacklevel=2)
    if not out:
        raise ValueError("no usable extractor")
    return out
