"""Profiles: chains and fans of operators over all images at once."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lumenframe.operators import grid
from lumenframe.plans import quality, registry


@dataclass(frozen=True)
class Profile:
    """Operator names in order, their parameters by name, and `pipeline` or `parallel`."""

    processors: list[str]
    config: dict[str, dict] = field(default_factory=dict)
    mode: str = "parallel"


def profile(profiles: dict[str, dict], name: str, default_mode: str = "parallel") -> Profile:
    """The named profile of a configuration; a missing or empty one is an error."""
    if name not in profiles:
        raise KeyError(f"no profile {name!r}; there are {sorted(profiles)}")
    p = profiles[name]
    if not p.get("processors"):
        raise ValueError(f"profile {name!r} has no processors")
    return Profile(list(p["processors"]), {k: v for k, v in p.items() if isinstance(v, dict)}, p.get("mode", default_mode))


def _one(name: str, config: dict, current: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    if name != "mask_composition":
        return registry.get(registry.PROCESSORS, name, config)(current)
    options = {k: v for k, v in config.items() if k != "target_image"}
    wanted = config.get("target_image", "original")
    if wanted not in stages:
        warnings.warn(f"no stage {wanted!r}: the original is used", stacklevel=3)
    return registry.PROCESSORS[name].run(stages.get(wanted, stages["original"]), mask=current, **options)


def checked(images: DataFrame, p: Profile, quarantine: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every stage by name, each on the output of the one before, the last also as `pipeline`; and the quarantine (image_id,
    operator, message). An operator's data checks judge what it is about to read: images that fail leave there and have no
    later stage, the others go on. quarantine: images (image_id, operator, maybe message) that are to leave in any case."""
    stages = {"original": images}
    now, bad = images, []
    for name in p.processors:
        operator = registry.PROCESSORS[name] if name in registry.PROCESSORS else None
        if quarantine is not None:
            told = quarantine.where(F.col("operator") == name)
            message = F.col("message") if "message" in quarantine.columns else F.lit(None).cast("string")
            told = told.groupBy("image_id").agg(F.first(message).alias("message")).select("image_id", F.lit(name).alias("operator"), "message")
            bad.append(told.join(now.select("image_id").distinct(), "image_id", "left_semi"))
            now = now.join(told.select("image_id"), "image_id", "left_anti")
        now, failed = quality.split(now, name, operator.data if operator else ())
        bad += [failed] if failed is not None else []
        now = stages[name] = _one(name, p.config.get(name, {}), now, stages)
    kind = images.schema["image_id"].dataType.simpleString()
    none = images.sparkSession.createDataFrame([], f"image_id {kind}, operator string, message string")
    return stages | {"pipeline": now}, reduce(DataFrame.unionByName, bad, none)


def chain(images: DataFrame, p: Profile, quarantine: DataFrame | None = None) -> dict[str, DataFrame]:
    """The stages of `checked`, without those that failed."""
    return checked(images, p, quarantine)[0]


def fan(images: DataFrame, p: Profile, keep: str = "all") -> dict[str, DataFrame]:
    """Every operator on the original, which is dealt by image_id once and kept if there are several; mask operators have no
    mask here and are left out. keep `last`: the last alone."""
    names = [n for n in p.processors if n != "mask_composition"]
    if len(names) > 1 and keep != "last":
        images = grid.kept_by_image(images)
    out = {n: _one(n, p.config.get(n, {}), images, {"original": images}) for n in (names[-1:] if keep == "last" else names)}
    return {"original": images} | out


def run(images: DataFrame, p: Profile, **options) -> dict[str, DataFrame]:
    """An unknown mode has no output but the original."""
    if p.mode == "pipeline":
        return chain(images, p, **options)
    return fan(images, p, **options) if p.mode == "parallel" else {"original": images}


def statuses(images: DataFrame, p: Profile, quarantine: DataFrame) -> DataFrame:
    """image_id, stage, status of a chain: ok, failed, or skipped_due_to_earlier_failure. images: image_id."""
    places = {n: k for k, n in enumerate(p.processors)}
    at = F.create_map(*(F.lit(x) for pair in places.items() for x in pair))
    first = quarantine.where(F.col("operator").isin(list(places))).groupBy("image_id").agg(F.min(F.element_at(at, F.col("operator"))).alias("bad"))
    every = images.select("image_id").distinct().withColumn("s", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for n, k in places.items()))))
    every = every.join(first, "image_id", "left")
    status = F.when(F.col("bad").isNull() | (F.col("s.k") < F.col("bad")), "ok").when(F.col("s.k") == F.col("bad"), "failed").otherwise("skipped_due_to_earlier_failure")
    return every.select("image_id", F.col("s.n").alias("stage"), status.alias("status"))


def summary(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("n"))


def together(stages: dict[str, DataFrame]) -> DataFrame:
    """All gray stages in one relation with a column stage."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("stage"), "image_id", "y", "x", "v") for n, df in stages.items()))


def extract(images: DataFrame, meta: DataFrame, wanted: list[str], config: dict[str, dict] | None = None) -> DataFrame:
    """The wide feature table. The images are read and dealt by image_id once and kept while several extractors use them."""
    from lumenframe.functions import color
    from lumenframe.operators import features

    config = config or {}
    names = features.select_extractors(list(config) or list(registry.EXTRACTORS), wanted, list(registry.EXTRACTORS))
    kept: dict[bool, DataFrame] = {}
    parts = {}
    for n in names:
        run = registry.get(registry.EXTRACTORS, n, config.get(n))  # parameters are checked before anything is kept
        gray = registry.EXTRACTORS[n].needs_gray or "v" in images.columns
        if gray not in kept:
            kept[gray] = grid.kept_by_image(color.to_gray(images) if gray else images)
        parts[n] = run(kept[gray])
    return features.assemble(meta, parts)
