"""Images as arrays inside the task of their group: what a whole image decides at once (regions, transforms, votes)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lumenframe.operators import grid


def image(table: pa.Table, column: str = "v", kind: type = float) -> np.ndarray:
    """A column of one image's pixels as an array; pixels that are missing count as 0."""
    y, x = table["y"].to_numpy(), table["x"].to_numpy()
    out = np.zeros((int(y.max()) + 1, int(x.max()) + 1), kind) if len(y) else np.zeros((0, 0), kind)
    out[y, x] = table[column].to_numpy()
    return out


_CELLS = 100_000  # of small images together in one stack
_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def rows(image_id: pa.Scalar, columns: dict[str, np.ndarray], schema: str) -> pa.Table:
    """Columns of one image in the types of schema, after its image_id."""
    n = len(next(iter(columns.values())))
    kinds = dict(c.split(" ") for c in schema.split(", "))
    return pa.table({"image_id": pa.repeat(image_id, n)} | {k: pa.array(columns[k]).cast(_TYPES[t]) for k, t in kinds.items()})


def id_type(df: DataFrame) -> str:
    return df.schema["image_id"].dataType.simpleString()


def per_image(df: DataFrame, function: Callable[[pa.Table], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """function(one image's rows) -> columns of schema; image_id comes first."""
    return df.groupBy("image_id").applyInArrow(lambda t: rows(t["image_id"][0], function(t), schema), f"image_id {id_type(df)}, {schema}")


def per_image_pair(a: DataFrame, b: DataFrame, function: Callable[[pa.Table, pa.Table], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """The same of an image's rows in two relations; either may have none."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return rows((left if len(left) else right)["image_id"][0], function(left, right), schema)

    b = b.select(*(F.col(c).alias(c) for c in b.columns))  # columns of its own, also where both come from one relation
    return a.groupBy("image_id").cogroup(b.groupBy("image_id")).applyInArrow(run, f"image_id {id_type(a)}, {schema}")


def whole(images: DataFrame) -> bool:
    """Whether images has a row for each image (image_id, height, width, and its pixels row by row as the array cells), so that
    nothing need be dealt or sorted; else it has a row for each pixel."""
    return "cells" in images.columns


def sized(images: DataFrame) -> DataFrame:
    """images with height and width. A pixel relation comes out image after image, each in one task."""
    return images if whole(images) else grid.sized(images.select("image_id", "y", "x", "v"))


def _stacks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Array, tuple, np.ndarray]]:
    """Ids, keys and a stack (n, height, width) of images with equal keys, of a batch's images at a time."""
    held: list[pa.RecordBatch] = []  # of the image that the batches before ended with
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if "cells" in batch.schema.names:
            yield from _of_cells(batch, keys)
            continue
        ids = batch["image_id"]
        last = _starts(ids)[-1]
        if held and (last or not held[-1]["image_id"][-1].equals(ids[0])):
            table = pa.Table.from_batches([*held, batch.slice(0, last)]) if last else pa.Table.from_batches(held)
            yield from _of_pixels(table, keys)
            held = []
        elif last:
            yield from _of_pixels(pa.Table.from_batches([batch.slice(0, last)]), keys)
        held.append(batch.slice(last))
    if held:
        yield from _of_pixels(pa.Table.from_batches(held), keys)


def _starts(ids: pa.Array) -> np.ndarray:
    """Where a run of equal ids begins."""
    none = ids.is_null().to_numpy(zero_copy_only=False)
    other = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)), False).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, other | (none[1:] != none[:-1])])


def _equal(table: pa.Table | pa.RecordBatch, keys: list[str], at: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
    rows = np.stack([np.asarray(table[k])[at] for k in keys], axis=1)
    kinds, of = np.unique(rows, axis=0, return_inverse=True)
    for k, kind in enumerate(kinds):
        yield tuple(int(x) for x in kind), np.flatnonzero(of.ravel() == k)


def _of_cells(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[pa.Array, tuple, np.ndarray]]:
    for kind, rows in _equal(batch, keys, np.arange(batch.num_rows)):
        some = batch.take(pa.array(rows))
        yield some["image_id"], kind, pc.fill_null(some["cells"].flatten(), 0).to_numpy().astype(float).reshape(len(rows), kind[0], kind[1])


def _of_pixels(table: pa.Table, keys: list[str]) -> Iterator[tuple[pa.Array, tuple, np.ndarray]]:
    ids = table["image_id"].combine_chunks()
    start = _starts(ids)
    image = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ids))))
    y, x, v = (np.asarray(table[c]) for c in "yxv")
    for kind, rows in _equal(table, keys, start):
        place = np.full(len(start), -1)
        place[rows] = np.arange(len(rows))
        own = place[image] >= 0
        out = np.zeros((len(rows), kind[0], kind[1]))
        out[place[image[own]], y[own], x[own]] = np.nan_to_num(v[own].astype(float))
        yield ids.take(pa.array(start[rows])), kind, out


def per_stack(images: DataFrame, function: Callable[..., dict[str, np.ndarray]], schema: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """function(stack of images of one size, height, width, *keys) -> columns of schema, each of as many rows for every image of
    the stack: (images, rows). images: from sized(), with whole numbers in the columns of keys. Pixels that are missing count as 0.
    Small images are worked on by the hundred; a task holds those of one Arrow batch, or one image."""
    every = ["height", "width", *keys]
    kinds = dict(c.split(" ") for c in schema.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = ((ids[i : i + step], kind, stack[i : i + step]) for ids, kind, stack in _stacks(batches, every) for step in [max(1, _CELLS // max(1, stack[0].size))] for i in range(0, len(stack), step))
        for ids, kind, stack in some:
            out = function(stack, *kind)
            n = next(iter(out.values())).shape[1]
            if n:
                own = ids.take(pa.array(np.repeat(np.arange(len(ids)), n)))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(out[k].ravel()).cast(_TYPES[t]) for k, t in kinds.items())], names=["image_id", *kinds])

    cells = ["cells"] if whole(images) else [F.col(c).cast(t).alias(c) for c, t in (("y", "int"), ("x", "int"), ("v", "double"))]
    return images.select("image_id", *(F.col(k).cast("int").alias(k) for k in every), *cells).mapInArrow(run, f"image_id {id_type(images)}, {schema}")
