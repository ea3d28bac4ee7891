"""Hashes of blocks of documents meet in buckets of the hash space, and what the buckets find goes back to the blocks.

A block is a range of doc_ids with about `block_docs` rows, so that its hashes are made distinct before they are shuffled: a
key that a third of all documents hold is sent once a block. Ranges begin at multiples of a power of two, which is the block's
name. One pass over ids and lengths gives the first width (Sizes); ranges that hold far more rows or bytes are cut again by
the span of the ids in them, until none does or a single id is left, whose rows (or those of no id) are dealt over several
blocks. Messages are packed arrays, one a block and bucket. A null doc_id counts as larger than any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.llm import _text
from lumenframe.llm._shared import partitions, written

#: A block's name, in the order of doc_ids; blocks that differ in the last part alone hold the same id.
BLOCK = ["block", "salt"]
MESSAGE = "bucket int, block long, salt int, hashes binary, counts binary"
NULL_ID = np.iinfo(np.int64).max
_BLOCK_BYTES, _BUCKET_BYTES = 64 << 20, 1 << 30
MOST_BROADCAST = 100_000


class Sizes(NamedTuple):
    bits: int  # a block has 2**bits doc_ids
    rows: int  # of a block, about
    buckets: int


def sizes(docs: DataFrame, block_docs: int, buckets: int | None) -> Sizes:
    """Blocks of about block_docs rows at the ids' mean density; more if messages would be under a KB, up to 64 MB of text.
    Buckets: twice the shuffle partitions, or one a GB of text if that is more."""
    n, low, high, size = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id"), F.sum(F.octet_length("text"))).first()
    if buckets is None:
        buckets = max(2 * partitions(docs.sparkSession), math.ceil((size or 0) / _BUCKET_BYTES))
        mean = max(1.0, (size or 0) / max(1, n))
        block_docs = max(block_docs, min(math.ceil(1300 * buckets / mean), int(_BLOCK_BYTES / mean)))
    spread = (high - low + 1) if low is not None else 1
    return Sizes(_bits(spread * block_docs // max(1, n)), block_docs, buckets)


def _bits(width: int) -> int:
    """The nearest power of two at or below a width of ids; beyond 2**62 a range's span would not fit a long."""
    return min(62, max(1, width).bit_length() - 1)


def _floor(id_: Column, bits: Column | int) -> Column:
    """The multiple of 2**bits at or below an id."""
    return F.call_function("shiftleft", F.call_function("shiftright", id_, F.lit(bits) if isinstance(bits, int) else bits), F.lit(bits) if isinstance(bits, int) else bits)


def blocked(docs: DataFrame, s: Sizes) -> DataFrame:
    """docs (doc_id, text) with the columns of BLOCK. A cut takes at least two bits off a range's width, so that there are at
    most 32 rounds; tables whose ids are about evenly spread need none."""
    id_ = F.coalesce("doc_id", F.lit(NULL_ID))
    over, salts = [], None
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    now = docs.select(id_.alias("id"), size.alias("size"), _floor(id_, s.bits).alias("block"), F.lit(s.bits).alias("bits"))
    while True:
        most = now.groupBy("block", "bits").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("id").alias("low"), F.max("id").alias("high"))
        # a block of one id is over a size from one time the aim on, so that its rows are dealt evenly
        times = F.when(F.col("bits") == 0, 1).otherwise(4)
        full = most.where((F.col("n") > times * s.rows) | (F.col("size") > times * _BLOCK_BYTES)).withColumn("parts", F.ceil(F.greatest(F.col("n") / s.rows, F.col("size") / _BLOCK_BYTES)))
        # the power of two at or below span / parts, by the length of its binary digits
        fit = F.length(F.bin(F.greatest(F.lit(1), F.floor((F.col("high") - F.col("low") + 1) / F.col("parts"))).cast("long"))) - 1
        full = written(full.select("block", "bits", F.col("parts").cast("int").alias("parts"), F.greatest(F.lit(0), F.least(fit, F.col("bits") - 2)).cast("int").alias("finer")), "block-cuts")
        n_full, n_wide = full.agg(F.count("*"), F.count_if(F.col("bits") > 0)).first()
        small = F.broadcast if n_full <= MOST_BROADCAST else (lambda df: df)
        single = full.where("bits = 0").select("block", "parts")
        if n_full > n_wide:
            salts = single if salts is None else salts.union(single)
        if not n_wide:
            break
        cut = small(full.where("bits > 0").select("block", "bits", "finer"))
        over.append(cut)
        now = now.join(cut, ["block", "bits"]).select("id", "size", _floor(F.col("id"), F.col("finer")).alias("block"), F.col("finer").alias("bits"))
    out = docs.select("doc_id", "text", _floor(id_, s.bits).alias("block"), F.lit(s.bits).alias("bits"))
    for cut in over:
        out = out.join(cut, ["block", "bits"], "left")
        out = out.select("doc_id", "text", F.when(F.col("finer").isNull(), F.col("block")).otherwise(_floor(id_, F.col("finer"))).alias("block"), F.coalesce("finer", "bits").alias("bits"))
    if salts is None:
        return out.select("doc_id", "text", "block", F.lit(0).alias("salt"))
    salts = F.broadcast(salts) if salts.count() <= MOST_BROADCAST else salts
    out = out.join(salts.withColumn("bits", F.lit(0)), ["block", "bits"], "left")
    return out.select("doc_id", "text", "block", F.coalesce(F.pmod(F.xxhash64("text"), F.col("parts")), F.lit(0)).cast("int").alias("salt"))


def ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy().astype(np.int64)


def messages(table: pa.Table, hashes: np.ndarray, counts: np.ndarray | None, buckets: int) -> pa.Table:
    """Rows of MESSAGE of a block (table: its rows), from ascending distinct hashes and the number of its documents with each."""
    cut = np.searchsorted(_text.bucket_of(hashes, buckets), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    part = lambda a: [a[cut[i] : cut[i + 1]] for i in full]
    name = {c: pa.array([table[c][0].as_py()] * len(full), t) for c, t in zip(BLOCK, (pa.int64(), pa.int32()), strict=True)}
    return pa.table(
        {"bucket": pa.array(full, pa.int32())}
        | name
        | {
            "hashes": pa.array([_text.pack(x) for x in part(hashes)], pa.binary()),
            "counts": pa.array([x.astype("<u4").tobytes() for x in part(counts)] if counts is not None else [None] * len(full), pa.binary()),
        }
    )


def meet(sent: DataFrame, answer: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray | None]]) -> DataFrame:
    """Each bucket's hashes, ascending and with the blocks of one hash in order, go to answer(hash, first, least, count), which
    returns which of them to send back and a value for each. first: the first of its hash; least: of the blocks that
    begin its hash (several if they hold one doc_id). The result has a row of MESSAGE for each block and bucket."""

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in BLOCK])
        names = table["block"].to_numpy()
        range_ = np.concatenate([[0], np.cumsum(names[1:] != names[:-1])]).astype(np.int32)
        got = [_text.unpack(x) for x in table["hashes"].to_pylist()]
        of = np.repeat(np.arange(len(got), dtype=np.int32), [len(x) for x in got])
        h = np.concatenate(got)
        del got
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        count = None
        if table["counts"].null_count == 0:
            count = np.frombuffer(b"".join(table["counts"].to_pylist()), "<u4")[order]
        del order
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        least = first
        if len(range_) > 1 and not np.diff(range_).all():
            mine = range_[of]
            least = mine == mine[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
        back, value = answer(h, first, least, count)
        h, of = h[back], of[back]
        value = value[back].astype(np.uint32) if value is not None else None
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
        own, at = np.unique(of, return_index=True)
        cut = np.append(at, len(of))
        slices = [slice(cut[i], cut[i + 1]) for i in range(len(own))]
        return pa.table(
            {"bucket": pa.array(np.full(len(own), table["bucket"][0].as_py()), pa.int32())}
            | {c: table[c].take(pa.array(own)) for c in BLOCK}
            | {
                "hashes": pa.array([_text.pack(h[s]) for s in slices], pa.binary()),
                "counts": pa.array([None] * len(own) if value is None else [value[order][s].astype("<u4").tobytes() for s in slices], pa.binary()),
            }
        )

    return sent.groupBy("bucket").applyInArrow(judge, MESSAGE)


def answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All that came back to a block: ascending hashes, and their values (0 where none were sent)."""
    table = table.sort_by("bucket")
    h = np.concatenate([np.zeros(0, np.uint64), *(_text.unpack(x) for x in table["hashes"].to_pylist())])
    v = np.frombuffer(b"".join(x or b"" for x in table["counts"].to_pylist()), "<u4")
    return h, v if len(v) == len(h) else np.zeros(len(h), np.uint32)


def found(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted value is in the ascending array, and where."""
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return (sorted_values[at] == wanted) if len(sorted_values) else np.zeros(len(wanted), bool), at


def slices(table: pa.Table, most: int = 2_000_000) -> Iterator[tuple[_text.Texts, int, int]]:
    """A block's texts, about `most` bytes at a time, so that numpy's work arrays stay small for very long texts."""
    all_texts = _text.texts(table["text"])
    for i, j in _text.pieces(all_texts, most):
        yield _text.part(all_texts, i, j), i, j
