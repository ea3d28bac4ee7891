"""Hard-negative mining: threshold joins in the manner of L2AP over tiles of anchors and rows.

A tile's rows have an inverted index by groups of dimensions, the dimension of most energy first. A row is not listed under
the last dimensions, as many as its norm there times the anchors' largest norm there stays below every anchor's threshold.
Partial scores are accumulated group by group; a row that no anchor can lift over its threshold by the norms that remain is
dropped, and what is left over at the end is bounded by the norms beyond the index. Pairs whose bound reaches the anchor's
threshold are scored exactly. Thresholds begin high and are lowered, to the bound of the pairs left, until each anchor's windows
are full or nothing above the window's floor is left.

1. Positives: tiles of one label's anchors and rows; the threshold is the lowest of the anchor's best rows so far.
2. Negatives: an anchor's positives give windows of scores; tiles find the best rows of other labels in each.

Tiles are pairs of an anchor block and a row block, both dealt by hash, so no block grows with a label or a copied vector;
anchors go to all row blocks and rows to all anchor blocks, a stated query set against all rows. Between the steps only the
best rows of each tile are shuffled.

Scores are inner products of integers, exact as long as they fit 64 bits; a tile uses floating point where all partial sums
are below 2**53, and integers otherwise. Vectors of different lengths are taken as ending in zeros.

Cases: rows with a null id, label or vector, or a component that is null or not finite, take no part; of rows with equal id
the one with the least label and vector takes part; anchors without a positive, and positives without a negative in their
window, have no row; ties go to the smaller id; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenframe.llm._shared import partitions, written

_GROUP = 8  # dimensions of the index that are accumulated at once
_COLUMNS = 4096  # rows of a tile that are compared at once
_EXACT = 1 << 53


def vectors(rows: DataFrame, id_: str, vector: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """id, label, anchor (whether the row is one), x: floor(scale * component) of the rows that take part."""
    bad = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    df = rows.where(F.col(id_).isNotNull() & F.col(vector).isNotNull() & label.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    df = df.select(F.col(id_).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), x.alias("x"))
    return df.groupBy("id").agg(F.min(F.struct("label", "x", "anchor")).alias("r")).select("id", "r.label", "r.anchor", "r.x")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of integers, with zeros behind the shorter ones."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    size = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat.flatten().to_numpy()
    return out


class Tile:
    """Bounds and exact scores of anchors (rows of a) against rows (of b)."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        energy = np.square(a.astype(float)).sum(0) + np.square(b.astype(float)).sum(0)
        order = np.argsort(-energy, kind="stable")
        self.a, self.b = a[:, order], b[:, order]
        self.edges = [*range(0, a.shape[1], _GROUP), a.shape[1]]
        self.na, self.nb = self._norms(self.a), self._norms(self.b)
        most = float(self.na[:, 0].max(initial=0)) * float(self.nb[:, 0].max(initial=0))
        self.slack = 0.0 if most < _EXACT else 1e-12  # of the norms' product, for sums that floats round
        if not self.slack:
            self.a, self.b = self.a.astype(float), self.b.astype(float)
        elif most >= 1 << 63:
            raise OverflowError("scores beyond 64 bits")

    def _norms(self, m: np.ndarray) -> np.ndarray:
        """For each row the norm of its dimensions from each edge on, the last being 0; a little above the true one."""
        part = [np.square(m[:, x:y].astype(float)).sum(1) for x, y in zip(self.edges[:-1], self.edges[1:], strict=True)]
        tail = np.cumsum(np.stack([np.zeros(len(m)), *reversed(part)]), axis=0)[::-1]
        return np.sqrt(tail.T) * (1 + 1e-9)

    def bounds(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that some anchor may score `least` (one for each anchor) or more with, and the pairs' upper bounds."""
        lowest = float(least.min(initial=math.inf))
        # the first edge behind which a row need not be listed: there no anchor reaches its threshold by what is left
        beyond = self.nb * self.na.max(0, initial=0)[None, :]
        listed = np.argmax(beyond < max(lowest, 0.0), axis=1) if lowest > 0 else np.full(len(self.b), len(self.edges) - 1)
        rows = np.argsort(-listed, kind="stable")  # a group's list is then the first so many rows
        part = np.zeros((len(self.a), len(rows)))
        for g in range(len(self.edges) - 1):
            n = int(np.searchsorted(-listed[rows], -g, "left"))  # listed[row] > g
            if not n:
                break
            x, y = self.edges[g], self.edges[g + 1]
            part[:, :n] += self.a[:, x:y] @ self.b[rows[:n], x:y].T
            if g % 2 and g + 2 < len(self.edges):
                alive = (part + self.na[:, g + 1, None] * self.nb[rows, g + 1] + self.slack * self.na[:, 0, None] * self.nb[rows, 0] >= least[:, None]).any(0)
                done = listed[rows] <= g + 1  # what is not listed further is bounded at the end
                if 2 * (alive | done).sum() < len(rows):
                    rows, part = rows[alive | done], part[:, alive | done]
        part += self.na[:, listed[rows]] * self.nb[rows, listed[rows]]
        if self.slack:
            part += self.slack * self.na[:, 0, None] * self.nb[rows, 0]
        return rows, part

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for k in range(0, len(i), 100_000):
            out[k : k + 100_000] = np.einsum("ij,ij->i", self.a[i[k : k + 100_000]], self.b[j[k : k + 100_000]])
        return out


def _best(groups: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Indices of each group's `most` highest scores, equal ones by smaller id."""
    order = np.lexsort((ids, -score, groups))
    g = groups[order]
    first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    place = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0)) if len(g) else np.zeros(0, np.int64)
    return order[place < most]


def best_of_label(a: np.ndarray, b: np.ndarray, own: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor number, row number, score of the `most` best rows with another id for each anchor. own, ids: the ids."""
    kept = [np.zeros(0, np.int64)] * 3
    least = np.full(len(a), -math.inf)
    for at in range(0, len(b), _COLUMNS):
        tile = Tile(a, b[at : at + _COLUMNS])
        if at == 0 and len(tile.b) > 8 * most:  # thresholds to begin with: the best of a few rows
            some = np.arange(4 * most)
            i, j = np.repeat(np.arange(len(a)), len(some)), np.tile(some, len(a))
            s = np.where(own[i] == ids[j], np.iinfo(np.int64).min, tile.exact(i, j)).reshape(len(a), -1)
            least = np.sort(s, axis=1)[:, -most].astype(float)
        rows, bound = tile.bounds(least)
        i, j = np.nonzero((bound >= least[:, None]) & (own[:, None] != ids[at + rows]))
        j = rows[j]
        found = [np.concatenate(x) for x in zip(kept, (i, j + at, tile.exact(i, j)), strict=True)]
        best = _best(found[0], found[2], ids[found[1]], most)
        kept = [x[best] for x in found]
        n = np.bincount(kept[0], minlength=len(a))
        low = np.full(len(a), math.inf)
        np.minimum.at(low, kept[0], kept[2].astype(float))
        least = np.where(n >= most, low, least)
    return kept[0], kept[1], kept[2]


def best_in_windows(a: np.ndarray, b: np.ndarray, other: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, whose: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window number, row number, score of the `most` best rows of each window low..high of anchor `whose`.

    other: for each anchor and row whether the labels differ.
    """
    kept = [np.zeros(0, np.int64)] * 3
    floor, top = np.full(len(a), math.inf), np.full(len(a), -math.inf)
    np.minimum.at(floor, whose, low.astype(float))
    np.maximum.at(top, whose, high.astype(float))
    for at in range(0, len(b), _COLUMNS):
        part = slice(at, at + _COLUMNS)
        tile = Tile(a, b[part])
        # a window that is full asks for more than its lowest row; an anchor for the least of its windows
        need = low.astype(float).copy()
        n = np.bincount(kept[0], minlength=len(low))
        if len(kept[0]):
            lowest = np.full(len(low), math.inf)
            np.minimum.at(lowest, kept[0], kept[2].astype(float))
            need = np.where(n >= most, np.maximum(need, lowest), need)
        now = np.full(len(a), math.inf)
        np.minimum.at(now, whose, need)
        rows, bound = tile.bounds(now)
        bound = np.where(other[:, part][:, rows], bound, -math.inf)
        open_ = np.isfinite(now)
        now = np.where(open_, now, 0.0)
        upper, lower = np.full(len(a), math.inf), now + (np.maximum(top, now) - now) / 2
        share = 2.0
        while open_.any():
            i, j = np.nonzero((bound >= np.where(open_, lower, math.inf)[:, None]) & (bound < upper[:, None]))
            j = rows[j]
            score = tile.exact(i, j)
            # each pair meets its anchor's windows
            order = np.argsort(whose, kind="stable")
            first = np.searchsorted(whose[order], np.arange(len(a) + 1))
            times = np.diff(first)[i]
            pair = np.repeat(np.arange(len(i)), times)
            window = order[np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[i], times)]
            fits = (score[pair] >= low[window]) & (score[pair] <= high[window])
            found = [np.concatenate(x) for x in zip(kept, (window[fits], j[pair[fits]] + at, score[pair[fits]]), strict=True)]
            best = _best(found[0], found[2], ids[found[1]], most)
            kept = [x[best] for x in found]
            # a window is settled if it is full and its lowest row is above all bounds left
            n = np.bincount(kept[0], minlength=len(low))
            lowest = np.full(len(low), math.inf)
            np.minimum.at(lowest, kept[0], kept[2].astype(float))
            settled = (n >= most) & (lowest > lower[whose])
            left = np.zeros(len(a), bool)
            left[whose[~settled]] = True
            open_ &= left & (lower > now)
            upper = lower
            share *= 2
            lower = np.where(share > 16, now, now + (lower - now) / 2)
    return kept[0], kept[1], kept[2]


def mine(rows: DataFrame, id_: str, vector: str, label: Column, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, anchor_block: int = 1 << 14, row_block: int = 1 << 17) -> DataFrame:
    """rows: id_, vector (array of numbers) and what the columns label and anchor (a condition) read. Scores are inner
    products of floor(scale * component).

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each anchor and each of its
    `positives` best other rows of its label, the `negatives` best rows of other labels whose score is between low_percent and
    high_percent of the positive's.
    """
    spark = rows.sparkSession
    clean = written(vectors(rows, id_, vector, label, anchor, scale), "negatives-vectors")
    n, n_anchors, width = clean.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("x"))).first()
    width = max(1, width or 1)
    # as many blocks as tasks run at once, but not of few rows each: every block gives each anchor's best rows
    blocks = max(1, min(partitions(spark), math.ceil(n / _COLUMNS)), math.ceil(n / row_block))
    anchor_blocks = max(1, math.ceil(n_anchors / anchor_block))
    block = lambda k, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k)).cast("int")
    some = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    keys, row = ["a", "b"], ["id", "label", "x"]
    against = clean.select(some(anchor_blocks).alias("a"), block(blocks, 1).alias("b"), *(F.col(c).alias(c) for c in row))
    asking = clean.where("anchor").select(block(anchor_blocks, 2).alias("a"), some(blocks).alias("b"), *row)
    none = np.zeros(0, np.int64)
    best = "anchor_id long, positive_id long, score long"

    def positive(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(none, none, none)]
        if len(left) and len(right):
            a, b = matrix(left["x"], width), matrix(right["x"], width)
            own, ids, mine_, theirs = (t[c].to_numpy() for c, t in (("id", left), ("id", right), ("label", left), ("label", right)))
            for k in np.unique(mine_):
                p, q = np.flatnonzero(mine_ == k), np.flatnonzero(theirs == k)
                if len(q):
                    i, j, score = best_of_label(a[p], b[q], own[p], ids[q], positives)
                    out.append((own[p][i], ids[q][j], score))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
        return pa.table(dict(zip(("anchor_id", "positive_id", "score"), columns, strict=True)))

    found = asking.groupBy(keys).cogroup(against.groupBy(keys)).applyInArrow(positive, best)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    found = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives)
    found = written(found.groupBy("anchor_id").agg(F.collect_list("positive_id").alias("p"), F.collect_list("score").alias("s")), "negatives-positives")
    asking = clean.where("anchor").join(found.withColumnRenamed("anchor_id", "id"), "id")  # at most `positives` each
    asking = asking.select(block(anchor_blocks, 2).alias("a"), some(blocks).alias("b"), *row, "p", "s")
    result = "anchor_id long, positive_id long, positive_score long, negative_id long, score long"

    def negative(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split(" ")[0] for x in result.split(", ")]
        if not len(left) or not len(right):
            return pa.table({c: none for c in names})
        a, b = matrix(left["x"], width), matrix(right["x"], width)
        own, ids, mine_, theirs = (t[c].to_numpy() for c, t in (("id", left), ("id", right), ("label", left), ("label", right)))
        p, s = left["p"].to_pylist(), left["s"].to_pylist()
        whose = np.repeat(np.arange(len(p)), [len(x) for x in p])
        p, s = np.array([y for x in p for y in x], np.int64), np.array([y for x in s for y in x], np.int64)
        # of integers the least and the greatest inside; the products may need more than 64 bits
        low, high = (np.array([f(x) for x in s.tolist()], np.int64) for f in (lambda x: -(-low_percent * x // 100), lambda x: high_percent * x // 100))
        out = [[none] * 5]
        for at in range(0, len(a), 512):  # anchors at a time, so that the bounds of a step stay in some MB
            w = np.flatnonzero((whose >= at) & (whose < at + 512) & (low <= high))
            if len(w):
                window, j, score = best_in_windows(a[at : at + 512], b, mine_[at : at + 512, None] != theirs, ids, low[w], high[w], whose[w] - at, negatives)
                window = w[window]
                out.append([own[whose[window]], p[window], s[window], ids[j], score])
        return pa.table(dict(zip(names, (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)), strict=True)))

    found = asking.groupBy(keys).cogroup(against.groupBy(keys)).applyInArrow(negative, result)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
