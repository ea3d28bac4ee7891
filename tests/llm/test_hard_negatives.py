"""Hard negatives against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import hard_negatives

RNG = np.random.default_rng(12)


def _plain(rows, scale=256, positives=5, negatives=3, low=50, high=95):
    by = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = (label, [math.floor(scale * c) for c in v])
        by[i] = min(by.get(i, x), x)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    out = set()
    for a in [i for i in by if i % 50 == 0]:
        every = sorted((-score(by[a][1], x), i, label) for i, (label, x) in by.items() if i != a)
        for ps, p, _ in [e for e in every if e[2] == by[a][0]][:positives]:
            fit = [(s, n) for s, n, label in every if label != by[a][0] and low * -ps <= 100 * -s <= high * -ps]
            out |= {(a, p, k + 1, n, -ps, -s) for k, (s, n) in enumerate(fit[:negatives])}
    return out


@pytest.mark.parametrize("kind", ["plain", "clustered", "copies", "wide", "huge"])
def test_against_every_pair(spark, kind):
    n, d = 900, {"wide": 37}.get(kind, 16)
    centre = RNG.normal(0, 1, (6, d))
    label = RNG.integers(0, 6, n)
    v = {
        "plain": RNG.normal(0, 1, (n, d)),
        "clustered": centre[label] + RNG.normal(0, 0.4, (n, d)),
        "copies": centre[RNG.integers(0, 6, n)],
        "wide": centre[label] * 0.3 + RNG.normal(0, 0.2, (n, d)) * np.geomspace(1, 0.01, d),
        "huge": centre[label] * 2**20 + RNG.normal(0, 2**19, (n, d)),
    }[kind]
    rows = [(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, label, strict=True))]
    rows += [(2000, None, 1), (2001, [1.0] * d, None), (None, [1.0] * d, 1), (2050, [math.nan] * d, 1), (2100, [None, *[1.0] * (d - 1)], 2), (2150, [math.inf] * d, 2), (2200, [], 3), (2250, [1.0, 2.0], 3), (50, [9.0] * d, 5), (7, [9.0] * d, 0), (7, [9.0] * d, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("x"))
    for blocks in ({}, {"anchor_block": 7, "row_block": 100}):
        got = hard_negatives.mine(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 50 == 0, **blocks).collect()
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == _plain(rows), blocks


def test_bounds_hold_and_leave_pairs_out():
    a, b = RNG.integers(-40, 40, (30, 64)), RNG.integers(-40, 40, (500, 64))
    scale = np.geomspace(60, 1, 64).astype(int)
    a, b = a * scale, b * scale
    tile = hard_negatives.Tile(a, b)
    true = a @ b.T
    for q in (0.5, 0.99, 1.0):
        least = np.quantile(true, q, axis=1)
        rows, bound = tile.bounds(least)
        assert (bound >= true[:, rows] - 1e-6 * np.abs(true[:, rows]))[bound >= least[:, None]].all()
        hit = np.argwhere(true >= least[:, None])
        at = {r: k for k, r in enumerate(rows.tolist())}
        assert all(j in at and bound[i, at[j]] >= least[i] for i, j in hit.tolist())
    assert (bound >= least[:, None]).mean() < 0.5  # most pairs are never scored


def test_nothing_to_mine(spark):
    df = spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    for some in (df, df.limit(0)):
        assert hard_negatives.mine(some, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 50 == 0).count() == 0
