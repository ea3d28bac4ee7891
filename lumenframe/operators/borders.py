"""Connected regions and their borders in one image's array, with numpy: components by union of runs, borders as linked lists
of pixel edges that pointer jumping puts in order. No loop runs over pixels."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

_STEP = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])  # east, south, west, north: the way along an edge
_OUT = np.array([(-1, 0), (0, 1), (1, 0), (0, -1)])  # what lies outside an edge that is walked so


class Runs(NamedTuple):
    """Horizontal stretches of set pixels in raster order."""

    y: np.ndarray
    x0: np.ndarray
    x1: np.ndarray

    def names(self) -> np.ndarray:
        """A number for each run that orders them within the image."""
        return self.y.astype(np.int64) << 31 | self.x0


def connected(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for edges u-v: the larger of two roots hangs on the smaller, and pointer
    jumping flattens the trees, so that the number of roots halves in each round at least."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def runs(mask: np.ndarray) -> Runs:
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    return Runs(y, x0, np.nonzero(edge == -1)[1] - 1)


def touching(r: Runs, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs in neighbouring rows that touch; r in raster order."""
    if not len(r.y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    reach, wide = int(diagonal), int(r.x1.max()) + 3
    y = r.y.astype(np.int64)
    first = np.searchsorted(y * wide + r.x1 + 1, (y + 1) * wide + r.x0 - reach + 1, "left")
    stop = np.searchsorted(y * wide + r.x0 + 1, (y + 1) * wide + r.x1 + reach + 1, "right")
    n = np.maximum(stop - first, 0)
    u = np.repeat(np.arange(len(y)), n)
    return u, np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def label(r: Runs, diagonal: bool) -> np.ndarray:
    """For each run the first run of its region."""
    return connected(len(r.y), *touching(r, diagonal))


def painted(shape: tuple[int, int], r: Runs, value: np.ndarray) -> np.ndarray:
    """An array with each run's value on its pixels, -1 elsewhere."""
    out = np.full(shape, -1, np.int64)
    n = r.x1 - r.x0 + 1
    x = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(r.x0, n)
    out[np.repeat(r.y, n), x] = np.repeat(value, n)
    return out


class Regions(NamedTuple):
    """Regions of set pixels (8 neighbours) and holes (regions of 4 neighbours of unset ones that do not touch the frame) by
    the names of their first runs. parent: of a hole the region left of it, of a region the hole around it, or -1."""

    front: np.ndarray  # region on each pixel, or -1
    back: np.ndarray  # hole on each pixel, or -1
    region: np.ndarray
    region_parent: np.ndarray
    hole: np.ndarray
    hole_parent: np.ndarray

    def levels(self) -> tuple[np.ndarray, np.ndarray]:
        """How many regions and holes lie around each region and each hole, by pointer doubling."""
        n = len(self.region)
        name = np.concatenate([self.region, self.hole])
        # a region and a hole never begin at one pixel, so names are unique
        order = np.argsort(name)
        parent = np.concatenate([self.region_parent, self.hole_parent])
        up = np.full(len(name) + 1, len(name))
        some = parent >= 0
        up[:-1][some] = order[np.searchsorted(name[order], parent[some])]
        level = (up != len(name)).astype(np.int64)
        while (up != len(name)).any():
            level += level[up]
            up = up[up]
        return level[:n], level[n:-1]


def regions(mask: np.ndarray) -> Regions:
    f, b = runs(mask), runs(~mask)
    fname, bname = f.names(), b.names()
    root = label(f, True)
    front = painted(mask.shape, f, fname[root])
    broot = label(b, False)
    h, w = mask.shape
    frame = (b.y == 0) | (b.y == h - 1) | (b.x0 == 0) | (b.x1 == w - 1)
    open_ = np.zeros(len(broot), bool)
    np.logical_or.at(open_, broot, frame)
    inner = ~open_[broot]
    back = painted(mask.shape, Runs(b.y[inner], b.x0[inner], b.x1[inner]), bname[broot[inner]])
    hole = np.flatnonzero((broot == np.arange(len(broot))) & ~open_)
    first = np.flatnonzero(root == np.arange(len(root)))
    y, x = f.y[first], f.x0[first]
    around = np.where(x > 0, back[y, np.maximum(x - 1, 0)], -1)
    return Regions(front, back, fname[first], around, bname[hole], front[b.y[hole], b.x0[hole] - 1])


class Borders(NamedTuple):
    """The border of each region and hole as the set pixels in order, border after border. A region's begins at its first
    pixel and goes down, a hole's at the pixel left of it and goes up; a pixel comes as often as the border passes it."""

    border: np.ndarray  # for each vertex the number of its border
    y: np.ndarray
    x: np.ndarray
    first: np.ndarray  # where borders begin, and the end
    is_hole: np.ndarray


def _jumped(after: np.ndarray, rounds: int, value: np.ndarray, join) -> np.ndarray:
    """value joined over all that follow, by pointer jumping; the end points at itself."""
    for _ in range(rounds):
        value, after = join(value, value[after]), after[after]
    return value


def borders(mask: np.ndarray) -> Borders:
    """Each edge between a set pixel and an unset one is walked with the set one on the right. The next edge: of the pixel
    outside and ahead if that is set (diagonal neighbours are one region), of the pixel ahead, or the next side of this one."""
    m = np.pad(mask, 1)
    py, px = np.nonzero(m)
    side = np.stack([~m[py + dy, px + dx] for dy, dx in _OUT])  # is there an edge
    number = np.full((*m.shape, 4), -1, np.int64)
    at, way = np.nonzero(side.T)  # edges by pixel in raster order, then by side
    y, x = py[at], px[at]
    n = len(y)
    number[y, x, way] = np.arange(n)
    ey, ex = y + _STEP[way, 0], x + _STEP[way, 1]
    oy, ox = ey + _OUT[way, 0], ex + _OUT[way, 1]
    outer, ahead = m[oy, ox], m[ey, ex]
    after = np.where(outer, number[oy, ox, (way + 3) % 4], np.where(ahead, number[ey, ex, way], number[y, x, (way + 1) % 4]))
    rounds = max(1, math.ceil(math.log2(n + 1)))
    least = _jumped(after, rounds, np.arange(n), np.minimum)
    is_hole = way[least] != 0  # a region's first edge lies above its first pixel, a hole's below the pixels above it
    key = np.where(way == np.where(is_hole, 1, 0), np.arange(n), n)
    start = _jumped(after, rounds, key, np.minimum)
    # steps to the edge before the start: there the list is cut
    last = after == start
    cut = np.where(last, np.arange(n), after)
    left = _jumped(cut, rounds, (~last).astype(np.int64), np.add)
    order = np.lexsort((-left, start))
    y, x, loop, hole = y[order] - 1, x[order] - 1, start[order], is_hole[order]
    new = np.r_[True, loop[1:] != loop[:-1]] if n else np.zeros(0, bool)
    moved = np.r_[True, (y[1:] != y[:-1]) | (x[1:] != x[:-1])] if n else new
    keep = new | moved
    y, x, loop, hole, new = y[keep], x[keep], loop[keep], hole[keep], new[keep]
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(y))
    # the walk comes back to the first pixel
    back = (stop - first > 1) & (y[stop - 1] == y[first]) & (x[stop - 1] == x[first]) if n else np.zeros(0, bool)
    keep = np.ones(len(y), bool)
    keep[stop[back] - 1] = False
    y, x, hole = y[keep], x[keep], hole[keep]
    size = stop - first - back
    first = np.cumsum(size) - size
    # against the walk, from the same start
    border = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(y)) - first[border]
    turned = first[border] + (-place) % size[border]
    return Borders(border, y[turned], x[turned], np.append(first, len(y)), hole[first])


def measures(b: Borders) -> tuple[np.ndarray, np.ndarray]:
    """Area inside and length of each border, as a polygon through the pixels' centres."""
    if not len(b.y):
        return np.zeros(0), np.zeros(0)
    place = np.arange(len(b.y))
    after = np.where(place + 1 == b.first[b.border + 1], b.first[b.border], place + 1)
    dy, dx = b.y[after] - b.y, b.x[after] - b.x
    n = len(b.is_hole)
    area = np.abs(np.bincount(b.border, b.x * b.y[after] - b.x[after] * b.y, n)) / 2
    straight = np.bincount(b.border, (np.abs(dy) + np.abs(dx) == 1).astype(float), n)
    return area, straight + math.sqrt(2) * np.bincount(b.border, (np.abs(dy) + np.abs(dx) == 2).astype(float), n)


def corners(b: Borders) -> np.ndarray:
    """Which vertices stay when those in the middle of straight stretches go."""
    place = np.arange(len(b.y))
    last = b.first[b.border + 1] - 1
    after = np.where(place == last, b.first[b.border], place + 1)
    before = np.where(place == b.first[b.border], last, place - 1)
    same = (b.y[after] - b.y == b.y - b.y[before]) & (b.x[after] - b.x == b.x - b.x[before])
    return ~same | (last == b.first[b.border])
