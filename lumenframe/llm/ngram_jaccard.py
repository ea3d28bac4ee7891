"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures; bit counts bound the overlap from above before
exact intersections of sorted arrays.

1. Blocks of documents send their distinct shingle hashes to buckets of the hash space and learn in how many documents
   each occurs, and whether an earlier block has a document with the same set (then it is a copy and stands aside).
2. In the order rarest first, two sets that reach the threshold share one of their first n - ceil(t n) + 1 shingles.
   Representatives that share one lie in one cluster (connected components over such stars, so no pairs are made).
3. A cluster's sets are compared in one task, in tiles of rows of a size band against rows of the same and the next bands
   below; the Hamming distance of two bitmaps is at most the size of the symmetric difference, which rules most pairs out.
   Rows already in one component are not compared again. A cluster of more than `tile_docs` sets is split by bands of sizes
   of which only neighbours can link, and these into pairs of row blocks, whose links meet in a second run of connected
   components. No pair that could link is left out.

Cases: a null or empty text has the empty set, n_shingles 0 and itself as component; a text of fewer words than a shingle
has one shingle, the whole sequence; rows with equal text share a component; a row with a null doc_id has a null component
and links nothing; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm import _exchange, _text
from lumenframe.llm._graph import components
from lumenframe.llm._shared import written

_SETS = "doc_id long, n_shingles long, d1 long, d2 long, prefix array<long>, shingles binary"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(t: _text.Texts, k: int) -> list[np.ndarray]:
    """Each text's ascending distinct shingle hashes, A-Z lower-cased."""
    t = t._replace(data=_LOWER[t.data])
    w = _text.words(t)
    h = _text.word_hashes(t, w)
    at, _ = _text.window_starts(w.first, k)
    n = np.diff(w.first)
    windows = _text.window_hashes(h, k)[at] if len(at) else np.zeros(0, np.uint64)
    cut = np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))])
    out = [np.unique(windows[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        out[i] = _text.window_hashes(h[w.first[i] : w.first[i + 1]], int(n[i]))
    return out


def _digest(s: np.ndarray, salt: int) -> np.uint64:
    return np.add.reduce(_text.mix(s + np.uint64(salt)), dtype=np.uint64) if len(s) else np.uint64(0)


def _same_set(s: np.ndarray) -> np.uint64:
    """A key in the hash space for a whole set."""
    return _text.mix(np.array([_digest(s, 1)], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))[0]


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One bit for each shingle, at the top bits of its hash; rows of 64-bit words."""
    out = np.zeros((len(sets), bits), np.uint8)
    shift = np.uint64(64 - int(math.log2(bits)))
    for i, s in enumerate(sets):
        out[i, s >> shift] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def link(sets: list[np.ndarray], percent: int, rows: int = 256) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Components of the sets under 100 * intersection >= percent * union: each set's root, and the links that made them.
    All pairs that size, bitmap and component leave open are intersected."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    sets, size = [sets[i] for i in order], size[order]
    root, links = np.arange(len(sets)), []
    for a in range(0, len(sets), rows):
        here = slice(a, min(a + rows, len(sets)))
        # the smallest size that the largest of these rows could link with begins the bands compared with them
        for b in range(int(np.searchsorted(size, math.ceil(size[a] * percent / 100))) // rows * rows, a + 1, rows):
            there = slice(b, min(b + rows, len(sets)))
            if (root[here] == root[a]).all() and (root[there] == root[a]).all():
                continue
            bits = 1 << min(14, max(8, math.ceil(math.log2(size[here.stop - 1] + 1))))
            x, y = _bitmaps(sets[here], bits), _bitmaps(sets[there], bits)
            for i in range(here.stop - here.start):
                p = here.start + i
                both = size[p] + size[there]
                apart = np.bitwise_count(y ^ x[i]).sum(axis=1, dtype=np.int64)
                open_ = (100 + percent) * apart <= (100 - percent) * both
                for q in (there.start + np.flatnonzero(open_ & (root[there] != root[p]))).tolist():
                    if q >= p or root[q] == root[p]:
                        continue
                    small, large = (sets[p], sets[q]) if size[p] <= size[q] else (sets[q], sets[p])
                    common = int(_exchange.found(large, small)[0].sum())
                    if 100 * common >= percent * (len(small) + len(large) - common):
                        links.append((int(order[p]), int(order[q])))
                        root[root == root[q]] = root[p]
    back = np.empty(len(sets), np.int64)
    back[order] = order[root]
    return back, links


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75, block_docs: int = 1024, tile_docs: int = 512, buckets: int | None = None) -> DataFrame:
    """Groups of texts whose sets of `words`-word shingles link at a Jaccard similarity of percent/100 or more.

    docs: doc_id, text. Returns doc_id, n_shingles, component_id: the smallest doc_id reachable over links.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = _exchange.sizes(docs, block_docs, buckets)
    docs, by = _exchange.blocked(docs, size), _exchange.BLOCK

    def send(table: pa.Table) -> pa.Table:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        whole = []
        for t, _, _ in _exchange.slices(table):
            sets = [s for s in shingle_sets(t, words) if len(s)]
            whole += [_same_set(s) for s in sets]
            parts.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True))
        whole = np.unique(np.array(whole, np.uint64))
        h = np.concatenate([*(x for x, _ in parts), whole])
        n = np.concatenate([*(c for _, c in parts), np.zeros(len(whole), np.int64)])
        u, back = np.unique(h, return_inverse=True)
        return _exchange.messages(table, u, np.bincount(back, n, len(u)).astype(np.int64), size.buckets)

    def answer(h: np.ndarray, first: np.ndarray, least: np.ndarray, count: np.ndarray):
        group = np.cumsum(first) - 1
        df = np.bincount(group, count)[group] if len(h) else np.zeros(0)
        whole = count == 0
        return (whole & ~first) | (~whole & (df >= 2)), np.where(whole, 0, df)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_id = _exchange.ids(left["doc_id"])
        order = np.argsort(doc_id, kind="stable")
        known, df = _exchange.answers(right)
        rows: list = [None] * len(doc_id)
        for t, i, _ in _exchange.slices(left):
            for j, s in enumerate(shingle_sets(t, words)):
                n = len(s)
                keys = (int(_digest(s, 1).astype(np.int64)), int(_digest(s, 2).astype(np.int64))) if n else (int(doc_id[i + j]), 0)
                there, at = _exchange.found(known, s)
                own = np.where(there, df[at], 1) if n and len(known) else np.ones(n, np.int64)
                need = n - -(-percent * n // 100) + 1 - int((own == 1).sum())
                prefix = None
                if n and need > 0 and doc_id[i + j] != _exchange.NULL_ID and not _exchange.found(known, np.array([_same_set(s)]))[0][0]:
                    shared = np.flatnonzero(own > 1)
                    prefix = s[shared[np.lexsort((s[shared], own[shared]))[:need]]].astype(np.int64).tolist()
                rows[i + j] = (n, *keys, prefix, s.tobytes() if prefix else None)
        seen = set()
        for i in order.tolist():  # inside the block the first of equal sets stands for them
            n, d1, d2, prefix, data = rows[i]
            if prefix and (n, d1, d2) in seen:
                rows[i] = (n, d1, d2, None, None)
            seen.add((n, d1, d2))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        names = ("n_shingles", "d1", "d2", "prefix", "shingles")
        return pa.table({"doc_id": left["doc_id"]} | {k: pa.array([r[c] for r in rows], kind) for c, (k, kind) in enumerate(zip(names, kinds, strict=True))})

    empty = pa.table({"doc_id": pa.array([], pa.int64()), "n_shingles": pa.array([], pa.int64()), "d1": pa.array([], pa.int64()), "d2": pa.array([], pa.int64()), "prefix": pa.array([], pa.list_(pa.int64())), "shingles": pa.array([], pa.binary())})
    sent = docs.groupBy(by).applyInArrow(send, _exchange.MESSAGE)
    replies = _exchange.meet(sent, answer)
    sets = written(docs.groupBy(by).cogroup(replies.groupBy(by)).applyInArrow(lambda left, right: judge(left, right) if len(left) else empty, _SETS), "ngram-sets")

    heads = sets.where("prefix IS NOT NULL")
    holders = heads.select("doc_id", F.explode("prefix").alias("token"))
    least = holders.groupBy("token").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    clusters = written(components(holders.join(least, "token").select(F.col("doc_id").alias("a"), "b"), "ngram-stars"), "ngram-clusters")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"))
    members = heads.select("doc_id", "n_shingles", "shingles").join(clusters.withColumnRenamed("node", "doc_id"), "doc_id")

    def roots(table: pa.Table) -> pa.Table:
        own = table["doc_id"].to_numpy()
        root, links = link([np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()], percent)
        if table["i"][0].as_py() >= 0:
            a, b = (own[[x[i] for x in links]] if links else np.zeros(0, np.int64) for i in (0, 1))
        else:
            least = np.full(len(own), _exchange.NULL_ID)
            np.minimum.at(least, root, own)
            a, b = own, least[root]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    none, keys = F.lit(-1), ["component", "band", "i", "j"]
    tiles = members.join(sizes, "component")
    whole = tiles.where(F.col("n") <= tile_docs).select("component", *(none.alias(c) for c in keys[1:]), "doc_id", "shingles")
    linked = whole.groupBy(keys).applyInArrow(roots, "a long, b long")
    if sizes.where(F.col("n") > tile_docs).limit(1).count():
        # sets that link are of one band of sizes or of neighbouring ones: each goes to its own band and the one below
        band = F.floor(F.log("n_shingles") / (math.log(100 / percent) + 1e-9)).cast("int") if percent < 100 else F.col("n_shingles").cast("int")
        split = tiles.where(F.col("n") > tile_docs).select("component", F.explode(F.array(band, band - 1)).alias("band"), "doc_id", "shingles")
        blocks = F.ceil(F.col("rows") / tile_docs).cast("int")
        split = split.join(split.groupBy("component", "band").agg(F.count("*").alias("rows")), ["component", "band"])
        split = split.withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        split = split.select("component", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "shingles")
        met = components(split.groupBy(keys).applyInArrow(roots, "a long, b long"), "ngram-links")
        linked = linked.union(met.select(F.col("node").alias("a"), F.col("component").alias("b")))
    linked = linked.select(F.col("a").alias("head"), F.col("b").alias("least"))

    keys = ["n_shingles", "d1", "d2"]
    classes = sets.groupBy(keys).agg(F.min("doc_id").alias("head")).join(linked, "head", "left")
    classes = classes.select(*keys, F.coalesce("least", "head").alias("least"))
    out = sets.select("doc_id", *keys).join(classes, keys, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"))
