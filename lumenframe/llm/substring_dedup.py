"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; repeated windows merge into maximal
removal intervals.

Blocks of documents send their distinct window hashes to buckets of the hash space. A bucket tells each block which of
its windows also start in an earlier block; inside its block a document knows the rest. The windows so marked merge into
intervals. Two different windows count as equal if their 64-bit hashes are (about one pair in 10**19).

Cases: a null or empty text has no words and loses none; texts shorter than a window lose none; of rows with equal doc_id
neither is smaller, so they don't remove from each other; a null doc_id counts as larger than all others; extra columns of
the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm import _exchange, _text

RESULT = "doc_id long, n_words long, n_removed long, starts array<int>, lengths array<int>, kept string"
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(t: _text.Texts, w: _text.Words, gone: np.ndarray) -> list[bytes]:
    """Each text's kept words joined by one space."""
    keep = np.flatnonzero(~gone)
    size = w.stop[keep] - w.start[keep] + 1
    first = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    inner = np.arange(len(out)) - np.repeat(first, size)
    at = inner + np.repeat(w.start[keep], size)
    real = inner < np.repeat(size - 1, size)
    out[real] = t.data[at[real]]
    raw = out.tobytes()
    cut = np.append(first, len(out))[np.searchsorted(keep, w.first)]
    return [raw[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def remove_repeats(docs: DataFrame, window: int = 13, block_docs: int = 1024, buckets: int | None = None, digest: bool = False) -> DataFrame:
    """Removes every word covered by a window of `window` words whose words also start in a document with a smaller doc_id.

    docs: doc_id, text. Returns doc_id, n_words, n_removed and either the removal intervals (`starts`, `lengths`, in words,
    maximal and disjoint) with the kept words joined by one space, or with digest=True their SHA-256 (kept_sha256).
    block_docs, buckets: see _exchange.sizes; one range of the hash space is held by a task at a time.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = _exchange.sizes(docs, block_docs, buckets)
    docs, by = _exchange.blocked(docs, size), _exchange.BLOCK

    def windows(t: _text.Texts) -> tuple[_text.Words, np.ndarray, np.ndarray, np.ndarray]:
        w = _text.words(t)
        at, text = _text.window_starts(w.first, window)
        return w, at, text, _text.window_hashes(_text.word_hashes(t, w), window)[at] if len(at) else np.zeros(0, np.uint64)

    def send(table: pa.Table) -> pa.Table:
        own = [np.unique(windows(t)[3]) for t, _, _ in _exchange.slices(table)]
        return _exchange.messages(table, np.unique(np.concatenate(own)), None, size.buckets)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_id = _exchange.ids(left["doc_id"])
        earlier, _ = _exchange.answers(right)
        hashes = [windows(t)[2:] for t, _, _ in _exchange.slices(left)]
        starts = [i for _, i, _ in _exchange.slices(left)]
        owner = np.concatenate([doc_id[i + text] for i, (text, _) in zip(starts, hashes, strict=True)])
        h = np.concatenate([x for _, x in hashes])
        order = np.lexsort((owner, h))
        first = np.ones(len(h), bool)
        first[1:] = h[order][1:] != h[order][:-1]
        least = owner[order][np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))] if len(h) else owner
        marked = np.zeros(len(h), bool)
        marked[order] = least < owner[order]
        marked |= _exchange.found(earlier, h)[0]
        rows: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "starts", "lengths", "kept")}
        done = 0
        for t, _, _ in _exchange.slices(left):
            w = _text.words(t)
            at, _ = _text.window_starts(w.first, window)
            gone = _text.covered(len(w.start), at[marked[done : done + len(at)]], window)
            done += len(at)
            total = np.concatenate([[0], np.cumsum(gone)])
            rows["n_words"] += np.diff(w.first).tolist()
            rows["n_removed"] += np.diff(total[w.first]).tolist()
            kept = _kept(t, w, gone)
            if digest:
                rows["kept"] += [hashlib.sha256(x).hexdigest() for x in kept]
                continue
            rows["kept"] += [x.decode("utf-8", "replace") for x in kept]
            for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
                rows["starts"].append(edge[::2].tolist())
                rows["lengths"].append((edge[1::2] - edge[::2]).tolist())
        out = {"doc_id": left["doc_id"], "n_words": pa.array(rows["n_words"], pa.int64()), "n_removed": pa.array(rows["n_removed"], pa.int64())}
        if digest:
            return pa.table(out | {"kept_sha256": pa.array(rows["kept"], pa.string())})
        spans = {k: pa.array(rows[k], pa.list_(pa.int32())) for k in ("starts", "lengths")}
        return pa.table(out | spans | {"kept": pa.array(rows["kept"], pa.string())})

    sent = docs.groupBy(by).applyInArrow(send, _exchange.MESSAGE)
    replies = _exchange.meet(sent, lambda h, first, least, count: (~least, None))
    return docs.groupBy(by).cogroup(replies.groupBy(by)).applyInArrow(lambda left, right: judge(left, right) if len(left) else _empty(digest), DIGEST if digest else RESULT)


def _empty(digest: bool) -> pa.Table:
    out = {"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64())}
    spans = {} if digest else {k: pa.array([], pa.list_(pa.int32())) for k in ("starts", "lengths")}
    return pa.table(out | spans | {"kept_sha256" if digest else "kept": pa.array([], pa.string())})
