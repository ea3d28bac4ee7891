"""Quality rules: suffix-array repetition. Longest-common-prefix intervals find each text's maximal repeated substrings;
the union of their spans and the longest repeat are limited.

A suffix array over words is built for a batch of texts at once by prefix doubling, refining only groups that still hold
two suffixes or more; the ranks of each doubling step then give the longest common prefix of neighbours. The deepest
interval that holds a suffix has the larger of its two neighbouring prefix lengths: from there the text repeats for so many
words. Those stretches of at least `min_repeat` words make up the covered words.

Cases: a null or empty text has no words and fails the base rule (fewer than `min_words`); rows with equal doc_id or text
are judged each by itself; very long texts are taken whole; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm import _text
from lumenframe.llm._shared import small_batches

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, span_starts array<int>, span_lengths array<int>"


def repeat_lengths(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word of the texts (word hashes h, text i at first[i]:first[i+1]), over how many words from there on the
    text repeats a stretch that also starts elsewhere in it: the largest LCP interval holding that suffix."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    end = np.repeat(first[1:], size)

    def groups(major: np.ndarray, minor: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """at, ordered by (major, minor); where runs of equal pairs begin; where runs of equal major begin."""
        order = np.lexsort((minor, major))
        a, b = major[order], minor[order]
        new_major = np.ones(len(a), bool)
        new_major[1:] = a[1:] != a[:-1]
        new = new_major.copy()
        new[1:] |= b[1:] != b[:-1]
        return at[order], new, new_major

    everywhere = np.arange(n)
    sa, new, _ = groups(text, h, everywhere)
    place = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, place, 0))
    levels, step = [rank.copy()], 1
    while True:
        count = np.bincount(rank[:n], minlength=n)
        open_ = np.flatnonzero(count[rank[:n]] > 1)
        if not len(open_):
            break
        beyond = open_ + step
        minor = np.where(beyond < end[open_], rank[np.minimum(beyond, n)], -1)
        at, new, new_major = groups(rank[open_], minor, open_)
        place = np.arange(len(at))
        start = np.maximum.accumulate(np.where(new_major, place, 0))
        base = rank[at]
        sa[base + place - start] = at
        rank[at] = base + np.maximum.accumulate(np.where(new, place, 0)) - start
        levels.append(rank.copy())
        step *= 2
    a, b = sa[:-1], sa[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[near], b[near]
    common = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        same = inside & (levels[k][np.minimum(x, n)] == levels[k][np.minimum(y, n)])
        common += same << k
    lcp = np.zeros(n + 1, np.int64)
    lcp[near + 1] = common
    out = np.empty(n, np.int64)
    out[sa] = np.maximum(lcp[:-1], lcp[1:])
    return out


def _per_text(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[hi] - total[lo]


def _dup_lines(t: _text.Texts, w: _text.Words) -> np.ndarray:
    """Lines (between \\n) with a word that equal an earlier line of their text."""
    cut = np.unique(np.concatenate([t.lo, np.flatnonzero(t.data == 10) + 1]))
    stop = np.append(cut[1:], len(t.data))
    with_word = np.searchsorted(w.start, stop) > np.searchsorted(w.start, cut)
    cut, stop = cut[with_word], stop[with_word]
    stop = stop - (t.data[stop - 1] == 10)  # the line feed is no part of its line
    h = _text.word_hashes(t, _text.Words(cut, stop, cut[:0]))
    text = np.searchsorted(t.lo, cut, "right") - 1
    order = np.lexsort((h, text))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][again], minlength=len(t.lo))


def measure(t: _text.Texts, window: int, min_repeat: int) -> dict[str, list]:
    w = _text.words(t)
    n = len(w.start)
    length = repeat_lengths(_text.word_hashes(t, w), w.first)
    lo, hi = w.first[:-1], w.first[1:]
    repeats = np.flatnonzero(length >= min_repeat)
    edge = np.bincount(repeats, minlength=n + 1) - np.bincount(repeats + length[repeats], minlength=n + 1)
    in_repeat = np.cumsum(edge)[:n] > 0
    longest = np.zeros(len(lo), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(lo)), hi - lo), length)
    letter = _text._LETTER[t.data] & ((t.data & 0xC0) != 0x80)
    step = np.flatnonzero(np.diff(np.concatenate([[0], in_repeat.astype(np.int8), [0]])))
    a, b = step[::2], step[1::2]
    inner = np.unique(np.concatenate([a, w.first[1:-1][in_repeat[np.minimum(w.first[1:-1], n - 1)] & (w.first[1:-1] < n)]])) if n else a
    stops = np.minimum(b[np.searchsorted(a, inner, "right") - 1], np.append(inner[1:], n)) if len(inner) else inner
    at = np.searchsorted(inner, w.first)
    own = [slice(x, y) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return {
        "n_words": hi - lo,
        "word_chars": _per_text(letter, t.lo, t.hi),
        "n_symbols": _per_text(_SYMBOL[t.data], t.lo, t.hi),
        "n_dup_lines": _dup_lines(t, w) if n else np.zeros(len(lo), np.int64),
        "n_repeat_words": _per_text(_text.covered(n, np.flatnonzero(length >= window), window), lo, hi),
        "n_covered_words": _per_text(in_repeat, lo, hi),
        "longest_repeat": longest,
        "span_starts": [(inner[s] - f).astype(np.int32).tolist() for s, f in zip(own, lo, strict=True)],
        "span_lengths": [(stops[s] - inner[s]).astype(np.int32).tolist() for s in own],
    }


def repetition_rules(docs: DataFrame, min_words: int = 10, window: int = 5, max_window_percent: int = 20, min_repeat: int = 8, max_covered_percent: int = 15, max_longest: int = 40) -> DataFrame:
    """Measures each whole text and judges it.

    docs: doc_id, text. Returns COLUMNS and base_failed (fewer than min_words words, or more than max_window_percent of
    the words in windows of `window` words that occur twice), kept (not base_failed, at most max_covered_percent of the
    words in repeats of min_repeat words or more, and no repeat of more than max_longest words).
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = _text.texts(batch["text"])
            for i, j in _text.pieces(all_texts, 1_500_000):
                got = measure(_text.part(all_texts, i, j), window, min_repeat)
                kinds = {k: pa.list_(pa.int32()) if k.startswith("span") else pa.int64() for k in got}
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"][i:j]} | {k: pa.array(v, kinds[k]) for k, v in got.items()})

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COLUMNS)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_window_percent * F.col("n_words"))
    kept = ~failed & (100 * F.col("n_covered_words") <= max_covered_percent * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return out.withColumn("base_failed", failed).withColumn("kept", kept)
