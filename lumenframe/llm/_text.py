"""Words and window hashes of whole Arrow batches of texts, with numpy over the texts' bytes.

A word is a maximal run of characters other than space and \\t \\n \\v \\f \\r. Those are single bytes in UTF-8, so words
are found in the bytes of all texts of a batch at once. A null text has no words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_LETTER = np.ones(256, bool)
_LETTER[[9, 10, 11, 12, 13, 32]] = False
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown for each base."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shifts, xors and odd multipliers)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts(NamedTuple):
    """Bytes of all texts; text i is data[lo[i]:hi[i]]."""

    data: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


class Words(NamedTuple):
    """Word j is data[start[j]:stop[j]]; text i has the words first[i]:first[i+1]."""

    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64))
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    return Texts(flat, at[:-1], at[1:])


def pieces(t: Texts, most: int):
    """Index ranges of texts with about `most` bytes each; a longer text is alone in its range."""
    i, n = 0, len(t.lo)
    while i < n:
        j = max(i + 1, int(np.searchsorted(t.hi, t.lo[i] + most, "right")))
        yield i, j
        i = j


def part(t: Texts, i: int, j: int) -> Texts:
    a, b = (t.lo[i], t.hi[j - 1]) if j > i else (0, 0)
    return Texts(t.data[a:b], t.lo[i:j] - a, t.hi[i:j] - a)


def words(t: Texts, letters: np.ndarray = _LETTER) -> Words:
    """letters: for each byte whether it is part of a word."""
    letter = letters[t.data]
    start, stop = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1]
    stop[:-1] &= ~letter[1:]
    some = t.hi > t.lo
    start[t.lo[some]] = letter[t.lo[some]]
    stop[t.hi[some] - 1] = letter[t.hi[some] - 1]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    first = np.searchsorted(a, np.append(t.lo, len(t.data)))
    return Words(a, b, first)


def word_hashes(t: Texts, w: Words) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, scrambled with its length."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    size = w.stop - w.start
    first = np.cumsum(size) - size
    inner = np.arange(int(size.sum())) - np.repeat(first, size)
    terms = t.data[inner + np.repeat(w.start, size)].astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(_BYTE_BASE, int(size.max()))[inner]
    return mix(np.add.reduceat(terms, first) + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp: the hash of the k words from each position on, as differences of prefix sums scaled back to the same
    power. The last k-1 positions have none; windows across texts are included and left to the caller."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(_WORD_BASE, len(h)), dtype=np.uint64)])
    inverse = pow(_WORD_BASE, -1, 1 << 64)
    return mix((total[k:] - total[:-k]) * powers(inverse, n) + np.uint64(k))


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose window of k words stays in its text, and the text of each."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n), text


def covered(n_words: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in one of the windows of k words that begin at `starts`."""
    edge = np.bincount(starts, minlength=n_words + 1) - np.bincount(np.minimum(starts + k, n_words), minlength=n_words + 1)
    return np.cumsum(edge)[:n_words] > 0


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Ascending 64-bit values byte plane by byte plane: the high planes are runs, which Spark's shuffle codec squeezes."""
    return np.ascontiguousarray(sorted_hashes).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the hash space, so that buckets of ascending hashes are slices."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
