"""Hashed n-grams of the characters of whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lumenframe.llm import _text

_SPREAD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def characters(t: _text.Texts) -> _text.Texts:
    """The texts as code points instead of bytes; bytes that are no UTF-8 become U+FFFD."""
    raw = t.data.tobytes()
    try:
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
        return _text.Texts(codes, at[t.lo], at[t.hi])
    except UnicodeDecodeError:
        own = [raw[a:b].decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(t.lo.tolist(), t.hi.tolist(), strict=True)]
        stop = np.cumsum([0, *map(len, own)]) // 4
        return _text.Texts(np.frombuffer(b"".join(own), np.uint32), stop[:-1], stop[1:])


def grams(t: _text.Texts, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, of `bits` bits, of all n-grams of characters, and the text of each. Shorter texts have none."""
    at, text = _text.window_starts(np.append(t.lo, len(t.data)), n)
    code = np.full(len(at), n, np.uint64)
    for k in range(n):
        code *= _STEP
        code += t.data[at + k]
    return (code * _SPREAD >> np.uint64(64 - bits)).astype(np.int64), text


def counts(t: _text.Texts, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """A row for each text: how often each hashed n-gram occurs in it."""
    size = 1 << bits
    out = np.zeros(len(t.lo) * size, np.int64)
    for n in orders:
        h, text = grams(t, n, bits)
        out += np.bincount(text * size + h, minlength=len(out))
    return out.reshape(-1, size)


def groups(t: _text.Texts, rows: int, most: int = 1_000_000) -> Iterator[tuple[_text.Texts, int, int]]:
    """At most `rows` texts at a time, and about `most` bytes."""
    for i, j in _text.pieces(t, most):
        for a in range(i, j, rows):
            b = min(a + rows, j)
            yield _text.part(t, a, b), a, b
