"""Packing against plain Python, and its invariants."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
RNG = np.random.default_rng(6)
TEXTS = [None, "", " ", "one two", "one two", "It's DON'T <|endoftext|> a<|startoftext|>b", "x" * 5000, "wörd ÜBER straße. İstanbul Σας ﬁ e\u0301 日本 1,234.5!!", "tab\tfeed\n\nline  two", "a,b c.d (e) -f- &&& g$$$ <br> it's, o'clock's.", "\x00 \u00a0 \u2003x"]
TEXTS += [" ".join("".join(chr(RNG.integers(97, 123)) for _ in range(RNG.integers(1, 9))) for _ in range(n)) for n in RNG.integers(1, 400, 150)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i // 2, t, 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(3).sortWithinPartitions("doc_id", "text").cache()


LIBRARY = Tokenizer.from_file(PATH)


def _ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("size", [1, 16, 100, 2048])
def test_every_id_lies_in_one_piece(docs, size):
    rows = packing.pack(docs, PATH, 1, size, ids=True).collect()
    parts: dict = {}
    for r in rows:
        parts.setdefault(r["sequence_id"], []).append(r)
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for p in parts.values():
        p.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in p] == np.cumsum([0, *(r["length"] for r in p)])[:-1].tolist()
        n = sum(r["length"] for r in p)
        assert n == size or n < size and n & (n - 1) == 0  # no padding at all
    # rows of one doc_id can't be told apart, but the ids of all pieces are those of all documents
    want = sorted(zip([None if i == 3 else i // 2 for i in range(len(TEXTS))], map(_ids, TEXTS), strict=True), key=str)
    flat = {}
    for r in rows:
        flat[r["doc_id"]] = flat.get(r["doc_id"], 0) + r["length"]
    need = {}
    for d, x in want:
        need[d] = need.get(d, 0) + len(x)
    assert flat == need
    alone = {d for d in need if sum(e == d for e, _ in want) == 1}
    for d, x in want:
        if d in alone:
            own = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == d)
            assert [i for _, ids in own for i in ids] == x and {r["doc_tokens"] for r in rows if r["doc_id"] == d} == {len(x)}


def test_levels_are_chosen_by_the_squares():
    """Each choice against all levels, counted anew."""
    p, size = packing.Packer(30), 30
    squares = lambda n: sum(int(x) ** 2 for x in n[1:size])
    for i, n in enumerate(RNG.integers(1, 31, 400).tolist()):
        best = None
        for level in range(size - n, -1, -1):
            if n < size and (level == 0 or p.levels[level]):
                now = p.levels.copy()
                now[level] -= level > 0
                now[level + n] += 1
                if best is None or squares(now) < best[0]:
                    best = squares(now), level
        if best:
            assert p.place(n) == best[1]
        list(p.add(i, np.zeros(n, np.uint16)))
        assert all(len(p.open.get(h, [])) == p.levels[h] for h in range(1, size))


def test_documents_are_cut_at_the_end_only():
    """Documents within a window stay whole but for the last windows, and there no cutting whatever gives far fewer pieces (a greedy choice of groups: 15 %): cuts
    are windows less groups that fill windows by themselves, of which there are at most the pairs and a third of the others."""
    p, whole, pieces = packing.Packer(256), 0, 0
    for i, n in enumerate(RNG.integers(1, 257, 20000).tolist()):
        for w in p.add(i, np.zeros(n, np.uint16)):
            assert w.fill == 256 and all(start == 0 for _, start, _ in w.pieces)
            whole += len(w.pieces)
    left = Counter(len(ids) for windows in p.open.values() for w in windows for _, _, ids in w.pieces)
    docs, filled = left.total(), sum(n * m for n, m in left.items()) // 256
    pairs = sum(min(left[n], left[256 - n]) for n in range(1, 128)) + left[128] // 2
    least = docs + filled - pairs - (docs - 2 * pairs) // 3 - 1
    for w in p.close():
        pieces += len(w.pieces)
        assert w.fill == 256 or w.fill.bit_count() == 1
    assert whole > 18000 and whole + docs == 20000 and least <= pieces <= 1.15 * least


def test_sequences_are_padded_but_for_powers_of_two(docs, spark):
    out = packing.sequences(packing.pack(docs, PATH, 1, 100, powers=False, ids=True), 100, pad_id=9).collect()
    assert all(len(r["ids"]) == (r["n_tokens"] if r["n_tokens"].bit_count() == 1 else 100) and set(r["ids"][r["n_tokens"] :]) <= {9} for r in out)
    assert sum(r["n_tokens"] for r in out) == sum(len(_ids(t)) for t in TEXTS)
    assert packing.pack(docs.limit(0), PATH, 1).count() == 0
    assert packing.pack(spark.createDataFrame([(1, "")], "doc_id long, text string"), PATH, None).count() == 0


def test_stretches_as_the_library_encodes_them():
    own = packing.StretchEncoder(PATH, most=50)
    every = [chr(c) for c in [*range(0x250), 0x300, 0x301, 0x345, 0x370, 0x3A3, 0x3C2, 0x1E9E, 0x2126, 0xAC00, 0x1F600]]
    texts = [*TEXTS, *(f"e{c}b {c} {c}x, a{c}. {c}{c}" for c in every)]
    texts = [t or "" for t in texts]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, own.kind).tolist() for x in own.packed(texts)] == want
