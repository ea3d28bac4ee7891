"""Ranked search against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lumenframe.llm import lexical_search

RNG = np.random.default_rng(13)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _plain(docs, items, most=10):
    own = [(d, Counter(_terms(t))) for d, t in docs]
    own = [x for x in own if x[1]]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked: dict = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(_terms(t))
    out = set()
    for i, q in asked.items():
        scored = []
        for d, c in own:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in q.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out |= {(i, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:most])}
    return out


VOCABULARY = np.array([f"t{i}" for i in range(300)] + ["Ünï", "日本", "it's", "A1-b2", "é"])


def _text(n):
    return " ".join(VOCABULARY[np.minimum(RNG.zipf(1.3, n) - 1, len(VOCABULARY) - 1)])


@pytest.fixture(scope="module")
def rows():
    docs = [(i, _text(int(n))) for i, n in enumerate(RNG.geometric(0.02, 250))]
    docs += [(300 + i, docs[7][1]) for i in range(40)]  # one stratum holds many copies
    docs += [(400, None), (401, ""), (402, " -- !"), (None, _text(30)), (None, docs[9][1]), (9, _text(20)), (9, docs[9][1]), (-5, docs[9][1]), (403, "t3 " * 20_000), (404, "x" * 50_000)]
    items = [(i, _text(int(n))) for i, n in enumerate(RNG.integers(1, 40, 30))]
    items += [(100, None), (101, "unknownterm zz"), (102, docs[9][1]), (None, "t1"), (103, "t5 t5 T5"), (103, "t9"), (104, "t3 " * 3000)]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark, rows):
    return spark.createDataFrame([(d, t, 1) for d, t in rows[0]], "doc_id long, text string, score int").repartition(3), spark.createDataFrame(rows[1], "item_id long, text string")


def test_against_every_document(frames, rows, spark, tmp_path):
    want = _plain(*rows)
    for size in (lexical_search._SEGMENT_BYTES, 4000):
        got = lexical_search.rank(*frames, segment_bytes=size).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want, size
    path = str(tmp_path / "index")
    built = lexical_search.build(frames[0], 4000, path)
    again = lexical_search.index_at(spark, path)
    assert (again.n_docs, again.n_terms) == (built.n_docs, built.n_terms)
    assert set(map(tuple, lexical_search.search(again, frames[1], item_block=5).collect())) == want
    assert set(map(tuple, lexical_search.search(again, frames[1], most=3).collect())) == _plain(*rows, most=3)


def test_strata_below_the_last_place_are_not_visited(frames, rows):
    built = lexical_search.build(frames[0])
    segment = lexical_search.Segment(built.table.first().asDict())
    n, _, terms, tf = lexical_search.document_terms(lexical_search._text.texts(lexical_search.pa.array(["t200 t250 t120"])))
    seen = []
    whole = lexical_search._sums
    lexical_search._sums = lambda g, v, k: seen.append(k) or whole(g, v, k)
    try:
        docs, score = segment.best(terms, np.array([5000, 6000, 7000]), 2, 0)
    finally:
        lexical_search._sums = whole
    assert len(docs) == 2 and sum(seen[1:]) < len(segment.doc_id) / 2


def test_nothing_to_find(spark, frames):
    docs, items = frames
    assert lexical_search.rank(docs.limit(0), items).count() == 0
    assert lexical_search.rank(docs, items.limit(0)).count() == 0
    assert lexical_search.rank(docs.where("text IS NULL"), items).count() == 0


def test_a_task_holds_little_before_it_sends(spark):
    """A segment is of 12 MB of text at most, and a task sends its postings before it holds a million and a piece's; before, twice
    and three times that."""
    assert lexical_search._SEGMENT_BYTES <= 12 << 20 and lexical_search._POSTINGS <= 1_000_000 and lexical_search._PIECE <= 1_500_000
