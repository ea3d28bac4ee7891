"""Every operator against a plain Python version, on small awkward tables."""

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm import _shared, _text, bpe_transducer, decontamination, language_id, license_scan, ngram_jaccard, pii_surrogates, quality_classifier, quality_rules, substring_dedup, token_wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (0, BASE),
    (1, BASE.replace("w30", "x30")),
    (2, None),
    (3, ""),
    (4, " \n\t"),
    (5, "one two"),
    (6, "one two"),
    (7, "a b c d e f g h i j k l m n " * 6),
    (8, "line one\nline one\n\nother\nline one "),
    (9, "Ünïcode wörds, 日本語 テスト " + BASE),
    (10, BASE + " tail " + BASE),
    (11, "z" * 20_000 + " end"),
    (12, "\x0bv\x0cf\rr"),
    (13, BASE.upper()),
    (13, "one two"),
    (None, BASE),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in TEXTS], "doc_id long, text string, block string, n_words int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_words_are_found_in_bytes():
    import pyarrow as pa

    t = _text.texts(pa.array([x for _, x in TEXTS]))
    w = _text.words(t)
    got = [[bytes(t.data[a:b]).decode() for a, b in zip(w.start[i:j], w.stop[i:j], strict=True)] for i, j in itertools.pairwise(w.first)]
    assert got == [WORD.findall(x or "") for _, x in TEXTS]


def test_substring_dedup(docs, none):
    rows = [(float("inf") if d is None else d, WORD.findall(t or "")) for d, t in TEXTS]
    first: dict = {}
    for d, w in rows:
        for i in range(len(w) - 4):
            first[tuple(w[i : i + 5])] = min(d, first.get(tuple(w[i : i + 5]), d))
    want = Counter()
    for d, w in rows:
        gone = {i + k for i in range(len(w) - 4) if first[tuple(w[i : i + 5])] < d for k in range(5)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[(None if d == float("inf") else d, len(w), len(gone), kept)] += 1
    for block in (1, 4, 1024):
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs, 5, block).collect())
        assert got == want, block
    digest = substring_dedup.remove_repeats(docs, 5, digest=True).collect()
    assert Counter(r["kept_sha256"] for r in digest) == Counter(hashlib.sha256(k[3].encode()).hexdigest() for k in want.elements())
    assert substring_dedup.remove_repeats(none, 5).count() == 0


def test_substring_dedup_of_hot_and_sparse_ids(spark):
    """One id with a third of the rows, rows without an id, a far cluster of ids: blocks are cut, the order of ids holds."""
    rng = np.random.default_rng(8)
    ids = [*([5] * 60), *([None] * 30), *range(40), *range(10**15, 10**15 + 40)]
    rows = [(d, " ".join(f"w{i}" for i in np.concatenate([np.arange(a, a + 9) for a in rng.integers(0, 40, 4)]))) for d in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first: dict = {}
    least = lambda d: float("inf") if d is None else d
    split = [(d, t.split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 4):
            first[tuple(w[i : i + 5])] = min(least(d), first.get(tuple(w[i : i + 5]), float("inf")))
    want = Counter((d, " ".join(x for p, x in enumerate(w) if not any(first[tuple(w[i : i + 5])] < least(d) for i in range(max(0, p - 4), min(p, len(w) - 5) + 1)))) for d, w in split)
    for block in (2, 7, 1024):
        assert Counter((r["doc_id"], r["kept"]) for r in substring_dedup.remove_repeats(df, 5, block).collect()) == want, block
    unique = [(i if d is not None else None, t) for i, (d, t) in enumerate(rows)]
    got = Counter(map(tuple, ngram_jaccard.jaccard_components(spark.createDataFrame(unique, "doc_id long, text string"), block_docs=2).collect()))
    assert got == _jaccard(unique)


def test_blocks_hold_few_rows_whatever_the_ids(spark):
    from lumenframe.llm import _exchange

    rng = np.random.default_rng(4)
    hashed = lambda n: rng.integers(-(2**63), 2**63 - 1, n).tolist()
    cases = {
        "one hashed": hashed(1),
        "300 hashed": hashed(300),
        "5000 hashed": hashed(5000),
        "one far id": [*range(6000), 2**62],
        "two dense ends": [*range(-(2**63), -(2**63) + 3000), *range(2**63 - 3000, 2**63 - 1)],
        "ever denser": [x for k in range(3, 60) for x in range(2**k, 2**k + min(2**k, 100))],
        "one id": [*([7] * 3000), *([None] * 500), *range(100)],
    }
    for name, ids in cases.items():
        df = spark.createDataFrame([(d, f"t{i}") for i, d in enumerate(ids)], "doc_id long, text string")
        out = _exchange.blocked(df, _exchange.sizes(df, 64, 4)).collect()
        assert len(out) == len(ids) and max(Counter((r["block"], r["salt"]) for r in out).values()) <= 4 * 64, name
        spans: dict = {}
        for r in out:
            spans.setdefault(r["block"], []).append(_exchange.NULL_ID if r["doc_id"] is None else r["doc_id"])
        ordered = [(min(v), max(v)) for _, v in sorted(spans.items())]
        assert all(a[1] < b[0] for a, b in itertools.pairwise(ordered)), name


def test_hashed_ids(spark):
    rng = np.random.default_rng(5)
    for n in (1, 300):
        rows = [(int(d), " ".join(f"w{i}" for i in np.concatenate([np.arange(a, a + 9) for a in rng.integers(0, 40, 4)]))) for d in rng.integers(-(2**63), 2**63 - 1, n)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert Counter(map(tuple, ngram_jaccard.jaccard_components(df, block_docs=16).collect())) == _jaccard(rows)
        first: dict = {}
        for d, t in rows:
            w = t.split()
            for i in range(len(w) - 12):
                first[tuple(w[i : i + 13])] = min(d, first.get(tuple(w[i : i + 13]), d))
        gone = {d: len({p for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for p in range(i, i + 13)}) for d, w in ((d, t.split()) for d, t in rows)}
        assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df, block_docs=16).collect()} == gone


def _jaccard(rows, k=5):
    sets = []
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and sets[i][0] is not None and sets[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), None if d is None else least[find(i)]) for i, (d, s) in enumerate(sets))


def test_ngram_jaccard(docs, none):
    got = Counter(map(tuple, ngram_jaccard.jaccard_components(docs, block_docs=4).collect()))
    assert got == _jaccard(TEXTS)
    assert ngram_jaccard.jaccard_components(none).count() == 0


def test_ngram_jaccard_of_chains_and_split_clusters(spark):
    rng = np.random.default_rng(3)
    rows, words = [], [f"t{i}" for i in rng.integers(0, 9999, 80)]
    for d in range(150):  # each a small edit of one of the last few
        words = list(words)
        for _ in range(rng.integers(1, 3)):
            words[rng.integers(0, 80)] = f"n{rng.integers(0, 9999)}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _jaccard(rows)
    for tile in (512, 40):
        assert Counter(map(tuple, ngram_jaccard.jaccard_components(df, tile_docs=tile).collect())) == want


def test_suffix_repetition(docs, none):
    rows = quality_rules.repetition_rules(docs).collect()
    assert len(rows) == len(TEXTS)

    def plain(t):
        w = WORD.findall(t or "")
        best = [max((next((k for k in range(len(w)) if i + k >= len(w) or j + k >= len(w) or w[i + k] != w[j + k]), 0) for j in range(len(w)) if j != i), default=0) for i in range(len(w))]
        cover = lambda m, k: len({i + x for i in range(len(w)) if best[i] >= m for x in range(best[i] if k is None else k)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), cover(5, 5), cover(8, None), max(best, default=0))

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in rows) == Counter((d, *plain(t)) for d, t in TEXTS)
    for r in rows:
        assert sum(r["span_lengths"]) == r["n_covered_words"]
    assert quality_rules.repetition_rules(none).count() == 0


def test_wavelet_shards_round_trip(docs, none, spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    token_wavelet.write_shards(docs, f"{tmp_path}/s", path, end_id=2, shard_ids=50)
    got = token_wavelet.read_documents(spark, f"{tmp_path}/s").orderBy("start").collect()
    rows = sorted(TEXTS, key=lambda r: -1 if r[0] is None else r[0])
    ids = {(d, t): np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in rows}
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(ids[d, t]), zlib.crc32(ids[d, t].tobytes())) for d, t in rows)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    token_wavelet.write_shards(none, f"{tmp_path}/e", path)
    assert token_wavelet.read_documents(spark, f"{tmp_path}/e").count() == 0


def test_wavelet_shards_of_hot_ids(spark, tmp_path):
    """A third of the rows without an id, a third with one id: all tasks write, and the order of ids holds."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}") for i in range(300)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_wavelet.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/s", path)
    got = [r["doc_id"] for r in token_wavelet.read_documents(spark, f"{tmp_path}/s").orderBy("start").collect()]
    assert got == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    assert spark.read.parquet(f"{tmp_path}/s").select("part").distinct().count() == 4


def test_wavelet_rank_and_select(monkeypatch):
    rng = np.random.default_rng(1)
    for n, block in ((3000, 1 << 15), (3000, 256), (512, 256), (1, 256), (0, 256)):
        monkeypatch.setattr(token_wavelet, "_BLOCK", block)
        ids = rng.integers(0, 300, n)
        m = token_wavelet.WaveletMatrix.frombytes(token_wavelet.WaveletMatrix.build(ids).tobytes())
        assert (m.decode() == ids).all() and [m.access(i) for i in range(0, n, 7)] == ids[::7].tolist()
        for t in (*ids[:9].tolist(), 301, 5000):
            want = np.flatnonzero(ids == t).tolist()
            assert m.occurrences(t) == want and m.count(t) == len(want) and [m.select(t, k) for k in range(len(want))] == want
            assert [m.rank(t, i) for i in (0, n // 2, n)] == [int((ids[:i] == t).sum()) for i in (0, n // 2, n)]


def test_wavelet_reads_one_block_a_plane():
    ids = np.random.default_rng(2).integers(0, 50_000, 1 << 19)
    data = token_wavelet.WaveletMatrix.build(ids).tobytes()
    for ask in (lambda m: m.access(300_000), lambda m: m.select(int(ids[77]), 0)):
        m = token_wavelet.WaveletMatrix.frombytes(data)
        read, real = [], m._unpack
        m._unpack = type("Counted", (), {"decompress": lambda self, x, n: read.append(1) or real.decompress(x, n)})()
        ask(m)
        assert len(read) <= 3 * 16  # of 16 planes of 16 blocks


def test_bpe_equals_the_library(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in bpe_transducer.encode_decode(docs, path).collect())
    ids = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t in TEXTS]
    assert got == Counter((d, tuple(i), library.decode(i, skip_special_tokens=False)) for d, i in ids)
    assert bpe_transducer.encode_decode(none, path).count() == 0


def test_bpe_reads_every_character_as_the_library_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    bpe, library = bpe_transducer.WordBpe(path, odd=bpe_transducer.odd_characters(path)), Tokenizer.from_file(path)
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 512):
        text = " ".join(f"a{c}c {c}e\u0301 x{c}" for c in every[at : at + 512])
        assert list(bpe.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_bpe_refuses_files_it_cannot_follow(tmp_path):
    import json

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        j = json.load(f)
    for change in ({"model": j["model"] | {"byte_fallback": True}}, {"decoder": {"type": "ByteLevel"}}):
        (tmp_path / "t.json").write_text(json.dumps(j | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe_transducer.WordBpe(f"{tmp_path}/t.json")
    (tmp_path / "n.json").write_text(json.dumps(j | {"normalizer": {"type": "NFD"}}), encoding="utf-8")
    other = bpe_transducer.WordBpe(f"{tmp_path}/n.json")
    text = "Ünïcode WÖRDS don't 日本 ٣٤ a\tb <|endoftext|>c"
    assert list(other.encode(text)) == Tokenizer.from_file(f"{tmp_path}/n.json").encode(text, add_special_tokens=False).ids


def test_bpe_streams_long_words_in_little_memory():
    path = public_tokenizers.path("word_bpe_49k.json")
    bpe, library = bpe_transducer.word_bpe(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    for text in ("a" * 3000, "the" * 900, "".join(rng.choice(list("aehlnorst"), 4000)), "<|endoftext|>a<|endoftext|>'S İΣ"):
        assert list(bpe.encode(text)) == library.encode(text, add_special_tokens=False).ids
        if text.isalpha() and text.isascii():
            assert list(bpe.transducer.stream(text)) == list(bpe.encode(text))
    d = bpe_transducer.Decoder(bpe.names, "</w>")
    assert "".join(d.feed([i]) for i in bpe.encode("héllo wörld")) + d.close() == "héllo wörld "


def test_pii_surrogates(spark, none):
    rows = [(1, "Mail Anna.Bee9@mail7.example.com or anna.bee9@MAIL7.example.com, call +1 (017) 555-7713."), (2, "4111 1111 1111 1111 = 4111-1111-1111-1111, ip 10.0.0.255"), (3, None), (4, ""), (5, "Mrs. Anna Smith, г. Г-жа Иванова; Mr John Doe, Mr. John Doe"), (6, "plain 12 text 3.14"), (6, "call +1 017 555-7713")]
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_entities int")
    out = [r["text"] for r in pii_surrogates.replace(df, "k").orderBy("doc_id", F.length("text").desc()).collect()]
    assert out[2:4] == [None, ""] and "plain 12 text 3.14" in out
    a, b = re.findall(r"\S+@\S+?\.com", out[0])
    assert a == b and "nna" not in a
    c, d = re.findall(r"(?:\d{4}[ -]){3}\d{4}", out[1])
    assert c.replace(" ", "") == d.replace("-", "") and c.startswith("4111 1111") is False
    phone = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4})", out[0])
    assert phone and f"+1 {phone[1]} {phone[2]}" in " ".join(x or "" for x in out)
    names = re.findall(r"Mrs?\.? \w+ \w+", out[4])
    assert names[0].split()[1].endswith("a") and names[1].split()[1:] == names[2].split()[1:] and re.search(r"Г-жа [А-Я][а-я]+", out[4])
    assert pii_surrogates.replace(none, "k").count() == 0


def test_license_scan(spark, none):
    mit = dict((x, t) for x, t in license_scan.KNOWN if len(t) > 400)["MIT"]
    rows = [(1, f"Copyright (c) 2020 Someone\n\n{mit.upper()}\n"), (2, "text\nlicenced under the APACHE licence,  version 2.0\nmore"), (3, None), (4, "no licence that is known"), (None, "Released under the MIT License"), (None, "Released under the MIT License")]
    got = {tuple(r) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT", "document", 1), (1, "MIT", "line", 1), (2, "Apache-2.0", "line", 1), (None, "MIT", "document", 2), (None, "MIT", "line", 2)}
    assert license_scan.scan(none).count() == 0
    assert all(re.search(license_scan.CLUE, t) for _, t in license_scan.KNOWN)


def test_license_notices_inside_documents(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    rows = [(1, "Copyright 2020 J. Smith. Released under the MIT License."), (2, "Copyright (c) 2020 J. Smith"), (3, f"code here\n\n# Copyright 2021 X\n# {gpl.replace(chr(10), chr(10) + '# ')}\n \nmore code\nlast"), (4, "A licence\n\n" + "word " * 50_000)]
    got = {tuple(r) for r in license_scan.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, scope int")).collect()}
    assert got == {(1, "MIT", "document", 1), (1, "MIT", "line", 1), (3, "GPL-3.0", "paragraph", 1)}
    with pytest.raises(ValueError):
        license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), [("X", "nothing to look for")])


def test_one_very_long_line(spark):
    df = spark.createDataFrame([(1, "A licence\n\n" + "word " * 400_000 + "\n\n \nunder the MIT License" ), (2, "licence" + ", x" * 20_000)], "doc_id long, text string")
    start = time.time()
    license_scan.scan(df).collect()
    assert time.time() - start < 60


def test_license_files(spark):
    full = {x: t for x, t in license_scan.KNOWN if len(t) > 400}
    mit = f"MIT License\n\nCopyright (c) 2020 Someone\n\n{full['MIT']}"
    isc = "ISC License\n\n" + full["ISC"].replace(" copyright notice", "\ncopyright notice")
    two = "Copyright 2021 A. Holder\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE\nCOPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.\n"
    domain = "This is free and unencumbered software released into the public\ndomain."
    got = license_scan.scan(spark.createDataFrame([(1, mit), (2, isc), (3, two), (4, domain)], "doc_id long, text string"))
    assert {(r["doc_id"], r["license"]) for r in got.where("scope = 'document'").collect()} == {(1, "MIT"), (2, "ISC"), (3, "BSD-2-Clause"), (4, "Unlicense")}


def test_templates_catch_changed_parameters(spark, none):
    item = "A train leaves the station with Maria at 9 and travels 120 km before it meets 9 other trains near the old bridge."
    moved = item.replace("9", "7").replace("120 km", "450 miles").replace("Maria", "Peter")
    mixed = item.replace("at 9", "at 7").replace("meets 9", "meets 8")
    rows = [(1, f"Intro words here. {item} And more follows."), (2, f"Other. {moved} End."), (3, f"Other. {mixed} End."), (4, BASE), (5, None), (None, item)]
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, 8, 0.5).collect()}
    assert got == {(1, 10, "exact"), (2, 10, "reparameterised")}
    assert decontamination.contaminated(none, bench).count() == 0


def test_templates_are_judged_by_occurrence(spark):
    item = "A train leaves the station with Maria at 9 and travels 120 km before it meets 9 other trains near the old bridge."
    moved = item.replace("9", "7").replace("120 km", "450 miles").replace("Maria", "Peter")
    again = item.replace("9", "5").replace("120 km", "300 miles").replace("Maria", "Paula")
    longer = again.replace("and travels", "and then slowly travels")
    rows = [(1, f"First. {item} Then. {moved} End."), (2, f"{moved} {again} End."), (3, f"Other. {moved} Then more. {longer} End."), (4, item), (4, moved)]
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    got = {(r["doc_id"], r["kind"], r["n_windows"] <= r["item_windows"]) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, 8, 0.5).collect()}
    assert got == {(1, "exact", True), (2, "reparameterised", True), (3, "reparameterised", True), (4, "exact", True)}


def _corpus(spark):
    rng = np.random.default_rng(2)
    syllables = {"aa": ["lo", "mi", "ta", "re"], "bb": ["schu", "kirz", "oeg", "unt"], "cc": ["ção", "nhe", "ão", "lhi"]}
    rows = [(i, " ".join("".join(rng.choice(s, 3)) for _ in range(40)), lang) for i, (lang, s) in enumerate(list(syllables.items()) * 60)]
    return spark.createDataFrame([*rows, (9001, None, "aa"), (9002, "123 !!", None), (9003, "", "bb")], "doc_id long, text string, lang string")


def test_language_id_on_held_out_rows(spark):
    docs = _corpus(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = language_id.predict(docs, language_id.fit(docs, ~held)).withColumn("held", held).collect()
    known = [r for r in out if r["doc_id"] < 9000]
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in known if r["held"]) and not any(r["rejected"] for r in known if r["held"])
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in out if r["doc_id"] > 9000)
    empty = language_id.fit(docs.limit(0), ~held)
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"} and language_id.predict(docs.limit(0), empty).count() == 0


def test_samples_of_repeated_and_very_long_rows(spark):
    """A language of few different rows, many times each, is learned; a sample keeps within its bytes."""
    english = [(i, f"the other house and there is that which {w} with them", "en") for i, w in enumerate("alpha beta gamma delta".split())]
    german = [(100 + i, f"und der andere baum ist nicht so wie er war {i}", "de") for i in range(40)]
    df = spark.createDataFrame(english, "doc_id long, text string, lang string").withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("c")
    df = df.union(spark.createDataFrame(german, df.schema))
    model = language_id.fit(df, F.lit(True))
    assert set(model.owner.tolist()) == {0, 1}
    seen = language_id.predict(spark.createDataFrame([("the house with them and that", 7.0)], "text string, score double"), model).first()
    assert seen["lang_pred"] == "en" and not seen["rejected"] and seen["score"] < 1
    labels = df.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("quality"))
    fitted = quality_classifier.fit(df, labels, F.lit(True), most=44)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(df.dropDuplicates(), fitted).collect()}
    assert min(got[i] for i in range(4)) > max(got[100 + i] for i in range(40))
    rows = spark.createDataFrame([(0, i, "x" * 1000) for i in range(50)], "g int, k int, text string")
    groups = spark.createDataFrame([(0, 50, 40, 5500)], "g int, n long, most int, most_bytes long")
    assert _shared.sampled(rows, groups, "g", 1, "text").count() == 5
    long = language_id.fit(spark.createDataFrame([(1, "lo mi ta " * 300_000, "aa")], "doc_id long, text string, lang string"), F.lit(True), most_bytes=1000)
    assert len(long.centroids) == 1


def test_quality_classifier_on_held_out_rows(spark):
    docs = _corpus(spark)
    labels = docs.where("lang IN ('aa', 'bb')").select("doc_id", (F.col("lang") == "aa").cast("int").alias("quality")).union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int"))
    held = F.col("doc_id") % 5 == 0
    model = quality_classifier.fit(docs, labels, ~held)
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    ok = [(s >= 0.5) == (truth[d] == "aa") for d, s in scores.items() if d < 9000 and d % 5 == 0 and truth[d] in ("aa", "bb")]
    assert sum(ok) >= 0.95 * len(ok) and len(scores) == len(truth) and all(0 <= s <= 1 for s in scores.values())
    one = quality_classifier.fit(docs, labels.where("quality = 1"), ~held)
    assert quality_classifier.score(docs.limit(3), one).where("score > 0.99").count() == 3
    assert quality_classifier.score(docs.limit(0), one).count() == 0


def test_tables_without_a_word(spark):
    """Nulls and white space alone: nothing crashes, nothing is lost."""
    docs = spark.createDataFrame([(1, None), (2, ""), (None, " "), (2, "\n")], "doc_id long, text string")
    bytes_, words = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    assert [r["n_words"] for r in quality_rules.repetition_rules(docs).collect()] == [0] * 4
    assert [r["kept"] for r in substring_dedup.remove_repeats(docs).collect()] == [""] * 4
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs).collect()} == {(1, 0, 1), (2, 0, 2), (None, 0, None)}
    assert token_wavelet.token_offsets(docs, bytes_, 2).agg(F.sum("n_tokens")).first()[0] == 6
    assert bpe_transducer.encode_decode(docs, words).agg(F.sum("n_tokens")).first()[0] == 0
    assert license_scan.scan(docs).count() == 0 and pii_surrogates.replace(docs, "k").where("n_entities = 0").count() == 4
    assert decontamination.contaminated(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    model = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert language_id.predict(docs, model).where("rejected AND lang_pred = 'und'").count() == 4
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality_classifier.score(docs, quality_classifier.fit(docs, labels, F.lit(True))).count() == 4


def test_pieces_as_the_library_encodes_them():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["a \0x b", "\0", "a \0\n b", "\0a", "wörd, straße. ΣΊ", "word, word!\nnext, word?!", "日本語。 日本, 語", " lead, a  b ", "it's, don't!", ",;", ""]
    encoder = token_wavelet.PieceEncoder(path, most=3)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_different_pieces_are_looked_up_once_a_batch():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    asked = []

    class Counted(dict):
        def get(self, *key):
            asked.append(key[0])
            return dict.get(self, *key)

        def __getitem__(self, key):
            asked.append(key)
            return dict.__getitem__(self, key)

    encoder = token_wavelet.PieceEncoder(path)
    encoder.after = Counted(encoder.after)
    texts = ["Straße, straße&&& word*** word. word' it's\nword *** <|endoftext|> end<|endoftext|>\n" * 200, "\n first", "\tfirst", "\0", "last\n"] * 20
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) < 100  # of 52,000 pieces


def test_batches_are_grouped_whole():
    batches = [pa.RecordBatch.from_pydict({"x": pa.array(range(n), pa.int64()), "text": pa.array(["y" * 10] * n, pa.string())}) for n in (3, 4, 0, 9, 1, 1)]
    got = list(token_wavelet._grouped(iter(batches), rows=8))
    assert [x.num_rows for x in got] == [7, 9, 2] and sum((x["x"].to_pylist() for x in got), []) == [i for x in batches for i in x["x"].to_pylist()]
    assert [x.num_rows for x in token_wavelet._grouped(iter(batches), rows=99, size=1)] == [x.num_rows for x in batches] and not list(token_wavelet._grouped(iter([])))
