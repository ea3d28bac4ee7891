"""Ranked lexical search over a length-stratified index.

A document's normaliser m is 25 + 75 n N div L (n: its terms, L: the terms of all N documents). `build` groups documents into
segments of neighbouring m and writes, for each segment, its documents by m and the postings of every term by stratum (equal
m) and term frequency. In a stratum a term's part of the score depends on the frequency alone, so it is computed once for each
run of postings with one frequency. `search` looks into each segment for all items: the highest frequency of each term in a
stratum bounds the stratum's scores; strata are visited from the highest bound on, and those whose bound is below the
item's last place, in this segment or in ones that the task saw before, are not visited.

A term is a maximal run of ASCII letters and digits and of other characters from U+0080 on, with A-Z lower-cased. Terms are
told apart by 64-bit hashes (among 10**9 different terms about one pair in thirty is equal).

How segments are cut: boundaries of m at quantiles, so the driver holds up to 4096 numbers; documents of one m, or of a range
with more text than a segment's, are dealt over several segments by a hash of their text, so no m is one task's alone.

Cases: a null or empty text has no term, is not counted in N and is never found; rows with equal doc_id are documents of their
own, one of no id comes behind equal scores; the rows of one item_id are one item; items of no id or no known term find
nothing; very long texts and items are taken whole; extra columns are not read; without documents or items nothing is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumenframe.llm import _text
from lumenframe.llm._shared import shared_dir, small_batches, written

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PART = "segment int, salt int, doc_id binary, known binary, m binary, size binary, terms binary, tf binary"
INDEX = "segment int, salt int, doc_id binary, known binary, strata binary, first binary, terms binary, df binary, runs binary, stratum binary, tf binary, ends binary, docs binary"
_SEGMENT_BYTES, _RANGES = 12 << 20, 4096
_POSTINGS, _PIECE = 1_000_000, 1_500_000  # held before they are sent, and bytes of text cut at a time
_MOST_BROADCAST = 64 << 20
_NO_ID = np.iinfo(np.int64).max


def document_terms(t: _text.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's number of terms, its number of different ones, and these with their frequencies, text after text."""
    t = t._replace(data=_LOWER[t.data])
    w = _text.words(t, _TERM)
    h, n = _text.word_hashes(t, w), np.diff(w.first)
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return n, np.bincount(of[at], minlength=len(n)), h[at], np.diff(np.append(at, len(h)))


def lengths(docs: DataFrame) -> DataFrame:
    """n: the terms of each document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _text.texts(batch["text"])
            n = np.concatenate([np.zeros(0, np.int64), *(np.diff(_text.words(_text.part(t, i, j), _TERM).first) for i, j in _text.pieces(t, _PIECE))])
            yield pa.RecordBatch.from_arrays([pa.array(n[n > 0].astype(np.int64))], names=["n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n long")


def _segment(rows: pa.Table) -> dict[str, np.ndarray]:
    """One segment's index from its messages."""
    cat = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows[c]])
    doc_id, known, m, size = cat("doc_id", "<i8"), cat("known", "?"), cat("m", "<i8"), cat("size", "<u4")
    terms, tf = cat("terms", "<u8"), cat("tf", "<u4")
    order = np.lexsort((doc_id, m))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    m, doc_id, known = m[order], doc_id[order], known[order]
    begin = np.r_[True, m[1:] != m[:-1]]
    first, stratum = np.flatnonzero(begin), np.cumsum(begin) - 1
    docs = np.repeat(rank, size)
    stratum = stratum.astype("<u4")
    order = np.lexsort((docs, tf, stratum[docs], terms))
    terms, tf, docs = terms[order], tf[order], docs[order]
    del order
    of = stratum[docs]
    new = np.r_[True, (terms[1:] != terms[:-1]) | (of[1:] != of[:-1]) | (tf[1:] != tf[:-1])]
    run = np.flatnonzero(new)
    own = terms[run]
    head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    ends = np.append(run[1:], len(terms))
    df = np.diff(np.append(run[head], len(terms)))
    return {
        "doc_id": doc_id, "known": known, "strata": m[first], "first": np.append(first, len(m)).astype("<u4"), "terms": own[head], "df": df.astype("<u4"),
        "runs": np.append(head, len(run)).astype("<u4"), "stratum": of[run].astype("<u4"), "tf": tf[run], "ends": ends.astype("<u4"), "docs": docs,
    }


_KINDS = {"doc_id": "<i8", "known": "?", "strata": "<i8", "first": "<u4", "terms": "<u8", "df": "<u4", "runs": "<u4", "stratum": "<u4", "tf": "<u4", "ends": "<u4", "docs": "<u4"}


class Index:
    """A written index: its table and the numbers of documents and terms."""

    def __init__(self, table: DataFrame, n_docs: int, n_terms: int):
        self.table, self.n_docs, self.n_terms = table, n_docs, n_terms


def build(docs: DataFrame, segment_bytes: int = _SEGMENT_BYTES, path: str | None = None) -> Index:
    """docs: doc_id, text. Indexes every term of every document; path: a new folder that driver and executors share."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = written(lengths(docs).groupBy("n").agg(F.count("*").alias("docs")), "search-lengths")
    n_docs, n_terms = own.agg(F.sum("docs"), F.sum(F.col("n") * F.col("docs"))).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / segment_bytes))
    ranges = min(parts, _RANGES)
    salts = math.ceil(parts / ranges)
    # boundaries between lengths, so that segments are of about equal text; one length may hold several of them
    upto = F.sum(F.col("n") * F.col("docs")).over(Window.orderBy("n"))  # a row for each different length
    reached = own.select("n", upto.alias("u")).groupBy(F.floor(F.col("u") * ranges / F.lit(max(1, n_terms))).alias("k")).agg(F.min("n").alias("n"))
    first = {int(r["k"]): r["n"] for r in reached.collect()} if ranges > 1 else {}
    edges = np.array([min(n for k, n in first.items() if k >= cut) for cut in range(1, ranges)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (segment, salt), some in held.items():
                columns = [b"".join([np.ascontiguousarray(x[k]).tobytes() for x in some]) for k in range(6)]
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([salt], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], names=[c.split(" ")[0] for c in _PART.split(", ")])
            held.clear()

        for batch in batches:
            ids = batch["doc_id"]
            known, doc_id = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(_NO_ID).to_numpy()
            t = _text.texts(batch["text"])
            for a, b in _text.pieces(t, _PIECE):
                n, size, terms, tf = document_terms(_text.part(t, a, b))
                stop = np.cumsum(size)
                low, high = np.searchsorted(edges, n, "left"), np.searchsorted(edges, n, "right")
                mixed = _text.mix(np.bincount(np.repeat(np.arange(len(n)), size), (terms >> np.uint64(40)).astype(float), len(n)).astype(np.uint64) + n.astype(np.uint64))
                # a length that is several boundaries at once has several segments
                segment = low + (mixed % (high - low + 1).astype(np.uint64)).astype(np.int64)
                salt = ((mixed >> np.uint64(20)) % np.uint64(salts)).astype(np.int64)
                m = 25 + np.array([75 * x * n_docs // max(1, n_terms) for x in n.tolist()], np.int64)
                group = np.where(n > 0, segment * salts + salt, -1)
                order = np.argsort(group, kind="stable")
                at = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
                for some in np.split(order, at[1:]):
                    if group[some[0]] >= 0:
                        take = _spans(stop[some] - size[some], size[some])
                        held.setdefault(divmod(int(group[some[0]]), salts), []).append((doc_id[a + some], known[a + some], m[some], size[some].astype("<u4"), terms[take], tf[take].astype("<u4")))
                waiting += len(terms)
                if waiting >= _POSTINGS:
                    yield from flush()
                    waiting = 0
        yield from flush()

    def index(rows: pa.Table) -> pa.Table:
        out = _segment(rows)
        return pa.table({"segment": rows["segment"][:1], "salt": rows["salt"][:1]} | {c: pa.array([np.ascontiguousarray(out[c]).tobytes()], pa.binary()) for c in _KINDS})

    path = path or shared_dir(spark, "search-index")
    docs.mapInArrow(run, _PART).groupBy("segment", "salt").applyInArrow(index, INDEX).write.parquet(path)
    return Index(spark.read.schema(INDEX).parquet(path), n_docs, n_terms)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of spans, one after the other."""
    size = size.astype(np.int64)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start.astype(np.int64), size)


class Segment:
    """One segment's arrays, and the best documents of an item in it."""

    def __init__(self, row: dict[str, pa.Buffer]):
        for c, kind in _KINDS.items():
            setattr(self, c, np.frombuffer(row[c], kind))
        self.size = np.diff(self.first.astype(np.int64))
        self.begins = np.append(0, self.ends[:-1])
        n = len(self.stratum)
        last = np.ones(n, bool)  # the run of the highest frequency of its term and stratum
        last[:-1] = self.stratum[1:] != self.stratum[:-1]
        last[self.runs[1:].astype(np.int64) - 1] = True
        self.last = last
        # computed once for each run: the part that a frequency has in its stratum
        tf, m = self.tf.astype(np.int64), self.strata[self.stratum]
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)

    def best(self, terms: np.ndarray, weight: np.ndarray, most: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and scores of the `most` best documents that score above 0 and at least floor. weight: of each
        different term, times its repeats in the item."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        here = self.terms[at] == terms
        at, weight = at[here], weight[here]
        start = self.runs[at].astype(np.int64)
        size = self.runs[at + 1].astype(np.int64) - start
        runs = _spans(start, size)
        part, of = np.repeat(weight, size) * self.impact[runs], self.stratum[runs]
        top = self.last[runs]
        bound = _sums(of[top], part[top], len(self.strata))
        order = np.argsort(-bound, kind="stable")
        docs, score, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        want = 4 * most  # documents of the strata visited at a time; more each time
        while seen < len(order) and bound[order[seen]] >= max(floor, 1):
            upto = seen + 1 + int(np.searchsorted(np.cumsum(self.size[order[seen:]]), want))
            visit = np.zeros(len(self.strata), bool)
            visit[order[seen:upto]] = True
            visit &= bound >= max(floor, 1)
            some = visit[of]
            rows = runs[some]
            count = self.ends[rows].astype(np.int64) - self.begins[rows]
            found = self.docs[_spans(self.begins[rows], count)]
            numbers, back = np.unique(found, return_inverse=True)
            total = _sums(back, np.repeat(part[some], count), len(numbers))
            good = (total > 0) & (total >= floor)
            docs, score = np.concatenate([docs, numbers[good].astype(np.int64)]), np.concatenate([score, total[good]])
            keep = np.lexsort((self.doc_id[docs], ~self.known[docs], -score))[:most]
            docs, score = docs[keep], score[keep]
            if len(score) >= most:
                floor = max(floor, int(score[-1]))
            seen, want = upto, want * 4
        return docs, score


def _sums(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of integers by group, exact."""
    if len(value) and float(value.max()) * len(value) >= 1 << 53:
        out = np.zeros(n, np.int64)
        np.add.at(out, group, value)
        return out
    return np.bincount(group, value, n).astype(np.int64)


def weights(index: Index, items: DataFrame) -> DataFrame:
    """items: item_id, text. Returns item_id, term (hash), weight (times the term's repeats in the item) of the terms that
    the index has."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, size, terms, tf = document_terms(_text.texts(batch["text"]))
            own = np.repeat(batch["item_id"].to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(terms.view(np.int64)), pa.array(tf.astype(np.int64))], names=["item_id", "term", "times"])

    items = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = written(items.mapInArrow(cut, "item_id long, term long, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times")), "search-items")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, df in zip(batch["terms"], batch["df"], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_buffer(), "<i8")), pa.array(np.frombuffer(df.as_buffer(), "<u4").astype(np.int64))], names=["term", "df"])

    every = index.table.select("terms", "df").mapInArrow(count, "term long, df long")
    wanted = asked.select("term").distinct()
    wanted = F.broadcast(wanted) if wanted.limit(_MOST_BROADCAST // 16 + 1).count() <= _MOST_BROADCAST // 16 else wanted
    df = every.join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    return asked.join(df, "term").select("item_id", "term", (w * F.col("times")).alias("weight"))


def search(index: Index, items: DataFrame, most: int = 10, item_block: int = 4096) -> DataFrame:
    """items: item_id, text. Returns item_id, rank, doc_id, score: each item's `most` best documents with a score above 0,
    equal scores by ascending doc_id. All documents of the index are searched for all items, item_block at a time."""
    asked = weights(index, items)
    n_items = asked.agg(F.count_distinct("item_id")).first()[0]
    blocks = max(1, math.ceil(n_items / item_block))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")
    asked = asked.groupBy(block, "item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    asked = written(asked.groupBy("block").agg(F.collect_list(F.struct("item_id", "terms", "weights")).alias("items")), "search-blocks")
    small = asked.select(F.sum(F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + 16 * F.size(x["terms"])))).first()[0] or 0
    result = "item_id long, doc_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}  # an item's best documents of the segments this task has seen
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment({c: batch[c][row].as_buffer() for c in _KINDS})
                for item in batch["items"][row].as_py():
                    old = best.get(item["item_id"])
                    floor = int(old[2][-1]) if old and len(old[2]) >= most else 0
                    docs, score = segment.best(np.array(item["terms"], np.int64).view(np.uint64), np.array(item["weights"], np.int64), most, floor)
                    if not len(docs):
                        continue
                    now = [~segment.known[docs], segment.doc_id[docs], score]
                    if old:
                        now = [np.concatenate(x) for x in zip(old, now, strict=True)]
                        keep = np.lexsort((now[1], now[0], -now[2]))[:most]
                        now = [x[keep] for x in now]
                    best[item["item_id"]] = tuple(now)
        for item, (missing, ids, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), pa.array(ids, mask=missing), pa.array(score)], names=["item_id", "doc_id", "score"])

    table = index.table.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *_KINDS)
    found = table.join(F.broadcast(asked) if small <= _MOST_BROADCAST else asked, "block").mapInArrow(run, result)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, most: int = 10, **options) -> DataFrame:
    """search in a new index of docs."""
    return search(build(docs, **options), items, most)


def index_at(spark: SparkSession, path: str) -> Index:
    """An index that build() wrote: its numbers follow from its own documents."""
    table = spark.read.schema(INDEX).parquet(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, tf, begin in zip(batch["doc_id"].to_pylist(), batch["tf"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                ends = np.frombuffer(begin, "<u4").astype(np.int64)
                terms = int((np.frombuffer(tf, "<u4").astype(np.int64) * np.diff(ends, prepend=0)).sum())
                yield pa.RecordBatch.from_arrays([pa.array([len(doc_id) // 8], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])

    n = table.select("doc_id", "tf", "ends").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return Index(table, n[0] or 0, n[1] or 0)
