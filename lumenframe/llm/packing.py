"""Packing: sum-of-squares online packing of documents into windows of a fixed length.

Each document goes into the fill level that makes the sum of the squared counts of partly filled windows smallest; the counts
are an array over the levels. A document longer than a window fills whole windows first, and its rest is placed so. When a
task has seen its documents, the windows still open are poured together: first pairs and triples of pieces that fill whole
windows, then the others, so that at most one window is left, and that is cut at powers of two, which need no padding. So
documents of at most a window are cut only among the last windows of a task, and no id is padding at all unless `powers` is off.

Tasks pack what they read, each by itself, in the order they read it, so nothing is shuffled and a lost task gives the same
rows again where the input comes in the same order (files, tables, sorted partitions). What a task holds are its open windows:
their number grows with the square root of its documents at most, for lengths that can fill windows at all.

Cases: a null or empty text is the end id alone; without an end id it has no piece; rows with equal or missing doc_id are
packed each by itself; texts of any length are cut; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import functools
import itertools
import os
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm._shared import small_batches
from lumenframe.llm.bpe_transducer import byte_symbols

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = dict(enumerate(byte_symbols()))
_TASK_BITS = 33  # of a sequence_id: below them the window's number in its task


class StretchEncoder:
    """Token ids by the tokenizers library, for a tokenizer that drops white space and never joins across it. Stretches
    between spaces are encoded once and kept: two generations of up to `most` stretches, of which the older goes when the
    younger is full. Words of common letters, maybe with punctuation behind them, are asked of the library's model at once;
    other stretches go through the whole library, many in one call with a special token between them."""

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        specials = [(t.content, i) for i, t in self.library.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        # the token between stretches must be cut out of any text, and white space must say nothing
        self.cut = next((s for s in specials if self._plain(f"a{s[0]}b c\nd") == [*self._plain("a"), s[1], *self._plain("b"), *self._plain("c"), *self._plain("d")]), None)
        self.now: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # letters that the library lower-cases as Python does, and of which it makes one word of the model
        letters = [c for c in map(chr, range(0x250)) if c.isalpha() and c.lower().isalpha()]
        # punctuation that is a piece of its own behind letters
        self.behind = "".join(c for c in string.punctuation if c not in "'<" and self._ids(f"ab{c}{c}") == self._ids("ab") + self._ids(f"{c}{c}"))
        self.letters = frozenset(c for c in letters if self._word(c.lower()) == self._ids(c) and self._word(f"a{c.lower()}b") == self._ids(f"A{c}b"))

    def _plain(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _ids(self, text: str) -> bytes:
        return np.array(self._plain(text), self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of lower-case letters."""
        name = word if word.isascii() else word.encode().decode("latin-1").translate(_NAMES)
        return array.array(self.kind.char, [t.id for t in self.library.model.tokenize(name)]).tobytes()

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of `kind`."""
        if self.cut is None:
            return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.now) > self.most:
            self.old, self.now, self.words = self.now, {"": b""}, {}
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set(itertools.chain.from_iterable(split)).difference(self.now)
        again = new.intersection(self.old)
        self.now.update({s: self.old[s] for s in again})
        self._learn(list(new.difference(again)))
        get = self.now.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def _learn(self, stretches: list[str]) -> None:
        mark, cut = self.cut
        rest, behind, now, words, letters = [], [], self.now, self.words, self.letters
        for s in stretches:
            low = s.lower()
            stem = low if low.isalpha() else low.rstrip(self.behind)
            if not stem.isalpha() or not letters.issuperset(s[: len(stem)]) or len(stem) > 200:
                rest.append(s)
                continue
            ids = words.get(stem)
            if ids is None:
                ids = words[stem] = self._word(stem)
            if len(stem) == len(low):
                now[s] = ids
            else:
                behind.append((s, ids, low[len(stem) :]))
        rest += {t for _, _, t in behind}.difference(now)
        odd = [s for s in rest if "<" in s or len(s) > 1000]
        now.update({s: self._ids(s) for s in odd})
        if odd:
            rest = [s for s in rest if s not in now]
        wide = self.kind.itemsize
        for i in range(0, len(rest), 4000):
            some = rest[i : i + 4000]
            ids = np.array(self._plain(mark.join(some)), self.kind)
            at = [-1, *np.flatnonzero(ids == cut).tolist(), len(ids)]
            raw = ids.tobytes()
            now.update(zip(some, [raw[wide * (a + 1) : wide * b] for a, b in itertools.pairwise(at)], strict=True))
        now.update({s: ids + now[t] for s, ids, t in behind})


@functools.lru_cache(1)
def encoder(path: str) -> StretchEncoder:
    """One a process: Python workers run many tasks."""
    return StretchEncoder(path)


class Window:
    """Pieces in order: (document, start, ids); fill: their ids."""

    __slots__ = ("fill", "pieces")

    def __init__(self):
        self.pieces, self.fill = [], 0

    def add(self, doc, start: int, ids: np.ndarray) -> None:
        self.pieces.append((doc, start, ids))
        self.fill += len(ids)


class Packer:
    """Windows of `size` ids, filled online. levels[h]: how many open windows hold h ids."""

    def __init__(self, size: int, powers: bool = True):
        self.size, self.powers = size, powers
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[Window]] = {}

    def place(self, n: int) -> int:
        """The level (0: a new window) at which n ids change the sum of squares least; of equal ones the fullest."""
        top = self.size - n
        gain = 2 * self.levels[n:] + 1  # one window more at level h + n, for h from 0 on
        gain[top] = 0  # a full window counts no longer
        gain[1:] -= 2 * self.levels[1 : top + 1] - 1  # and one less at level h
        there = self.levels[: top + 1] > 0
        there[0] = True
        at = np.flatnonzero(there)[::-1]
        return int(at[np.argmin(gain[at])])

    def add(self, doc, ids: np.ndarray) -> Iterator[Window]:
        """Puts a document in; gives the windows that are full."""
        start = 0
        while len(ids) - start >= self.size:
            w = Window()
            w.add(doc, start, ids[start : start + self.size])
            start += self.size
            yield w
        if start == len(ids):
            return
        n = len(ids) - start
        level = self.place(n)
        if level:
            w = self.open[level].pop()
            self.levels[level] -= 1
        else:
            w = Window()
        w.add(doc, start, ids[start:])
        if w.fill == self.size:
            yield w
        else:
            self.levels[w.fill] += 1
            self.open.setdefault(w.fill, []).append(w)

    def close(self) -> Iterator[Window]:
        """The pieces of the windows left, cut as seldom as they can be found to be: pairs and triples whose ids fill whole windows
        come first, each cut in its middle at most; the others are poured behind each other. What is over is cut at powers of two."""
        loose: dict[int, list[tuple]] = {}
        for level in sorted(self.open):
            for doc, start, ids in (piece for w in self.open[level] for piece in w.pieces):
                loose.setdefault(len(ids), []).append((doc, start, ids))
        self.open, self.levels[:] = {}, 0
        w = Window()
        for n in self._groups({n: len(x) for n, x in loose.items()}):
            doc, start, ids = loose[n].pop()
            while len(ids) >= self.size - w.fill:
                room = self.size - w.fill
                w.add(doc, start, ids[:room])
                yield w
                w, start, ids = Window(), start + room, ids[room:]
            if len(ids):
                w.add(doc, start, ids)
        if w.pieces:
            yield from self._powers(w) if self.powers else [w]

    def _groups(self, lengths: dict[int, int]) -> Iterator[int]:
        """All the lengths (length -> how many), those first that add up to whole windows two by two, then three by three."""
        size, counts = self.size, np.zeros(self.size, np.int64)
        for n, many in lengths.items():
            counts[n] = many
        for n in range(1, size // 2 + 1):
            for _ in range(min(counts[n], counts[size - n]) if 2 * n < size else counts[n] // 2 if 2 * n == size else 0):
                counts[[n, size - n]] -= 1 + (2 * n == size)
                yield from (n, size - n)
        each = np.arange(size)
        for n in range(size - 1, 0, -1):
            while counts[n]:
                counts[n] -= 1
                third = (-n - each) % size
                there = np.flatnonzero((counts > 0) & (counts[third] > (third == each)))
                if not len(there):
                    counts[n] += 1
                    break
                m = int(there[-1])
                counts[m] -= 1
                counts[third[m]] -= 1
                yield from (n, m, int(third[m]))
        yield from np.repeat(each, counts).tolist()

    @staticmethod
    def _powers(w: Window) -> Iterator[Window]:
        pieces = list(reversed(w.pieces))
        for bit in reversed(range(w.fill.bit_length())):
            if w.fill >> bit & 1:
                part = Window()
                while part.fill < 1 << bit:
                    doc, start, ids = pieces.pop()
                    n = min(len(ids), (1 << bit) - part.fill)
                    part.add(doc, start, ids[:n])
                    if n < len(ids):
                        pieces.append((doc, start + n, ids[n:]))
                yield part


def pack(docs: DataFrame, tokenizer: str, end_id: int | None, size: int = 2048, powers: bool = True, ids: bool = False) -> DataFrame:
    """docs: doc_id, text; tokenizer: a file's path, readable on the executors; end_id: added to each document.

    Returns a row for each piece: doc_id, start (its document's ids before it), length, ids_crc32 (of its ids as little-endian
    unsigned 32-bit integers), doc_tokens, sequence_id, offset (in the sequence), and with ids=True the ids themselves.
    powers: whether the last sequence of a task may be several of a power of two ids each, which are not padded.
    """
    small_batches(docs.sparkSession)
    schema = PIECES + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = encoder(tokenizer), Packer(size, powers)
        end = b"" if end_id is None else np.array([end_id], own.kind).tobytes()
        if end_id is not None and end_id > np.iinfo(own.kind).max:
            raise ValueError(f"an end id of {end_id} beside ids of {own.kind}")
        sequence = TaskContext.get().partitionId() << _TASK_BITS
        rows: list[tuple] = []

        def put(windows: Iterable[Window]) -> None:
            nonlocal sequence
            for w in windows:
                offset = 0
                for (doc_id, total), start, x in w.pieces:
                    rows.append((doc_id, start, len(x), zlib.crc32(x.astype("<u4").tobytes()), total, sequence, offset, x))
                    offset += len(x)
                sequence += 1

        def given() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            out = [pa.array(c, pa.int64()) for c in columns[:7]]
            if ids:
                stop = np.cumsum([0, *columns[2]]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(stop), pa.array(np.concatenate(columns[7]).astype(np.int32))))
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=[c.split(" ")[0] for c in schema.split(", ")])

        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            for doc_id, data in zip(batch["doc_id"].to_pylist(), own.packed(texts), strict=True):
                x = np.frombuffer(data + end, own.kind)
                put(packer.add((doc_id, len(x)), x))
                if len(rows) >= 4000:
                    yield given()
        put(packer.close())
        if rows:
            yield given()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, schema)


def sequences(pieces: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """pieces: of pack(ids=True). Returns sequence_id, n_tokens, ids (padded with pad_id to size, but for a power of two) and
    doc_ids, starts, lengths of its pieces in order: what a training step reads."""
    own = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), own.alias("p"))  # at most `size` ids a group
    n = F.col("n_tokens").cast("int")
    more = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(F.lit(size) - n)
    padded = F.concat(F.flatten(F.col("p.ids")), F.array_repeat(F.lit(pad_id), more.cast("int")))
    return out.select("sequence_id", "n_tokens", padded.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.length").alias("lengths"))
