"""Token-ID output: one wavelet matrix for each shard, a compressed file of bit planes with rank and select.

`encode` turns texts into token ids with the tokenizers library (every piece of text that it can cut off safely is encoded
once and kept), `write_shards` puts the documents in ascending doc_id order and writes shards, `read_documents` reads them
back. A shard's bytes also answer access, count and occurrence lookups without being decoded: see WaveletMatrix.

The files are rows of a Parquet table (part, first, n_docs, n_ids, payload): Spark's writer commits them, so that lost
tasks are run again without leaving half a file, on any file system that Spark writes to.

Cases: a null text counts as empty and yields the end id alone; a null doc_id comes before all others; rows of equal doc_id
follow each other in any order (so that many of them can be written by several tasks); a text longer than a shard makes one longer shard; extra columns are not
read; an empty table gives a table without shards.
"""

from __future__ import annotations

import array
import functools
import itertools
import os
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenframe.llm.bpe_transducer import byte_symbols
from lumenframe.llm._shared import partitions, shared_dir, small_batches

_NAMES = dict(enumerate(byte_symbols()))
_MAGIC, _BLOCK = b"LFW2", 1 << 15
_TAIL = string.punctuation.replace("'", "")  # an apostrophe may begin a piece of its own with the letters behind it
_NEW = object()  # beside the ids of known pieces
SHARD = "part int, first long, n_docs long, n_ids long, payload binary"


class WaveletMatrix:
    """Token ids as bit planes, highest bit first; each plane is followed by a stable partition, zeros before ones.

    A file holds each plane in blocks of _BLOCK bits, compressed one by one, and before them a directory: the ones before
    each block and where it lies. So access, rank and select read one block a plane, found in the directory, and decompress
    nothing else; the blocks read last are kept.
    """

    def __init__(self, n: int, zeros: np.ndarray, ones: np.ndarray, at: np.ndarray, data: memoryview, kept: int = 64):
        """ones: before each block, a row a plane, with all of the plane's at the end; at: where blocks begin in data."""
        self.n, self.zeros, self.ones, self.at, self.data = n, zeros, ones, at, data
        self.levels, self._unpack = len(zeros), zstandard.ZstdDecompressor()
        self._block = functools.lru_cache(kept)(self._read)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int | None = None) -> WaveletMatrix:
        levels = levels or max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        blocks, wide = -(-max(len(ids), 1) // _BLOCK), _BLOCK // 8
        press, data, zeros = zstandard.ZstdCompressor(level=1), [], np.zeros(levels, np.int64)
        ones = np.zeros((levels, blocks + 1), np.int64)
        for level, b in enumerate(range(levels - 1, -1, -1)):
            bit = (now & (1 << b)) != 0
            plane = np.packbits(bit, bitorder="little")
            padded = np.zeros(blocks * wide, np.uint8)
            padded[: len(plane)] = plane
            ones[level, 1:] = np.cumsum(np.bitwise_count(padded).reshape(blocks, wide).sum(1, dtype=np.int64))
            data += [press.compress(plane[i * wide : (i + 1) * wide].tobytes()) for i in range(blocks)]
            now = np.concatenate([low := now[~bit], now[bit]])
            zeros[level] = len(low)
        at = np.concatenate([[0], np.cumsum([len(x) for x in data])])
        return cls(len(ids), zeros, ones, at, memoryview(b"".join(data)))

    def tobytes(self) -> bytes:
        size = np.diff(self.at)
        return struct.pack("<4sQII", _MAGIC, self.n, self.levels, _BLOCK) + self.zeros.astype("<u8").tobytes() + self.ones.astype("<u8").tobytes() + size.astype("<u4").tobytes() + self.data

    @classmethod
    def frombytes(cls, data: bytes) -> WaveletMatrix:
        """Reads the directory; the planes stay compressed."""
        magic, n, levels, block = struct.unpack_from("<4sQII", data)
        if magic != _MAGIC or block != _BLOCK:
            raise ValueError("not a wavelet matrix of this format")
        blocks, at = -(-max(n, 1) // block), 20
        zeros = np.frombuffer(data, "<u8", levels, at).astype(np.int64)
        at += 8 * levels
        ones = np.frombuffer(data, "<u8", levels * (blocks + 1), at).astype(np.int64).reshape(levels, blocks + 1)
        at += 8 * levels * (blocks + 1)
        size = np.frombuffer(data, "<u4", levels * blocks, at)
        at += 4 * levels * blocks
        return cls(n, zeros, ones, np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), memoryview(data)[at:])

    def _read(self, level: int, block: int) -> np.ndarray:
        k = level * (self.ones.shape[1] - 1) + block
        return np.frombuffer(self._unpack.decompress(self.data[self.at[k] : self.at[k + 1]], _BLOCK // 8), np.uint8)

    def decode(self) -> np.ndarray:
        """All ids in order: the planes from the lowest up, each undoing its partition."""
        out = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            plane = np.concatenate([self._read(level, k) for k in range(self.ones.shape[1] - 1)])
            bit, z = np.unpackbits(plane, count=self.n, bitorder="little").view(bool), self.zeros[level]
            before = np.empty_like(out)
            before[~bit] = out[:z]
            before[bit] = out[z:] | out.dtype.type(1 << (self.levels - 1 - level))
            out = before
        return out

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i: those before its block by the directory, and the rest in the block."""
        block, rest = divmod(i, _BLOCK)
        ones = int(self.ones[level, block])
        if rest:
            bits = self._block(level, block)
            whole, some = divmod(rest, 8)
            ones += int(np.bitwise_count(bits[:whole]).sum(dtype=np.int64)) + (int(bits[whole] & ((1 << some) - 1)).bit_count() if some else 0)
        return ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = int(self._block(level, i // _BLOCK)[i % _BLOCK >> 3] >> (i & 7) & 1)
            ones = self._rank1(level, i)
            value, i = value << 1 | bit, int(self.zeros[level]) + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of token among the first i ids lie behind the last plane."""
        a, b = 0, i
        if token < 0 or token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            x, y = self._rank1(level, a), self._rank1(level, b)
            z = int(self.zeros[level])
            a, b = (z + x, z + y) if token >> (self.levels - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token among the first i ids."""
        a, b = self._range(token, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _selected(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """The positions of the k-th (from 0, ascending) bits of one kind: the directory tells their blocks."""
        before = self.ones[level] if bit else np.arange(self.ones.shape[1]) * _BLOCK - self.ones[level]
        block = np.searchsorted(before, k, "right") - 1
        out = np.empty(len(k), np.int64)
        for b in np.unique(block):
            here = block == b
            found = np.flatnonzero(np.unpackbits(self._block(level, int(b)), bitorder="little") == bit)
            out[here] = b * _BLOCK + found[k[here] - before[b]]
        return out

    def _positions(self, token: int, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._selected(level, bit, at - self.zeros[level] if bit else at)
        return at

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence, from 0."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        return int(self._positions(token, np.array([a + k]))[0])

    def occurrences(self, token: int) -> list[int]:
        a, b = self._range(token, self.n)
        return self._positions(token, np.arange(a, b)).tolist() if b > a else []


class PieceEncoder:
    """Token ids of texts by the tokenizers library, for a byte-level BPE whose pattern starts a piece at every space
    after a non-space, and between letters and the punctuation or single line feed that follows them. Such pieces are
    encoded by the library once, words by its model and others many in one call with a line feed between them, and kept:
    in two generations of up to about `most` pieces, of which the older goes when the younger is full, save what was used
    meanwhile. Arrow cuts the texts of a batch, numbers their different pieces and puts the ids in their places; Python
    loops over different pieces only."""

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.code = "H" if self.size <= 1 << 16 else "I"  # ids are kept in two bytes if they fit
        self.wide = array.array(self.code).itemsize
        feed = self.feed_bytes = self._library("\n")
        self.feed = int.from_bytes(feed, "little") if len(feed) == self.wide else None
        # the ids of " " + key, or without the space if the key begins with \0; None: the cut behind it isn't safe
        self.after: dict[str, bytes | None] = {}
        self.atoms: dict[str, bytes] = {}
        self.old: tuple[dict, dict] = ({}, {})

    def _library(self, text: str) -> bytes:
        return array.array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    @staticmethod
    def _split(piece: str) -> list[str] | None:
        """The parts of a piece that the library can encode one by one; None if it has none."""
        if "\n" not in piece:
            if piece[-1] in ",.;:!?":
                stem = piece.rstrip(",.;:!?")
                if stem[1:].isalpha() and (stem[0] == " " or stem[0].isalpha()):
                    return [stem, piece[len(stem) :]]
            return [piece] if not piece[0].isspace() or (len(piece) > 1 and piece[0] == " " and not piece[1].isspace()) else None
        out: list[str] = []
        for k, line in enumerate(piece.split("\n")):
            if not line or line[-1].isspace() or line[0].isspace() and (k or line[:1] != " " or line[1:2].isspace()):
                return None
            out += (["\n"] if k else []) + (PieceEncoder._split(line) or [line])
        return out

    def _word(self, word: str) -> bytes:
        """The ids of letters, with or without a space before them."""
        name = word.replace(" ", "\u0120") if word.isascii() else word.encode().decode("latin-1").translate(_NAMES)
        return array.array(self.code, [x.id for x in self.model.tokenize(name)]).tobytes()

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Adds pieces to those kept: letters, or letters and punctuation, by words of the model; others by the library."""
        after, kept, word_ids = self.after, self.old[0], self._word
        rest, tails = [], {}
        for p in pieces:
            if (ids := kept.get(p, _NEW)) is not _NEW:
                after[p] = ids
                continue
            stem = p if p.isalpha() else p.rstrip(_TAIL)
            bare = stem[:1] == "\0"
            word = stem[1:] if bare else stem
            if word.isalpha():
                ids = after.get(stem) or kept.get(stem)
                if ids is None:
                    ids = word_ids(word if bare else f" {word}")
                after[stem] = ids
                if len(stem) < len(p):
                    tail = p[len(stem) :]
                    if tail not in tails:
                        tails[tail] = self._learn([tail])[0]
                    after[p] = ids + tails[tail]
            elif p == "\0" or p == "\0\n":
                after[p] = self.feed_bytes if p[1:] else b""
            elif not p or p[-1].isspace() or (p[0] == "\0" and p[1:2].isspace()):
                after[p] = None
            else:
                rest.append(p)
        after.update(zip(rest, self._learn([p[1:] if p[0] == "\0" else f" {p}" for p in rest]), strict=True))

    def _learn(self, pieces: list[str]) -> list[bytes]:
        split = [self._split(p) for p in pieces]
        new = {a for s in split if s for a in s}.difference(self.atoms, ["\n"])
        kept = self.old[1]
        again = [a for a in new if a in kept]
        self.atoms.update({a: kept[a] for a in again})
        new = list(new.difference(again))
        self.atoms["\n"] = b"" if self.feed is None else self.feed_bytes
        if self.feed is None or any("\n" in a for a in new):
            split = [None] * len(pieces)
        else:
            # letters, with or without a space before them, are one word of the model: its merges can be asked at once
            words = [a for a in new if (a[1:] if a[0] == " " else a).isalpha()]
            self.atoms.update({a: self._word(a) for a in words})
            new = [a for a in new if a not in self.atoms]
            for i in range(0, len(new), 5000):
                some = new[i : i + 5000]
                ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, f"<u{self.wide}")
                cut = [-1, *np.flatnonzero(ids == self.feed).tolist(), len(ids)]
                raw, n = ids.tobytes(), self.wide
                self.atoms.update(zip(some, [raw[n * a + n : n * b] for a, b in itertools.pairwise(cut)], strict=True))
        get = self.atoms.__getitem__
        return [self._library(p) if s is None else get(s[0]) if len(s) == 1 else b"".join(map(get, s)) for p, s in zip(pieces, split, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [np.frombuffer(x, f"<u{self.wide}").astype("<u4").tobytes() for x in self.packed(texts)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of `wide` bytes."""
        if not texts:
            return []
        if len(self.atoms) > self.most or len(self.after) > 2 * self.most:
            self.old = (self.after, self.atoms)
            self.after, self.atoms = {}, {}
        # \0 marks pieces without a space before them, at the beginning and beside a single line feed, which is a piece
        # (a text that has \0 itself or begins with white space goes the slow way: as an empty piece, where no cut is safe)
        marked = ["" if "\0" in t or t[:1].isspace() else "\0" + (t.replace("\n", " \0\n \0") if " \n" not in t and "\n " not in t and "\n\n" not in t else t) for t in texts]
        cut = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        words = cut.values.dictionary_encode()
        pieces = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = [*map(self.after.get, pieces, itertools.repeat(_NEW))]
        new = [k for k, x in enumerate(known) if x is _NEW]
        self._learn_pieces([pieces[k] for k in new])
        for k in new:
            known[k] = self.after[pieces[k]]
        ids = pa.array(known, pa.large_binary()).take(words.indices)
        first = cut.offsets.to_numpy()
        unsafe = np.logical_or.reduceat(ids.is_null().to_numpy(zero_copy_only=False), first[:-1])  # white space where a cut isn't safe
        stop = np.frombuffer(ids.buffers()[1], np.int64)[first].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [self._slow(t) if slow else data[a:b].tobytes() for t, slow, (a, b) in zip(texts, unsafe.tolist(), itertools.pairwise(stop), strict=True)]

    def _slow(self, text: str) -> bytes:
        """Texts with white space that is more than one space: cut only before a space that follows a non-space."""
        out, piece = [], ""
        for k, p in enumerate(text.split(" ")):
            if k and piece and not piece[-1].isspace():
                out.append(piece)
                piece = f" {p}"
            else:
                piece += f" {p}" if k else p
        return b"".join(self._learn([*out, piece] if piece else out))


@functools.lru_cache(1)
def encoder(path: str) -> PieceEncoder:
    """One a process: Python workers run many tasks, and the kept pieces serve them all."""
    return PieceEncoder(path)


def _grouped(batches: Iterator[pa.RecordBatch], rows: int = 4000, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, up to about so many rows and bytes: their different pieces are looked up once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and (sum(x.num_rows for x in held) + batch.num_rows > rows or sum(x.nbytes for x in held) + batch.nbytes > size):
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def encode(docs: DataFrame, tokenizer: str, end_id: int | None, bounds: list[int]) -> DataFrame:
    """part (the range between ascending bounds that the doc_id falls in), doc_id, ids (packed, 16 bits each if they fit)."""

    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        if (end_id or 0) >> 8 * own.wide:
            raise ValueError(f"an end id of {end_id} beside a vocabulary of {own.size}")
        end = b"" if end_id is None else end_id.to_bytes(own.wide, "little")
        for batch in _grouped(batches):
            doc_id = batch["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
            ids = [x + end for x in own.packed([x or "" for x in batch["text"].to_pylist()])]
            low, part = np.searchsorted(edges, doc_id, "left"), np.searchsorted(edges, doc_id, "right")
            for k in np.flatnonzero(part > low):  # an id on bounds, maybe on many: its rows may go to either side
                part[k] = low[k] + zlib.crc32(ids[k]) % (part[k] - low[k] + 1)
            part = pa.array(part, pa.int32())
            yield pa.RecordBatch.from_pydict({"part": part, "doc_id": batch["doc_id"], "wide": pa.array([own.wide == 4] * len(ids)), "ids": pa.array(ids, pa.binary())})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "part int, doc_id long, wide boolean, ids binary")


def pack_shard(doc_ids: list[int | None], ids: list[np.ndarray], levels: int) -> bytes:
    """A shard's bytes: the documents' ids and lengths, then the wavelet matrix of all their token ids."""
    known = np.array([x is not None for x in doc_ids])
    head = [np.packbits(known).tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([len(x) for x in ids], "<u4").tobytes()]
    head = zlib.compress(b"".join(head), 1)
    return struct.pack("<QQ", len(doc_ids), len(head)) + head + WaveletMatrix.build(np.concatenate(ids), levels).tobytes()


def unpack_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, the number of token ids of each document, and the matrix."""
    n, size = struct.unpack_from("<QQ", data)
    head = zlib.decompress(data[16 : 16 + size])
    bits = -(-n // 8)
    known = np.unpackbits(np.frombuffer(head[:bits], np.uint8), count=n).tolist()
    doc_ids = np.frombuffer(head, "<i8", n, bits).tolist()
    return [x if k else None for x, k in zip(doc_ids, known, strict=True)], np.frombuffer(head, "<u4", n, bits + 8 * n), WaveletMatrix.frombytes(data[16 + size :])


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, shard_ids: int = 1 << 19) -> None:
    """Encodes docs (doc_id, text) and writes their ids in ascending doc_id order, about shard_ids ids in a shard."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = partitions(spark)
    least = F.coalesce(F.col("doc_id").cast("long"), F.lit(np.iinfo(np.int64).min))
    bounds = [int(x) for x in docs.select(least.alias("k")).approxQuantile("k", [k / parts for k in range(1, parts)], 0.25 / parts)] if parts > 1 else []
    encoded = encode(docs, tokenizer, end_id, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple[list, list] = ([], [])
        part, first, held = None, 0, 0

        def flush() -> pa.RecordBatch:
            wide = max(int(x.max(initial=0)) for x in own[1])
            row = {"part": [part], "first": [first], "n_docs": [len(own[0])], "n_ids": [held], "payload": [pack_shard(*own, max(1, wide.bit_length()))]}
            return pa.RecordBatch.from_arrays([pa.array(row["part"], pa.int32()), *(pa.array(row[k], pa.int64()) for k in ("first", "n_docs", "n_ids")), pa.array(row["payload"], pa.binary())], names=list(row))

        for batch in batches:
            for p, doc, wide, data in zip(*(batch[k].to_pylist() for k in ("part", "doc_id", "wide", "ids")), strict=True):
                if own[0] and (p != part or held >= shard_ids):
                    yield flush()
                    own, first, held = ([], []), first + held, 0
                if p != part:
                    part, first = p, 0
                own[0].append(doc)
                own[1].append(np.frombuffer(data, "<u4" if wide else "<u2"))
                held += len(own[1][-1])
        if own[0]:
            yield flush()

    ordered = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(run, SHARD).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Reads shards back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARD).parquet(path)
    offsets, total = {}, 0
    for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row for each write task
        offsets[r["part"]], total = total, total + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, data in zip(batch["part"].to_pylist(), batch["first"].to_pylist(), batch["payload"], strict=True):
                doc_ids, size, matrix = unpack_shard(data.as_py())
                raw = matrix.decode().astype("<u4").tobytes()
                stop = np.cumsum(size, dtype=np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((stop - size).tolist(), stop.tolist(), strict=True)]
                start = stop - size + (offsets[part] + first)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return shards.select("part", "first", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_offsets(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """write_shards into a new folder of the shared one, then read_documents."""
    path = shared_dir(docs.sparkSession, "wavelet-shards")
    write_shards(docs, path, tokenizer, end_id)
    return read_documents(docs.sparkSession, path)
