"""Quality classifier: supervised subword embeddings. Learned vectors of hashed words and character n-grams are averaged over a
document and go through a softmax; numpy stochastic gradient descent trains both.

Fitting takes at most `most` labelled documents (chosen by a hash of doc_id and label; of several texts of a document the
first in order) and about `most_bytes` of their texts. The softmax of two classes over an average
is a sum over features, so each feature's vector is multiplied with the output weights once, and scoring adds one number
for each feature of every whole text.

Cases: a null or empty text scores as a document without features, by the bias alone; without labelled rows of both
classes the score is the share of label 1 (0.5 without any); rows with equal doc_id are scored each by itself; rows of
labels with a null teach nothing; very long texts are taken whole; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.llm import _ngrams, _text
from lumenframe.llm._shared import row_hash, sampled, small_batches


class Model(NamedTuple):
    weight: np.ndarray  # what each hashed feature adds to the log odds of label 1
    bias: float
    orders: tuple[int, ...]
    bits: int


def _features(t: _text.Texts, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features and the text of each: words, then n-grams of each order; all share one table."""
    w = _text.words(t)
    h = _text.word_hashes(t, w)
    yield (h >> np.uint64(64 - bits)).astype(np.int64), np.repeat(np.arange(len(t.lo)), np.diff(w.first))
    t = _ngrams.characters(t)
    for n in orders:
        yield _ngrams.grams(t, n, bits)


def train(texts: pa.ChunkedArray, labels: np.ndarray, orders: tuple[int, ...], bits: int, dim: int, epochs: int, rate: float, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        return Model(np.zeros(1 << bits, np.float32), 30.0 if share == 1 else -30.0 if share == 0 and len(labels) else 0.0, orders, bits)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for t, i, j in _ngrams.groups(_text.texts(texts), 256):
        found = list(_features(t, orders, bits))
        h, text = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        key, n = np.unique(text << bits | h, return_counts=True)
        cut = np.searchsorted(key >> bits, np.arange(j - i + 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            docs.append((key[a:b] & ((1 << bits) - 1), (n[a:b] / max(1, n[a:b].sum())).astype(np.float32)))
    table = ((rng.random((1 << bits, dim)) - 0.5) / dim).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.log(np.array([1 - share, share], np.float32))
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, part = docs[i]
            lr = rate * (1 - step / steps)
            step += 1
            mean = part @ table[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= 0.1 * lr * p
            table[ids] -= (lr * len(ids) ** 0.5) * part[:, None] * back
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), orders, bits)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", most: int = 6000, most_bytes: int = 256 << 20, orders: tuple[int, ...] = (3, 4), bits: int = 15, dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 11) -> Model:
    """labels: doc_id and `label` (0 or 1); learn: which of its rows may teach, over its doc_id."""
    rows = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.lit(0).alias("all"), "doc_id", F.col(label).alias("__label"))
    n = rows.agg(F.approx_count_distinct(row_hash(rows, "all", seed), 0.05)).first()[0]
    bound = lambda n: docs.sparkSession.createDataFrame([(0, max(1, n), most, most_bytes)], "all int, n long, most int, most_bytes long")
    chosen = sampled(rows, bound(n), "all", seed).drop("all")
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # `most` rows
    found = found.groupBy("doc_id", "__label").agg(F.min("text").alias("text"))
    some = sampled(found.select(F.lit(0).alias("all"), "*"), bound(1), "all", seed, "text").drop("all").toArrow()
    some = some.take(pc.sort_indices(some, [("doc_id", "ascending"), ("__label", "ascending"), ("text", "ascending")]))
    return train(some["text"], some["__label"].to_numpy().astype(np.int64), orders, bits, dim, epochs, rate, seed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, score: the probability of label 1."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats, whatever the table's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            odds = np.full(batch.num_rows, m.bias)
            for t, i, j in _ngrams.groups(_text.texts(batch["text"]), 1000):
                total, n = np.zeros(j - i), np.zeros(j - i)
                for h, text in _features(t, m.orders, m.bits):
                    total += np.bincount(text, m.weight[h], j - i)
                    n += np.bincount(text, minlength=j - i)
                odds[i:j] += total / np.maximum(n, 1)
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
