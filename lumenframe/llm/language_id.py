"""Language ID: nearest of several clustered centroids per language, by cosine of normalised TF-IDF vectors of hashed
character n-grams; a text that is far from all centroids is rejected.

Fitting takes at most `per_language` labelled rows of each language, `most_rows` and about `most_bytes` of text in all (chosen by
a hash of the row, equal rows once), of the `most_languages` languages with most rows, so what the driver holds does not grow
with the table or its texts; prediction reads every whole text. How near is near enough depends on the length: the learned rows, whole and cut to powers
of two of characters, give a bound for each language and length.

Cases: a null text or one without a letter is `und` with score 0 and rejected; with no learned language everything is
`und`; rows whose lang is null teach nothing; equal scores go to the language first in order; rows with equal doc_id are
predicted each by itself; other columns are kept, but for columns named as the three new ones, which these replace; very long
texts are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.llm import _ngrams, _text
from lumenframe.llm._shared import column, row_hash, sampled, small_batches

UNDETERMINED = "und"
_OTHER = np.arange(256, dtype=np.uint8)  # ASCII that is no letter counts as a space
_OTHER[[b for b in range(128) if not chr(b).isalpha()]] = 32


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of unit length
    owner: np.ndarray  # the language of each centroid
    nearest: np.ndarray  # the least cosine that is accepted, for each language and band of lengths
    orders: tuple[int, ...]
    bits: int


_BANDS = 12


def _lowered(column: pa.Array | pa.ChunkedArray) -> _text.Texts:
    t = _text.texts(pc.utf8_lower(column))
    return t._replace(data=_OTHER[t.data])


def _band(t: _text.Texts) -> np.ndarray:
    """The binary logarithm of each text's length, from 1 on, as 0, 1, ..."""
    return np.clip(np.frexp(np.maximum(t.hi - t.lo, 1))[1] - 2, 0, _BANDS - 1)


def _begun(t: _text.Texts, size: int) -> _text.Texts:
    """The first `size` characters of the texts that have more."""
    lo = t.lo[t.hi - t.lo > size]
    at = np.arange(len(lo)) * size
    return _text.Texts(t.data[(lo[:, None] + np.arange(size)).ravel()], at, at + size)


def _vectors(t: _text.Texts, orders: tuple[int, ...], bits: int, idf: np.ndarray | None) -> np.ndarray:
    v = np.log1p(_ngrams.counts(t, orders, bits)).astype(np.float32)
    if idf is not None:
        v *= idf
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return v


def _clusters(v: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means."""
    k = min(k, len(v))
    c = v[rng.choice(len(v), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        sums = np.stack([v[own == i].sum(0) if (own == i).any() else c[i] for i in range(k)])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c


def fit(docs: DataFrame, learn: Column, centroids: int = 3, per_language: int = 800, orders: tuple[int, ...] = (1, 2, 3), bits: int = 12, reject_quantile: float = 0.01, reject_share: float = 0.6, seed: int = 7, most_languages: int = 500, most_rows: int = 40_000, most_bytes: int = 256 << 20) -> Model:
    """Learns from text and lang of the rows where `learn` holds and lang is not null.

    A text is rejected whose cosine is below reject_share times the reject_quantile of its language's own learned rows of
    about its length.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id", F.col("text").cast("string").alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(row_hash(rows, "lang", seed), 0.05).alias("m")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    languages = sorted(r["lang"] for r in sizes)
    most = max(1, min(per_language, most_rows // max(1, len(sizes))))
    spark = docs.sparkSession
    bounds = spark.createDataFrame([(r["lang"], r["m"], most, most_bytes // len(sizes)) for r in sizes], "lang string, n long, most int, most_bytes long")
    some = sampled(rows, bounds, "lang", seed, "text").toArrow()
    some = some.take(pc.sort_indices(some, [("doc_id", "ascending"), ("text", "ascending")]))
    of = np.array([languages.index(x) for x in some["lang"].to_pylist()], np.int64)
    rng = np.random.default_rng(seed)
    held = np.zeros(1 << bits, np.int64)
    for t, _, _ in _ngrams.groups(_lowered(some["text"]), 256):
        held += (_ngrams.counts(_ngrams.characters(t), orders, bits) > 0).sum(0)
    idf = (np.log((1 + len(of)) / (1 + held)) + 1).astype(np.float32)
    parts, taught = [np.zeros((0, 1 << bits), np.float32)], []
    nearest = np.zeros((len(languages), _BANDS))
    for lang in range(len(languages)):  # one language's vectors at a time
        own = [_ngrams.characters(t) for t, _, _ in _ngrams.groups(_lowered(some["text"].filter(pa.array(of == lang))), 256)]
        if not own:
            continue
        c = _clusters(np.concatenate([_vectors(t, orders, bits, idf) for t in own]), centroids, 12, rng)
        near, band = [], []
        for t in own:
            for size in (None, *(1 << k for k in range(1, 10))):
                cut = t if size is None else _begun(t, size)
                near.append((_vectors(cut, orders, bits, idf) @ c.T).max(1, initial=0))
                band.append(_band(cut))
        near, band = np.concatenate(near), np.concatenate(band)
        for k in range(_BANDS):
            some_near = near[band == k]
            nearest[lang, k] = reject_share * np.quantile(some_near, reject_quantile) if len(some_near) else nearest[lang, k - 1] * (k > 0)
        parts.append(c)
        taught.append((lang, len(c)))
    whose = np.repeat(np.array([x for x, _ in taught], np.int64), [n for _, n in taught])
    return Model(languages, idf, np.concatenate(parts), whose, nearest, orders, bits)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs: text and more. Returns the columns of docs with lang_pred, score (the cosine), rejected."""
    small_batches(docs.sparkSession, 500)
    names = docs.columns
    ranks = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    held = docs.sparkSession.sparkContext.broadcast(model)  # centroids x 2**bits floats, whatever the table's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            text, known = batch["__text"], batch["__letter"].to_numpy(zero_copy_only=False)
            best, cosine, least = np.zeros(len(text), np.int64), np.zeros(len(text)), np.ones(len(text))
            if len(m.centroids):
                for t, i, j in _ngrams.groups(_lowered(text), 256):
                    t = _ngrams.characters(t)
                    near = _vectors(t, m.orders, m.bits, m.idf) @ m.centroids.T
                    top = near.argmax(1)
                    best[i:j], cosine[i:j] = m.owner[top], near[np.arange(j - i), top]
                    least[i:j] = m.nearest[best[i:j], _band(t)]
            else:
                known = np.zeros(len(text), bool)
            cosine = np.where(known, np.clip(cosine, 0, 1), 0.0)
            lang = [m.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            rejected = ~known | (cosine < least)
            rest = [batch[f"__{k}"] for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(cosine, pa.float64()), pa.array(rejected)], names=[*(f"__{k}" for k in range(len(names))), "lang_pred", "score", "rejected"])

    from pyspark.sql.types import StructType

    numbered = docs.select(*(column(docs, n).alias(f"__{k}") for k, n in enumerate(names)), F.col("text").cast("string").alias("__text"), ranks.alias("__letter"))
    schema = StructType(numbered.schema.fields[: len(names)]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    out = numbered.mapInArrow(run, schema)
    new = {"lang_pred", "score", "rejected"}
    return out.select(*(F.col(f"__{k}").alias(n) for k, n in enumerate(names) if n not in new), "lang_pred", "score", "rejected")
