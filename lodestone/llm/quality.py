"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics come from whole texts, in Arrow batches. Class means and covariances are
sums over every labelled training row, added up by Spark; only the sums of the two
classes reach the driver. Covariances are shrunk towards their diagonal and a common
scale, factored once (Cholesky), and a document's score is the logistic of the
difference of the two Gaussian log-densities, each a Mahalanobis distance through
the cached factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, id_crc, map_arrow
from .textarrays import Texts, byte_prefix, mix64, slices, U64

FOLDS, THRESHOLD, SHRINKAGE, FLOOR, TEXT_AT_ONCE = 5, 0.3, 0.15, 1e-3, 1 << 18

# Byte classes: other, lower, upper, digit, blank, line end, sentence mark, exclamation, bar, symbol, quote or bracket, beyond ASCII.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 4, 5
_CLASS[[ord(c) for c in ".,;:?-"]], _CLASS[ord("!")], _CLASS[ord("|")] = 6, 7, 8
_CLASS[[ord(c) for c in "#$%&*+=@^~<>/\\_"]], _CLASS[[ord(c) for c in "\"'`()[]{}"]] = 9, 10
_CLASS[128:] = 11
_CLASSES = 12
FEATURES = (
    "log_words", "upper", "digit", "marks", "exclamation", "bar", "symbol", "quote", "word_length",
    "repeat_next", "repeat_types", "repeat_lines",
)


def _repeats(keys: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """For each document, how many of its keys occurred before in it."""
    if not len(keys):
        return np.zeros(n)
    both = mix64(keys ^ (docs.astype(U64) * U64(0x9E3779B97F4A7C15)))
    first = np.unique(both, return_index=True)[1]
    return np.bincount(docs, minlength=n) - np.bincount(docs[first], minlength=n)


def statistics(texts: Texts) -> np.ndarray:
    """One row of transformed statistics per document (:data:`FEATURES`); an empty text has zeros."""
    n = texts.n
    lengths = np.diff(texts.bounds)
    of = np.repeat(np.arange(n), lengths)
    kinds = np.bincount(of * _CLASSES + _CLASS[texts.data], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    starts, ends, docs = texts.words()
    prefix = byte_prefix(texts.data)
    codes = prefix.of(starts, ends)
    words = np.bincount(docs, minlength=n)
    next_same = np.flatnonzero((codes[1:] == codes[:-1]) & (docs[1:] == docs[:-1])) if len(codes) else np.zeros(0, dtype=np.int64)
    breaks = np.flatnonzero(texts.data == 10)
    edges = np.union1d(breaks + 1, texts.bounds[:-1][lengths > 0])
    edges = edges[edges < len(texts.data)]
    stops = np.append(edges[1:], len(texts.data)) if len(edges) else edges
    line_of = np.searchsorted(texts.bounds, edges, side="right") - 1
    lines = np.bincount(line_of, minlength=n) if len(edges) else np.zeros(n)
    line_codes = prefix.of(edges, stops) if len(edges) else np.zeros(0, dtype=U64)
    inside = np.maximum(kinds.sum(1) - kinds[:, 4] - kinds[:, 5], 1)
    per_word = np.maximum(words, 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 11], 1)
    columns = [
        np.log1p(words) / 4,
        np.sqrt(kinds[:, 2] / letters),
        *(np.sqrt(kinds[:, k] / inside) for k in (3, 6, 7, 8, 9, 10)),
        np.log1p(inside / per_word),
        np.sqrt(np.bincount(docs[next_same], minlength=n) / per_word),
        _repeats(codes, docs, n) / per_word,
        np.sqrt(_repeats(line_codes, line_of, n) / np.maximum(lines, 1)),
    ]
    return np.where(lengths[:, None] > 0, np.stack(columns, 1), 0.0)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text"), TEXT_AT_ONCE):
            x = statistics(texts)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(texts.first, texts.n), flat], ["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of each document; an empty table has none."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _batches, "doc_id long, x array<double>")


@dataclass
class Model:
    """Means, inverse Cholesky factors and log terms of the classes 0 and 1; None scores every document ``constant``."""

    means: np.ndarray | None
    inverse: np.ndarray | None
    offsets: np.ndarray | None
    constant: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        z = np.einsum("kij,knj->kni", self.inverse, x[None] - self.means[:, None])
        density = self.offsets[:, None] - 0.5 * (z**2).sum(2)
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -60, 60)))


def fit(rows: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """Fit on every row of ``rows`` (doc_id, x) with a label whose crc32(doc_id) mod 5 is not 0.

    Labels other than 0 and 1 are left out. With fewer than two rows of a class there
    is no covariance; the model then scores all documents as the other class, or 1
    without any label.
    """
    k = len(FEATURES)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    known = known.where(id_crc() % FOLDS != 0)
    x = [F.col("x")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.join(known, "doc_id").groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(a) for a in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p")
    )
    found = {r.quality: r for r in sums.collect()}  # two rows at most
    n = np.array([found[c].n if c in found else 0 for c in (0, 1)])
    if n.min() < 2:
        return Model(None, None, None, 0.0 if n[0] > n[1] else 1.0)
    means = np.array([np.array(found[c].s) / found[c].n for c in (0, 1)])
    inverse, offsets = [], []
    for c in (0, 1):
        cov = np.zeros((k, k))
        for (i, j), v in zip(pairs, found[c].p, strict=True):
            cov[i, j] = cov[j, i] = v / n[c] - means[c, i] * means[c, j]
        spread = np.diag(np.maximum(np.diag(cov), 0))
        cov = (1 - shrinkage) * cov + shrinkage * spread + (FLOOR + 0.01 * spread.mean()) * np.eye(k)
        factor = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(factor))
        offsets.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Model(means, np.array(inverse), np.array(offsets))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of rows (doc_id, x); no rows give none."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return map_arrow(rows, apply, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have zero statistics and are scored like any other. Labels,
    lang, source and doc_id are no inputs of the score. Rows that repeat a doc_id are
    scored each on its own text; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = durable(features(docs))
    scored = score(rows, fit(rows, labels))
    return scored.select(
        "doc_id", (F.coalesce(id_crc(), F.lit(1)) % FOLDS == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, all columns unchanged; texts pass through the scoring tasks without a shuffle.

    Null and empty texts are scored as such, rows that repeat or have no doc_id each on
    their own text. An empty table gives an empty result; without labels of both kinds
    all are scored alike.
    """
    model = fit(features(docs), labels)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = docs_columns.index("text")
        for batch in batches:
            kept = [model.score(statistics(t)) >= threshold for t in slices(batch.column(at), TEXT_AT_ONCE)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    docs_columns = docs.columns
    return map_arrow(docs, passing, docs.schema)
