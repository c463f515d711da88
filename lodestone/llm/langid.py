"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of it is predicted by a binary classifier over
hashed byte n-grams of the letters of the whole text. Decoding adds up the
exponential loss of the bits' margins against each codeword, every bit weighted by
how well its classifier separates the training rows, and takes the codeword of least
loss. A small gap to the second is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, map_arrow, small_side
from .textarrays import Texts, U64, slices

FOLDS, HELD_OUT = 4, 2
DIMENSIONS, SAMPLE_ROWS, RIDGE, AMBIGUOUS_UNDER = 2048, 5_000, 0.05, 0.6
#: Vectors of so many documents are held at once (8 MB).
ROWS_AT_ONCE = 512

_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def ngrams(texts: Texts) -> np.ndarray:
    """A unit vector of hashed letter n-gram counts (one to three bytes, square roots) for each document."""
    n, size = texts.n, len(texts.data)
    counts = np.zeros(n * DIMENSIONS)
    if size:
        letters = _LETTER[texts.data].astype(U64)
        of = np.repeat(np.arange(n, dtype=np.int64), np.diff(texts.bounds)) * DIMENSIONS
        code = np.zeros(size, dtype=U64)
        for length in (1, 2, 3):
            code = (code[: size - length + 1] << U64(8)) | letters[length - 1 :]
            place = ((code * U64(0x9E3779B97F4A7C15) + U64(length)) >> U64(53)).astype(np.int64)
            whole = of[: len(code)] == of[length - 1 :]
            counts += np.bincount((of[: len(code)] + place)[whole], minlength=len(counts))
    x = np.sqrt(counts.reshape(n, DIMENSIONS))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def codewords(classes: int) -> np.ndarray:
    """Codewords of -1 and 1: all distinct splits for up to seven classes, else a fixed random code."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 7:
        bits = [b for b in product((-1, 1), repeat=classes - 1) if -1 in b]
        return np.array([[1] * len(bits), *zip(*bits, strict=True)])
    draw = np.random.default_rng(20)
    tries = [draw.choice((-1, 1), size=(classes, 15 * int(np.ceil(np.log2(classes))))) for _ in range(50)]
    return max(tries, key=lambda c: -(c @ c.T - np.eye(classes) * c.shape[1] * 2).max())


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray | None
    bias: np.ndarray | None
    trust: np.ndarray | None
    sharpness: float = 1.0

    def _loss(self, x: np.ndarray) -> np.ndarray:
        margins = np.clip(x @ self.weights + self.bias, -3, 3)
        return np.einsum("nlb,b->nl", np.exp(-margins[:, None, :] * self.code[None]), self.trust)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and its share of the decoded evidence, 0 to 1."""
        if self.weights is None:
            return np.zeros(len(x), dtype=np.int64), np.ones(len(x))
        gain = -self.sharpness * self._loss(x)
        share = np.exp(gain - gain.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        return best, share[np.arange(len(x)), best]


def train(x: np.ndarray, y: list[str]) -> Model:
    languages = sorted(set(y))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, None, None, None)
    target = code[np.searchsorted(languages, y)].astype(float)
    parts = [slice(i, i + 500) for i in range(0, len(x), 500)]  # in parts, so that the driver holds little more than the sample
    mean, bias = x.mean(0, dtype=np.float64), target.mean(0)
    gram, cross = np.zeros((x.shape[1],) * 2), np.zeros((x.shape[1], code.shape[1]))
    for part in parts:
        z = x[part] - mean
        gram += z.T @ z
        cross += z.T @ (target[part] - bias)
    gram[np.diag_indices_from(gram)] += RIDGE * len(x) / 100
    weights = np.linalg.solve(gram, cross)
    model = Model(languages, code, weights, bias - mean @ weights, np.ones(code.shape[1]))
    wrong = sum((((x[part] @ weights + model.bias) * target[part]) <= 0).sum(0) for part in parts) / len(x)
    trust = np.log((1 - np.clip(wrong, 1e-3, 0.49)) / np.clip(wrong, 1e-3, 0.49))
    model.trust, model.sharpness = trust / trust.sum(), 4.0 * len(languages)
    return model


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text"), 1 << 20, ROWS_AT_ONCE):
            x = ngrams(texts).astype(np.float16)
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * 2 * DIMENSIONS).astype(np.int32)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(texts.first, texts.n), packed], ["lang", "x"])


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, chosen by a hash of their ids; whole texts.

    Half of the sample is dealt equally to the languages, half by their frequency, so
    that rare languages are learned too. No labelled rows give a model without languages.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(id_crc(), F.lit(0)) % FOLDS != HELD_OUT))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    total = sum(counts.values())
    least = rows // (2 * max(1, len(counts)))
    quotas = [(lang, min(n, max(1, least + (rows - least * len(counts)) * n // total)), n) for lang, n in counts.items()]
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 20))
    # Hash thresholds first, so that few texts reach the ranking for the exact bounds; the side has a row a language.
    limits = known.sparkSession.createDataFrame([(lang, q, int(min(1 << 20, (1 << 20) * (1.3 * q + 20) / n))) for lang, q, n in quotas], "lang string, quota int, under int")
    near = known.join(small_side(limits, len(quotas)), "lang").withColumn("_place", place).where(F.col("_place") < F.col("under"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_place", "doc_id"))
    sample = near.withColumn("_rank", rank).where((F.col("_rank") <= F.col("quota")) & (F.col("_rank") <= rows)).select("lang", "text")
    x, y = [], []
    for row in map_arrow(sample, _packed, "lang string, x binary").toLocalIterator():
        x.append(np.frombuffer(row.x, dtype=np.float16))
        y.append(row.lang)
    return train(np.array(x, dtype=np.float32).reshape(len(y), DIMENSIONS), y)


def _has_letter(texts: Texts) -> np.ndarray:
    """Whether a text has a letter of any script."""
    plain = np.concatenate(([0], np.cumsum((_LETTER[texts.data] != 32) & (texts.data < 128))))
    found = np.diff(plain[texts.bounds]) > 0
    for k in np.flatnonzero(~found & (np.diff(texts.bounds) > 0)):
        found[k] = any(map(str.isalpha, texts.data[texts.bounds[k] : texts.bounds[k + 1]].tobytes().decode("utf-8", "replace")))
    return found


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous.

    ``und`` with score 0 for null or empty texts and texts without a letter, and for
    all documents if no language could be learned. Rows that repeat a doc_id are
    judged each on its own text. Of equally near codewords the language first in order
    wins. An empty table gives an empty result; other columns are ignored.
    """
    learned = fit(docs) if model is None else model

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text"), 1 << 20, ROWS_AT_ONCE):
                usable = _has_letter(texts) & bool(learned.languages)
                best, share = learned.predict(ngrams(texts))
                names = np.array([*learned.languages, "und"], dtype=object)
                label = names[np.where(usable, best, len(learned.languages))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(texts.first, texts.n), pa.array(label, pa.string()), pa.array(np.where(usable, share, 0.0))],
                    ["doc_id", "lang_pred", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = map_arrow(rows, apply, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (F.coalesce(id_crc(), F.lit(0)) % FOLDS == HELD_OUT).alias("held_out"), "lang_pred", "score", (F.col("score") < AMBIGUOUS_UNDER).alias("ambiguous"))
