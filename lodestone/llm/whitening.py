"""Embedding whitening by bit-sliced scatter matrices.

Every component becomes a whole number. A task takes blocks of rows, shifts each
dimension by its least value in the block, and packs each bit of each dimension across
the rows into 64-bit words: one bit plane a dimension and bit. The sum of products of
two dimensions is then the sum, over pairs of their planes, of the number of ones in
the AND of both, weighted by the power of two of the pair; shifts are put back by the
dimensions' sums. All of this is exact. Spark adds the blocks' sums as decimals; the
driver gets one row a pair of dimensions, centres them as whole numbers
(``n * sum(xy) - sum(x) * sum(y)``) and only then divides and takes eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 40
COMPONENTS, ROWS_AT_ONCE, DIMENSIONS = 32, 16_384, 4_096
#: Components with a smaller share of the largest eigenvalue hold no variance to divide by.
LEAST_SHARE = 1e-12


def whole(values: np.ndarray) -> np.ndarray:
    """``floor(64 * c)``; what is beyond 2^40 either way counts as 2^40."""
    return np.clip(np.floor(SCALE * values), -MOST, MOST).astype(np.int64)


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of non-negative whole numbers (rows by dimensions): words (plane by word), and each plane's dimension and bit; planes of zeros are left out."""
    words, dims, bits = [], [], []
    short = -len(y) % 64
    for d in range(y.shape[1]):
        for b in range(int(y[:, d].max()).bit_length()):
            ones = np.concatenate((((y[:, d] >> b) & 1).astype(np.uint8), np.zeros(short, dtype=np.uint8)))
            words.append(np.packbits(ones, bitorder="little").view(np.uint64))
            dims.append(d)
            bits.append(b)
    planes = np.stack(words) if words else np.zeros((0, (len(y) + short) // 64), dtype=np.uint64)
    return planes, np.array(dims, dtype=np.int64), np.array(bits, dtype=np.int64)


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums of the dimensions and sums of their products, exact, by AND and popcount of bit planes."""
    n, width = x.shape
    low = x.min(0)
    planes, dims, bits = bit_planes(x - low)
    ones = np.bitwise_count(planes).sum(1, dtype=np.int64)
    exact = np.int64 if not len(bits) or 2 * int(bits.max()) + n.bit_length() + 2 < 62 else object  # past that, Python's whole numbers
    y_sums, products = np.zeros(width, dtype=exact), np.zeros((width, width), dtype=exact)
    weights = np.array([1 << int(b) for b in bits], dtype=exact)
    np.add.at(y_sums, dims, ones.astype(exact) * weights)
    for p in range(len(planes)):
        both = np.bitwise_count(planes[p] & planes).sum(1, dtype=np.int64).astype(exact) * weights * weights[p]
        np.add.at(products[dims[p]], dims, both)
    base, add = [int(v) for v in low], [int(v) for v in y_sums]
    sums = [a + n * b for a, b in zip(add, base, strict=True)]
    return sums, [[int(products[i, j]) + base[i] * add[j] + base[j] * add[i] + n * base[i] * base[j] for j in range(width)] for i in range(width)]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows gathered to ROWS_AT_ONCE: planes are cheaper the longer they are."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], int] = {}
    for table in _chunks(batches):
        x = whole(_matrix(table.column("vector").combine_chunks()))
        sums, products = scatter(x)
        total[-1, -1] = total.get((-1, -1), 0) + len(x)
        for i, s in enumerate(sums):
            total[i, -1] = total.get((i, -1), 0) + s
            for j in range(i + 1):
                total[i, j] = total.get((i, j), 0) + products[i][j]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([str(v) for v in total.values()])], ["i", "j", "s"])


@dataclass
class Whitening:
    """Rows, sums of ``floor(64 * c)`` a dimension, eigenvalues, unit eigenvectors (columns) and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def held(self) -> np.ndarray:
        """Which components have variance to divide by."""
        return self.values > LEAST_SHARE * max(self.values[0], 0) if len(self.values) else np.zeros(0, dtype=bool)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Centred rows on the components, over the root of each eigenvalue; not a number where there is no variance."""
        mean = np.array([s / self.n for s in self.sums])
        scale = np.where(self.held(), 1 / np.sqrt(np.where(self.held(), self.values, 1)), np.nan)
        return (x - mean) @ self.vectors * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """``sum((n * x - S) ** 2)`` of each row, exact."""
        far = max(int(abs(x).max()) * self.n + max(abs(s) for s in self.sums), 1) if x.size else 1
        exact = np.int64 if far * far * x.shape[1] < 1 << 62 else object
        away = x.astype(exact) * self.n - np.array(self.sums, dtype=exact)
        return [int(v) for v in (away * away).sum(1)]


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of rows that take part: not null, not empty, of the commonest length, all components finite."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return rows if length is None else rows.where(F.size("vector") == length.length)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows (vec_id, vector of one length); None without rows. The driver gets one row a pair of dimensions."""
    width = rows.select(F.size("vector").alias("w")).first()
    if width is None:
        return None
    if width.w > DIMENSIONS:
        raise ValueError(f"vectors of {width.w} components; at most {DIMENSIONS} go into one covariance")
    parts = map_arrow(rows.select("vector"), _scattered, "i int, j int, s string")
    total = {(r.i, r.j): int(r.s) for r in parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n, sums = total[-1, -1], [total[i, -1] for i in range(width.w)]
    covariance = np.zeros((width.w, width.w))
    for i in range(width.w):
        for j in range(i + 1):
            covariance[i, j] = covariance[j, i] = (n * total[i, j] - sums[i] * sums[j]) / (n * n)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, sums, values[order], axes[:, order], float(np.trace(covariance)))


def identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from a pass over all rows; components without variance do not count."""
    held = np.flatnonzero(fitted.held())
    if not len(held):
        return 0.0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(held), len(held) + 1))
        for table in _chunks(batches):
            z = fitted.whiten(whole(_matrix(table.column("vector").combine_chunks())))[:, held]
            total += z.T @ np.concatenate((z, np.ones((len(z), 1))), axis=1)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in (i.astype(np.int32), j.astype(np.int32), total)], ["i", "j", "s"])

    total = np.zeros((len(held), len(held) + 1))
    for r in map_arrow(rows.select("vector"), products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.i, r.j] = r.s
    total /= fitted.n
    mean = total[:, -1]  # rows are centred before they are multiplied; what is left of the mean is rounding
    return float(abs(total[:, :-1] - np.outer(mean, mean) - np.eye(len(held))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row a vector and component.

    Rows whose vector is null, empty, of another length than the commonest, or holds null
    or non-finite entries are dropped; zero vectors, repeated rows and rows without a
    vec_id stay, each a row of its own. With fewer dimensions than ``components`` there
    are as many components as dimensions. Equal eigenvalues keep the solver's order, the
    same for all rows. A component without variance has no whitened value (null) and
    does not count in identity_error; without any variance explained is null.
    A deviation beyond a long is null. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = usable(vectors, vector)
    fitted = fit(rows, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = whole(_matrix(batch.column("vector")))
                z = fitted.whiten(x)
                flat = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), flat)
                deviation = pa.array([d if d < 1 << 63 else None for d in fitted.deviations(x)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists], ["vec_id", "deviation", "z"])

    error = identity_error(rows, fitted)
    explained = F.array(*[F.lit(float(v) / fitted.trace if fitted.trace > 0 else None).cast("double") for v in fitted.values])
    out = map_arrow(rows, apply, "vec_id long, deviation long, z array<double>").select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened"))
    return out.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
    )
