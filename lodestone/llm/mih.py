"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes are the signs of unit vectors after learned rotations (principal axes, then
iterative quantisation, several rotations side by side up to CODE_BITS bits). Codes
split into substrings, each indexed on its own. If two codes differ in at most
``radius`` bits, one of their substrings differs in at most ``radius // SUBSTRINGS``,
so probing the buckets within that distance finds every code within the radius; a code
found through several substrings counts for the first only. Only what lies within the
radius by its whole code is ranked, by the cosine of the original vectors in double
precision.

Buckets are probed in one of two ways that find the same codes. With a small reach the
keys within it are listed for each query and meet the index in an equi-join. With a
wide reach most buckets are probed anyway; then the codes are dealt in parts and each
query's code is compared with all codes of a part at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_arrow, shuffle_width

SAMPLE_ROWS, PROBE_ROWS, ROUNDS = 20_000, 256, 12
CODE_BITS, SUBSTRING_BITS = 256, 16
SUBSTRINGS, WORDS = CODE_BITS // SUBSTRING_BITS, CODE_BITS // 64
TARGET_RECALL, VECTORS_A_PART, NEIGHBOURS, QUERIES_AT_ONCE = 0.97, 32_768, 5, 32
#: Keys are listed if the buckets in reach hold this share of the entries at most, and the lists are this much shorter than the index.
LISTED_SHARE, LISTED_LESS = 1 / 16, 8
CODE = [f"code{w}" for w in range(WORDS)]


@dataclass
class Coder:
    """Rotation to codes, the radius that holds the target recall, and the share of all codes that the buckets in its reach hold."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int
    reached: float = 1.0

    def codes(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        bits = ((unit - self.mean) @ self.rotation > 0).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def learn(x: np.ndarray, k: int = NEIGHBOURS, seed: int = 5) -> Coder:
    """Rotations and radius from sample vectors. The radius holds TARGET_RECALL of the sample's own neighbours, which lie farther off than those in the whole table."""
    rng = np.random.default_rng(seed)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit.mean(0)
    z = unit - mean
    axes = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :CODE_BITS]
    v, width = z @ axes, axes.shape[1]
    blocks = []
    for _ in range(-(-CODE_BITS // width)):
        rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(v.T @ np.sign(v @ rotation), full_matrices=False)
            rotation = u @ w
        blocks.append(axes @ rotation)
    coder = Coder(mean, np.concatenate(blocks, axis=1)[:, :CODE_BITS], CODE_BITS)
    own = rng.permutation(len(x))[:PROBE_ROWS]
    near = unit[own] @ unit.T
    near[np.arange(len(own)), own] = -2
    best = np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
    codes = coder.codes(x)
    apart = np.bitwise_count(codes[own][:, None] ^ codes[best]).sum(2, dtype=np.int64)
    coder.radius = min(CODE_BITS, int(np.quantile(apart, TARGET_RECALL)) + 1)
    parts = codes.view(np.uint16)
    some = parts[rng.permutation(len(x))[:2_000]]
    coder.reached = float(np.mean([(np.bitwise_count(some ^ parts[q]) <= reach(coder.radius)).any(1).mean() for q in own[:64]]))
    return coder


def reach(radius: int) -> int:
    """Bits in which one substring at least must agree to, of two codes within the radius."""
    return radius // SUBSTRINGS


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of rows that take part: of the commonest length, finite and not zero; one row of each vec_id (the least vector)."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    )
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if length is None:
        return rows
    return rows.where(F.size("vector") == length.length).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


_INDEX = "vec_id long, vector array<double>, " + ", ".join(f"{c} long" for c in CODE)


def encode(rows: DataFrame, coder: Coder) -> DataFrame:
    """vec_id, vector and the words of its code."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = coder.codes(_matrix(batch.column("vector"))).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), *[pa.array(codes[:, w].copy()) for w in range(WORDS)]], ["vec_id", "vector", *CODE])

    return map_arrow(rows, apply, _INDEX)


def entries_of(index: DataFrame, k: int) -> DataFrame:
    """What is indexed: of rows with one vector only the k + 1 of the smallest ids, as ties go to these and a row is not its own neighbour.

    The rank has a bound, so each task drops the others before they are dealt.
    """
    same = Window.partitionBy(*CODE, F.xxhash64("vector"), "vector").orderBy("vec_id")
    return index.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n")


def _substrings(prefix: str = "") -> list[Column]:
    per = 64 // SUBSTRING_BITS
    return [F.shiftrightunsigned(F.col(f"{prefix}{CODE[s // per]}"), SUBSTRING_BITS * (s % per)).bitwiseAND((1 << SUBSTRING_BITS) - 1) for s in range(SUBSTRINGS)]


def by_keys(entries: DataFrame, queries: DataFrame, radius: int, k: int) -> DataFrame:
    """Probes by listed keys: query_id, vec_id, score of the k nearest found.

    Every substring value in reach of a query's is a key; entries and probes meet on
    (substring, value). Pairs are checked on whole codes inside the join; vectors join
    by id only for the pairs that stay.
    """
    t = reach(radius)
    masks = [sum(1 << b for b in bits) for d in range(t + 1) for bits in combinations(range(SUBSTRING_BITS), d)]
    e = entries.select("vec_id", *CODE, F.posexplode(F.array(*_substrings())).alias("sub", "value"))
    q = queries.select(F.col("vec_id").alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in CODE], F.posexplode(F.array(*_substrings())).alias("sub", "own"))
    q = q.withColumn("value", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m.bitwiseXOR(F.col("own")))))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"q_{c}"))) for c in CODE), F.lit(0))
    differ = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(_substrings(), _substrings("q_"), strict=True)]
    first = F.coalesce(*[F.when(d <= t, F.lit(s)) for s, d in enumerate(differ)])
    pairs = e.join(q, ["sub", "value"]).where((apart <= radius) & (first == F.col("sub")) & (F.col("vec_id") != F.col("query_id"))).select("query_id", "vec_id")
    of = lambda rows, key, name: rows.select(F.col("vec_id").alias(key), F.col("vector").alias(name))
    rows = pairs.join(of(entries, "vec_id", "d"), "vec_id").join(of(queries, "query_id", "q"), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = dot("q", "d") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("d", "d")))
    return _ranked(rows.select("query_id", "vec_id", score.alias("score")), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_part(radius: int, k: int):
    """Compares the queries of a part (role 1) with its entries (role 0), which come first."""

    def ranked(entries: list, queries: tuple) -> Iterator[pa.RecordBatch]:
        ids, x, codes = (np.concatenate(c) for c in zip(*entries, strict=True))
        norms = np.sqrt((x * x).sum(1))
        out: list[list[np.ndarray]] = [[], [], []]
        for i in range(0, len(queries[0]), QUERIES_AT_ONCE):
            own, vectors, code = (a[i : i + QUERIES_AT_ONCE] for a in queries)
            apart = np.zeros((len(own), len(ids)), dtype=np.int16)
            for w in range(WORDS):
                apart += np.bitwise_count(code[:, w, None] ^ codes[None, :, w])
            row, at = np.nonzero((apart <= radius) & (own[:, None] != ids[None]))
            edges = np.searchsorted(row, np.arange(len(own) + 1))
            for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                near = at[a:b]
                if len(near) > k:  # a rough product first; what could be among the k best is scored exactly
                    s = (x[near] @ vectors[r]) / norms[near]
                    near = near[s >= np.partition(s, -k)[-k] - 1e-9 * max(1.0, abs(s).max())]
                if len(near):
                    score = (vectors[r] * x[near]).sum(1) / (np.sqrt((vectors[r] * vectors[r]).sum()) * norms[near])
                    best = np.lexsort((ids[near], -score))[:k]
                    for column, values in zip(out, (np.full(len(best), own[r]), ids[near[best]], score[best]), strict=True):
                        column.append(values)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, entries = None, []
        for batch in batches:
            part, role = np.asarray(batch.column("part")), np.asarray(batch.column("role"))
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
                if a == b:
                    continue
                if part[a] != at:
                    at, entries = part[a], []
                piece = batch.slice(a, b - a)
                codes = np.stack([np.asarray(piece.column(c)) for c in CODE], 1).view(np.uint64)
                block = (np.asarray(piece.column("vec_id")), _matrix(piece.column("vector")), codes)
                if role[a] == 0:
                    entries.append(block)
                elif entries:
                    yield from ranked(entries, block)

    return apply


def by_parts(entries: DataFrame, queries: DataFrame, radius: int, k: int, rows: int) -> DataFrame:
    """Probes all buckets: entries are dealt to parts by a hash of the id, every query goes to every part; the same codes as :func:`by_keys`."""
    parts = max(1, -(-rows // VECTORS_A_PART), min(shuffle_width(entries.sparkSession), -(-rows // 1024)))
    own = entries.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("role"), "vec_id", "vector", *CODE)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("role"), "vec_id", "vector", *CODE)
    dealt = own.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "role")
    return _ranked(map_arrow(dealt, _search_part(radius, k), "query_id long, vec_id long, score double"), k)


def search(index: DataFrame, queries: DataFrame, radius: int, k: int = NEIGHBOURS, reached: float = 1.0) -> DataFrame:
    """query_id, vec_id, score, rank: for each query the k nearest of the codes within the radius; an empty index or no queries give none.

    ``index`` and ``queries`` have vec_id, vector and code words; ``reached`` is the share
    of the entries in the buckets within reach, which decides how they are probed.
    """
    entries, rows = entries_of(index, k), index.count()
    keys = SUBSTRINGS * sum(comb(SUBSTRING_BITS, d) for d in range(reach(radius) + 1))
    if reached <= LISTED_SHARE and keys * LISTED_LESS <= rows:
        return by_keys(entries, queries, radius, k)
    return by_parts(entries, queries, radius, k, rows)


def nearest(vectors: DataFrame, every: int = 50, k: int = NEIGHBOURS, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by ``every``.

    Rows whose vector is null, zero, of an odd length or holds null or non-finite
    components, and rows without a vec_id, take no part. Of rows that repeat a vec_id the
    one with the least vector takes part. The coder is learned on at most SAMPLE_ROWS
    rows, all rows are indexed. A query with fewer than k codes in its radius is asked
    again over all codes. A row is never its own neighbour; equal scores go to the smaller
    vec_id. An empty table gives an empty result.
    """
    rows = durable(usable(vectors, vector))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").toArrow()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sample.num_rows < 2:
        return empty
    coder = learn(_matrix(sample.column("vector").combine_chunks()), k)
    index = durable(encode(rows, coder))
    queries = index.where(F.col("vec_id") % every == 0)
    first = durable(search(index, queries, coder.radius, k, coder.reached))
    enough = first.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = durable(queries.join(enough, "vec_id", "left_anti"))
    if short.limit(1).count():
        again = search(index, short, CODE_BITS, k)
        first = first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
