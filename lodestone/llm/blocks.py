"""Text blocks and their anchor index, shared by the two substring operators.

A block is a run of whole documents of about a megabyte, kept compressed. Windows of a
fixed length (words or bytes) are never shuffled themselves: each window chooses an
anchor, a short gram picked by its content, so equal windows choose equal anchors at
the same place within them. Consecutive windows with one anchor form a context. Every
block sends, for each anchor and context it holds, one entry to the anchor's bucket;
the bucket sees whether an anchor or a whole context occurs elsewhere and answers the
blocks. Copies cost one entry a block, however many a block holds.

An anchor with many different contexts (a line in a good part of all documents) would
fill one bucket. Such hot anchors are counted first, and each of their windows becomes
a context of its own under a second hash of the whole window: these keys spread over
all buckets, and each has one distinct context, however many documents hold it.

Rows between steps carry arrays as bytes: (block or bucket, kind, payload). Spark
deals them by key, sorts them inside partitions and spills as it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_arrow, shuffle_width
from .textarrays import Texts, slices

BLOCK_BYTES = 1 << 20
#: Distinct contexts of an anchor above which it is split by windows, contexts that a counting task holds at once, and entries of a bucket.
HOT, COUNTED_AT_ONCE, ENTRIES_A_BUCKET = 2048, 1 << 20, 400_000
ROWS = "key long, kind int, payload binary"


def pack(*arrays: np.ndarray, level: int = 0) -> bytes:
    """Arrays one after another, each behind its type and length, at multiples of eight bytes; compressed if a level is given."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [a.dtype.str.encode().ljust(8), np.int64(len(a)).tobytes(), a.tobytes(), bytes(-a.nbytes % 8)]
    raw = b"".join(parts)
    return zstandard.ZstdCompressor(level=level).compress(raw) if level else raw


def unpack(payload: bytes, compressed: bool = False) -> list[np.ndarray]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(payload) if compressed else payload)
    out, at = [], 0
    while at < len(raw):
        kind, n = np.dtype(bytes(raw[at : at + 8]).decode().strip()), int(np.frombuffer(raw, np.int64, 1, at + 8)[0])
        out.append(np.frombuffer(raw, kind, n, at + 16))
        at += 16 + (n * kind.itemsize + 7) // 8 * 8
    return out


def row_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    key, kind, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["key", "kind", "payload"])


class Block:
    """Documents of one block: ids (null ids carry their mask) and texts."""

    def __init__(self, payload: bytes):
        self.ids, self.known, bounds, data = unpack(payload, compressed=True)
        self.texts = Texts(data, bounds, 0)


def make_blocks(docs: DataFrame) -> DataFrame:
    """Checkpointed blocks (key, kind 0, payload) of doc_id and text; null texts are empty."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id")
            for texts in slices(batch.column("text"), BLOCK_BYTES):
                own = ids.slice(texts.first, texts.n)
                payload = pack(np.asarray(own.fill_null(0)), np.asarray(own.is_valid()), texts.bounds, texts.data, level=3)
                yield row_batch([(key, 0, payload)])
                key += 1

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return durable(map_arrow(plain, build, ROWS))


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_buffer()


def per_row(df: DataFrame, work: Callable[[int, int, bytes], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """Rows that ``work`` makes of each row alone."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, kind, payload in each_row(batches):
            if rows := list(work(key, kind, payload)):
                yield row_batch(rows)

    return map_arrow(df, apply, ROWS)


def per_key(df: DataFrame, work: Callable[[int, list[tuple[int, bytes]]], Iterator], schema: str = ROWS, form: Callable = row_batch) -> DataFrame:
    """What ``work`` makes of all rows (kind, payload) of a key, in order of kind."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for key, kind, payload in each_row(batches):
            if key != at and held:
                if rows := list(work(at, held)):
                    yield form(rows)
                held = []
            at = key
            held.append((kind, payload))
        if held and (rows := list(work(at, held))):
            yield form(rows)

    width = shuffle_width(df.sparkSession)
    return map_arrow(df.repartition(width, "key").sortWithinPartitions("key", "kind"), apply, schema)


def deal(values: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Places of the values of each bucket, by their upper bits; values sorted inside a bucket stay so."""
    bucket = (values >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    return [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys (first one foremost) and the group number of each sorted row."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def first_of(group: np.ndarray) -> np.ndarray:
    """Places at which a new group begins in sorted group numbers."""
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else group


def hot_anchors(blocks: DataFrame, contexts: Callable[[bytes], tuple[np.ndarray, np.ndarray]], hot: int = HOT) -> tuple[np.ndarray, int]:
    """Sorted anchors with more than ``hot`` distinct contexts, and the number of buckets for all entries.

    ``contexts`` gives anchors and contexts of a block's distinct entries. Counts are
    summed over groups of blocks. An anchor with a single context in a group is left out
    there, so others have at most one context a group more than ``hot``; hot ones are at
    most one for every ``hot`` contexts of all. Buckets hold ENTRIES_A_BUCKET entries on
    average at most and are three for each shuffle partition at least.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def tell() -> pa.RecordBatch:
            anchor, context = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((context, anchor))
            a, c = anchor[order], context[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
            a, n = np.unique(a[new], return_counts=True)
            several = n > 1
            # The last row, without an anchor, counts the entries.
            names = pa.array(np.append(a[several].view(np.int64), 0), mask=np.append(np.zeros(several.sum(), dtype=bool), True))
            return pa.RecordBatch.from_arrays([names, pa.array(np.append(n[several], size))], ["anchor", "n"])

        for _, _, payload in each_row(batches):
            anchor, context = contexts(payload)
            if len(anchor):
                held.append((anchor, context))
                size += len(anchor)
            if size >= COUNTED_AT_ONCE:
                yield tell()
                held, size = [], 0
        if held:
            yield tell()

    sums = map_arrow(blocks, count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    rows = sums.where((F.col("n") > hot) | F.col("anchor").isNull()).collect()
    entries = sum(r.n for r in rows if r.anchor is None)
    anchors = np.sort(np.array([r.anchor for r in rows if r.anchor is not None], dtype=np.int64).view(np.uint64))
    return anchors, max(3 * shuffle_width(blocks.sparkSession), -(-entries // ENTRIES_A_BUCKET))


def split_hot(hot: np.ndarray, anchor: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, second: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
    """anchor, place, low, high with each window of a hot anchor as a context of its own, under a second hash of the whole window."""
    if not len(hot) or not len(anchor):
        return anchor, place, low, high
    split = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
    if not split.any():
        return anchor, place, low, high
    many = np.where(split, high - low + 1, 1)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    split, anchor, place, low, high = (np.repeat(x, many) for x in (split, anchor, place, low, high))
    low = low + at
    high = np.where(split, low, high)
    anchor[split] = second(low[split])
    return anchor, place, low, high
