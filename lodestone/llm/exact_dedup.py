"""Exact dedup through a partitioned cuckoo-filter index of live digests.

Texts are normalised by deleting ``[\\x20\\x09-\\x0D]`` and identified by SHA-256.
Digests are hash-partitioned, in partitions of a measured size; each task holds the
cuckoo filter of its partition and, beside it, the stored digests as sorted arrays. A
filter miss means a new digest; a filter hit is verified against the stored digests,
so false positives only cost a comparison. A filter that overflows is rebuilt at twice
the size from the stored digests. Rows are reduced inside each input task before the
shuffle, so a hot text costs one row per task, however many copies it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, keep_marked, map_arrow, row_marks, shuffle_width, whole_text
from .textarrays import U64, mix64

BLANKS = " \t\n\x0b\x0c\r"
LOCAL_GROUPS, ROWS_A_PART = 100_000, 500_000


class CuckooFilter:
    """Sixteen-bit fingerprints (0 is an empty slot), four to a bucket, two candidate buckets for each key; keys are arrays of digests."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64):
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.table = np.zeros((self.buckets, self.SLOTS), dtype=np.uint16)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = keys.view(np.uint64).reshape(len(keys), 4)
        mark = np.maximum(words[:, 1] & U64(0xFFFF), U64(1)).astype(np.uint16)
        first = (words[:, 0] & U64(self.buckets - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return place ^ (mix64(mark.astype(U64)) & U64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def _fill(self, mark: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Puts marks into free slots of their buckets; tells which found none."""
        order = np.argsort(place, kind="stable")
        sorted_place = place[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_place, sorted_place)
        taken = self.table[sorted_place] != 0
        fits = rank < self.SLOTS - taken.sum(1)
        slot = np.argsort(taken, axis=1, kind="stable")[fits, rank[fits]]
        self.table[sorted_place[fits], slot] = mark[order[fits]]
        left = np.ones(len(mark), dtype=bool)
        left[order[fits]] = False
        return left

    def insert(self, keys: np.ndarray) -> bool:
        """False if the filter is full; it must then be rebuilt larger."""
        mark, a, b = self._places(keys)
        left = self._fill(mark, a)
        mark, a, b = mark[left], a[left], b[left]
        left = self._fill(mark, b)
        return all(self._kick(m, int(p)) for m, p in zip(mark[left], a[left], strict=True))

    def _kick(self, mark: np.uint16, place: int) -> bool:
        for kick in range(self.KICKS):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return True
            slot = kick % self.SLOTS
            mark, self.table[place, slot] = self.table[place, slot], mark
            place = int(self._other(np.array([place]), np.array([mark]))[0])
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Takes one mark of each key out; only keys that were inserted may be deleted."""
        mark, a, b = self._places(keys)
        for m, x, y in zip(mark, a, b, strict=True):
            place = x if (self.table[x] == m).any() else y
            self.table[place, np.flatnonzero(self.table[place] == m)[0]] = 0


def reduced(keys: np.ndarray, n: np.ndarray, doc: np.ndarray, known: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each key, keys ascending: of most code points, then the smallest doc_id (null last), and the sum of counts."""
    order = np.lexsort((doc, ~known, -n, keys))
    keys = keys[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else order
    best = order[head]
    return keys[head], n[best], doc[best], known[best], np.add.reduceat(count[order], head) if len(head) else count


class DigestIndex:
    """A cuckoo filter before the stored digests, which are sorted arrays with what is kept of each.

    ``find`` answers from the filter and verifies hits; ``add`` and ``delete`` keep the
    filter and the store in step, and an overflow rebuilds the filter at twice its size
    from the stored digests.
    """

    def __init__(self, buckets: int = 64):
        self.filter = CuckooFilter(buckets)
        self.keys = np.zeros(0, dtype="S32")
        self.n = self.doc = self.count = np.zeros(0, dtype=np.int64)
        self.known = np.zeros(0, dtype=bool)
        self.false_hits = self.rebuilt = 0

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys in the store, -1 if they are not live."""
        out = np.full(len(keys), -1, dtype=np.int64)
        hits = np.flatnonzero(self.filter.contains(keys))
        at = np.minimum(np.searchsorted(self.keys, keys[hits]), len(self.keys) - 1)
        real = self.keys[at] == keys[hits] if len(self.keys) else np.zeros(len(hits), dtype=bool)
        out[hits[real]] = at[real]
        self.false_hits += int((~real).sum())
        return out

    def add(self, keys: np.ndarray, n: np.ndarray, doc: np.ndarray, known: np.ndarray, count: np.ndarray) -> None:
        """Rows as :func:`reduced` makes them: new digests come in, live ones take the better row and the sum of counts."""
        at = self.find(keys)
        old, own = at[at >= 0], np.flatnonzero(at >= 0)
        self.count[old] += count[own]
        less = (n[own] == self.n[old]) & ((known[own] & ~self.known[old]) | ((known[own] == self.known[old]) & (doc[own] < self.doc[old])))
        better = (n[own] > self.n[old]) | less
        self.n[old[better]], self.doc[old[better]], self.known[old[better]] = n[own[better]], doc[own[better]], known[own[better]]
        fresh = at < 0
        place = np.searchsorted(self.keys, keys[fresh])
        self.keys, self.known = np.insert(self.keys, place, keys[fresh]), np.insert(self.known, place, known[fresh])
        self.n, self.doc, self.count = (np.insert(x, place, y[fresh]) for x, y in ((self.n, n), (self.doc, doc), (self.count, count)))
        if len(self.keys) * 2 > self.filter.buckets * self.filter.SLOTS or not self.filter.insert(keys[fresh]):
            self._rebuild()

    def delete(self, places: np.ndarray) -> None:
        self.filter.delete(self.keys[places])
        self.keys, self.known, self.n, self.doc, self.count = (np.delete(x, places) for x in (self.keys, self.known, self.n, self.doc, self.count))

    def _rebuild(self) -> None:
        size = self.filter.buckets
        while True:
            size, self.rebuilt = size * 2, self.rebuilt + 1
            if len(self.keys) * 2 > size * CuckooFilter.SLOTS:
                continue
            self.filter = CuckooFilter(size)
            if self.filter.insert(self.keys):
                return


def digests(docs: DataFrame, *carry) -> DataFrame:
    """doc_id, text_sha256 of the normalised text, n_code_points of the original one (null text: empty), and carried columns."""
    text = whole_text()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256).alias("text_sha256"),
        F.char_length(text).cast("long").alias("n_code_points"), *carry,
    )


_GROUPS = "digest binary, n_code_points long, keep_id long, group_size long"


def _key_array(column: pa.Array) -> np.ndarray:
    """A column of 32-byte values without nulls as an array."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].copy().view("S32") if len(column) else np.zeros(0, dtype="S32")


def _binary(keys: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((np.arange(len(keys) + 1) * 32).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(keys).tobytes())])


def _reduce(batches: Iterator[pa.RecordBatch], flush_at: int | None) -> Iterator[pa.RecordBatch]:
    index = DigestIndex()

    def emit() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(index), 10_000):
            part = slice(i, i + 10_000)
            columns = [_binary(index.keys[part]), pa.array(index.n[part]), pa.array(index.doc[part], mask=~index.known[part]), pa.array(index.count[part])]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "n_code_points", "keep_id", "group_size"])

    for batch in batches:
        doc = batch.column(2)
        index.add(*reduced(_key_array(batch.column(0)), np.asarray(batch.column(1)), np.asarray(doc.fill_null(0)), np.asarray(doc.is_valid()), np.asarray(batch.column(3))))
        if flush_at and len(index) >= flush_at:
            yield from emit()
            index = DigestIndex()
    yield from emit()


def _parts(df: DataFrame, rows: int) -> int:
    """Partitions for digests of so many rows: ROWS_A_PART each at most, and no fewer than the session's."""
    return max(shuffle_width(df.sparkSession), -(-rows // ROWS_A_PART))


def build_index(rows: DataFrame) -> DataFrame:
    """One row for each live digest: text_sha256, n_code_points, keep_id, group_size.

    ``rows`` has the columns of :func:`digests` and should be durable, as it is counted.
    Every task first reduces its own rows (in runs of ``LOCAL_GROUPS`` digests), then the
    digests are dealt by hash and each partition's index decides.
    """
    first = rows.select(F.unhex("text_sha256").alias("digest"), "n_code_points", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    local = map_arrow(first, lambda b: _reduce(b, LOCAL_GROUPS), _GROUPS)
    index = map_arrow(local.repartition(_parts(rows, rows.count()), "digest"), lambda b: _reduce(b, None), _GROUPS)
    return index.select(F.lower(F.hex("digest")).alias("text_sha256"), "n_code_points", "keep_id", "group_size")


def update_index(index: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Live digests and their counts after changes: text_sha256, live.

    ``index`` has text_sha256 and live (or group_size); ``added`` and ``removed`` have
    text_sha256. A digest leaves the index when its last row is removed; removing
    an unknown digest changes nothing, as do rows without a digest. Repeated rows count
    each; without changes the index comes back, and an empty one takes what is added.
    """
    live = "live" if "live" in index.columns else "group_size"
    count = F.count(F.lit(1))
    changes = (
        index.select("text_sha256", F.col(live).cast("long").alias("n"))
        .unionByName(added.groupBy("text_sha256").agg(count.alias("n")))
        .unionByName(removed.groupBy("text_sha256").agg((-count).alias("n")))
    )
    changes = durable(changes.where("text_sha256 is not null").select(F.unhex("text_sha256").alias("digest"), "n"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, less = DigestIndex(), []
        for batch in batches:
            keys, n = _key_array(batch.column(0)), np.asarray(batch.column(1))
            zero = np.zeros(len(keys), dtype=np.int64)
            part = n > 0
            own.add(*reduced(keys[part], zero[part], zero[part], zero[part] == 0, n[part]))
            less.append((keys[~part], n[~part]))
        for keys, n in less:
            at = own.find(keys)
            np.add.at(own.count, at[at >= 0], n[at >= 0])
        own.delete(np.flatnonzero(own.count <= 0))
        yield pa.RecordBatch.from_arrays([_binary(own.keys), pa.array(own.count)], ["digest", "live"])

    kept = map_arrow(changes.repartition(_parts(changes, changes.count()), "digest"), apply, "digest binary, live long")
    return kept.select(F.lower(F.hex("digest")).alias("text_sha256"), "live")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and form a group with texts of blanks only. Of equal
    texts the row with the most code points stays, then the smallest doc_id (a null
    doc_id only if no other is there). Rows that repeat a doc_id share its decision.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = durable(digests(docs))
    index = build_index(rows).select("text_sha256", "keep_id", "group_size")
    return rows.join(index, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts, all columns unchanged.

    It is the one that :func:`exact_dedup` keeps. Rows are told apart by all their
    columns, not by doc_id: rows of one doc_id (or without any) and different texts all
    stay, and of several rows with the text, doc_id and length that stays one does.
    Null texts count as empty; an empty table gives an empty result.
    """
    rows = durable(digests(docs, *row_marks(docs)))
    index = build_index(rows).select("text_sha256", "keep_id", F.col("n_code_points").alias("most"))
    best = rows.join(index, "text_sha256").where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_code_points") == F.col("most")))
    return keep_marked(docs, best, "text_sha256")
