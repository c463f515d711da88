"""Substring dedup by suffix arrays over bytes, built by two-stage sorting.

The anchor index (see :mod:`blocks`) tells which contexts of 200-byte windows can have
a match at all. One representative of each such context goes to its anchor's bucket,
with the number of its copies; there the suffixes that begin windows are sorted. Only
suffixes smaller than their successors are sorted directly; the others are induced
from them by scans over the first-byte buckets. Common prefixes of neighbours in the
array then show which windows occur twice, and the covered bytes go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import HOT, Block, deal, first_of, hot_anchors, make_blocks, pack, per_key, per_row, split_hot, unpack
from .common import durable
from .textarrays import U64, anchors, byte_prefix, mix64, second_prefix

LENGTH, GRAM = 200, 100
NO_ANCHORS = np.zeros(0, dtype=U64)


def direct_stops(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places whose byte is under the next one of the same document, so that their suffixes are sorted directly; then the end."""
    rises = np.zeros(len(data), dtype=bool)
    rises[:-1] = data[:-1] < data[1:]
    last = bounds[1:] - 1
    rises[last[last >= 0]] = False
    return np.append(np.flatnonzero(rises), len(data))


class SuffixOrder:
    """Suffixes of many short strings, sorted to a depth of ``length`` bytes.

    ``data`` holds the strings one after another; string k has suffixes to sort at
    ``begins[k] .. begins[k] + counts[k] - 1``, of which the last is smaller than its
    successor or is the empty suffix at the string's end (``empty[k]``).
    """

    def __init__(self, data: np.ndarray, begins: np.ndarray, counts: np.ndarray, empty: np.ndarray, length: int):
        self.length = length
        self.data = np.concatenate((data, np.zeros(length + 16, dtype=np.uint8)))
        self.words = np.ndarray((len(self.data) - 8,), dtype=">u8", buffer=self.data, strides=(1,))
        total = int(counts.sum())
        offsets = np.cumsum(counts) - counts
        self.at = np.repeat(begins - offsets, counts) + np.arange(total)  # place of each suffix
        self.string = np.repeat(np.arange(len(counts)), counts)
        letter = self.data[self.at].astype(np.int16) + 1
        letter[(offsets + counts - 1)[empty]] = 0
        self.letter = letter
        direct = np.empty(total, dtype=bool)
        direct[:-1] = self._rising(offsets, counts)
        direct[-1:] = True
        direct[offsets + counts - 1] = True
        self.direct, self.first = direct, np.zeros(total, dtype=bool)
        self.first[offsets] = True
        self.order = self._induce(self._sort(np.flatnonzero(direct)))

    def _rising(self, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which suffixes, but the last one of all, are smaller than their successors: by the next different letter."""
        total, last = len(self.letter), offsets + counts - 1
        differs = np.ones(total, dtype=bool)
        differs[:-1] = self.letter[1:] != self.letter[:-1]
        differs[last] = True
        stop = np.flatnonzero(differs)
        stop = stop[np.searchsorted(stop, np.arange(total - 1))]
        ends = np.zeros(total, dtype=bool)
        ends[last] = True
        # A run of one letter that reaches the last suffix shares the type of that one, which is directly sorted.
        return np.where(ends[stop], True, self.letter[np.minimum(stop + 1, total - 1)] > self.letter[: total - 1])

    def _sort(self, chosen: np.ndarray) -> np.ndarray:
        """The chosen suffixes in order, eight bytes at a time; only ties between different windows go on."""
        prefix = byte_prefix(self.data)
        place = self.at[chosen]
        whole = prefix.of(place, place + self.length)
        key = (self.letter[chosen].astype(U64) << U64(48)) | (self.words[place].astype(U64) >> U64(16))
        key = np.where(self.letter[chosen] > 0, key, U64(0))
        order = np.argsort(key, kind="stable")
        key = key[order]
        group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) if len(key) else key.astype(np.int64)
        depth = 6
        while depth < self.length and len(order):
            head = first_of(group)
            sizes = np.diff(np.append(head, len(group)))
            mixed = np.zeros(len(head), dtype=bool)
            same = np.ones(len(group), dtype=bool)
            same[1:] = (whole[order[1:]] == whole[order[:-1]]) | (group[1:] != group[:-1])
            np.logical_or.at(mixed, np.searchsorted(head, np.flatnonzero(~same), side="right") - 1, True)
            open_ = np.repeat(mixed & (sizes > 1), sizes) & (self.letter[chosen[order]] > 0)
            tied = np.flatnonzero(open_)
            if not len(tied):
                break
            more = self.words[place[order[tied]] + depth].astype(U64)
            inner = np.lexsort((more, group[tied]))
            order[tied] = order[tied[inner]]
            more = more[inner]
            split = np.zeros(len(group), dtype=np.int64)
            split[tied[1:]] = (more[1:] != more[:-1]) & (group[tied[1:]] == group[tied[:-1]])
            group = group + np.cumsum(split)
            depth += 8
        return chosen[order]

    def _induce(self, sorted_direct: np.ndarray) -> np.ndarray:
        """All suffixes in order: each first-letter bucket holds its larger-than-next suffixes, then the directly sorted ones."""
        letters = np.unique(self.letter)
        direct = dict(zip(letters.tolist(), np.split(sorted_direct, np.searchsorted(self.letter[sorted_direct], letters[1:])), strict=True))
        waiting: dict[int, list[np.ndarray]] = {int(c): [] for c in letters}
        out = []

        def before(suffixes: np.ndarray) -> np.ndarray:
            own = suffixes[~self.first[suffixes]] - 1
            return own[~self.direct[own]]

        def hand_out(suffixes: np.ndarray) -> None:
            if len(suffixes):
                c = self.letter[suffixes]
                order = np.argsort(c, kind="stable")
                heads = np.flatnonzero(np.concatenate(([True], c[order][1:] != c[order][:-1])))
                for part in np.split(suffixes[order], heads[1:]):
                    waiting[int(self.letter[part[0]])].append(part)

        for c in letters.tolist():
            queue = np.concatenate(waiting.pop(c) or [np.zeros(0, dtype=np.int64)])
            while len(queue):  # a run of one letter goes on within the bucket
                out.append(queue)
                ahead = before(queue)
                hand_out(ahead[self.letter[ahead] > c])
                queue = ahead[self.letter[ahead] == c]
            own = direct[c]
            out.append(own)
            hand_out(before(own))
        return np.concatenate(out) if out else sorted_direct

    def common_prefixes(self, order: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each suffix in ``order`` with the next one, ``length`` at most."""
        a, b = self.at[order[:-1]], self.at[order[1:]]
        out = np.zeros(len(a), dtype=np.int32)
        alive = np.arange(len(a))
        for depth in range(0, self.length, 8):
            x = (self.words[a[alive] + depth] ^ self.words[b[alive] + depth]).astype(U64)
            equal = x == 0
            odd = x[~equal]
            lead = np.zeros(len(odd), dtype=np.int32)
            for byte in range(1, 8):
                lead += odd < U64(1 << (64 - 8 * byte))
            out[alive[~equal]] = depth + lead
            alive = alive[equal]
            if not len(alive):
                break
        out[alive] = self.length
        return np.minimum(out, self.length)


class _Cut:
    """Anchors and contexts of a block's byte windows, and its distinct entries.

    Windows of ``hot`` anchors (sorted) are contexts of their own, with a second hash of the window for an anchor.
    """

    def __init__(self, block: Block, length: int, gram: int, hot: np.ndarray = NO_ANCHORS):
        self.block, self.length = block, length
        data, bounds = block.texts.data, block.texts.bounds
        n = len(data)
        anchor = context = np.zeros(0, dtype=U64)
        self.low = self.high = np.zeros(0, dtype=np.int64)
        if n >= length:
            prefix = byte_prefix(data)
            i = np.arange(n - gram + 1)
            grams = prefix.of(i, i + gram)
            doc = np.repeat(np.arange(block.texts.n, dtype=np.int32), np.diff(bounds))
            place, self.low, self.high = anchors(grams, doc[: n - length + 1] == doc[length - 1 :], length - gram + 1)
            anchor = grams[place]
            anchor, place, self.low, self.high = split_hot(hot, anchor, place, self.low, self.high, lambda own: second_prefix(data).of(own, own + length))
            context = prefix.of(self.low, self.high + length) ^ mix64((place - self.low + 1).astype(U64))
        order = np.lexsort((context, anchor))
        a, c = anchor[order], context[order]
        entry = np.cumsum(np.concatenate(([0], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))) if len(a) else np.zeros(0, dtype=np.int64)
        head = first_of(entry)
        self.entry_of = np.empty(len(order), dtype=np.int64)
        self.entry_of[order] = entry
        self.first = order[head]
        self.many = np.bincount(entry) > 1 if len(entry) else np.zeros(0, dtype=bool)
        self.anchor, self.context = a[head], c[head]


def _compare(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """A bucket's answers to each block: entries that have copies, entries to send for sorting, and whether those have copies."""
    parts = [unpack(p) for _, p in held]
    sizes = [len(p[1]) for p in parts]
    block = np.repeat(np.array([p[0][0] for p in parts]), sizes)
    index = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
    a, c, many = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    order = np.lexsort((block, c, a))
    a, c, many, block, index = (x[order] for x in (a, c, many, block, index))
    new_a = np.concatenate(([True], a[1:] != a[:-1]))
    new = new_a.copy()
    new[1:] |= c[1:] != c[:-1]
    entry, anchor_no = np.cumsum(new) - 1, np.cumsum(new_a) - 1
    copies = np.bincount(entry, weights=1.0 + many)[entry] > 1
    repeated = copies | (np.bincount(anchor_no, weights=new)[anchor_no] > 1)
    send = new & repeated
    chosen = np.flatnonzero(copies | send)
    chosen = chosen[np.argsort(block[chosen], kind="stable")]
    for own in np.split(chosen, first_of(block[chosen])[1:]) if len(chosen) else []:
        same, asked = own[~send[own]], own[send[own]]
        yield int(block[own[0]]), 0, pack(index[same], index[asked], copies[asked])


def _sort_bucket(held: list[tuple[int, bytes]], length: int) -> Iterator[tuple[int, int, bytes]]:
    """Sorts a bucket's contexts; tells each block which windows of its contexts occur twice, as runs."""
    parts = [unpack(p) for _, p in held]
    block = np.repeat(np.array([p[0][0] for p in parts]), [len(p[1]) for p in parts])
    index, copies, windows, counts, sizes, empty = (np.concatenate([p[k] for p in parts]) for k in range(1, 7))
    begins = np.cumsum(sizes) - sizes
    order = SuffixOrder(np.concatenate([p[7] for p in parts]), begins, counts, empty.astype(bool), length)
    rank = np.arange(len(order.at)) - np.repeat(np.cumsum(counts) - counts, counts)  # place within its string
    real = rank < windows[order.string]
    array = order.order[real[order.order]]
    long_enough = order.common_prefixes(array) >= length
    twice = np.zeros(len(order.at), dtype=bool)
    twice[array[:-1]] |= long_enough
    twice[array[1:]] |= long_enough
    twice |= real & copies[order.string].astype(bool)
    edge = np.flatnonzero(twice)
    if not len(edge):
        return
    start = np.concatenate(([True], (edge[1:] != edge[:-1] + 1) | order.first[edge[1:]]))
    low, high = edge[start], edge[np.append(np.flatnonzero(start)[1:] - 1, len(edge) - 1)]
    owner = order.string[low]
    by_block = np.argsort(block[owner], kind="stable")
    for own in np.split(by_block, first_of(block[owner[by_block]])[1:]):
        yield int(block[owner[own[0]]]), 0, pack(index[owner[own]], rank[low[own]].astype(np.int32), rank[high[own]].astype(np.int32))


RESULT = "doc_id long, n_bytes long, kept_bytes binary, spans array<struct<start:int,length:int>>"


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, kept_bytes, spans (start, length) of the maximal removed runs.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else
    too. Null and empty texts have no bytes. Rows that repeat a doc_id are documents
    of their own. Other columns are ignored; an empty table gives an empty result.
    """
    blocks = make_blocks(docs)

    def contexts(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        c = _Cut(Block(payload), length, gram)
        return c.anchor, c.context

    split, n = hot_anchors(blocks, contexts, hot)

    def cut(held: list[tuple[int, bytes]]) -> _Cut:
        return _Cut(Block(next(p for kind, p in held if kind == 0)), length, gram, split)

    def index(key: int, kind: int, payload: bytes) -> Iterator[tuple[int, int, bytes]]:
        c = _Cut(Block(payload), length, gram, split)
        for bucket, own in enumerate(deal(c.anchor, n)):
            if len(own):
                yield bucket, 0, pack(np.array([key]), c.anchor[own], c.context[own], c.many[own])

    def send(key: int, held: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        if len(held) < 2:
            return
        c = cut(held)
        data, bounds = c.block.texts.data, c.block.texts.bounds
        stops = direct_stops(data, bounds)
        deals = deal(c.anchor, n)
        for kind, payload in held:
            if kind <= 0:
                continue
            _, asked, copies = unpack(payload)
            if not len(asked):
                continue
            own = c.first[deals[kind - 1][asked]]
            low, high = c.low[own], c.high[own]
            doc_end = bounds[1:][np.searchsorted(bounds[1:], high, side="right")]
            last = np.minimum(stops[np.searchsorted(stops, high)], doc_end)  # the next suffix to be sorted directly, or the document's end
            end = np.minimum(last + length, doc_end)
            sizes = end - low + 1  # one more byte, so that an empty suffix has a place
            at = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            text = np.where(at == np.repeat(end, sizes), np.uint8(0), data[np.minimum(at, len(data) - 1)])
            yield kind - 1, 0, pack(np.array([key]), asked, copies, high - low + 1, last - low + 1, sizes, last == doc_end, text)

    def answer(key: int, held: list[tuple[int, bytes]]) -> Iterator[tuple]:
        c = cut(held)
        texts = c.block.texts
        deals = deal(c.anchor, n)
        step = np.zeros(len(texts.data) + 1, dtype=np.int32)
        whole = np.zeros(len(c.first), dtype=bool)
        partly = [np.zeros((3, 0), dtype=np.int64)]
        for kind, payload in held:
            if kind > 0:
                whole[deals[kind - 1][unpack(payload)[0]]] = True
            elif kind < 0:
                entry, a, b = unpack(payload)
                partly.append(np.stack((deals[-kind - 1][entry], a, b)).astype(np.int64))
        entry, a, b = np.concatenate(partly, axis=1)
        # Runs hold for every occurrence of an entry, not only for the one that was sent.
        covers = np.zeros(len(c.first), dtype=bool)
        covers[entry[(a == 0) & (b == (c.high - c.low)[c.first[entry]])]] = True
        whole |= covers
        rest = ~whole[entry]
        base = c.low[c.first[entry[rest]]]
        runs = np.flatnonzero(whole[c.entry_of]) if len(c.entry_of) else np.zeros(0, dtype=np.int64)
        np.add.at(step, np.concatenate((c.low[runs], base + a[rest])), 1)
        np.add.at(step, np.concatenate((c.high[runs], base + b[rest])) + length, -1)
        yield c.block, np.cumsum(step[:-1]) > 0

    first = durable(per_key(per_row(blocks, index), lambda key, held: ((b, key + 1, p) for b, _, p in _compare(held))))
    sent = per_key(blocks.unionByName(first), send)
    second = per_key(sent, lambda key, held: ((b, -key - 1, p) for b, _, p in _sort_bucket(held, length)))
    return per_key(blocks.unionByName(first).unionByName(second), answer, RESULT, _result_batch)


def _result_batch(rows: list[tuple]) -> pa.RecordBatch:
    block, removed = rows[0]
    bounds = block.texts.bounds
    upto = np.concatenate(([0], np.cumsum(~removed)))[bounds]
    kept = pa.Array.from_buffers(pa.binary(), block.texts.n, [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(block.texts.data[~removed])])
    opens, closes = removed.copy(), removed.copy()
    opens[1:] &= ~removed[:-1]
    closes[:-1] &= ~removed[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(removed))]
    opens[cuts] |= removed[cuts]
    closes[cuts - 1] |= removed[cuts - 1]
    low, high = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = np.searchsorted(bounds, low, side="right") - 1
    fields = [pa.array((low - bounds[doc]).astype(np.int32)), pa.array((high - low).astype(np.int32))]
    offsets = np.searchsorted(doc, np.arange(block.texts.n + 1)).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length"]))
    return pa.RecordBatch.from_arrays(
        [pa.array(block.ids, mask=~block.known), pa.array(np.diff(bounds).astype(np.int64)), kept, spans], ["doc_id", "n_bytes", "kept_bytes", "spans"]
    )


def suffix_dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what :func:`repeated_spans` leaves of each document."""
    return repeated_spans(docs, length, hot=hot).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept_bytes")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )
