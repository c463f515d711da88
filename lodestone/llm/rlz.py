"""Substring dedup by relative Lempel-Ziv parsing over words.

Every document is factored against all indexed reference blocks. The index holds, by
anchor, the first place of each context of windows (see :mod:`blocks`); windows whose
context is new but whose anchor is not are looked up one by one, so a factor's ends,
where it changes from one reference to another or to new text, are checked window by
window. Hits that run on along one reference make a factor; a factor of at least
``window`` words is a duplicate span, and its words go. "Earlier" is by doc_id, then
place; the index answers with the first place of all, so copies of copies point to
the original.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import HOT, Block, deal, first_of, hot_anchors, make_blocks, pack, per_key, per_row, split_hot, unpack
from .common import durable
from .textarrays import U64, anchors, byte_prefix, mix64, second_word_prefix, word_prefix

WINDOW, GRAM = 20, 10
_LAST = np.int64(2**63 - 1)


class _Parsed:
    """The words of a block, its windows' anchors, and its distinct entries (anchor, context) with their first places."""

    def __init__(self, block: Block, window: int, gram: int, hot: np.ndarray = np.zeros(0, dtype=U64)):
        self.block, self.window = block, window
        self.starts, self.ends, self.docs = block.texts.words()
        self.order_id = np.where(block.known, block.ids, _LAST)
        codes = byte_prefix(block.texts.data).of(self.starts, self.ends)
        self.prefix = word_prefix(codes)
        n = len(codes)
        self.first_word = np.searchsorted(self.docs, np.arange(block.texts.n))
        none = np.zeros(0, dtype=np.int64)
        self.place = self.low = self.high = none
        if n >= window:
            i = np.arange(n - gram + 1)
            grams = self.prefix.of(i, i + gram)
            valid = self.docs[: n - window + 1] == self.docs[window - 1 :]
            self.place, self.low, self.high = anchors(grams, valid, window - gram + 1)
            found = grams[self.place], self.place, self.low, self.high
            anchor, self.place, self.low, self.high = split_hot(hot, *found, lambda own: second_word_prefix(codes).of(own, own + window))
        else:
            anchor = np.zeros(0, dtype=U64)
        context = self.prefix.of(self.low, self.high + window) ^ mix64((self.place - self.low + 1).astype(U64))
        order, entry = self._in_order(anchor, context, self.low)
        head = first_of(entry)
        self.entry_of = np.empty(len(order), dtype=np.int64)
        self.entry_of[order] = entry
        self.first = order[head]  # the first occurrence of each entry
        self.anchor, self.context = anchor[self.first], context[self.first]

    def _in_order(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted by (a, b), then document order, then place; and the group of equal (a, b)."""
        order = np.lexsort((at, self.order_id[self.docs[at]] if len(at) else at, b, a))
        new = np.zeros(len(order), dtype=bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        return order, np.cumsum(new)

    def where(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order id of the document and place in it, of words of the block."""
        doc = self.docs[words]
        return self.order_id[doc], (words - self.first_word[doc]).astype(np.int32)

    def asked_windows(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of the entries' first occurrences: starts, group of equal ones, and first of each group."""
        runs = self.first[entries]
        lengths = self.high[runs] - self.low[runs] + 1
        starts = np.repeat(self.low[runs], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        hashes = self.prefix.of(starts, starts + self.window)
        order, group = self._in_order(hashes, np.zeros(len(hashes), dtype=U64), starts)
        return starts[order], group, hashes[order]


def _resolve(held: list[tuple[int, bytes]], two_keys: bool) -> Iterator[tuple[int, int, bytes]]:
    """A bucket's answers: for each block, which of its entries occur earlier and where, and which share only their anchor."""
    parts = [unpack(p) for _, p in held]
    sizes = [len(p[1]) for p in parts]
    block = np.repeat(np.array([p[0][0] for p in parts]), sizes)
    index = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
    a, b, doc, place = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
    order = np.lexsort((block, doc, b, a))
    a, b, doc, place, block, index = (x[order] for x in (a, b, doc, place, block, index))
    new_a = np.concatenate(([True], a[1:] != a[:-1]))
    new = new_a.copy()
    new[1:] |= b[1:] != b[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    anchor_no = np.cumsum(new_a) - 1
    several = (np.bincount(anchor_no, weights=new) > 1)[anchor_no] & new if two_keys else np.zeros(len(new), dtype=bool)
    chosen = np.flatnonzero(~new | several)
    chosen = chosen[np.argsort(block[chosen], kind="stable")]
    for own in np.split(chosen, first_of(block[chosen])[1:]) if len(chosen) else []:
        copies, ask = own[~new[own]], own[new[own]]
        yield int(block[own[0]]), 0, pack(index[copies], doc[head[copies]], place[head[copies]], index[ask])


def _answers(held: list[tuple[int, bytes]], sign: int, deals: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Entries that occur earlier, their sources, and entries to be asked about window by window."""
    got = [(deals[abs(kind) - 1], unpack(p)) for kind, p in held if kind * sign > 0]
    if not got:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in ([d[p[0]] for d, p in got], [p[1] for _, p in got], [p[2] for _, p in got], [d[p[3]] for d, p in got]))


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_words, kept_text, spans of (start, length, source_doc, source_start) in words.

    Spans are the factors of at least ``window`` words that occur earlier; they may
    overlap where the parse changes reference. Null and empty texts have no words and
    an empty kept text. A null doc_id comes after all others; rows that repeat a
    doc_id are documents of their own, in order of storage. An empty table gives an
    empty result; other columns are ignored.
    """
    blocks = make_blocks(docs)

    def contexts(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        p = _Parsed(Block(payload), window, gram)
        return p.anchor, p.context

    split, n = hot_anchors(blocks, contexts, hot)

    def parsed(held: list[tuple[int, bytes]]) -> _Parsed:
        return _Parsed(Block(next(p for kind, p in held if kind == 0)), window, gram, split)

    def index(key: int, kind: int, payload: bytes) -> Iterator[tuple[int, int, bytes]]:
        p = _Parsed(Block(payload), window, gram, split)
        doc, place = p.where(p.low[p.first])
        for bucket, own in enumerate(deal(p.anchor, n)):
            if len(own):
                yield bucket, 0, pack(np.array([key]), p.anchor[own], p.context[own], doc[own], place[own])

    def ask(key: int, held: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        p = parsed(held)
        entries = _answers(held, 1, deal(p.anchor, n))[3]
        if len(entries):
            starts, group, hashes = p.asked_windows(np.sort(entries))
            head = first_of(group)
            doc, place = p.where(starts[head])
            for bucket, own in enumerate(deal(hashes[head], n)):
                if len(own):
                    yield bucket, 0, pack(np.array([key]), hashes[head][own], np.zeros(len(own), dtype=U64), doc[own], place[own])

    def parse(key: int, held: list[tuple[int, bytes]]) -> Iterator[tuple]:
        p = parsed(held)
        copied, source_doc, source_place, entries = _answers(held, 1, deal(p.anchor, n))
        # Contexts: the source of an entry is the index's answer, or for later occurrences in this block its first one.
        own_doc, own_place = p.where(p.low[p.first])
        own_doc, own_place = own_doc.copy(), own_place.astype(np.int64)
        earlier = np.zeros(len(p.first), dtype=bool)
        earlier[copied], own_doc[copied], own_place[copied] = True, source_doc, source_place
        hit = earlier[p.entry_of] if len(p.entry_of) else np.zeros(0, dtype=bool)
        later = np.ones(len(p.low), dtype=bool)
        later[p.first] = False
        runs = np.flatnonzero(hit | later)
        low, high = p.low[runs], p.high[runs]
        from_doc, from_place = own_doc[p.entry_of[runs]], own_place[p.entry_of[runs]]
        # Windows that were asked about one by one.
        if len(entries):
            starts, group, hashes = p.asked_windows(np.sort(entries))
            head = first_of(group)
            doc, place = p.where(starts[head])
            doc, place, found = doc.copy(), place.astype(np.int64), np.zeros(len(head), dtype=bool)
            copied, source_doc, source_place, _ = _answers(held, -1, deal(hashes[head], n))
            found[copied], doc[copied], place[copied] = True, source_doc, source_place
            is_head = np.zeros(len(starts), dtype=bool)
            is_head[head] = True
            chosen = found[group] | ~is_head
            low, high = np.concatenate((low, starts[chosen])), np.concatenate((high, starts[chosen]))
            from_doc, from_place = np.concatenate((from_doc, doc[group][chosen])), np.concatenate((from_place, place[group][chosen]))
        yield from _documents(p, low, high, from_doc, from_place)

    entries = per_row(blocks, index)
    first = durable(per_key(entries, lambda key, held: ((b, key + 1, p) for b, _, p in _resolve(held, True))))
    asked = per_key(blocks.unionByName(first), ask)
    second = per_key(asked, lambda key, held: ((b, -key - 1, p) for b, _, p in _resolve(held, False)))
    return per_key(blocks.unionByName(first).unionByName(second), parse, SPANS, _span_batch)


SPANS = "doc_id long, n_words long, kept_text string, spans array<struct<start:int,length:int,source_doc:long,source_start:int>>"


def _documents(p: _Parsed, low: np.ndarray, high: np.ndarray, from_doc: np.ndarray, from_place: np.ndarray) -> Iterator[tuple]:
    """Factors from hits (runs of window starts with one source), then what is left of each document."""
    window, words, data = p.window, len(p.starts), p.block.texts.data
    order = np.argsort(low, kind="stable")
    low, high, from_doc, from_place = low[order], high[order], from_doc[order], from_place[order]
    # Greedy parse: a factor runs on while the next hit begins right behind on the same reference.
    begins = np.ones(len(low), dtype=bool)
    if len(low):
        begins[1:] = (low[1:] != high[:-1] + 1) | (p.docs[low[1:]] != p.docs[low[:-1]]) | (from_doc[1:] != from_doc[:-1])
        begins[1:] |= (from_place[1:] - from_place[:-1]) != (low[1:] - low[:-1])
    head = np.flatnonzero(begins)
    tail = np.append(head[1:], len(low)) - 1 if len(head) else head
    step = np.zeros(words + 1, dtype=np.int32)
    np.add.at(step, low[head], 1)
    np.add.at(step, high[tail] + window, -1)
    removed = np.cumsum(step[:-1]) > 0
    # Kept words and one space behind each but the last of its document.
    keep = np.flatnonzero(~removed)
    last = np.ones(len(keep), dtype=bool)
    last[:-1] = p.docs[keep[1:]] != p.docs[keep[:-1]]
    out = np.append(data, np.uint8(32))
    mask = np.zeros(len(data) + 2, dtype=np.int8)
    np.add.at(mask, p.starts[keep], 1)
    np.add.at(mask, p.ends[keep], -1)
    mask = np.cumsum(mask[:-1]).astype(bool)
    spaces = p.ends[keep[~last]]
    out[spaces] = 32
    mask[spaces] = True
    upto = np.concatenate(([0], np.cumsum(mask)))
    kept, bounds = out[mask[: len(out)]], upto[p.block.texts.bounds]
    span_doc = p.docs[low[head]]
    yield (
        p.block.ids, p.block.known, np.bincount(p.docs, minlength=p.block.texts.n), kept, bounds,
        np.searchsorted(span_doc, np.arange(p.block.texts.n + 1)), (low[head] - p.first_word[span_doc]).astype(np.int32),
        (high[tail] - low[head] + window).astype(np.int32), from_doc[head], from_place[head].astype(np.int32),
    )


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, known, n_words, kept, bounds, offsets, start, length, source_doc, source_start = rows[0]
    text = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(kept)])
    source = pa.array(source_doc, mask=source_doc == _LAST)
    fields = [pa.array(start), pa.array(length), source, pa.array(source_start)]
    spans = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "source_doc", "source_start"]))
    return pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(n_words.astype(np.int64)), text, spans], ["doc_id", "n_words", "kept_text", "spans"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_factors: what :func:`factors` leaves of each document."""
    kept = F.when(F.length("kept_text") == 0, 0).otherwise(F.length("kept_text") - F.length(F.translate("kept_text", " ", "")) + 1)
    return factors(docs, window, hot=hot).select(
        "doc_id", "n_words", (F.col("n_words") - kept).cast("long").alias("n_removed"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_factors"),
    )
