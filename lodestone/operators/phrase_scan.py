"""Phrases of a counted table in slices of texts, inside tasks: a trie over token numbers, and scans from the left for all topics at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice (or one longer document), and pairs of a hit and a topic that are held at once (or one topic's).
SLICE_BYTES, PAIRS_AT_ONCE = 1 << 19, 1 << 20
_LENGTHS = 16  # more than a phrase's most tokens


@dataclass(frozen=True)
class PhraseTable:
    """Words and a trie over their numbers; topics of each phrase, sorted by phrase."""

    words: list[str]
    keys: np.ndarray  # node * number of words + word, sorted
    child: np.ndarray
    phrase_of: np.ndarray  # of each node, -1 if none ends there
    topics: list[str]
    entry_phrase: np.ndarray
    entry_topic: np.ndarray
    entry_place: np.ndarray
    longest: int

    @staticmethod
    def of(rows: list[tuple[str, str, int]]) -> PhraseTable:
        """From (topic, phrase as tokens with blanks between, place), each topic and phrase once."""
        phrases, topics = sorted({g for _, g, _ in rows}), sorted({t for t, _, _ in rows})
        words = sorted({w for g in phrases for w in g.split(" ")})
        number, nodes, ends = {w: k for k, w in enumerate(words)}, {}, []
        for gram in phrases:
            node = 0
            for w in gram.split(" "):
                node = nodes.setdefault((node, number[w]), len(nodes) + 1)
            ends.append(node)
        keys = np.array([a * len(words) + b for a, b in nodes], dtype=np.int64)
        order = np.argsort(keys)
        phrase_of = np.full(len(nodes) + 1, -1, dtype=np.int64)
        phrase_of[ends] = np.arange(len(phrases))
        of_phrase, of_topic = {g: k for k, g in enumerate(phrases)}, {t: k for k, t in enumerate(topics)}
        entries = np.array(sorted((of_phrase[g], of_topic[t], place) for t, g, place in rows), dtype=np.int64)
        return PhraseTable(words, keys[order], np.array(list(nodes.values()), dtype=np.int64)[order], phrase_of, topics, *entries.T, max(g.count(" ") for g in phrases) + 1)

    def hits(self, words: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, phrase and length of every occurrence; ``end`` is where each token's document ends. All lengths of a place follow each other."""
        live, node, found = np.arange(len(words)), np.zeros(len(words), dtype=np.int64), []
        for k in range(self.longest):
            word = words[np.minimum(live + k, len(words) - 1)]
            key = node * len(self.words) + word
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = (live + k < end[live]) & (word >= 0) & (self.keys[at] == key)
            live, node = live[on], self.child[at[on]]
            phrase = self.phrase_of[node]
            found.append((live[phrase >= 0], phrase[phrase >= 0], np.full((phrase >= 0).sum(), k + 1)))
        at, phrase, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], phrase[order], n[order]

    def parts(self, phrase: np.ndarray) -> Iterator[np.ndarray]:
        """Masks of entries that share out the topics, each of a bounded number of hits."""
        times = np.bincount(phrase, minlength=self.entry_phrase[-1] + 1)[self.entry_phrase]
        upto = np.cumsum(np.bincount(self.entry_topic, weights=times, minlength=len(self.topics)))
        part = (upto // PAIRS_AT_ONCE)[self.entry_topic]
        for p in np.unique(part):
            yield part == p

    def scores(self, words: np.ndarray, doc: np.ndarray, end: np.ndarray, docs: int, given: np.ndarray | None, category: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, topic and number of distinct phrases, by document: of each topic's hits those that a scan from the left takes."""
        at, phrase, n = self.hits(words, end) if len(words) else (np.zeros(0, dtype=np.int64),) * 3
        found = [(np.zeros(0, dtype=np.int64),) * 3]
        for mask in self.parts(phrase) if len(at) else ():
            found.append(self._taken(at, phrase, n, doc, docs, mask, given, category))
        d, t, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(d, kind="stable")
        return d[order], t[order], score[order]

    def _taken(self, at, phrase, n, doc, docs, mask, given, category):
        entry_phrase, entry_topic, entry_place = self.entry_phrase[mask], self.entry_topic[mask], self.entry_place[mask]
        begin = np.searchsorted(entry_phrase, phrase)
        times = np.searchsorted(entry_phrase, phrase, side="right") - begin
        hit = np.repeat(np.arange(len(at)), times)
        entry = np.arange(len(hit)) + np.repeat(begin - np.cumsum(times) + times, times)
        if given is not None:
            own = given[doc[at[hit]]]
            keep = (own < 0) | (own == category[entry_topic[entry]])
            hit, entry = hit[keep], entry[keep]
        if not len(hit):
            return (np.zeros(0, dtype=np.int64),) * 3
        # Places of one topic after those of another; of the hits at one place the first by (place in the table, length) stands for all.
        spot = entry_topic[entry] * (len(doc) + _LENGTHS) + at[hit]
        order = np.lexsort((entry_place[entry] * _LENGTHS + n[hit], spot))
        spot, hit, entry = spot[order], hit[order], entry[order]
        first = np.concatenate(([True], spot[1:] != spot[:-1]))
        spot, hit, entry = spot[first], hit[first], entry[first]
        upto = spot + n[hit]
        # A hit that begins behind all before it is taken; from there on each taken hit leads to the first that begins behind it.
        free = np.concatenate(([True], spot[1:] >= np.maximum.accumulate(upto)[:-1]))
        after = np.arange(1, len(spot) + 1)
        for _ in range(self.longest - 1):
            inside = (after < len(spot)) & (spot[np.minimum(after, len(spot) - 1)] < upto)
            if not inside.any():
                break
            after += inside
        taken, now = free.copy(), np.flatnonzero(free)
        while len(now):
            now = after[now]
            now = now[now < len(spot)]
            now = now[~free[now]]
            taken[now] = True
        row = doc[at[hit[taken]]] * len(self.topics) + entry_topic[entry[taken]]
        kinds = len(self.phrase_of)
        rows, score = np.unique(np.unique(row * kinds + phrase[hit[taken]]) // kinds, return_counts=True)
        return rows // len(self.topics), rows % len(self.topics), score


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    begin = 0
    while begin < len(sizes):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def scanner(held, by_category: bool, best: bool):
    """Over (_id, _words: tokens with blanks between, _given) rows (id, topic, score), or with ``best`` one row a document with a topic: id, primary_topic, n_topics, scores.

    ``held`` is a broadcast variable with a :class:`PhraseTable`.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        words, topics = pa.array(table.words, pa.string()), pa.array(table.topics, pa.string())
        own = pa.array([t.split(":", 1)[0] for t in table.topics], pa.string())
        kinds = pc.unique(own)
        category = pc.index_in(own, value_set=kinds).to_numpy(zero_copy_only=False).astype(np.int64)
        by_name = sorted(range(len(table.topics)), key=lambda k: (len(table.topics[k]), table.topics[k]))
        name_rank = np.empty(len(by_name), dtype=np.int64)
        name_rank[by_name] = np.arange(len(by_name))
        for batch in batches:
            for rows in _slices(batch, "_words"):
                lists = pc.split_pattern(pc.fill_null(rows.column("_words"), ""), " ")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                numbers = pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc, end = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes), sizes)
                given = None
                if by_category:
                    # -1: none given; a category without topics meets none.
                    known = pc.fill_null(pc.index_in(rows.column("_given"), value_set=kinds), len(kinds))
                    given = np.where(rows.column("_given").is_null().to_numpy(zero_copy_only=False), -1, known.to_numpy(zero_copy_only=False))
                d, t, score = table.scores(numbers, doc, end, len(sizes), given, category)
                if best:
                    order = np.lexsort((name_rank[t], -score, d))
                    d, t, score = d[order], t[order], score[order]
                    at = np.flatnonzero(np.concatenate((np.ones(min(len(d), 1), dtype=bool), d[1:] != d[:-1])))
                    n = np.diff(np.append(at, len(d)))
                    sums = np.add.reduceat(score, at) if len(at) else score
                    yield pa.RecordBatch.from_arrays([rows.column("_id").take(pa.array(d[at])), topics.take(pa.array(t[at])), pa.array(n, pa.int64()), pa.array(sums, pa.int64())], ["_id", "primary_topic", "n_topics", "scores"])
                else:
                    yield pa.RecordBatch.from_arrays([rows.column("_id").take(pa.array(d)), topics.take(pa.array(t)), pa.array(score, pa.int64())], ["_id", "topic", "score"])

    return apply
