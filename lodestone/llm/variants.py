"""Spelling variant grouping with bidirectional FM-index search schemes.

Words are runs of letters of all texts, counted by Spark. Of two words that differ by
one code point, one half of either is found unchanged in the other, so the other word
begins with the first half or ends with the second. Each word therefore goes to one
shard by its first three code points and to one by its last three; no half is shorter.
A shard's words, sorted and delimited, are one text with a bidirectional FM-index.
A search matches a half exactly, outwards from the middle to the delimiter, and then
extends across the other half to the other delimiter, allowing one error. What is
left is an interval of one suffix, and as the words are sorted its rank says which
word it is. A large shard is cut into parts by a hash of the word, each with an index of
its own, and every word of the shard asks each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_arrow, shuffle_width

LEAST_LENGTH, LEAST_COUNT, FORM_TIMES, DELETE_EVERY = 7, 2, 10, 31
HALF = LEAST_LENGTH // 2
WORDS_A_SHARD, QUERIES_AT_ONCE = 30_000, 4_000
PREFIX, SUFFIX = 0, 1
END, DELIMITER = 0, 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; the last code is the smallest and occurs once."""
    rank = text.astype(np.int64)
    n, step = len(rank), 1
    while True:
        next_rank = np.zeros(n, dtype=np.int64)
        next_rank[:-step] = rank[step:] + 1
        key = rank * (n + 257) + next_rank
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        sorted_key = key[order]
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


class Ranks:
    """How often each code, and each smaller code, occurs before a place of a Burrows-Wheeler transform: counts every 64 places and bits between."""

    def __init__(self, text: np.ndarray, codes: int):
        order = suffix_array(text)
        last = text[order - 1]
        n = len(text)
        words = n // 64 + 1
        ones = np.zeros((codes, words * 64), dtype=np.uint8)
        ones[last, np.arange(n)] = 1
        less = np.cumsum(ones, axis=0, dtype=np.uint8) - ones
        self.bits, self.counts = self._tables(ones, words)
        self.less_bits, self.less_counts = self._tables(less, words)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=codes))))[:codes]

    @staticmethod
    def _tables(ones: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        bits = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).T.copy()
        counts = np.zeros((words + 1, ones.shape[0]), dtype=np.int32)
        np.cumsum(np.bitwise_count(bits), axis=0, dtype=np.int32, out=counts[1:])
        return bits, counts

    @staticmethod
    def _mask(at: np.ndarray) -> np.ndarray:
        return (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)

    def of(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.counts[word, code] + np.bitwise_count(self.bits[word, code] & self._mask(at)).astype(np.int64)

    def less(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.less_counts[word, code] + np.bitwise_count(self.less_bits[word, code] & self._mask(at)).astype(np.int64)

    def all(self, at: np.ndarray) -> np.ndarray:
        """Ranks of every code, a row a place."""
        word = at >> 6
        return self.counts[word] + np.bitwise_count(self.bits[word] & self._mask(at)[:, None]).astype(np.int64)


@dataclass
class State:
    """Intervals of matched strings: where they begin among the suffixes of the text and of its reverse, and how long they are."""

    low: np.ndarray
    back: np.ndarray
    size: np.ndarray

    def pick(self, rows: np.ndarray) -> State:
        return State(self.low[rows], self.back[rows], self.size[rows])


class Index:
    """A bidirectional FM-index over sorted, distinct words as bytes without 0 and 1."""

    def __init__(self, words: list[bytes]):
        body = np.frombuffer(b"\1" + b"".join(w + b"\1" for w in words), dtype=np.uint8)
        used = np.unique(body)
        self.codes = len(used) + 1  # END, DELIMITER and the letters in use
        self.table = np.full(256, -1, dtype=np.int64)
        self.table[used] = np.arange(1, len(used) + 1)
        text = self.table[body]
        self.left = Ranks(np.append(text, END), self.codes)
        self.right = Ranks(np.append(text[::-1], END), self.codes)
        self.length = len(text) + 1

    def everything(self, n: int) -> State:
        return State(np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, self.length, dtype=np.int64))

    def extend(self, state: State, code: np.ndarray, left: bool) -> State:
        """The matched strings with one code before (left) or behind; codes of -1 occur nowhere."""
        ranks, low, other = (self.left, state.low, state.back) if left else (self.right, state.back, state.low)
        known = np.maximum(code, 0)
        begin, end = ranks.of(known, low), ranks.of(known, low + state.size)
        size = np.where(code < 0, 0, end - begin)
        moved, held = ranks.first[known] + begin, other + ranks.less(known, low + state.size) - ranks.less(known, low)
        return State(moved, held, size) if left else State(held, moved, size)

    def branch(self, state: State, left: bool) -> tuple[np.ndarray, np.ndarray, State]:
        """Every letter that occurs next to the matched strings: state's row, code, extended state."""
        ranks, low, other = (self.left, state.low, state.back) if left else (self.right, state.back, state.low)
        begin = ranks.all(low)
        found = ranks.all(low + state.size) - begin
        row, code = np.nonzero(found[:, DELIMITER + 1 :])
        code += DELIMITER + 1
        less = np.cumsum(found, axis=1) - found
        moved, held = ranks.first[code] + begin[row, code], other[row] + less[row, code]
        size = found[row, code]
        return row, code, State(moved, held, size) if left else State(held, moved, size)

    def within_one_error(self, words: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word asked, place of the indexed word), each once: words with the half of this kind unchanged that differ by one code point.

        PREFIX matches the first half, SUFFIX the second and leaves out what also begins
        with the first half, which PREFIX finds.
        """
        left = kind == SUFFIX  # the way errors go
        n = len(words)
        length = np.array([len(w) for w in words], dtype=np.int64)
        half = length // 2
        exact = half if kind == PREFIX else length - half
        rest = length - exact
        data = self.table[np.frombuffer(b"".join(words), dtype=np.uint8)] if n else np.zeros(0, dtype=np.int64)
        start = np.cumsum(length) - length

        def inner(rows: np.ndarray, k: np.ndarray) -> np.ndarray:  # k-th code of the exact half, outwards from the middle
            return data[start[rows] + (half[rows] - 1 - k if kind == PREFIX else half[rows] + k)]

        def outer(rows: np.ndarray, k: np.ndarray) -> np.ndarray:  # k-th code of the other half; the delimiter behind it
            inside = k < rest[rows]
            place = start[rows] + (half[rows] + k if kind == PREFIX else half[rows] - 1 - k)
            return np.where(inside, data[np.where(inside, place, 0)], DELIMITER)

        rows, state = np.arange(n), self.everything(n)
        for k in range(int(exact.max(initial=0)) + 1):
            inside = np.full(len(rows), k) < exact[rows]
            over = k > exact[rows]
            code = np.where(inside, inner(rows, np.where(inside, k, 0)), DELIMITER)
            grown = self.extend(state, code, not left)
            state = State(*(np.where(over, old, new) for old, new in ((state.low, grown.low), (state.back, grown.back), (state.size, grown.size))))
            alive = np.flatnonzero(state.size > 0)
            rows, state = rows[alive], state.pick(alive)
        # One error at each place of the other half: a letter instead of the next, a letter more, or the next one left out.
        pools: list[tuple[np.ndarray, np.ndarray, State]] = []
        k = 0
        while len(rows):
            at = np.full(len(rows), k)
            code, inside = outer(rows, at), k < rest[rows]
            row, letter, grown = self.branch(state, left)
            other = letter != code[row]
            more = np.flatnonzero(other)
            instead = np.flatnonzero(other & inside[row])
            before = outer(rows, np.maximum(at - 1, 0))
            out = np.flatnonzero(inside & ((k == 0) | (before != code)))
            pools += [(rows[row[more]], np.full(len(more), k), grown.pick(more)), (rows[row[instead]], np.full(len(instead), k + 1), grown.pick(instead)), (rows[out], np.full(len(out), k + 1), state.pick(out))]
            grown = self.extend(state, code, left)
            alive = np.flatnonzero((grown.size > 0) & inside)
            rows, state = rows[alive], grown.pick(alive)
            k += 1
        found: list[np.ndarray] = [np.zeros((2, 0), dtype=np.int64)]
        if pools:
            rows, at = (np.concatenate([p[i] for p in pools]) for i in (0, 1))
            state = State(*(np.concatenate([getattr(p[2], f) for p in pools]) for f in ("low", "back", "size")))
            while len(rows):
                done = at == rest[rows]
                state = self.extend(state, outer(rows, at), left)
                hit = np.flatnonzero(done & (state.size > 0))
                found.append(np.stack((rows[hit], state.low[hit] - 2)))  # the end and the last delimiter come first
                alive = np.flatnonzero(~done & (state.size > 0))
                rows, at, state = rows[alive], at[alive] + 1, state.pick(alive)
        asked, place = np.unique(np.concatenate(found, axis=1), axis=1)
        return asked, place


def occurrences(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id and word of each run of at least ``least`` letters, A-Z lowered, with the deletions of the rule made.

    A run's hash is the CRC-32 of ``<doc_id>:<run>``; where DELETE_EVERY divides it, the
    code point at hash modulo length goes. Null texts have no runs; a null doc_id reads as
    ``null``.
    """
    lowered = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(lowered, F.lit(f"[a-zA-Z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    rows = rows.select("doc_id", "run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % DELETE_EVERY == 0, cut).otherwise(F.col("run"))
    return rows.select("doc_id", word.alias("word"))


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of at least ``least`` code points that occur ``count`` times in all texts."""
    words = occurrences(docs, least).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def _dealt(words: DataFrame, limit: int) -> DataFrame:
    """kind, shard, part, own, word, n: each word once in every part of its two shards; ``own`` marks the part that indexes it.

    A key of more than ``limit`` words has a shard of its own, cut into parts; the
    others share shards by a hash.
    """
    both = words.select("word", "n", F.explode(F.array(F.lit(PREFIX), F.lit(SUFFIX))).alias("kind"))
    key = F.when(F.col("kind") == PREFIX, F.substring("word", 1, HALF)).otherwise(F.substring("word", -HALF, HALF))
    both = both.withColumn("key", key)
    sizes = durable(both.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("words")))
    total = sizes.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-total // limit))
    parts: Column = F.greatest(F.lit(1), F.ceil(F.col("words") / limit)).cast("int")
    shard = F.when(parts > 1, F.concat_ws(":", "kind", "key")).otherwise(F.concat_ws("#", "kind", F.pmod(F.xxhash64("key"), F.lit(shards))))
    keyed = sizes.select("kind", "key", shard.alias("shard"), parts.alias("parts"))
    rows = both.join(keyed, ["kind", "key"])
    rows = rows.select("kind", "shard", "word", "n", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("home"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return rows.select("kind", "shard", "part", (F.col("part") == F.col("home")).alias("own"), "word", "n")


def _asked(index: Index, held: list[bytes], counts: np.ndarray, kind: int, words: list[bytes]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(words), QUERIES_AT_ONCE):
        some = words[i : i + QUERIES_AT_ONCE]
        asked, place = index.within_one_error(some, kind)
        if kind == SUFFIX and len(asked):
            keep = np.array([not held[p].startswith(some[a][: len(some[a]) // 2]) for a, p in zip(asked.tolist(), place.tolist(), strict=True)])
            asked, place = asked[keep], place[keep]
        if not len(asked):
            continue
        order = np.lexsort((place, -counts[place], asked))  # the largest count first, then the least word
        asked, place = asked[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], asked[1:] != asked[:-1])))
        near = np.diff(np.append(first, len(asked)))
        text = lambda b: b.decode("latin-1")
        yield pa.RecordBatch.from_arrays(
            [pa.array([text(some[a]) for a in asked[first].tolist()], pa.string()), pa.array(near.astype(np.int64)), pa.array(counts[place[first]]), pa.array([text(held[p]) for p in place[first].tolist()], pa.string())],
            ["word", "n_near", "best_n", "best"],
        )


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part, those to index first; the index of one part is held at a time."""
    at, entries, index, held, counts = None, [], None, [], np.zeros(0, dtype=np.int64)

    def built() -> None:
        nonlocal index, held, counts
        entries.sort()
        held, counts = [w for w, _ in entries], np.array([n for _, n in entries], dtype=np.int64)
        index = Index(held)

    for batch in batches:
        kinds, shards, parts, own, words, n = (batch.column(c).to_pylist() for c in ("kind", "shard", "part", "own", "word", "n"))
        i = 0
        while i < len(kinds):
            j, key = i, (kinds[i], shards[i], parts[i], own[i])
            while j < len(kinds) and (kinds[j], shards[j], parts[j], own[j]) == key:
                j += 1
            block = [w.encode("latin-1") for w in words[i:j]]
            if key[:3] != at:
                if entries and index is None:
                    built()
                    yield from _asked(index, held, counts, at[0], held)
                at, entries, index = key[:3], [], None
            if key[3]:
                entries.extend(zip(block, n[i:j], strict=True))
            elif entries:
                if index is None:
                    built()
                    yield from _asked(index, held, counts, at[0], held)
                yield from _asked(index, held, counts, at[0], block)
            i = j
    if entries and index is None:
        built()
        yield from _asked(index, held, counts, at[0], held)


def neighbours(words: DataFrame, limit: int = WORDS_A_SHARD) -> DataFrame:
    """word, n_near, best_n, best: for each word (word, n; distinct) with a near one, how many are near, and the most frequent of them (ties: the least word)."""
    # One shard or more a task, whatever Spark would join: the work is in the search, not in the bytes.
    dealt = _dealt(words, limit)
    dealt = dealt.repartition(shuffle_width(words.sparkSession), "shard", "part").sortWithinPartitions("shard", "part", F.desc("own"))
    found = map_arrow(dealt, _search, "word string, n_near long, best_n long, best string")
    lead = F.struct((-F.col("best_n")).alias("m"), "best")
    per = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(lead).alias("b"))
    return per.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last. Counts rise tenfold a step, so there is no circle; each round doubles the steps taken."""
    reached = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        reached = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return reached


def spelling_variants(docs: DataFrame, limit: int = WORDS_A_SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word that counts.

    Two words are near if one inserted, deleted or replaced code point makes one of the
    other. A word's form is its near word of largest count (ties: the least in code-point
    order) if that is FORM_TIMES the word's count at least; its root is the last of its
    forms, itself if there is none. Null, empty and letterless texts add nothing; rows
    that repeat count again; an empty table gives an empty result; other columns are
    ignored.
    """
    words = durable(vocabulary(docs))
    near = durable(neighbours(words, limit))
    joined = words.join(near, "word", "left")
    is_form = F.col("best_n") >= F.col("n") * FORM_TIMES
    rows = durable(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
