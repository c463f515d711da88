"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups of equal texts stay together. In the order of their digests, the smallest
feasible shard capacity is found by binary search: a capacity is feasible if greedy
filling needs no more than the allowed shards, and the cuts of that filling are the
result. Groups are not collected: the search runs on summaries of their ends, which
Spark makes finer only where a cut can lie.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordering import running_totals

from .common import durable, whole_text

SHARDS, CELLS = 16, 1 << 16


def _regions(spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(from, to, first cell, width) of each span of group ends that is to be seen more closely, CELLS in all at most."""
    width = max(1, -(-sum(b - a + 1 for a, b in spans) // (CELLS - len(spans))))
    out, cell = [], 0
    for a, b in spans:
        out.append((a, b, cell, width))
        cell += (b - a) // width + 1
    return out


def _summary(ends: DataFrame, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest group end of each filled cell of the spans, in order: one job, CELLS rows at most."""
    cell = F.lit(None).cast("long")
    for a, b, first, width in _regions(spans):
        cell = F.when((F.col("end") >= a) & (F.col("end") <= b), F.floor((F.col("end") - a) / width) + first).otherwise(cell)
    rows = ends.select("end", cell.alias("cell")).where("cell is not null").groupBy("cell").agg(F.min("end").alias("low"), F.max("end").alias("high")).toPandas()
    return np.sort(rows["low"].to_numpy()), np.sort(rows["high"].to_numpy())


class _Greedy:
    """Greedy filling over summarised group ends, with the least and the most that each shard can reach."""

    def __init__(self, low: np.ndarray, high: np.ndarray, total: int, shards: int):
        self.low, self.high, self.total, self.shards = low, high, total, shards

    def sure(self, x: int) -> int:
        """A group end at or under ``x`` that is known."""
        k = int(np.searchsorted(self.high, x, side="right"))
        own = int(self.low[k]) if k < len(self.low) and self.low[k] <= x else 0
        return max(own, int(self.high[k - 1]) if k else 0)

    def possible(self, x: int) -> int:
        """No group end at or under ``x`` lies beyond this."""
        k = int(np.searchsorted(self.low, x, side="right"))
        return min(x, int(self.high[k - 1])) if k else 0

    def ends(self, capacity: int, step) -> list[int]:
        at, out = 0, []
        for _ in range(self.shards):
            at = self.total if at + capacity >= self.total else step(at + capacity)
            out.append(at)
        return out

    def smallest(self, low: int, high: int, step) -> int:
        """Binary search of the smallest capacity whose filling reaches the end; ``high`` is feasible."""
        while low < high:
            middle = (low + high) // 2
            if self.ends(middle, step)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return high


def smallest_capacity(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the ends of the shards filled greedily with it.

    Binary search over capacities, each checked greedily, runs on a summary of the
    group ends: the smallest and largest end of each of CELLS cells. It gives bounds of
    the capacity and of every shard's end; only the spans between these bounds are
    summarised again, in cells some hundred times narrower, until each bound is one
    end. Rounds grow with the logarithm of the bytes (three at a gigabyte, five at 100 TB).
    """
    least, most = max(largest, -(-total // shards)), total
    spans = [(1, total)]
    while True:
        known = _Greedy(*_summary(ends, spans), total, shards)
        most = known.smallest(least, most, known.sure)
        least = known.smallest(least, most, known.possible)
        low, high = known.ends(least, known.sure), known.ends(most, known.possible)
        if least == most and low == high:
            return most, low
        spans = []
        for a, b in zip(low, high, strict=True):
            a = max(a, spans[-1][1] + 1) if spans else a
            if a <= b:
                spans.append((a, b))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: size is the UTF-8 length of the text plus 1, groups of equal texts
    (null counts as empty) are never split, and the largest shard is as small as a
    contiguous partition in digest order can make it. Slots count from 0 within a
    shard. With fewer groups than shards the last shards are empty; an empty table
    gives an empty result. Rows that repeat a doc_id each get a slot.
    """
    text = whole_text().cast("binary")
    rows = durable(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("group_key"),
        )
    )
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("group_rows"))
    placed = durable(running_totals(groups, ["group_key"], {"start": "group_size", "first_row": "group_rows"}).withColumn("end", F.col("start") + F.col("group_size")))
    top = placed.agg(F.max("end").alias("total"), F.max("group_size").alias("largest")).first()
    cuts = smallest_capacity(placed.select("end"), top.total, top.largest, shards)[1] if top.total else [0] * shards
    # The groups at which shards begin: at most one row a shard.
    begins = {r.start: r for r in placed.where(F.col("start").isin(sorted({0, *cuts}))).collect()}
    ends = [0, *cuts]
    marks = [(begins[ends[k]].group_key, begins[ends[k]].first_row, k) for k in range(shards) if ends[k + 1] > ends[k]]
    number, base = F.lit(0), F.lit(0).cast("long")
    for key, first_row, k in marks:
        number = F.when(F.col("group_key") >= key, k).otherwise(number)
        base = F.when(F.col("group_key") >= key, F.lit(first_row).cast("long")).otherwise(base)
    counted = running_totals(rows.withColumn("_one", F.lit(1)), ["group_key", "doc_id"], {"_row": "_one"})
    return counted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), number.cast("int").alias("shard"),
        (F.col("_row") - base).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
