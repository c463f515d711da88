"""Segmented scans: running values within a key where no task gets a whole key.

Rows are dealt in ranges of (key, order), so a key with a third of all rows lies in many
partitions. The rows of one key in one partition are a segment. Windows run inside
segments; what a segment passes on (a sum, a maximum, its last row) is one small row,
and only segments of keys that run on over the end of a partition have one: two a
partition at most. Frames of a bounded number of rows get copies of the rows before
their segment.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import durable, shuffle_width


@dataclass(frozen=True)
class Step:
    """A running value: inside a segment, of a whole segment, over the segments before (or behind), and both together."""

    inside: Callable
    whole: Callable
    carried: Callable
    put: Callable
    behind: bool = False


def total(x: Column) -> Step:
    """The sum of ``x`` up to this row; null before the first value."""
    return Step(lambda upto, _: F.sum(x).over(upto), lambda _: F.sum(x), lambda c, w: F.sum(c).over(w), lambda c, i: F.coalesce(c + i, c, i))


def row_number() -> Step:
    return total(F.lit(1).cast("long"))


def highest(x: Column) -> Step:
    """The largest ``x`` up to this row."""
    return Step(lambda upto, _: F.max(x).over(upto), lambda _: F.max(x), lambda c, w: F.max(c).over(w), lambda c, i: F.greatest(c, i))


def last_known(x: Column) -> Step:
    """The last ``x`` up to this row that is not null."""
    whole = lambda order: F.max_by(x, F.when(x.isNotNull(), order))
    return Step(lambda upto, _: F.last(x, ignorenulls=True).over(upto), whole, lambda c, w: F.last(c, ignorenulls=True).over(w), lambda c, i: F.coalesce(i, c))


def previous(x: Column) -> Step:
    """``x`` of the key's row before this one; null on the first."""
    row = F.struct(x.alias("v"))
    return Step(lambda _, order: F.lag(row).over(order), lambda order: F.max_by(row, order), lambda c, w: F.last(c, ignorenulls=True).over(w), lambda c, i: F.coalesce(i, c)["v"])


def following(x: Column) -> Step:
    """``x`` of the key's next row; null on the last."""
    row = F.struct(x.alias("v"))
    return Step(lambda _, order: F.lead(row).over(order), lambda order: F.min_by(row, order), lambda c, w: F.first(c, ignorenulls=True).over(w), lambda c, i: F.coalesce(i, c)["v"], behind=True)


_PART, _ENDS, _ROWS = "_part", ("_low", "_high"), "_rows"


@dataclass(frozen=True)
class Segments:
    """Rows dealt by key and order (``_part``), and the segments of keys in several partitions (``split``: _part, keys, _rows)."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    split: DataFrame

    @staticmethod
    def of(df: DataFrame, keys: list[str], order: list[str]) -> Segments:
        """Nulls in keys and order come first. Equal (key, order) stay together, so the order should tell rows apart."""
        dealt = df.repartitionByRange(shuffle_width(df.sparkSession), *keys, *order).withColumn(_PART, F.spark_partition_id())
        dealt = durable(dealt)  # partition numbers stand, whatever executors are lost
        key = F.struct(*keys)
        ends = dealt.groupBy(_PART).agg(F.min(key).alias(_ENDS[0]), F.max(key).alias(_ENDS[1]))
        ends = ends.select(_PART, F.explode(F.array(*_ENDS)).alias("_key")).distinct()
        more = ends.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
        split = ends.join(more, "_key", "left_semi").select(_PART, "_key.*")
        counted = _matched(dealt, split, keys, "left_semi").groupBy(_PART, *keys).agg(F.count(F.lit(1)).alias(_ROWS))
        return Segments(dealt, keys, order, durable(counted))

    def _windows(self) -> tuple:
        order = Window.partitionBy(_PART, *self.keys).orderBy(*self.order)
        return order.rowsBetween(Window.unboundedPreceding, 0), order

    def _held(self) -> DataFrame:
        """The rows of segments that do not hold their key whole."""
        return _matched(self.rows, self.split.drop(_ROWS), self.keys, "left_semi")

    def add(self, **steps: Step) -> Segments:
        """Adds a column for each step."""
        upto, order = self._windows()
        at = F.struct(*self.order)
        names = {n: f"_carry_{n}" for n in steps}
        held = self._held()
        wholes = held.groupBy(_PART, *self.keys).agg(*[s.whole(at).alias(names[n]) for n, s in steps.items()])
        along = Window.partitionBy(*self.keys).orderBy(_PART)
        before, behind = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
        carry = wholes.select(_PART, *self.keys, *[s.carried(F.col(names[n]), behind if s.behind else before).alias(names[n]) for n, s in steps.items()])
        inner = {n: f"_inside_{n}" for n in steps}
        rows = self.rows.withColumns({inner[n]: s.inside(upto, order) for n, s in steps.items()})
        joined = _matched(rows, carry, self.keys, "left")
        return replace(self, rows=joined.select(*self.rows.columns, *[s.put(F.col(names[n]), F.col(inner[n])).alias(n) for n, s in steps.items()]))

    def with_columns(self, **columns: Column) -> Segments:
        return replace(self, rows=self.rows.withColumns(columns))

    def frame(self, size: int, **columns: Callable) -> Segments:
        """Adds columns over the last ``size`` rows of the key, this one included: each a function of the window.

        The ``size - 1`` rows before a segment are copied to it, from as many segments as it takes.
        """
        need = size - 1
        along = Window.partitionBy(*self.keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, 0)
        runs = self.split.withColumn("_upto", F.sum(_ROWS).over(along))
        # A segment ends ``_begin - _upto`` rows before the one that begins after ``_begin`` rows; under ``need`` of them, so it lies in the same stretch or the one before.
        later = runs.select(F.col(_PART).alias("_to"), *self.keys, (F.col("_upto") - F.col(_ROWS)).alias("_begin"))
        later = later.withColumn("_stretch", F.explode(F.array(F.floor(F.col("_begin") / size), F.floor(F.col("_begin") / size) - 1)))
        earlier = runs.withColumn("_stretch", F.floor(F.col("_upto") / size))
        a, b = earlier.alias("a"), later.alias("b")
        meets = (F.col("a._stretch") == F.col("b._stretch")) & (F.col("a._upto") <= F.col("b._begin")) & (F.col("b._begin") - F.col("a._upto") < need) & (F.col(f"a.{_PART}") < F.col("b._to"))
        for k in self.keys:
            meets = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) & meets
        sent = a.join(b, meets).select(f"a.{_PART}", *[f"a.{k}" for k in self.keys], "_to", (need - F.col("_begin") + F.col("_upto")).alias("_need"))
        from_end = F.row_number().over(Window.partitionBy(_PART, *self.keys).orderBy(*[F.col(c).desc() for c in self.order]))
        tails = self._held().withColumn("_from_end", from_end).where(F.col("_from_end") <= need)
        copies = _matched(tails, sent, self.keys).where(F.col("_from_end") <= F.col("_need"))
        copies = copies.select(*[F.col("_to").alias(_PART) if c == _PART else c for c in self.rows.columns], F.lit(True).alias("_copied"))
        both = self.rows.withColumn("_copied", F.lit(False)).unionByName(copies)
        last = self._windows()[1].rowsBetween(-need, 0)
        framed = both.withColumns({n: c(last) for n, c in columns.items()})
        return replace(self, rows=framed.where(~F.col("_copied")).drop("_copied"))

    def result(self) -> DataFrame:
        return self.rows.drop(_PART)


def _matched(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with a small side (two rows a partition at most) of the same partition and key."""
    names = [_PART, *keys]
    small = small.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(names)], *[c for c in small.columns if c not in names])
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    joined = rows.join(F.broadcast(small), same, how)
    return joined if how == "left_semi" else joined.drop(*[f"_s{i}" for i in range(len(names))])
