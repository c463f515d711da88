"""Temporal tables: intervals from histories, as-of lookups, latest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans
from .scans import Segments


def to_intervals(history: DataFrame, keys: list[str], start: str, *tie: str) -> DataFrame:
    """Adds ``valid_from`` and ``valid_to`` (the key's next start; null while in force): half-open intervals."""
    rows = Segments.of(history, keys, [start, *tie]).add(_next=scans.following(F.col(start)))
    return rows.with_columns(valid_from=F.col(start), valid_to=F.col("_next")).result().drop("_next")


def inclusive_to_half_open(df: DataFrame, end: str) -> DataFrame:
    """Inclusive end dates become the day after, so that the last day of an old row still matches."""
    return df.withColumn(end, F.date_add(F.col(end), 1))


def valid_at(day: Column, start: str = "valid_from", end: str = "valid_to", closed: bool = False) -> Column:
    """start <= day < end, or <= end if closed; a null end is open."""
    e = F.col(end)
    return (F.col(start) <= day) & (e.isNull() | ((e >= day) if closed else (e > day)))


def in_force(end: str = "valid_to") -> Column:
    """Rows without an end: what a lookup without a date means."""
    return F.col(end).isNull()


def version_join(probes: DataFrame, versions: DataFrame, keys: list[str], time: str, closed: bool = False) -> DataFrame:
    """The versions (:func:`to_intervals`) of the key that hold at the probe's time, by :func:`as_of` instead of pairs.

    At most one version of a key holds at a time, and it is the last one that begins
    by then. With closed ends a version that ends at the very time holds too: these
    meet their probes in an equi-join on key and end.
    """
    rest = [c for c in versions.columns if c not in keys]
    carry = [*[c for c in rest if c not in ("valid_from", "valid_to")], "valid_from", "valid_to"]
    found = as_of(probes, versions, keys, time, "valid_from", carry)
    found = found.where(F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col(time))))
    if closed:
        p, v = probes.alias("p"), versions.alias("v")
        same = F.col(f"p.{time}") == F.col("v.valid_to")
        for k in keys:
            same = (F.col(f"p.{k}") == F.col(f"v.{k}")) & same
        found = found.unionByName(p.join(v, same & (F.col("v.valid_from") <= F.col(f"p.{time}"))).select("p.*", *[F.col(f"v.{c}") for c in carry]))
    return found.select(*probes.columns, *rest)


def as_of(probes: DataFrame, history: DataFrame, keys: list[str], time: str, since: str, carry: list[str]) -> DataFrame:
    """For each probe the carried columns of the key's last history row at or before its time, null if none.

    Both sides go through one order (union, then the last row that is not null, by a
    segmented scan), so a key with a long history costs no pairs and a hot key no large
    task. Among history rows of one time the last in order of the carried columns counts.
    """
    h = history.select(*keys, F.col(since).alias("_at"), F.lit(0).alias("_side"), F.struct(*carry).alias("_row"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in probes.columns if c not in keys])
    p = probes.select(*keys, F.col(time).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(h.schema["_row"].dataType).alias("_row"), *[c for c in probes.columns if c not in keys])
    # Probes of one time are spread by a hash of their columns; that order does not matter to the result.
    both = h.unionByName(p).withColumn("_spread", F.xxhash64(*probes.columns))
    rows = Segments.of(both, keys, ["_at", "_side", "_row", "_spread"]).add(_last=scans.last_known(F.col("_row"))).result().where("_side = 1")
    return rows.select(*probes.columns, *[F.col(f"_last.{c}").alias(c) for c in carry])


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key: a max over structs, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def gaps(spans: DataFrame, bounds: DataFrame, keys: list[str], start: str, end: str, low: str, high: str) -> DataFrame:
    """keys, gap_start, gap_end: the parts of each key's own bounds [low, high) that no span covers.

    What lies before the first span and behind the last counts, and a key without spans
    is one gap; spans may overlap, and reach over the bounds. Empty gaps do not count.
    """
    s = spans.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.lit(1).alias("_kind"))
    b = bounds.select(*keys, F.col(low).alias("_s"), F.col(low).alias("_e"), F.lit(0).alias("_kind"))
    t = bounds.select(*keys, F.col(high).alias("_s"), F.col(high).alias("_e"), F.lit(2).alias("_kind"))
    rows = Segments.of(s.unionByName(b).unionByName(t), keys, ["_s", "_kind", "_e"])
    edge = lambda kind, c: scans.highest(F.when(F.col("_kind") == kind, F.col(c)))
    rows = rows.add(_reach=scans.highest(F.when(F.col("_kind") != 2, F.col("_e"))), _low=edge(0, "_s"), _over=edge(2, "_s"))
    rows = rows.add(_before=scans.previous(F.col("_reach")), _done=scans.previous(F.col("_over"))).result()
    found = rows.where(F.col("_low").isNotNull() & F.col("_done").isNull() & (F.col("_s") > F.col("_before")))
    return found.select(*keys, F.greatest("_before", "_low").alias("gap_start"), F.col("_s").alias("gap_end")).where(F.col("gap_start") < F.col("gap_end"))


def merged(df: DataFrame, keys: list[str], start: str, end: str, *carry: str) -> DataFrame:
    """Overlapping and touching intervals of a key as one: keys, merged_start, merged_end, n_merged, and the carried columns of the first one (by start, then end)."""
    rows = Segments.of(df, keys, [start, end, *carry]).add(_reach=scans.highest(F.col(end))).add(_before=scans.previous(F.col("_reach")))
    rows = rows.with_columns(_new=F.when(F.col("_before") >= F.col(start), 0).otherwise(1)).add(_island=scans.total(F.col("_new"))).result()
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias("merged_start"), F.max(end).alias("merged_end"), F.count(F.lit(1)).alias("n_merged"), *[F.min_by(c, F.struct(start, end, c)).alias(c) for c in carry]).drop("_island")
