"""Sampling and quotas. "Random" is order by a hash of seed and id, so draws can be repeated."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.identifiers import shuffle_key
from lodestone.operators.ordering import kth_smallest
from lodestone.session import durable


def clamped_quotas(df: DataFrame, group: str, target: int, low: float = 0.05, high: float = 0.40) -> DataFrame:
    """group, n, share, quota: shares clamped to [low, high], renormalised, times the target. One row a group is windowed."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(every))
    clamped = F.least(F.lit(high), F.greatest(F.lit(low), F.col("share")))
    counts = counts.withColumn("_clamped", clamped)
    return counts.withColumn("quota", F.bround(F.col("_clamped") * target / F.sum("_clamped").over(every)).cast("long")).drop("_clamped")


def proportional_quotas(df: DataFrame, group: str, target: int) -> DataFrame:
    """group, n, quota: proportional, largest group first; the last takes what is left, none more than it has."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), group)
    counts = counts.withColumn("_part", F.bround(F.col("n") * target / F.sum("n").over(every)).cast("long"))
    before = F.coalesce(F.sum("_part").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.row_number().over(order) == F.count(F.lit(1)).over(every)
    quota = F.when(last, F.lit(target) - before).otherwise(F.col("_part"))
    return counts.select(group, "n", F.greatest(F.lit(0), F.least(F.col("n"), quota)).alias("quota"))


def pick(df: DataFrame, group: list[str], quotas: DataFrame | int, order: list[Column], most: int | None = None) -> DataFrame:
    """The first rows of each group, as many as its quota.

    No quota is over ``most``; that bound cuts each task's rows of a group before they
    are dealt, so a hot group is not sorted in one task.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    rows = df.withColumn("_n", F.row_number().over(w))
    if isinstance(quotas, int):
        return rows.where(F.col("_n") <= quotas).drop("_n")
    if most is not None:
        rows = rows.where(F.col("_n") <= most)
    return rows.join(quotas.select(*group, F.col("quota").alias("_quota")), group).where(F.col("_n") <= F.col("_quota")).drop("_n", "_quota")


def filled_pick(df: DataFrame, group: str, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """The first rows of each group, as many as its quota; what groups lack is filled up with the other rows in order.

    All picks are among the first rows of the groups, as many as all quotas together, and
    only these are ranked. Rows of other groups are not first picks but can fill up.
    """
    target = sum(quotas.values())
    inner = Window.partitionBy(group).orderBy(*order)
    rows = df.withColumn("_n", F.row_number().over(inner)).where(F.col("_n") <= target)
    quota = F.coalesce(*[F.when(F.col(group) == k, F.lit(v)) for k, v in quotas.items()], F.lit(0))
    outer = Window.partitionBy(F.lit(1)).orderBy(F.desc("_first"), *order)
    rows = rows.withColumn("_first", F.col("_n") <= quota).withColumn("_at", F.row_number().over(outer))
    return rows.where(F.col("_at") <= target).drop("_n", "_first", "_at")


def two_way_pick(df: DataFrame, group: str, kind: str, shares: dict[str, float], quotas: DataFrame, seed: int, key: str, most: int, unit: str | None = None) -> DataFrame:
    """A group's quota split by kind; what a kind lacks is topped up with the group's other rows in hash order.

    No quota is over ``most``: a row behind so many of its group and kind is never
    taken. With ``unit``, one row of each unit takes part (its first in hash order).
    """
    if unit is not None:
        rest = [c for c in df.columns if c != unit]
        first = df.groupBy(unit).agg(F.min_by(F.struct(*rest), F.struct(shuffle_key(seed, F.col(key)), key)).alias("_row"))
        df = first.select(unit, *[F.col(f"_row.{c}").alias(c) for c in rest])
    share = F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in shares.items()], F.lit(0.0))
    rows = df.join(quotas.select(group, F.col("quota").alias("_quota")), group).withColumn("_key", shuffle_key(seed, F.col(key)))
    inner = Window.partitionBy(group, kind).orderBy("_key", key)
    rows = rows.withColumn("_n", F.row_number().over(inner)).where(F.col("_n") <= most)
    rows = rows.withColumn("_first", F.col("_n") <= F.bround(F.col("_quota") * share))
    outer = Window.partitionBy(group).orderBy(F.desc("_first"), "_key", key)
    return rows.withColumn("_at", F.row_number().over(outer)).where(F.col("_at") <= F.col("_quota")).drop("_quota", "_key", "_first", "_at", "_n")


def share_of(count: int, share: float) -> int:
    """The nearest whole number to a share of a count, halves up, in decimals (0.05 of 1,010 is 51); one at least."""
    return max(1, int((count * Decimal(str(share))).quantize(Decimal(1), ROUND_HALF_UP)))


def split_by_key(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Adds ``split``: the first share of distinct keys (to the nearest whole number, halves up; at least one) in hash order is ``val``, so no key is on both sides.

    The cut is a threshold on the hash, found by histograms of its digits over the distinct keys.
    """
    keys = durable(df.select(key).distinct().select(shuffle_key(seed, F.col(key)).alias("_h")))
    cut = kth_smallest(keys, "_h", share_of(keys.count(), share))
    return df.withColumn("split", F.when(shuffle_key(seed, F.col(key)) <= F.lit(cut), "val").otherwise("train"))


def floored_quotas(df: DataFrame, group: str, target: int, floor: int, spare: str | None = None) -> DataFrame:
    """group, n, quota: ``floor`` rows each as far as there are, the rest of the target in proportion to what is left.

    What rounding leaves over or lacks goes to the group ``spare``, within its rows. One row a group is windowed.
    """
    every = Window.partitionBy(F.lit(1))
    rows = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("_base", F.least(F.lit(floor), F.col("n")))
    rows = rows.withColumn("_left", F.col("n") - F.col("_base"))
    rest = F.greatest(F.lit(target) - F.sum("_base").over(every), F.lit(0))
    more = F.least(F.bround(rest * F.col("_left") / F.nullif(F.sum("_left").over(every), F.lit(0))).cast("long"), F.col("_left"))
    rows = rows.withColumn("quota", F.col("_base") + F.coalesce(more, F.lit(0)))
    lacking = F.lit(target) - F.sum("quota").over(every)
    if spare is not None:
        rows = rows.withColumn("quota", F.when(F.col(group) == spare, F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") + lacking))).otherwise(F.col("quota")))
    return rows.select(group, "n", "quota")


def distinct_pick(df: DataFrame, group: str, quotas: DataFrame, order: list[Column], text: Column, target: int, enough: int, seed: int, key: str) -> DataFrame:
    """Each group's first rows, once for each text (case and end blanks aside); if fewer than ``enough`` stay, others fill up in hash order to ``target``.

    Groups come in order of their names. No quota is over ``target``, so no more rows
    of a group are ranked.
    """
    w = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= target).join(quotas.select(group, "quota"), group)
    firsts = ranked.where(F.col("_n") <= F.col("quota")).select(F.col(key).alias("_key"), "_n")
    rows = df.join(firsts, F.col(key) == F.col("_key"), "left").withColumns({"_first": F.col("_n").isNotNull(), "_text": F.lower(F.trim(text))})
    place = F.struct((~F.col("_first")).alias("later"), F.when(F.col("_first"), F.col(group)).alias("g"), F.when(F.col("_first"), F.col("_n")).alias("n"), F.when(~F.col("_first"), shuffle_key(seed, F.col(key))).alias("h"), F.col(key).alias("k"))
    rest = [c for c in rows.columns if c != "_text"]
    once = rows.groupBy("_text").agg(F.min_by(F.struct(*rest), place).alias("_row"), F.min(place).alias("_place"))
    once = once.orderBy("_place").limit(target).select("_place", *[F.col(f"_row.{c}").alias(c) for c in rest])
    firsts = F.sum(F.col("_first").cast("int")).over(Window.partitionBy(F.lit(1)))
    kept = once.withColumn("_firsts", firsts).where(F.col("_first") | (F.col("_firsts") < enough))
    return kept.select(*df.columns)
