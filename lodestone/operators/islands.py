"""Windows over event streams: islands, latches, trailing ranges, streaks. None gathers a whole key (see :mod:`scans`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .scans import Segments


def islands(df: DataFrame, keys: list[str], order: list[str], state: Column) -> DataFrame:
    """Adds ``island``, a number that changes whenever the state does."""
    rows = Segments.of(df.withColumn("_state", F.struct(state.alias("s"))), keys, order).add(_before=scans.previous(F.col("_state")))
    changed = F.when(F.col("_before").isNull(), 1).when(F.col("_state.s").eqNullSafe(F.col("_before.s")), 0).otherwise(1)
    return rows.with_columns(_changed=changed).add(island=scans.total(F.col("_changed"))).result().drop("_changed", "_state", "_before")


def rolling_latch(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, limit: float) -> DataFrame:
    """Adds ``rolling_mean`` of the last ``size`` values and ``tripped``: it was full and over the limit once, and stays so."""
    rows = Segments.of(df, keys, order).frame(size, rolling_mean=lambda w: F.avg(value).over(w), _full=lambda w: F.count(value).over(w) == size)
    rows = rows.with_columns(_over=(F.col("_full") & (F.col("rolling_mean") > limit)).cast("int")).add(_tripped=scans.highest(F.col("_over")))
    return rows.with_columns(tripped=F.col("_tripped") == 1).result().drop("_full", "_over", "_tripped")


def controlled_latch(df: DataFrame, keys: list[str], order: list[str], value: str, control: str, micros: Column, size: int, limit: float) -> DataFrame:
    """Adds ``rolling_mean``, ``tripped``, ``reason`` ("mean" or "manual") and ``since_us`` after each row of values and controls.

    ``control`` is "kill", "resume" or null for a value. A full window's mean over the
    limit trips the switch, a kill too and takes its reason over; a resume clears the
    switch and the window. The batch twin of :func:`lodestone.streaming.monitors.latched`.
    """
    rows = df.withColumns({"_us": micros, "_resumed": F.coalesce((F.col(control) == "resume").cast("int"), F.lit(0))})
    rows = Segments.of(rows, keys, order).add(_epoch=scans.total(F.col("_resumed"))).result()
    inner = [*keys, "_epoch"]
    values = Segments.of(rows.where(F.col(control).isNull()), inner, order).frame(size, _mean=lambda w: F.avg(value).over(w), _n=lambda w: F.count(F.lit(1)).over(w)).result()
    others = rows.where(F.col(control).isNotNull()).withColumns({"_mean": F.lit(None).cast("double"), "_n": F.lit(None).cast("long")})
    over = (F.col("_n") == size) & (F.col("_mean") > limit)
    both = Segments.of(values.unionByName(others), inner, order).add(
        _first=scans.highest(F.when(over, -F.col("_us"))), _killed=scans.last_known(F.when(F.col(control) == "kill", F.col("_us"))), rolling_mean=scans.last_known(F.col("_mean"))
    )
    since, reason = F.coalesce("_killed", -F.col("_first")), F.when(F.col("_killed").isNotNull(), "manual").when(F.col("_first").isNotNull(), "mean")
    return both.with_columns(tripped=since.isNotNull(), reason=reason, since_us=since).result().drop("_us", "_resumed", "_epoch", "_mean", "_n", "_first", "_killed")


def silences(df: DataFrame, keys: list[str], order: list[str], millis: Column, span_ms: int, upto_ms: Column) -> DataFrame:
    """keys, idle_since_ms, action_at_ms: after each row that no other follows within the span, if the end of the span is no later than the next row or ``upto_ms``."""
    rows = Segments.of(df.withColumn("_ms", millis), keys, order).add(_next=scans.following(F.col("_ms"))).result()
    due = F.col("_ms") + span_ms
    return rows.where(due <= F.coalesce("_next", upto_ms)).select(*keys, F.col("_ms").alias("idle_since_ms"), due.alias("action_at_ms"))


def _in_stretches(df: DataFrame, keys: list[str], seconds: Column, back: int, columns: dict) -> DataFrame:
    """Adds columns over the key's rows of the last ``back`` seconds, this one's included: each a function of the window.

    Time is cut in stretches of 16 times that; a row counts in its own stretch and, near the
    end of it, in the next one, so a key with a third of all rows is dealt to many tasks.
    """
    width = 16 * (back + 1)
    rows = df.withColumn("_at", seconds)
    own = F.floor(F.col("_at") / width)
    late = F.pmod(F.col("_at"), F.lit(width)) >= width - back
    rows = rows.withColumn("_own", own).withColumn("_stretch", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_stretch").orderBy("_at").rangeBetween(-back, 0)
    rows = rows.withColumns({n: c(w) for n, c in columns.items()})
    return rows.where(F.col("_stretch").eqNullSafe(F.col("_own"))).drop("_at", "_own", "_stretch")


def trailing(df: DataFrame, keys: list[str], seconds: Column, span: int, hit: Column) -> DataFrame:
    """Adds ``recent``: how many hits of the key lie in the trailing ``span`` seconds, this row's included."""
    return _in_stretches(df, keys, seconds, span, {"recent": lambda w: F.sum(hit.cast("int")).over(w)})


def trailing_stats(df: DataFrame, keys: list[str], seconds: Column, span: int, value: Column) -> DataFrame:
    """Adds ``recent`` and ``recent_mean``: count and mean of the key's values in the trailing ``span`` seconds, this one included."""
    rows = df.withColumn("_value", value.cast("double"))
    return _in_stretches(rows, keys, seconds, span - 1, {"recent": lambda w: F.count(F.lit(1)).over(w), "recent_mean": lambda w: F.avg("_value").over(w)}).drop("_value")


def progress(df: DataFrame, keys: list[str], order: list[str], micros: Column) -> DataFrame:
    """Adds ``at_us``, ``waited_us`` since the key's row before and ``done``, the rows so far."""
    rows = Segments.of(df.withColumn("at_us", micros), keys, order).add(_before=scans.previous(F.col("at_us")), done=scans.row_number())
    return rows.with_columns(waited_us=F.col("at_us") - F.col("_before")).result().drop("_before")


def spaced(df: DataFrame, keys: list[str], order: list[str], micros: Column, least: int) -> DataFrame:
    """Rows that come ``least`` microseconds after the key's row before at least, and first rows."""
    rows = progress(df, keys, order, micros)
    return rows.where(F.col("waited_us").isNull() | (F.col("waited_us") >= least)).drop("at_us", "waited_us", "done")


def streak(df: DataFrame, keys: list[str], order: list[str], hit: Column) -> DataFrame:
    """Adds ``streak``: consecutive hits up to this row, 0 on a miss; a hit that is null counts for nothing."""
    rows = Segments.of(df.withColumn("_hit", hit), keys, order).add(_hits=scans.total(F.coalesce(F.col("_hit").cast("int"), F.lit(0))))
    rows = rows.add(_at_miss=scans.last_known(F.when(~F.col("_hit"), F.col("_hits"))))
    return rows.with_columns(streak=F.col("_hits") - F.coalesce("_at_miss", F.lit(0))).result().drop("_hit", "_hits", "_at_miss")


def capped(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each group by an order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
