"""Aggregations for audits, gates and statistics that are more than one built-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordering import running_totals

#: Rows of a global order that are looked up together.
STRETCH = 4096


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, present, fill_rate: one pass over the rows, then one row a field."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present"), (F.col(c) / F.nullif(F.col("n"), F.lit(0))).alias("fill_rate")) for c in columns])
    return sums.select(F.inline(rows))


def lint_counts(per: DataFrame) -> DataFrame:
    """docs, thin (documents with fewer than half the upper median of n), empty_rate, of one row (n, empty) a document.

    Documents are counted by n first, so only the distinct counts are windowed. No row without documents.
    """
    sizes = per.groupBy("n").agg(F.count(F.lit(1)).alias("_docs"), F.sum("empty").alias("_empty"))
    every = Window.partitionBy(F.lit(1))
    upto = every.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = sizes.select("*", F.sum("_docs").over(upto).alias("_upto"), F.sum("_docs").over(every).alias("_all"))
    rows = rows.withColumn("_median", F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col("n"))).over(every))
    thin = F.coalesce(F.sum(F.when(F.col("n") * 2 < F.col("_median"), F.col("_docs"))), F.lit(0))
    return rows.groupBy("_median").agg(F.sum("_docs").alias("docs"), thin.alias("thin"), (F.sum("_empty") / F.sum(F.col("n") * F.col("_docs"))).alias("empty_rate")).drop("_median")


def group_quantiles(df: DataFrame, group: str, value: str, ps: list[int]) -> DataFrame:
    """group, median, p<n> for each percentile, low, high of groups of any size.

    The median is sorted[n // 2], the upper of two middle values. A percentile is the
    exclusive quantile of n + 1 steps, or the largest value when n is under
    100 / (100 - p). Distinct values are counted, and running counts over their global order tell which
    of them hold the wanted ranks; no group is gathered. Nulls are no values.
    """
    totals = df.groupBy(F.col(group).alias("_of")).agg(F.count(value).alias("_all"), F.min(value).alias("low"), F.max(value).alias("high"))
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_group"), F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counts, ["_group", "_value"], {"_start": "_n"})
    starts = placed.groupBy(F.col("_group").alias("_first_of")).agg(F.min("_start").alias("_base"))
    totals = totals.join(starts, F.col("_of").eqNullSafe(F.col("_first_of")), "left")
    n = F.col("_all")
    place = {p: (n + 1) * p / 100.0 for p in ps}
    low = {p: F.greatest(F.lit(1), F.floor(place[p])) for p in ps}
    ranks = {"_median": F.floor(n / 2)} | {f"_a{p}": low[p] - 1 for p in ps} | {f"_b{p}": F.least(low[p], n - 1) for p in ps}
    wanted = totals.where(n > 0).select("_of", F.inline(F.array(*[F.struct(F.lit(k).alias("_rank"), (F.col("_base") + r).cast("long").alias("_at")) for k, r in ranks.items()])))
    # Values and wanted ranks meet by group and stretch of the order, so that a hot group is dealt to many tasks.
    stretch = lambda at: F.floor(at / STRETCH)
    wanted = wanted.withColumn("_here", stretch(F.col("_at")))
    spread = placed.withColumn("_stretch", F.explode(F.sequence(stretch(F.col("_start")), stretch(F.col("_start") + F.col("_n") - 1))))
    held = (F.col("_start") <= F.col("_at")) & (F.col("_at") < F.col("_start") + F.col("_n"))
    hits = spread.join(wanted, (F.col("_stretch") == F.col("_here")) & F.col("_group").eqNullSafe(F.col("_of")) & held).drop("_of")
    found = hits.groupBy("_group").agg(*[F.max(F.when(F.col("_rank") == k, F.col("_value"))).alias(k) for k in ranks])
    whole = totals.join(found, F.col("_of").eqNullSafe(F.col("_group")), "left")
    between = {p: F.col(f"_a{p}") + (F.col(f"_b{p}") - F.col(f"_a{p}")) * (place[p] - low[p]) for p in ps}
    percentiles = [F.when(n * (100 - p) < 100, F.col("high")).otherwise(between[p]).alias(f"p{p}") for p in ps]
    return whole.select(F.col("_of").alias(group), F.col("_median").alias("median"), *percentiles, "low", "high")


def threshold_sweep(scores: DataFrame, score: str, positive: str, steps: int = 201) -> DataFrame:
    """theta, kept_rate (positives at or over it), refused_rate (others under it) on a grid of 0 to 1.

    Each score counts once, at its place in the grid; running sums over the grid's
    rows give the rates, so nothing is crossed with the grid.
    """
    cell = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor(F.col(score) * (steps - 1) + 1e-9) + 1)).cast("int")
    bars = scores.groupBy(cell.alias("cell")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    grid = scores.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("cell"))
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = grid.join(bars, "cell", "left").select("cell", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
    rows = rows.select("cell", F.sum("p").over(upto).alias("p_under"), F.sum("q").over(upto).alias("q_under"), F.sum("p").over(everything).alias("p_all"), F.sum("q").over(everything).alias("q_all"))
    return rows.where(F.col("cell") < steps).select(
        (F.col("cell") / (steps - 1)).alias("theta"), (1 - F.col("p_under") / F.nullif("p_all", F.lit(0))).alias("kept_rate"),
        (F.col("q_under") / F.nullif("q_all", F.lit(0))).alias("refused_rate"),
    )


def lowest_threshold(scores: DataFrame, score: str, positive: str, keep: float, refuse: float, steps: int = 200) -> DataFrame:
    """theta, kept_rate, refused_rate of the lowest theta that meets both rates, rounded to 4; no row if none does.

    The grid goes from the lowest to the highest score. Each score counts once, at the
    last grid point at or under it.
    """
    rows = scores.select(F.col(score).cast("double").alias("_s"), F.col(positive).alias("_pos")).where(F.col("_s").isNotNull() & F.col("_pos").isNotNull())
    ends = rows.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    theta = lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / steps
    near = F.coalesce(F.floor((F.col("_s") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * steps), F.lit(steps))
    rows = rows.join(F.broadcast(ends)).withColumn("_near", near)
    cell = F.when(theta(F.col("_near") + 1) <= F.col("_s"), F.col("_near") + 1).when(theta(F.col("_near")) <= F.col("_s"), F.col("_near")).otherwise(F.col("_near") - 1)
    bars = rows.groupBy(F.least(cell, F.lit(steps)).alias("_cell")).agg(F.count_if("_pos").alias("_p"), F.count_if(~F.col("_pos")).alias("_q"))
    grid = scores.sparkSession.range(steps + 1).select(F.col("id").alias("_cell")).join(bars, "_cell", "left").join(F.broadcast(ends))
    under = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = lambda c: F.coalesce(F.sum(c).over(under), F.lit(0)) / F.nullif(F.sum(c).over(everything), F.lit(0))
    rates = grid.select(theta(F.col("_cell")).alias("theta"), (1 - part("_p")).alias("kept_rate"), part("_q").alias("refused_rate"))
    met = rates.where((F.col("kept_rate") >= keep - 1e-12) & (F.col("refused_rate") >= refuse - 1e-12)).orderBy("theta").limit(1)
    return met.select(*[F.round(c, 4).alias(c) for c in met.columns])


def scoreboard(judged: DataFrame) -> DataFrame:
    """n, hits, answers (2 full, 1 partly, 0 wrong) and rates of judged rows (bucket, hit, answer), by bucket and for ``all``.

    Buckets are counted once; the totals are sums over their few rows.
    """
    names = {"full_correct": 2, "partly": 1, "wrong": 0}
    counts = judged.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit") == 1).alias("hit"), *[F.count_if(F.col("answer") == v).alias(k) for k, v in names.items()])
    total = counts.agg(F.lit("all").alias("bucket"), *[F.sum(c).alias(c) for c in ("n", "hit", *names)]).where("n is not null")
    rows = counts.unionByName(total)
    return rows.withColumns({"hit_rate": F.round(F.col("hit") / F.col("n"), 6), "full_rate": F.round(F.col("full_correct") / F.col("n"), 6)})


def share_warnings(counts: DataFrame, n: str, mix: str, wanted: float, cap: float = 0.40, floor: float = 0.05, off: float = 0.10) -> DataFrame:
    """Adds ``share`` of all and ``warnings``: over_cap, under_floor, mix_off (the mix is more than ``off`` from what is wanted). One row a group."""
    share = F.col(n) / F.sum(n).over(Window.partitionBy(F.lit(1)))
    rows = counts.withColumn("share", share)
    found = F.array(F.when(F.col("share") > cap, "over_cap"), F.when(F.col("share") < floor, "under_floor"), F.when(F.abs(F.col(mix) - wanted) > off, "mix_off"))
    return rows.withColumn("warnings", F.array_compact(found))


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column with totals and the row's share of all."""
    counts = df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count(F.lit(1)).alias("total"))
    all_rows = Window.partitionBy(F.lit(1))
    return counts.withColumn("share", F.col("total") / F.sum("total").over(all_rows))
