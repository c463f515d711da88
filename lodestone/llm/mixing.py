"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document has a hash that depends on its id alone. For each source, sizes are
summed by hash bucket; the running sums show the bucket in which the budget ends,
and only that bucket is summed again at a finer step, until one document is left in
it. A document is taken if its hash is under its source's threshold. If a boundary
bucket ends up with several rows of one hash (an id that repeats, or rows without one),
these are told apart the same way by a second hash, over the whole row; of rows that
are equal throughout as many are taken as come nearest to the budget. No row is
sorted, thresholds are nested (a larger budget takes a superset), and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordering import positions

from .common import WORD, durable, row_marks, small_side

HASH_BITS, STEP_BITS, MOST_REPEATS = 60, 12, 3


def id_hash(column: Column) -> Column:
    """Sixty bits of the MD5 of the id as text."""
    text = F.coalesce(column.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(rows: DataFrame) -> DataFrame:
    """source_key, source, source_size, target: weights 1, 2, 3 by source order, capped at three times the size.

    ``rows`` has source_key, source and size. The excess of capped sources goes to the
    others by weight, which has a closed form: with sources in order of cap by weight,
    a source is capped while the level (what is left, by the weights left) is above
    its own cap by weight. One row a source is windowed, never the documents.
    """
    per = rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.row_number().over(in_order) - 1) % 3 + 1)
    per = per.withColumn("cap", F.col("source_size") * MOST_REPEATS).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "source_key")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("all_size", F.sum("source_size").over(everything))
    per = per.withColumn(
        "level", (F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    )
    first_free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_key", "level"))).over(everything)
    per = per.withColumn("water", first_free["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")))
    return per.select("source_key", "source", "source_size", target.alias("target"))


def refined(sized: DataFrame, state: DataFrame, n_sources: int) -> DataFrame:
    """source_key, budget, low, under, n, bar: rows (source_key, hash, size) with hashes under ``low`` are taken and have ``under`` words.

    ``state`` has source_key and budget. ``n`` over 1 says that the budget ends among
    so many rows of the hash ``low``, with ``bar`` words; else nothing is left open.
    """
    state = state.select("source_key", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("under"), F.lit(False).alias("over"))
    width = HASH_BITS
    while True:
        state = durable(state.select("source_key", "budget", "low", "under", "over"))
        width -= STEP_BITS
        step = 1 << width
        inside = sized.join(small_side(state, n_sources), "source_key").where(
            (F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + step * (1 << STEP_BITS)) & ~F.col("over")
        )
        bucket = F.shiftright(F.col("hash") - F.col("low"), width)
        bars = inside.groupBy("source_key", bucket.alias("bucket")).agg(F.sum("size").alias("bar"), F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("source_key").orderBy("bucket")
        bars = bars.withColumn("sum_to", F.sum("bar").over(upto))
        ends = bars.join(small_side(state, n_sources), "source_key").where(F.col("under") + F.col("sum_to") > F.col("budget"))
        edge = ends.groupBy("source_key").agg(
            F.min_by(F.struct("bucket", "bar", "n", "sum_to"), "bucket").alias("e")
        )
        state = state.join(edge, "source_key", "left").select(
            "source_key", "budget",
            F.when(F.col("e").isNotNull(), F.col("low") + F.col("e.bucket") * step)
            .when(F.col("over"), F.col("low")).otherwise(F.col("low") + step * (1 << STEP_BITS)).alias("low"),
            F.when(F.col("e").isNotNull(), F.col("under") + F.col("e.sum_to") - F.col("e.bar")).otherwise(F.col("under")).alias("under"),
            (F.col("over") | F.col("e").isNull()).alias("over"),
            F.col("e.n").alias("n"), F.col("e.bar").alias("bar"),
        )
        # A boundary bucket with one document is settled: it is taken if that comes nearer to the budget.
        one = ~F.col("over") & (F.col("n") == 1)
        takes = one & (F.col("under") + F.col("bar") - F.col("budget") < F.col("budget") - F.col("under"))
        state = durable(state.select(
            "source_key", "budget",
            F.when(takes, F.col("low") + step).otherwise(F.col("low")).alias("low"),
            F.when(takes, F.col("under") + F.col("bar")).otherwise(F.col("under")).alias("under"),
            (F.col("over") | one).alias("over"), "n", "bar",
        ))
        if width < STEP_BITS or not state.where(~F.col("over")).limit(1).count():
            return state.select("source_key", "budget", "low", "under", F.when(~F.col("over"), F.col("n")).alias("n"), "bar")


def _open(state: DataFrame) -> DataFrame | None:
    """Sources whose budget ends among rows of one hash."""
    some = durable(state.where("n > 1"))
    return some if some.limit(1).count() else None


def thresholds(rows: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """source_key, whole (times that every document is taken), threshold, mark_threshold, number.

    Rows are taken once more if their hash is under the threshold, or is the threshold
    and their mark under the second one; of rows with both, ``number`` of them.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    wholes = targets.select("source_key", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("budget"))
    sized = rows.where(F.col("size") > 0).select("source_key", "hash", "mark", "size")
    first = refined(sized.drop("mark"), wholes, n_sources)
    limits = wholes.select("source_key", "whole").join(first.select("source_key", F.col("low").alias("threshold")), "source_key")
    limits = limits.withColumns({"mark_threshold": F.lit(0).cast("long"), "number": F.lit(0).cast("long")})
    tied = _open(first)
    if tied is None:
        return limits
    among = sized.join(small_side(tied.select("source_key", F.col("low").alias("hash")), n_sources), ["source_key", "hash"])
    second = refined(among.select("source_key", F.col("mark").alias("hash"), "size"), tied.select("source_key", (F.col("budget") - F.col("under")).alias("budget")), n_sources)
    repeats = F.when(F.col("n") > 1, F.round((F.col("budget") - F.col("under")) * F.col("n") / F.col("bar"))).otherwise(0).cast("long")
    inner = second.select("source_key", F.col("low").alias("_mark"), repeats.alias("_number"))
    return limits.join(inner, "source_key", "left").select("source_key", "whole", "threshold", F.coalesce("_mark", "mark_threshold").alias("mark_threshold"), F.coalesce("_number", "number").alias("number"))


def _rows(docs: DataFrame, carry: list[Column]) -> DataFrame:
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.shiftrightunsigned(row_marks(docs)[0], 64 - HASH_BITS)
    return docs.select(*carry, key.alias("source_key"), F.col("source").cast("string").alias("source"), size.alias("size"), id_hash(F.col("doc_id")).alias("hash"), mark.alias("mark"))


def _decided(rows: DataFrame, sizes: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` of every row, size, source_size, target and copies. ``sizes`` are the same rows' sizes, hashes and marks, written once."""
    targets = durable(source_targets(sizes))
    n_sources = targets.count()
    limits = durable(targets.drop("source").join(thresholds(sizes, targets, n_sources), "source_key"))
    joined = rows.drop("source").join(small_side(limits, n_sources), "source_key")
    at = F.col("hash") == F.col("threshold")
    more = (F.col("hash") < F.col("threshold")) | (at & (F.col("mark") < F.col("mark_threshold")))
    columns = [*carry, "size", "source_size", "target"]
    if not limits.where("number > 0").limit(1).count():
        return joined.select(*columns, (F.col("whole") + more.cast("long")).alias("copies"))
    equal = at & (F.col("mark") == F.col("mark_threshold")) & (F.col("number") > 0) & (F.col("size") > 0)
    # Rows equal throughout: any of them do, so they are numbered as they lie.
    numbered = positions(joined.where(equal).withColumn("_n", F.monotonically_increasing_id()), "source_key", ["_n"], "_place")
    some = numbered.select(*columns, (F.col("whole") + (F.col("_place") <= F.col("number")).cast("long")).alias("copies"))
    return joined.where(~equal).select(*columns, (F.col("whole") + more.cast("long")).alias("copies")).unionByName(some)


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    Size is the number of words; null and empty texts have 0 and are taken 0 words.
    A null source is a source of its own, last in order. Rows that repeat a doc_id, or
    have none, are documents of their own; equal rows are taken one by one. Sources with
    equal caps by weight go by name. An empty table gives an empty result; other columns
    only tell rows apart.
    """
    rows = durable(_rows(docs, [F.col("doc_id").cast("long").alias("doc_id")]))
    mixed = _decided(rows, rows, ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as its source's threshold says, all columns unchanged.

    Documents are decided as in :func:`mix`: nulls, repeated ids and equal rows as
    there. Texts without words are taken as often as their hash says. An empty table
    gives an empty result.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    sizes = durable(_rows(docs, []))
    mixed = _decided(_rows(docs, [whole]), sizes, ["_doc"])
    return mixed.where("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_doc.*")
