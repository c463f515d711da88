"""Most frequent values, exact, without grouping all values: sketches name candidates, a recount proves them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieval import measured
from lodestone.session import durable

#: Items that a sketch tracks at first, by how much that grows, and Spark's limit.
TRACKED, GROWTH, MOST_TRACKED = 4_096, 16, 1_000_000


def _bound(tracked: int) -> float:
    """What share of a group's rows a value that is no candidate can have at most: twice the error of a sketch of so many items."""
    return 2 * 3.5 * 0.75 / tracked


def sketches(rows: DataFrame, group: str, column: str, tracked: int) -> DataFrame:
    """group, n, sketch: one mergeable sketch of the values of each group, in one pass."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(`{column}`, {tracked})").alias("sketch"))


def candidates(made: DataFrame, group: str, most: int) -> DataFrame:
    """group, value: what the sketches of a group, merged, hold."""
    merged = made.groupBy(group).agg(F.expr("approx_top_k_combine(sketch)").alias("sketch"))
    return merged.select(group, F.explode(F.expr(f"approx_top_k_estimate(sketch, {most})")).alias("c")).select(group, F.col("c.item").alias("value"))


def top_values(df: DataFrame, column: str, k: int, group: str | None = None, tracked: int = TRACKED) -> DataFrame:
    """group (if any), value, n, rank: the ``k`` most frequent values of each group with their exact counts; ties to the smaller value.

    A pass makes the sketches, a second one counts their candidates only. The result
    stands if the k-th count is over what any other value can have, or if the candidates
    are all rows there are. Groups for which neither holds go again with larger sketches,
    and those that are flat to the end are counted in full. Null values do not count;
    a null group is a group.
    """
    own = group or "_all"
    rows = df.select((F.col(group) if group else F.lit(0)).alias(own), F.col(column).alias("value")).where("value is not null")
    rows = durable(rows)
    found: list[DataFrame] = []
    while True:
        tracked = min(tracked, MOST_TRACKED)
        made = durable(sketches(rows, own, "value", tracked))
        asked = durable(candidates(made, own, tracked))
        same = rows[own].eqNullSafe(F.col("_g")) & (rows["value"] == F.col("_v"))
        counted = rows.join(measured(asked.select(F.col(own).alias("_g"), F.col("value").alias("_v")), MOST_TRACKED), same).groupBy(rows[own], rows["value"]).agg(F.count(F.lit(1)).alias("n"))
        place = F.row_number().over(Window.partitionBy(own).orderBy(F.desc("n"), "value"))
        ranked = durable(counted.withColumn("rank", place).where(F.col("rank") <= k + 1))
        # Candidates that make up all rows of their group leave nothing out.
        seen = counted.groupBy(own).agg(F.sum("n").alias("seen"))
        edge = ranked.where(F.col("rank") == k).select(F.col(own).alias("_g"), F.col("n").alias("edge"))
        state = made.select(own, F.col("n").alias("all")).join(seen.withColumnRenamed(own, "_s"), F.col(own).eqNullSafe(F.col("_s")), "left").join(edge, F.col(own).eqNullSafe(F.col("_g")), "left")
        proven = (F.coalesce("seen", F.lit(0)) == F.col("all")) | F.coalesce(F.col("edge") > F.col("all") * _bound(tracked), F.lit(False))
        state = durable(state.select(F.col(own).alias("_o"), proven.alias("proven")))
        found.append(ranked.join(state.where("proven"), F.col(own).eqNullSafe(F.col("_o")), "left_semi").where(F.col("rank") <= k))
        if not state.where("not proven").limit(1).count():
            break
        rows = durable(rows.join(state.where("not proven"), F.col(own).eqNullSafe(F.col("_o")), "left_semi"))
        if tracked == MOST_TRACKED:
            counted = rows.groupBy(own, "value").agg(F.count(F.lit(1)).alias("n"))
            found.append(counted.withColumn("rank", place).where(F.col("rank") <= k))
            break
        tracked *= GROWTH
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out if group else out.drop(own)


def counted_values(df: DataFrame, column: str, k: int, group: str | None = None) -> DataFrame:
    """What :func:`top_values` gives, by one count of every value: one row a distinct value and task is shuffled, values are not written.

    For values that repeat, as words do, that is far less than a row each; where most
    values are distinct, sketches save the shuffle.
    """
    own = [group] if group else []
    counted = df.where(F.col(column).isNotNull()).groupBy(*own, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    first = [F.desc("n"), F.col("value")]
    rows = counted if group else counted.orderBy(*first).limit(k)
    place = F.row_number().over((Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(*first))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)
