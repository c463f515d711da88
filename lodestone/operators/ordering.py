"""Running sums over a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import durable, shuffle_width


def running_totals(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums over a global order: {new column: column}.

    Rows are range-partitioned and checkpointed, so partition numbers stand; only one
    row a partition is gathered, and windows stay inside partitions.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(shuffle_width(spark), *order).withColumn("_part", F.spark_partition_id())
    dealt = durable(dealt)
    per = dealt.groupBy("_part").agg(*[F.sum(c).cast("long").alias(n) for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(F.broadcast(offsets), "_part")  # one row for each shuffle partition
    return rows.select(*df.columns, *[(F.col(f"_before_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).cast("long").alias(n) for n, c in sums.items()])


def positions(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds the rows' numbers from 1 within their group, by ``order`` (ascending columns); no task gets a whole group.

    Numbers run over one global order by group; the number at which a group begins is taken off.
    """
    counted = running_totals(df.withColumn("_one", F.lit(1)), [group, *order], {"_at": "_one"}).drop("_one")
    begins = counted.groupBy(F.col(group).alias("_group")).agg(F.min("_at").alias("_base"))
    rows = counted.join(begins, F.col(group).eqNullSafe(F.col("_group")))
    return rows.withColumn(name, (F.col("_at") - F.col("_base") + 1).cast("long")).drop("_at", "_base", "_group")


def kth_smallest(values: DataFrame, column: str, k: int, digits: int = 3) -> str | None:
    """The k-th smallest of a column of distinct hexadecimal strings, by histograms of their leading digits.

    Each round counts ``16 ** digits`` buckets at most and goes on inside the one that
    holds the k-th value, so nothing is sorted or gathered. None if there are fewer.
    """
    head, rows = "", values
    while True:
        bars = sorted((r.b, r.n) for r in rows.groupBy(F.substring(column, 1, len(head) + digits).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        for bucket, n in bars:
            if k <= n:
                break
            k -= n
        else:
            return None
        if n == 1:
            return rows.where(F.substring(column, 1, len(bucket)) == bucket).first()[column]
        head, rows = bucket, values.where(F.substring(column, 1, len(bucket)) == bucket)
