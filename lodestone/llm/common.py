"""Small Spark helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import durable, map_arrow, shuffle_width, table  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"


load = table


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def small_side(df: DataFrame, rows: int, most: int = 10_000) -> DataFrame:
    """Broadcast a side whose row count was measured and is under ``most``; else leave the join to AQE."""
    return F.broadcast(df) if rows <= most else df


def id_crc(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def row_marks(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row, ``_mark_a`` and ``_mark_b``: rows with equal marks are repetitions of one row.

    Columns of types that cannot be hashed (maps, variants) do not count.
    """
    names = [f"`{f.name}`" for f in df.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in names])
    return [F.xxhash64(F.lit(1), *names, nulls).alias("_mark_a"), F.xxhash64(F.lit(2), nulls, *reversed(names)).alias("_mark_b")]


def keep_marked(docs: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """One row of ``docs`` for each group, all columns as they are: the one with the least marks of the group's ``rows`` (group, _mark_a, _mark_b).

    The kept marks are written, and how often each occurs; only if a kept row is wholly
    repeated are the rows ranked to drop its repetitions.
    """
    times = rows.groupBy(group, "_mark_a", "_mark_b").agg(F.count(F.lit(1)).alias("_times"))
    kept = durable(times.groupBy(group).agg(F.min(F.struct("_mark_a", "_mark_b", "_times")).alias("_m")).select("_m.*"))
    names = [fresh_name(docs, "_mark_a"), fresh_name(docs, "_mark_b")]
    marked = docs.select("*", *[m.alias(n) for m, n in zip(row_marks(docs), names, strict=True)]).alias("d")
    found = marked.join(kept.alias("k"), (F.col(f"d.{names[0]}") == F.col("k._mark_a")) & (F.col(f"d.{names[1]}") == F.col("k._mark_b")), "left_semi")
    if kept.where("_times > 1").limit(1).count():
        number = fresh_name(docs, "_number")
        ranked = found.withColumn(number, F.row_number().over(Window.partitionBy(*names).orderBy(names[0])))
        found = ranked.where(F.col(number) <= 1).drop(number)
    return found.drop(*names)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
