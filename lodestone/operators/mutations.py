"""Table mutations as functions from old state and changes to new state (write the result over the old table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import latest


def _same(keys: list[str], a: str, b: str) -> Column:
    """Equal keys of two aliased sides; null is a key like any other."""
    condition = F.lit(True)
    for k in keys:
        condition = F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) & condition
    return condition


def without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the others' keys."""
    return rows.alias("r").join(others.select(*keys).alias("x"), _same(keys, "r", "x"), "left_anti")


def replace_by_key(old: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or replace: the last change of a key wins over the old row, whole rows."""
    newest = latest(changes, keys, *order)
    return without(old, newest, keys).unionByName(newest.select(*old.columns))


def upsert(old: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], order: list[str] = ()) -> DataFrame:
    """Update only ``columns`` where a change has a value; other columns of old rows survive, new keys come in.

    Several changes of a key count in ``order`` (by all their columns if none is
    given): of each column the last value that is not null.
    """
    rest = [c for c in changes.columns if c not in keys]
    by = F.struct(*(order or rest))
    last = changes.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), by)).alias(c) for c in rest])
    picked = [
        F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in columns else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}") if c in changes.columns else F.lit(None)).alias(c)
        for c in old.columns
    ]
    return old.alias("o").join(last.alias("n"), _same(keys, "o", "n"), "full").select(*picked)


def insert_ignore(old: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key is new come in; of a repeated new key the first in ``order``."""
    rest = [c for c in old.columns if c not in keys]
    first = without(rows, old, keys).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return old.unionByName(first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*old.columns))


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """New values for the rows of a condition."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def keep_newest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Retention: the first ``n`` rows of an order (a top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)


def newest_page(df: DataFrame, asked: int, *order: Column, most: int = 500) -> DataFrame:
    """The first rows of an order, as many as asked for, between 1 and ``most``."""
    return keep_newest(df, max(1, min(asked, most)), *order)


def append_new(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Only the rows to append: those whose key the old table does not have, once each."""
    return without(rows, old, keys).dropDuplicates(keys)


MARKER = "[ENRICHED]"  # fixed value


def enrich_once(rows: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """Rows (key, text, parent, embed_text, upserted) with generated questions behind a marker, once.

    ``questions`` has key and questions (an array). Rows that carry the marker, have
    under 100 characters or got no question stay as they are; the others get a new
    embed_text and upserted 0.
    """
    joined = rows.join(questions, key, "left")
    fresh = ~F.coalesce(F.col("embed_text").contains(MARKER), F.lit(False)) & (F.length(F.coalesce("text", F.lit(""))) >= 100) & (F.size("questions") > 0)
    head = F.when(F.coalesce(F.length("parent"), F.lit(0)) > 0, F.concat(F.col("parent"), F.lit("\n\n"))).otherwise(F.lit(""))
    listed = F.array_join(F.transform("questions", lambda q: F.concat(F.lit("- "), q)), "\n")
    text = F.concat(head, F.col("text"), F.lit(f"\n\n{MARKER} User questions answered by this passage:\n"), listed)
    fresh = F.coalesce(fresh, F.lit(False))
    return joined.withColumns({"embed_text": F.when(fresh, text).otherwise(F.col("embed_text")), "upserted": F.when(fresh, 0).otherwise(F.col("upserted"))}).drop("questions")
