"""Exact duplicates by content hash, and links between the members of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import content_hash


def canonical_rows(df: DataFrame, key: Column, id_column: str) -> DataFrame:
    """Each row's canonical id (the smallest id with its key) and its group's size.

    Counts are combined before the shuffle and joined back on the key, where adaptive
    execution splits a hot key; no window gathers a group in one task.
    """
    rows = df.withColumn("_key", key)
    groups = rows.groupBy("_key").agg(F.min(id_column).alias("canonical_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "_key").drop("_key").withColumn("is_canonical", F.col(id_column) == F.col("canonical_id"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    return canonical_rows(docs.select("doc_id", "text"), content_hash(F.col("text")), "doc_id").select("doc_id", "canonical_id", "group_size", "is_canonical")


def link_pairs(df: DataFrame, key: Column, id_column: str) -> DataFrame:
    """(canonical_id, linked_id) for every further member of a group: links as rows, so a large group makes no large list."""
    rows = canonical_rows(df, key, id_column)
    return rows.where(~F.col("is_canonical")).select("canonical_id", F.col(id_column).alias("linked_id"))


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``: a min over structs, which combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*ordered)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def twins(df: DataFrame, keys: list[Column], id_column: str, side: str) -> DataFrame:
    """For each row the smallest id of the other side (``side`` is a boolean column) with equal keys; null if none."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(id_column, side, *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    best = rows.groupBy(*names, side).agg(F.min(id_column).alias("twin_id")).withColumn(side, ~F.col(side))
    return rows.join(best, [*names, side], "left").select(id_column, side, "twin_id")


def audit_rows(df: DataFrame, key: Column, id_column: str, source: str) -> DataFrame:
    """(chunk_key, duplicate_of, linked): canonical rows with the sorted sources of their copies, and a row "source::id" for each copy."""
    rows = canonical_rows(df, key, id_column)
    copies = rows.where(~F.col("is_canonical"))
    links = copies.groupBy(F.col("canonical_id").alias("_c")).agg(F.array_sort(F.collect_set(source)).alias("_linked"))
    kind = links.schema["_linked"].dataType
    kept = rows.where("is_canonical").join(links, F.col(id_column) == F.col("_c"), "left")
    kept = kept.select(F.col(id_column).cast("string").alias("chunk_key"), F.lit(None).cast(df.schema[id_column].dataType).alias("duplicate_of"), F.coalesce("_linked", F.array().cast(kind)).alias("linked"))
    return kept.unionByName(copies.select(F.concat_ws("::", source, F.col(id_column).cast("string")).alias("chunk_key"), F.col("canonical_id").alias("duplicate_of"), F.array().cast(kind).alias("linked")))


def language_twins(df: DataFrame, keys: list[str], id_column: str, first: str, second: str) -> DataFrame:
    """(id, twin_id): a row with both languages is its own twin; else the smallest id with equal keys that has the other language."""
    best = df.groupBy(*keys).agg(F.min(F.when(F.col(first), F.col(id_column))).alias("_a"), F.min(F.when(F.col(second), F.col(id_column))).alias("_b"))
    twin = F.when(F.col(first) & F.col(second), F.col(id_column)).when(F.col(first), F.col("_b")).otherwise(F.col("_a"))
    return df.join(best, keys).select(id_column, twin.alias("twin_id"))
