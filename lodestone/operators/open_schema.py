"""Rows of any schema: fields, their types and fill rates, and texts, by Spark's VARIANT type and without a list of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of nesting that are looked into; deeper values count as one field.
DEEPEST = 8


def variants(rows: DataFrame, column: str, id_column: str = "_row") -> DataFrame:
    """id and value: JSON texts as variants; null where a text is null or no JSON."""
    return rows.select(F.monotonically_increasing_id().alias(id_column), F.try_parse_json(F.col(column)).alias("value"))


def _nested(kind: Column) -> Column:
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def leaves(rows: DataFrame, id_column: str = "_row", deepest: int = DEEPEST) -> DataFrame:
    """id, field, kind, value: every value that is no object or array, by its path.

    Fields of an object are ``a.b``, elements of an array ``a[]``; a value that is no
    object has the field ``$``. Empty objects and arrays give no row. Levels are
    exploded one by one, each in the JVM and without a shuffle.
    """
    spark = rows.sparkSession
    level = rows.where(F.col("value").isNotNull()).select(id_column, F.lit("").alias("field"), "value", F.schema_of_variant("value").alias("kind"))
    found = []
    for _ in range(deepest):
        found.append(level.where(~_nested(F.col("kind"))).select(id_column, F.when(F.col("field") == "", "$").otherwise(F.col("field")).alias("field"), "kind", "value"))
        inner = level.where(_nested(F.col("kind"))).select(id_column, F.col("field").alias("_up"), F.col("value").alias("_value"))
        parts = inner.lateralJoin(spark.tvf.variant_explode(F.col("_value").outer()))
        name = F.when(F.col("key").isNull(), F.concat("_up", F.lit("[]"))).when(F.col("_up") == "", F.col("key")).otherwise(F.concat_ws(".", "_up", "key"))
        level = parts.select(id_column, name.alias("field"), "value", F.schema_of_variant("value").alias("kind"))
    found.append(level.select(id_column, "field", "kind", "value"))
    return reduce(DataFrame.unionByName, found)


def field_rates(rows: DataFrame, column: str) -> DataFrame:
    """field, types, present, fill_rate of every field that occurs in JSON texts.

    A field is present in a row if it holds a value there that is not null and, as text,
    not blank; the rate is over all rows, null and broken texts included. ``types`` are
    those of the field's values but null, in order. No texts give no row.
    """
    values = variants(rows, column)
    filled = (F.col("kind") != "VOID") & (F.trim(F.coalesce(F.try_variant_get("value", "$", "string"), F.lit("?"))) != "")
    own = leaves(values).select("_row", "field", F.when(F.col("kind") != "VOID", F.col("kind")).alias("kind"), filled.alias("filled"))
    per_row = own.groupBy("field", "_row").agg(F.bool_or("filled").alias("filled"), F.collect_set("kind").alias("kinds"))
    per = per_row.groupBy("field").agg(F.count_if("filled").alias("present"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("types"))
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    return per.join(F.broadcast(total)).select("field", F.array_join("types", ",").alias("types"), "present", (F.col("present") / F.col("n")).alias("fill_rate"))  # one row


def merged_schema(rows: DataFrame, column: str) -> str | None:
    """One schema that all JSON texts fit into, as a type string; null without texts."""
    return rows.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column)))).first()[0]


def row_text(value: Column, preferred: list[str], fallback: Column) -> Column:
    """The first of the preferred fields of a variant that is a text and not blank, else ``fallback``."""
    texts = [F.try_variant_get(value, f"$.{f}", "string") for f in preferred]
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts], fallback)


def texts_of_rows(rows: DataFrame, id_column: str, column: str, preferred: list[str]) -> DataFrame:
    """id and text: a preferred field, else all scalar values as "field: value", joined by "; " in order of field and value."""
    values = rows.select(F.col(id_column).alias("_row"), F.try_parse_json(F.col(column)).alias("value"))
    lines = leaves(values).where("kind <> 'VOID'").select("_row", F.concat("field", F.lit(": "), F.try_variant_get("value", "$", "string")).alias("line"))
    joined = lines.groupBy("_row").agg(F.array_join(F.array_sort(F.collect_list("line")), "; ").alias("lines"))
    return values.join(joined, "_row", "left").select(F.col("_row").alias(id_column), row_text(F.col("value"), preferred, F.col("lines")).alias("text"))
