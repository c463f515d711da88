"""Sinks: JSON lines, CSV and Parquet through Spark's committers, slimmed log rows, vector points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.identifiers import point_id
from lodestone.functions.vectors import doubles, finite


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines; the committer replaces the folder as a whole."""
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, tab: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t" if tab else ",").csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Parquet, partitioned by columns; rows are dealt by them first, so that each folder gets few files."""
    (df.repartition(*by).write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)


def log_row(answer: Column, citations: Column, most_answer: int = 16_000, most_row: int = 32_000) -> list[Column]:
    """Answer and citations (array of structs with id, page and section) within size limits, citations as JSON of those fields."""
    slim = F.transform(citations, lambda c: F.struct(c["id"].alias("id"), c["page"].alias("page"), c["section"].alias("section")))
    return [F.substring(answer, 1, most_answer).alias("answer_markdown"), F.substring(F.to_json(slim), 1, most_row).alias("citations_json")]


def points(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Rows for a vector store: a stable point id and the vector without NaN or infinity."""
    return df.withColumn("point_id", point_id(*[F.col(k) for k in keys])).withColumn(vector, finite(doubles(F.col(vector))))
