"""Filters by payload fields, exact lookups, hard filters of graded pairs, and texts of rows with varied schemas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Difficulty of a graded complexity, and complexity of a stated difficulty.
DIFFICULTY = {"low": "basic", "medium": "medium", "high": "hard"}
COMPLEXITY = {"easy": "low", "low": "low", "beginner": "low", "medium": "medium", "intermediate": "medium", "hard": "high", "high": "high", "advanced": "high", "expert": "high"}
# Fields that hold a question or an answer, in order of preference.
QUESTION_FIELDS, ANSWER_FIELDS = ("question", "instruction", "prompt", "input"), ("answer", "output", "response", "completion")


def payload_filter(filters: dict[str, object]) -> Column:
    """All fields as given: a list means any of its values, another value equality. No filters hold for every row."""
    conditions = [F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in filters.items()]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def typed_filter(equal: dict[str, object], at_least: dict[str, float]) -> Column:
    """Equality of the fields that are given and not empty, and least values of numbers that are given and not 0."""
    conditions = [F.col(k) == v for k, v in equal.items() if v] + [F.col(k) >= v for k, v in at_least.items() if v]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def exact_lookup(df: DataFrame, equal: dict[str, object], order: Sequence[str], most: int = 50) -> DataFrame:
    """Rows with exactly the given values (empty ones do not count), the first ``most`` in an order: a top-k, not a sort."""
    return df.where(typed_filter(equal, {})).orderBy(*order).limit(most)


def hard_filter(grading: Column, strict: bool = False) -> Column:
    """Whether a graded pair is answerable and specific, and realistic too if strict; ungraded pairs are not."""
    flags = ["answerable", "specific"] + (["realistic"] if strict else [])
    return reduce(lambda a, b: a & b, [F.coalesce(grading[f].cast("int") == 1, F.lit(False)) for f in flags])


def required_rate(df: DataFrame, required: Sequence[str], most: float = 0.02) -> DataFrame:
    """One row: n, rejected (a required field is null or blank), reject_rate, passed (the rate is ``most`` at the highest)."""
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)) for c in required])
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("rejected"))
    rate = F.col("rejected") / F.nullif(F.col("n"), F.lit(0))
    return one.withColumn("reject_rate", rate).withColumn("passed", F.coalesce(rate <= most, F.lit(True)))


def mapped(value: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """The entry of a small table for a value, case aside; ``otherwise`` (null) if there is none."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[F.lower(value)], F.lit(None) if otherwise is None else otherwise)


def difficulty(complexity: Column) -> Column:
    """basic, medium or hard of a graded complexity; other values stay, in lower case."""
    return mapped(complexity, DIFFICULTY, F.lower(complexity))


def complexity_hint(generator: Column, stated: Column) -> Column:
    """high for generators of complex questions, else by the stated difficulty; null if unknown."""
    return F.when(F.lower(F.coalesce(generator, F.lit(""))).contains("highcomplex"), "high").otherwise(mapped(stated, COMPLEXITY))


def row_text(df: DataFrame, least: int = 50) -> Column:
    """The best text of a row, whatever fields its table has.

    ``text`` if it has ``least`` characters; else the filled question and answer fields,
    one a line; else all string fields, joined by a blank.
    """
    filled = lambda names: [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names if c in df.columns]
    parts = [*filled(QUESTION_FIELDS), *filled(ANSWER_FIELDS)]
    strings = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() in ("string", "varchar", "char")]
    text = F.when(F.length("text") >= least, F.col("text")) if "text" in df.columns else F.lit(None).cast("string")
    return F.coalesce(text, F.nullif(F.concat_ws("\n", *parts), F.lit("")) if parts else F.lit(None), F.concat_ws(" ", *strings))


def question_and_answer(df: DataFrame, pairs: Sequence[Sequence[str]]) -> Column:
    """"Q: ...", "A: ..." of the first pair of fields that are both filled, or a single filled field as it is; else "name: value" lines of all filled strings."""
    tries = []
    for names in pairs:
        if all(n in df.columns for n in names):
            values = [F.trim(F.col(n).cast("string")) for n in names]
            full = reduce(lambda a, b: a & b, [F.coalesce(v != "", F.lit(False)) for v in values])
            tries.append(F.when(full, values[0] if len(names) == 1 else F.concat(F.lit("Q: "), values[0], F.lit("\nA: "), values[1])))
    strings = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    listed = F.concat_ws("\n", *[F.when(F.trim(f"`{c}`") != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in strings])
    return F.coalesce(*tries, listed)


def with_plan(df: DataFrame, doc_id: str, plans: DataFrame, defaults: DataFrame) -> DataFrame:
    """Each document with the chunking plan to use: its own stored one, else that of its id's prefix (before the first colon), else the general one.

    ``plans`` has doc_id and plan, ``defaults`` prefix and plan with one row a prefix and
    one ``_GENERIC_``. Adds plan and plan_source (stored, prefix, general).
    """
    prefix = F.when(F.col(doc_id).contains(":"), F.substring_index(doc_id, ":", 1)).otherwise(F.lit(""))
    own = plans.select(F.col("doc_id").alias("_id"), F.col("plan").alias("_own"))
    some = defaults.select(F.col("prefix").alias("_prefix"), F.col("plan").alias("_some"))
    general = defaults.where("prefix = '_GENERIC_'").select(F.col("plan").alias("_general"), F.lit("").alias("_all"))
    rows = df.withColumn("_p", prefix).join(own, F.col(doc_id) == F.col("_id"), "left").join(some, F.col("_p") == F.col("_prefix"), "left").join(F.broadcast(general), F.col("_all") == F.lit(""), "left")
    source = F.when(F.col("_own").isNotNull(), "stored").when(F.col("_some").isNotNull(), "prefix").when(F.col("_general").isNotNull(), "general")
    return rows.withColumn("plan", F.coalesce("_own", "_some", "_general")).withColumn("plan_source", source).drop("_p", "_id", "_own", "_prefix", "_some", "_general", "_all")
