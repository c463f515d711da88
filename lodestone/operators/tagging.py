"""Rule-based tagging, routing and classification of texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import let


def phrase_hits(lower_text: Column, phrases: list[str]) -> Column:
    """How many distinct phrases occur in a lower-case text."""
    pattern = "(?:" + "|".join(re.escape(p.lower()).replace(r"\ ", " ") for p in phrases) + ")"
    return F.size(F.array_distinct(F.regexp_extract_all(lower_text, F.lit(pattern), 0)))


def tag(df: DataFrame, text: str, rules: dict[str, list[str]], category: str | None = None) -> DataFrame:
    """Adds ``topics`` (topic, score of all hit topics) and ``primary_topic``: best score, then shorter key, then key.

    With a ``category`` column only topics "category:..." count in rows that have a category.
    """

    def hits_of(low: Column, topic: str, phrases: list[str]) -> Column:
        found = phrase_hits(low, phrases)
        if category is None:
            return found
        given = F.coalesce(F.col(category), F.lit(""))
        return F.when(given.isin("", topic.split(":", 1)[0]), found).otherwise(0)

    def scored(low: Column) -> Column:
        return F.array(*[F.struct(hits_of(low, k, v).alias("score"), F.lit(-len(k)).alias("n"), F.lit(-at).alias("at"), F.lit(k).alias("topic")) for at, (k, v) in enumerate(sorted(rules.items()))])

    hits = F.filter(let(F.lower(F.col(text)), scored), lambda t: t["score"] > 0)
    both = let(hits, lambda h: F.struct(h.alias("topics"), F.array_max(h).alias("best")))
    rows = df.withColumn("_tagged", both)
    topics = F.transform("_tagged.topics", lambda t: F.struct(t["topic"].alias("topic"), t["score"].alias("score")))
    return rows.withColumns({"topics": topics, "primary_topic": F.col("_tagged.best.topic")}).drop("_tagged")


def route(text: Column, patterns: dict[str, list[str]]) -> Column:
    """The category with most patterns hit; null if none is hit or the best two tie."""
    scores = [(k, sum((text.rlike("(?i)" + p).cast("int") for p in v), F.lit(0))) for k, v in patterns.items()]
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(k).alias("k")) for k, s in scores]))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.when((first["s"] < 0) & (F.coalesce(second["s"], F.lit(0)) != first["s"]), first["k"])


def cascade(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The label of the first rule that holds."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def flags(*rules: tuple[Column, str | Column]) -> Column:
    """The labels of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, label) for c, label in rules]))


def complexity(score: Column) -> Column:
    return cascade((score <= 0, "LOW"), (score <= 3, "MEDIUM"), otherwise="HIGH")


def question_score(question: Column, entities: Column, difficulty: Column, places: list[str], scenario: str, steps: str, lookup: str) -> Column:
    """How complex a question is: entities it needs, places named, phrases of several steps and of scenarios, length; lookups count less.

    ``places`` are whole words; the others are patterns, all regardless of case.
    """
    any_case = lambda p: "(?i)" + p
    named = sum((question.rlike(any_case(rf"\b{re.escape(p)}\b")).cast("int") for p in places), F.lit(0))
    plain_lookup = question.rlike(any_case(lookup)) & (entities <= 1) & (named == 0)
    return (
        F.when(entities >= 4, 3).when(entities >= 2, 1).otherwise(0) + F.least(named, F.lit(2)) + question.rlike(any_case(steps)).cast("int") * 2
        + (F.regexp_count(question, F.lit(any_case(scenario))) >= 3).cast("int") + (F.size(F.split(F.trim(question), r"\s+")) >= 40).cast("int")
        - plain_lookup.cast("int") * 2 + F.when(difficulty == "complex", 1).when(difficulty == "basic", -1).otherwise(0)
    )


def audit_flags(scanned: Column, keyword: Column, first: Column, body: Column, pages: Column, kilobytes: Column) -> Column:
    """SCANNED; KW-MISS(keyword) if an expected keyword is absent, KW-LATE if only the first part lacks it; STUB under 8 pages; LARGE over 8000 KB."""
    has = lambda t: F.coalesce(F.lower(t).contains(F.lower(keyword)), F.lit(False))
    asked = F.coalesce(keyword, F.lit("")) != ""
    missed = F.concat(F.lit("KW-MISS("), keyword, F.lit(")"))
    return flags((scanned, "SCANNED"), (asked & ~has(body), missed), (asked & has(body) & ~has(first), "KW-LATE"), (pages < 8, "STUB"), (kilobytes > 8000, "LARGE"))


def text_source(chars: Column, pages: Column) -> Column:
    """ocr under 500 characters in all, low_density under 200 a page, else born."""
    return cascade((chars < 500, "ocr"), (chars / F.greatest(pages, F.lit(1)) < 200, "low_density"), otherwise="born")


def length_bucket(length: Column, edges: list[int]) -> Column:
    """"<a", "a-b", ..., ">=z" by ascending edges."""
    rules = [(length < edges[0], f"<{edges[0]}")] + [(length < b, f"{a}-{b}") for a, b in zip(edges, edges[1:])]
    return cascade(*rules, otherwise=f">={edges[-1]}")


def span_check(span: Column, chunk: Column, is_table: Column, cosine: Column | None = None) -> Column:
    """Ladder of a quoted span against its chunk: length, terminator, exact, table, 6-gram Jaccard, cosine; the reason it ends with."""
    from lodestone.functions.text import canonical, char_grams, jaccard

    s, c = canonical(span), canonical(chunk)
    near = jaccard(char_grams(s, 6), char_grams(c, 6))
    rules = [
        (span.isNull() | chunk.isNull(), "null_input"), (~F.length(span).between(80, 450), "length"), (~span.rlike("[.?!;]"), "no_terminator"),
        (s == "", "empty_span"), (c.contains(s), "exact"), (is_table, "table_exact_miss"), (near >= 0.80, "jaccard"),
    ]
    if cosine is not None:
        rules.append((cosine >= 0.92, "cosine"))
    return cascade(*rules, otherwise="miss")
