"""Evaluation of retrieval runs: expectation matching, gates, list merging, failure classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.evidence import same_provision
from lodestone.functions.text import edit_similarity, let
from lodestone.operators.ordering import running_totals
from lodestone.operators.tagging import cascade


def matches(hits: DataFrame, gold: DataFrame, query_id: str, strict: bool = False) -> DataFrame:
    """Adds ``hit`` to ranked hits (doc_id, section, text) of gold items (doc_id, section, linked ids).

    A hit has the gold document or one linked to it, and the gold section if there is
    one: as a parent or child code if strict, else either text within the other.
    """
    g = gold.select(query_id, F.col("doc_id").alias("gold_doc"), F.col("section").alias("gold_section"), F.col("linked").alias("gold_linked"))
    rows = hits.join(g, query_id)
    same_doc = (F.col("doc_id") == F.col("gold_doc")) | F.coalesce(F.array_contains("gold_linked", F.col("doc_id")), F.lit(False))
    a, b = F.lower("section"), F.lower("gold_section")
    section = same_provision(F.col("section"), F.col("gold_section")) if strict else a.contains(b) | b.contains(a)
    hit = same_doc & (F.col("gold_section").isNull() | F.coalesce(section, F.lit(False)))
    return rows.withColumn("hit", hit).drop("gold_doc", "gold_section", "gold_linked")


def expectation_hits(hits: DataFrame, gold: DataFrame, query_id: str, least: int = 20) -> DataFrame:
    """Adds ``hit``: whether a ranked hit (doc_id, linked, section, text) meets any expectation of its item (docs, sections, expected_text).

    It does if it, or a document linked to it, is an expected one; if its section is an
    expected one, or a parent or child of it ("1" is not "12"); or if its text holds the
    expected one of more than ``least`` characters, case aside. Items without expectations
    have no hits; items meet hits in an equi-join.
    """
    rows = hits.join(gold.select(query_id, "docs", "sections", "expected_text"), query_id, "left")
    some = F.array().cast("array<string>")
    same_section = F.exists(F.coalesce("sections", some), lambda s: F.coalesce(same_provision(F.col("section"), s), F.lit(False)))
    wanted = F.lower(F.trim("expected_text"))
    same_text = (F.length(wanted) > least) & F.contains(F.lower("text"), wanted)
    parts = [F.array_contains("docs", F.col("doc_id")), F.arrays_overlap("docs", "linked"), same_section, same_text]
    hit = F.coalesce(parts[0], F.lit(False))
    for p in parts[1:]:
        hit = hit | F.coalesce(p, F.lit(False))
    return rows.withColumn("hit", hit).drop("docs", "sections", "expected_text")


def recall_gate(hits: DataFrame, query_id: str, least: float, errors: Column | None = None, most_errors: int = 0) -> DataFrame:
    """One row: n, hits, recall, errors, passed (recall reached and errors within the budget)."""
    per = hits.groupBy(query_id).agg(F.bool_or("hit").alias("hit"), F.bool_or(F.lit(False) if errors is None else errors).alias("error"))
    one = per.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.count_if("error").alias("errors"))
    return one.withColumn("recall", F.col("hits") / F.nullif("n", F.lit(0))).withColumn("passed", (F.col("recall") >= least) & (F.col("errors") <= most_errors))


def text_gate(rows: DataFrame, exact: Column, a: Column, b: Column, similar: float = 0.95) -> DataFrame:
    """One row: n, exact, similar, combined recall of exact hits or edit similarity."""
    near = exact | (edit_similarity(a, b) >= similar)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(exact).alias("exact"), F.count_if(near).alias("combined"), F.avg(near.cast("int")).alias("recall"))


def refusal_rate(scores: DataFrame, query_id: str, score: str, theta: float) -> DataFrame:
    """One row: n and the share of queries whose best score is under theta."""
    best = scores.groupBy(query_id).agg(F.max(score).alias("best"))
    return best.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("best") < theta).cast("int")).alias("refused"))


def merged_lists(*lists: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Union of ranked lists: the first occurrence (by list, then rank) of each key, ``most`` in all, in that order."""
    rows = None
    for k, ranked in enumerate(lists):
        part = ranked.withColumn("_list", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_list", "rank")).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    return first.orderBy("_list", "rank", *keys).limit(most).drop("_list")


def best_per_passage(rows: DataFrame, source: str, text: str, score: str, head: int = 120) -> DataFrame:
    """Of rows with one source and one beginning of text the best scored."""
    key = F.substring(text, 1, head)
    best = rows.groupBy(source, key.alias("_head")).agg(F.max_by(F.struct(*[c for c in rows.columns if c != source]), score).alias("r"))
    return best.select(source, *[F.col(f"r.{c}").alias(c) for c in rows.columns if c != source])


def near_ids(queries: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """query_id, item_id, d: for each query the ``most`` items before and after it in order of ids, so the nearest ones are among them.

    Queries and items are numbered in one order by the items before them; a query meets
    the items of the numbers around its own. Rows without an id are left out.
    """
    own = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").alias("_id"), F.lit(1).alias("_item"))
    asked = queries.where(F.col("query_id").isNotNull()).select(F.col("query_id").alias("_id"), F.lit(0).alias("_item"))
    rows = running_totals(own.unionByName(asked).withColumn("_asked", 1 - F.col("_item")), ["_id", "_asked"], {"_before": "_item"})
    around = F.explode(F.sequence(F.col("_before") - most, F.col("_before") + most - 1)).alias("_place")
    places = rows.where("_asked = 1").select(F.col("_id").alias("query_id"), around)
    numbered = rows.where("_item = 1").select(F.col("_id").alias("item_id"), F.col("_before").alias("_place"))
    return places.join(numbered, "_place").select("query_id", "item_id", F.abs(F.col("query_id") - F.col("item_id")).alias("d"))


def attach_negatives(pairs: DataFrame, negatives: DataFrame, query_id: str, most: int) -> DataFrame:
    """Each pair with its negatives in order of rank (an array, ``most`` at most); pairs without any keep an empty one."""
    few = negatives.where(F.col("rank") <= most)
    listed = few.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("_n"))
    return pairs.join(listed, query_id, "left").withColumn("negatives", F.transform(F.coalesce("_n", F.array().cast(listed.schema["_n"].dataType)), lambda n: n["item_id"])).drop("_n")


def failure_class(expected_acts: Column, found_acts: Column, expected_sections: Column, found_sections: Column, rate_question: Column, notification_expected: Column, procedural_share: Column, substantive: Column, best_score: Column) -> Column:
    """Why a miss missed, first rule first."""
    return cascade(
        (F.arrays_overlap(expected_sections, found_sections), "notation_mismatch"), (rate_question & notification_expected, "rate_notification_miss"),
        ((F.size(expected_acts) > 0) & (F.size(found_acts) > 0) & ~F.arrays_overlap(expected_acts, found_acts), "wrong_domain"),
        ((substantive & (procedural_share >= 0.6)) | (~substantive & (procedural_share <= 0.2)), "procedural_confusion"),
        (F.arrays_overlap(expected_acts, found_acts) & (F.size(expected_sections) > 0), "right_act_wrong_section"), (best_score < 0.35, "no_authoritative_chunk"),
        otherwise="right_act_wrong_section",
    )


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def found_in(expected: Column, answer: Column) -> Column:
    """The expected texts that an answer contains, case and runs of blanks aside; an empty one is in every answer, null arrays have none."""
    return let(_plain(answer), lambda a: F.filter(F.coalesce(expected, F.array().cast("array<string>")), lambda e: F.contains(a, _plain(e))))


def answer_points(answer: Column, expected: list[Column], forbidden: Column, verbatim_required: Column, verified_quotes: Column) -> Column:
    """points, most, forbidden_hits and verbatim_pass of an answer.

    A point for each expected text that it contains, one off for each forbidden one, and
    one for the gate: where a verbatim citation is required, one verified quote at least.
    """
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    some = F.array().cast("array<string>")
    every = [F.coalesce(e, some) for e in expected]
    hits = sum((F.size(found_in(e, answer)) for e in every), F.lit(0))
    bad = F.size(found_in(forbidden, answer))
    required = F.coalesce(verbatim_required, F.lit(False))
    passed = ~required | (size(F.coalesce(verified_quotes, some)) >= 1)
    gate = (required & passed).cast("int")
    return F.struct((hits - bad + gate).alias("points"), (sum((F.size(e) for e in every), F.lit(0)) + required.cast("int")).alias("most"), bad.alias("forbidden_hits"), passed.alias("verbatim_pass"))
