"""References, alias classes and phrase tables on hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import phrases, references
from lodestone.operators.components import components


def test_components_of_names_and_numbers(spark):
    pairs = [("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("z", None)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r.label for r in components(chain).collect()} == {0}
    assert components(chain.where("a < 0")).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "code"),
    [
        ("Section 16(2)(aa) CGST", "section", "16(2)(aa)"), ("10(1)(A) IGST", "section", "10(1)(a)"), ("see sec. 17 (5)", "section", "17(5)"), ("Rule 36 (4)", "rule", "36(4)"), ("rule 3A of 2004", "rule", "3a"),
        ("66/2017-Central Tax", "notification", "66/2017"), ("No. 1 / 98", "notification", "1/98"), ("outside scope", "other", None), ("", "other", None), (None, "other", None), ("section 68", "section", "68"),
    ],
)
def test_parsed_forms(spark, text, kind, code):
    row = spark.createDataFrame([(text,)], "t string").select(references.parsed(F.col("t")).alias("p")).first().p
    assert (row.kind, row.code) == (kind, code)


@pytest.mark.parametrize(("code", "up"), [("16", ["16"]), ("16(2)(b)", ["16", "16(2)", "16(2)(b)"]), ("66/2017", ["66/2017"])])
def test_ancestors(spark, code, up):
    assert spark.range(1).select(references.ancestors(F.lit(code)).alias("u")).first().u == up


@pytest.mark.parametrize(
    ("gold", "hit", "strict", "lenient"),
    [("16", "16", True, True), ("16", "16(2)(b)", True, True), ("16(2)(b)", "16", True, True), ("16(2)", "16(3)", False, False), ("16(2)(b)", "16(2)(c)", False, True), ("1", "12", False, False), ("12", "1", False, False), ("16(2)", "16(2)(b)", True, True), ("16(2)(b)", "16(1)(b)", False, False)],
)
def test_codes_match_as_parents(spark, gold, hit, strict, lenient):
    side = lambda code: spark.createDataFrame([(1, "section", code, "r"), (1, "rule", code + "9", "other")], "item int, kind string, code string, ref string")
    found = lambda s: references.code_matches(side(gold), side(hit).where("ref = 'r'"), "item", s).count() == 1
    assert (found(True), found(False)) == (strict, lenient)


def test_names_of_one_class(spark):
    pairs = spark.createDataFrame([("CGST Act", "Central Goods and Services Tax Act"), ("Central Goods and Services Tax Act", "cgst"), ("IGST", "integrated act")], "name string, alias string")
    classes = references.alias_classes(pairs)
    gold = spark.createDataFrame([(1, "g", "Section 16 CGST"), (2, "h", "Section 16"), (3, "i", "Section 16 IGST")], "item int, ref string, text string")
    rows = [(i, f"{i}{k}", t) for i in (1, 2, 3) for k, t in enumerate(["section 16(2) of the central goods and services tax act", "section 16 of the integrated act", "section 16 cgstx", "section 160 cgst"])]
    hits = spark.createDataFrame([*rows, (1, "no", None), (9, "far", "section 16 cgst")], gold.schema)
    got = sorted(r.ref for r in references.reference_matches(gold, hits, "item", "text", classes).collect())
    assert got == ["10", "20", "21", "22", "31"]


DOCS = [(1, "Input tax credit; input TAX credit is tax credit"), (2, "tax"), (3, None), (4, ""), (5, "credit note. tax credit note"), (6, "élan tax crédit")]
RULES = [("gst:itc", "input tax", 0), ("gst:itc", "tax credit", 1), ("gst:itc", "credit", 2), ("vat:note", "Credit-Note", 0), ("vat:long", "tax credit note", 1), ("x", "", 0), ("fr:a", "crédit", 0)]


@pytest.mark.parametrize("most", [10_000, 1])
def test_topics_from_a_table(spark, monkeypatch, most):
    monkeypatch.setattr(phrases, "PHRASES_IN_PLAN", most)
    monkeypatch.setattr(phrases.gram_hits, "__defaults__", (most,))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("topic", F.lit("clash")).withColumn("kind", F.when(F.col("doc_id") < 5, "gst"))
    table = spark.createDataFrame(RULES, "topic string, phrase string, place int")
    got = {(r.doc_id, r.topic): r.score for r in phrases.topics(docs, "doc_id", "text", table).collect()}
    plain = {}
    for doc, text in DOCS:
        words = re.findall("[a-z0-9ß-ÿ]+", (text or "").lower())
        for topic in {t for t, _, _ in RULES}:
            own = [(p, re.findall("[a-z0-9ß-ÿ]+", ph.lower())) for t, ph, p in RULES if t == topic]
            at, taken = 0, set()
            while at < len(words):
                hit = next((ph for _, ph in sorted(own) if ph and words[at : at + len(ph)] == ph), None)
                at += len(hit) if hit else 1
                taken |= {tuple(hit)} if hit else set()
            if taken:
                plain[doc, topic] = len(taken)
    assert got == plain and got[1, "gst:itc"] == 3
    kept = {(r.doc_id, r.topic) for r in phrases.topics(docs, "doc_id", "text", table, "kind").collect()}
    assert kept == {(d, t) for d, t in plain if d >= 5 or t.startswith("gst:")}
    best = {r.doc_id: (r.primary_topic, r.n_topics) for r in phrases.primary(phrases.topics(docs, "doc_id", "text", table), "doc_id").collect()}
    assert best[5] == ("gst:itc", 3) and best[6] == ("fr:a", 1) and 2 not in best


def test_phrases_that_are_too_long(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    table = spark.createDataFrame([("t", " ".join("abcdefghijklmn"), 0)], "topic string, phrase string, place int")
    with pytest.raises(ValueError, match="14 tokens"):
        phrases.topics(docs, "doc_id", "text", table)
    assert phrases.topics(docs, "doc_id", "text", table.where("place > 0")).count() == 0


def test_scores_of_topics_in_tasks_and_by_joins(spark, monkeypatch):
    """The scan inside a task agrees with the joins on overlapping phrases, repeated ids, categories, and slices of any size; and it deals no hits."""
    texts = [" ".join("abcde"[(k * k + j * j * (k % 7 + 1) + j // 3) % 5] for j in range(k * 3)) for k in range(40)] + ["", None, "ab, A b! a"]
    docs = spark.createDataFrame([(k if k < 36 else 36, text, (None, "x", "y", "z")[k % 4]) for k, text in enumerate(texts)], "doc_id long, text string, kind string")
    rules = [(f"{'xy'[k % 2]}:{k % 6}", " ".join("abcde"[(k * 3 + j * k) % 5] for j in range(k % 4 + 1)), k * 5 % 7) for k in range(60)]
    table = spark.createDataFrame(rules, "topic string, phrase string, place int")
    results = []
    for most, pairs in ((200_000, 1 << 20), (200_000, 5), (0, 1 << 20)):
        monkeypatch.setattr(phrases, "PHRASES_IN_TASK", most)
        monkeypatch.setattr("lodestone.operators.phrase_scan.PAIRS_AT_ONCE", pairs)
        found = [phrases.topics(docs, "doc_id", "text", table), phrases.topics(docs.where("doc_id < 36"), "doc_id", "text", table, "kind"), phrases.summaries(docs, "doc_id", "text", table)]
        results.append([sorted(map(str, f.select(sorted(f.columns)).collect())) for f in found])
    assert results[0] == results[1] == results[2] and all(len(r) > 30 for r in results[0])
    monkeypatch.setattr(phrases, "PHRASES_IN_TASK", 200_000)
    plan = phrases.summaries(docs.where("doc_id < 36"), "doc_id", "text", table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_text_is_read_once_however_many_rows_hold_it(spark, monkeypatch):
    read, durable = [], references.durable
    monkeypatch.setattr(references, "durable", lambda df: (lambda kept: (read.append((kept.columns, kept.count())), kept)[1])(durable(df)))
    classes = spark.createDataFrame([("cgst", "cgst"), ("igst", "igst")], "name string, class string")
    gold = spark.range(300).select(F.col("id").alias("item"), F.concat(F.lit("g"), "id").alias("ref"), F.when(F.col("id") % 2 == 0, "section 16(2) cgst").otherwise("section 16").alias("text"))
    hits = spark.range(300).select(F.col("id").alias("item"), F.concat(F.lit("h"), "id").alias("ref"), F.when(F.col("id") % 3 == 0, "sec. 16 igst").otherwise("sec. 16(2)(a) cgst").alias("text"))
    got = sorted(r.item for r in references.reference_matches(gold, hits, "item", "text", classes, True).collect())
    assert got == [k for k in range(300) if k % 2 or k % 3]
    assert [n for columns, n in read if "up" in columns and "text" in columns] == [4]
