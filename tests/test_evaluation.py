"""Evidence functions and evaluation operators on hand-made rows."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import evidence as E
from lodestone.operators import evaluation as V
from lodestone.operators import retrieval as R


def values(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_question_classes(spark):
    assert values(spark, *[E.query_tier(F.lit(t)) for t in ("Section 16 of the Act", "which rules apply", "hello")]) == ("hard", "soft", "none")
    acts = ["CGST", "IGST"]
    assert values(spark, *[E.needs_decomposition(F.lit(t), acts) for t in ("CGST and IGST rates", "compare a and b", "what is x?", "a? b? c?")]) == (True, True, False, True)
    assert values(spark, E.wants_passage(F.lit("what is supply")), E.wants_passage(F.lit("section 7"))) == (True, False)
    assert values(spark, E.anchors(F.lit("Refund of tax and refund of duty"), ["duty", "refund", "tax"])) == (["refund", "tax", "duty"],)


def test_relevance_and_paths(spark):
    got = values(spark, E.relevant(F.lit("a notification about exemption of machinery no 12"), F.lit("Exemption for Machinery parts"), F.lit("12")), E.relevant(F.lit("nothing"), F.lit("Exemption for Machinery"), F.lit("99")))
    assert got == (True, False)
    row = values(spark, E.path_parts(F.lit("/CX/Circulars/2017/a.pdf"), {"cx": "central-excise"}))[0]
    assert tuple(row) == ("central-excise", "circulars", 2017)


def test_file_status(spark):
    pdf = "%PDF" + "x" * 500
    cases = [(None, 1, 99), ("<html>", 1, 99), ("%PDF", 1, 99), (pdf, 0, 99), (pdf, 3, 10), (pdf, 3, 99)]
    got = values(spark, *[E.file_status(F.lit(c).cast("string").cast("binary"), F.lit(p), F.lit(n)) for c, p, n in cases])
    assert got == ("missing", "corrupt", "error_page", "corrupt", "image_only", "ok")


def test_quotes_and_citations(spark):
    answer = F.lit('It says *"the tax shall be paid by all"* [S2]. Also "short" [S1].')
    found = values(spark, E.quotes(answer))[0]
    assert [(q.quote, q.source) for q in found] == [("the tax shall be paid by all", 2)]
    checks = values(spark, *[E.quote_check(F.lit(q), F.lit("He said “the  tax” — is due")) for q in ("the  tax", '"the tax" - is', "other")])
    assert checks == ("exact", "normalised", "missing")
    text, context = F.lit("Section 16 applies. Section 99 applies too. Pay tax."), F.lit("Under section 16 credit is allowed.")
    assert values(spark, E.supported_sentences(text, context)) == ("Section 16 applies. Pay tax.",)
    assert values(spark, E.warnings(F.lit("TODO. Rule 5 is it. Same. Same. Same."), context)) == (["placeholder", "unsupported_section", "repeated_sentence"],)


def test_verdicts_and_sections(spark):
    assert values(spark, *[E.verdict(F.lit(t)) for t in ('ok {"verdict": "Partial"}', "Yes, it is", "maybe")]) == ("partial", "yes", "unknown")
    pairs = [("16", "Section 16(2)(b)"), ("1", "12"), ("rule 36", "36")]
    assert values(spark, *[E.same_provision(F.lit(a), F.lit(b)) for a, b in pairs]) == (True, False, True)


def test_small_assemblies(spark):
    got = values(spark, E.distinct_terms(F.array(*map(F.lit, ["Tax", "duty", "TAX"]))), E.evidence_block(F.array(F.lit("abc"), F.lit("defg")), 3), E.duration(F.lit(93_784)))
    assert got == (["Tax", "duty"], "[S1] abc\n\n[S2] def", "1d 02:03:04")


def test_tolerant_json(spark):
    texts = ['{"a": 1}', '```json\n{"a": [1, 2,],}\n```', 'x {"a": {"b": "c', "no json", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.j for r in rows.select("k", E.tolerant_json(F.col("t")).alias("j")).orderBy("k").collect()]
    assert got == ['{"a": 1}', '{"a": [1, 2]}', '{"a": {"b": "c"}}', None, None]


def test_matching_lenient_and_strict(spark):
    hits = spark.createDataFrame([(1, 1, "d1", "Section 12"), (1, 2, "d2", "Section 1(2)"), (1, 3, "d9", "Section 1")], "q int, rank int, doc_id string, section string")
    gold = spark.createDataFrame([(1, "d1", "1", ["d2"])], "q int, doc_id string, section string, linked array<string>")
    of = lambda strict: {r.rank: r.hit for r in V.matches(hits, gold, "q", strict).collect()}
    assert of(False) == {1: True, 2: True, 3: False}
    assert of(True) == {1: False, 2: True, 3: False}
    gate = V.recall_gate(V.matches(hits, gold, "q", True), "q", 0.9).first()
    assert gate.recall == 1.0 and gate.passed


def test_failure_classes(spark):
    array = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    no, one = F.lit(False), F.lit(0.5)
    base = lambda acts, found, sections, got, score=0.9: V.failure_class(acts, found, sections, got, no, no, one, F.lit(True), F.lit(score))
    got = values(spark, base(array("a"), array("b"), array("1"), array("1")), base(array("a"), array("b"), array("1"), array("2")), base(array("a"), array("a"), array("1"), array("2")), base(array(), array(), array(), array(), 0.1))
    assert got == ("notation_mismatch", "wrong_domain", "right_act_wrong_section", "no_authoritative_chunk")


@pytest.mark.parametrize("n_items", [0, 2, 60])
def test_near_ids_hold_the_nearest(spark, n_items):
    import random

    draw = random.Random(n_items)
    items = [draw.randrange(200) for _ in range(n_items)]
    queries = [draw.randrange(-50, 250) for _ in range(40)] + [100] * 3
    q = spark.createDataFrame([(x,) for x in queries], "query_id long").repartition(3)
    i = spark.createDataFrame([(x,) for x in items], "item_id long").repartition(3)
    rows = V.near_ids(q, i, 3).collect()
    for x in set(queries):
        got = sorted((r.d, r.item_id) for r in rows if r.query_id == x)
        exact = sorted((abs(x - y), y) for y in items for _ in range(queries.count(x)))
        assert got[:3] == exact[:3] and len(got) <= 6 * queries.count(x)


def test_negatives_are_not_paired_by_label(spark, sf_dir):
    import re

    from lodestone.plans import registry

    plan = registry.QUERIES["pairs_with_negatives"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not re.search(r"Join \w+, .*label", plan)


@pytest.fixture(scope="module")
def small_corpus(spark):
    docs = [(1, "red fox runs", "en"), (2, "red fox", "fr"), (3, "red fox fox fox", "fr"), (4, "blue whale", "en"), (5, None, "en"), (6, "", None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string")


def test_filters_hold_before_ranks(spark, small_corpus):
    items = spark.createDataFrame([(0, "red fox", "en"), (1, "red fox", "de"), (2, "red fox", None), (3, "whale", "fr")], "item_id long, text string, asked_lang string")
    asked = R.postings(items, "item_id", "text").join(items.select("item_id", "asked_lang"), "item_id")
    posts = R.asked_postings(small_corpus, "doc_id", "text", asked, ("lang",))
    holds = F.col("asked_lang").isNull() | (F.col("lang") == F.col("asked_lang"))
    got = sorted((r.item_id, r.rank, r.doc_id, r.filtered) for r in R.filtered_search(posts, "doc_id", asked, "item_id", 1, holds).collect())
    best = R.bm25_search(posts, "doc_id", asked.drop("asked_lang"), "item_id", 1).where("item_id = 0").first().doc_id
    assert best != 1  # the filter brings in what a filter of the one best hit would lose
    assert got == [(0, 1, 1, True), (1, 1, best, False), (2, 1, best, True), (3, 1, 4, False)]


def test_asked_terms_in_the_plan_or_joined(spark, small_corpus, monkeypatch):
    asked = spark.createDataFrame([("red",), ("whale",)], "term string")
    rows = lambda: sorted(map(tuple, R.asked_postings(small_corpus, "doc_id", "text", asked, ("lang",)).collect()))
    few = rows()
    monkeypatch.setattr(R, "TERMS_IN_PLAN", 1)
    assert rows() == few and (1, "red", 1, 3, "en") in few and all(r[1] in ("red", "whale", R.WHOLE) for r in few)


def test_rates_in_force_only(spark):
    docs = spark.createDataFrame([(1, "tea leaf"), (2, "tea"), (3, "tea leaf green")], "id long, text string")
    rates = spark.createDataFrame([(1, 0, 10, 5.0), (1, 10, None, 6.0), (2, 0, 4, 1.0)], "id long, valid_from int, valid_to int, rate double")
    asked = spark.createDataFrame([(7, "tea leaf green", 3), (8, "tea leaf green", 12), (9, "coffee", 3)], "q long, text string, day int")
    got = sorted((r.q, r.rank, r.id, r.rate) for r in R.in_force_search(docs, "id", "text", asked, "q", "day", rates, 5, ["rate"]).collect())
    assert got == [(7, 1, 1, 5.0), (7, 2, 2, 1.0), (8, 1, 1, 6.0)]


def test_neighbours_of_one_payload_and_length(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.5, 0.5], "a"), (4, [0.0, 1.0], None), (5, None, "a"), (6, [0.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "id long, v array<double>, kind string")
    found = lambda same: [(r.query_id, r.item_id) for r in R.nearest(df.where("id in (1, 4)"), "id", df, "id", "v", 1, same).orderBy("query_id").collect()]
    assert found(None) == [(1, 2), (4, 3)] and found("kind") == [(1, 3)]
    odd = df.unionByName(spark.createDataFrame([(9, [1.0], "a")], df.schema))
    with pytest.raises(ValueError, match="1 to 2 components"):
        R.nearest(odd.where("id = 1"), "id", odd, "id", "v", 1)


def test_points_with_arrays_and_the_verbatim_gate(spark):
    rows = [
        ("Section 16(2)  applies;\n credit allowed", ["section 16(2) applies", "Rule 36"], ["CREDIT"], ["refund"], True, ["q"]), ("no", ["x"], [], ["no"], True, []), (None, ["x", ""], None, None, False, None), ("any", None, None, None, None, None), ("", [], [], [], True, None),
    ]
    df = spark.createDataFrame(rows, "a string, secs array<string>, kws array<string>, bad array<string>, need boolean, quotes array<string>")
    points = V.answer_points(F.col("a"), [F.col("secs"), F.col("kws")], F.col("bad"), F.col("need"), F.col("quotes"))
    got = [tuple(r.p) for r in df.select(points.alias("p")).collect()]
    assert got == [(3, 4, 0, True), (-1, 2, 1, False), (1, 2, 0, True), (0, 0, 0, True), (0, 1, 0, False)]


def test_rates_in_force_behind_many_that_are_not(spark, monkeypatch):
    """Copies of a text are scored once, and a query reads on until it has its k or all documents, whatever it reads at first."""
    docs = spark.createDataFrame([(k, ("tea leaf", "tea", "leaf green", "tea leaf")[k % 4]) for k in range(60)], "id long, text string")
    rates = spark.createDataFrame([(k, 10 * (k % 5), None if k % 2 else 10 * (k % 5) + 3, float(k)) for k in range(60)], "id long, valid_from int, valid_to int, rate double")
    asked = spark.createDataFrame([(1, "tea leaf", 1), (2, "tea leaf", 45), (2, "green", 45), (3, "leaf", 0), (4, "tea", -1), (5, None, 3), (6, "tea tea", 22)], "q long, text string, day int")
    terms, scored = [], R.bm25_scores

    def noted(posts, *rest, **more):
        terms.append(posts.select(posts.columns[0]).distinct().count())
        return scored(posts, *rest, **more)

    monkeypatch.setattr(R, "bm25_scores", noted)
    run = lambda reach: sorted(tuple(r) for r in R.in_force_search(docs, "id", "text", asked, "q", "day", rates, 3, ["rate"], reach).select("q", "rank", "id", "score", "rate").collect())
    own = R.postings(asked, "q", "text")
    scores = scored(R.asked_postings(docs, "id", "text", own), "id", own, "q").join(asked.select("q", "day"), "q").join(rates, "id")
    in_force = scores.where("valid_from <= day and (valid_to is null or valid_to > day)")
    plain = sorted(tuple(r) for r in R.top(in_force, ["q"], [F.desc("score"), F.col("id"), F.col("rate")], 3).select("q", "rank", "id", "score", "rate").collect())
    assert run(1) == run(None) == run(100) == plain and len(plain) == 12
    assert terms == [3, 3, 3]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_channels_in_tasks_and_by_joins_are_those_of_plain_scores(spark, small_corpus, monkeypatch, most):
    monkeypatch.setattr(R, "ASKED_IN_TASK", most)
    monkeypatch.setattr(R, "CELLS_AT_ONCE", 8)
    asked = R.postings(small_corpus.where("doc_id % 2 = 0").select("doc_id", "text"), "doc_id", "text").withColumnRenamed("doc_id", "item_id")
    posts = R.asked_postings(small_corpus, "doc_id", "text", asked)
    every = sorted((r.item_id, -r.score, r.doc_id) for r in R.bm25_scores(posts, "doc_id", asked, "item_id", F.col("item_id") != F.col("doc_id")).collect())
    got = R.term_channels(small_corpus, "doc_id", "text", asked, "item_id", 2, apart=True).where("channel = 'score'").collect()
    plain = [(q, d, s) for n, (q, s, d) in enumerate(every) if sum(e[0] == q for e in every[:n]) < 2]
    assert sorted((r.item_id, r.doc_id, -r.score) for r in got) == sorted(plain) and plain


@pytest.mark.parametrize(("words", "within"), [(200_000, True), (3, False)])
def test_features_in_tasks_and_by_joins_are_those_of_all_features(spark, monkeypatch, words, within):
    """Features cut off among ties, pairs next to rare words and copies: documents' features are no rows unless words do not fit a task."""
    texts = ["red fish swims", "red fish red fish", "blue whale swims far", "ab zeta ab c1", "red", "the of", "", None, "fish swims red whale", "ab c1 ab c1 ab zeta", "red fish swims"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red fish swims far"), (1, "ab c1"), (2, "blue whale"), (3, "nothing known"), (4, None)], "item_id long, text string")
    wanted = {m: sorted(map(tuple, R._joined_tfidf(docs, "doc_id", asked, "item_id", "text", 3, m).collect())) for m in (5, 1000)}
    listed, features = [], R.features
    monkeypatch.setattr(R, "FREQUENT_IN_TASK", words)
    monkeypatch.setattr(R, "features", lambda df, *rest: listed.append(df) or features(df, *rest))
    for most, rows in wanted.items():
        assert sorted(map(tuple, R.tfidf_search(docs, "doc_id", asked, "item_id", "text", 3, most).collect())) == rows and rows
    assert bool(listed) != within
    if not within:
        return
    twice = docs.unionByName(docs.where("doc_id = 1"))
    assert sorted(map(tuple, R.tfidf_search(twice, "doc_id", asked, "item_id", "text", 3).collect())) == sorted(map(tuple, R._joined_tfidf(twice, "doc_id", asked, "item_id", "text", 3, 10_000).collect()))


@pytest.mark.parametrize(("known", "shared"), [(100_000, False), (2, False), (100_000, True)])
def test_norms_of_documents_are_those_of_all_their_postings(spark, monkeypatch, known, shared):
    """Postings are rows only where documents share an id; terms that tasks do not know meet their frequencies in a join."""
    texts = ["red fish swims", "red fish red fish", "blue whale swims far", "red", "the of", "", None, "fish fish swims red whale", "rare one two rare"]
    rows = [(k if k else None, t) for k, t in enumerate(texts)] + ([(1, "red sails"), (None, "blue")] if shared else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = {}
    for key, text in rows:
        of[key] = of.get(key, []) + [w for w in (text or "").split() if w not in ("the", "of")]
    of = {key: Counter(terms) for key, terms in of.items() if terms}
    df = Counter(term for terms in of.values() for term in terms)
    wanted = {key: (len(terms), pytest.approx(math.sqrt(sum((tf * math.log(len(of) / df[w])) ** 2 for w, tf in terms.items())))) for key, terms in of.items()}
    posted, postings = [], R.postings
    monkeypatch.setattr(R, "KNOWN_IN_TASK", known)
    monkeypatch.setattr(R, "postings", lambda *args: posted.append(args) or postings(*args))
    assert {r.doc_id: (r.n, r.norm) for r in R.tfidf_norms(docs, "doc_id", "text").collect()} == wanted
    assert {r.term: r.df for r in R.term_frequencies(docs, "doc_id", "text").collect()} == df | {R.WHOLE: len(of)}
    assert bool(posted) == shared


def test_norms_of_no_terms(spark):
    docs = spark.createDataFrame([(1, "the"), (2, None)], "doc_id long, text string")
    assert R.tfidf_norms(docs, "doc_id", "text").count() == 0
