"""Evaluation queries: gates, merged lists, best passages, verdicts and structural checks on the given texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import evidence as E
from lodestone.functions import text as T
from lodestone.operators import evaluation as V
from lodestone.operators import retrieval as R
from lodestone.operators.containment import first_holders
from lodestone.session import durable

from .registry import Tables, query
from .retrieval import _POSTS, _TERMS, BM25, bm25_hits, scores_sql


def any_case(word: str) -> str:
    """A pattern of an ASCII word in any case; (?i) of some engines takes letters of other scripts too."""
    return "".join(f"[{c}{c.upper()}]" for c in word)


#: What :func:`lodestone.functions.evidence.verdict` says, for an engine without look-around: a JSON field first, else the first whole word.
_APART = r"[^\pL\pM\pN_]"
_FIELD = r"""lower(json_extract_string(try_cast(nullif(regexp_extract(text, '(?s)(\{.*\})', 1), '') AS JSON), '$.verdict'))"""
_WORD = f"lower(regexp_extract(text, '(?:^|{_APART})({any_case('yes')}|{any_case('no')}|{any_case('partial')})(?:{_APART}|$)', 1))"
VERDICT = f"CASE WHEN {_FIELD} IN ('yes', 'no', 'partial') THEN {_FIELD} ELSE coalesce(nullif({_WORD}, ''), 'unknown') END"


@query(
    """
    WITH h AS (SELECT conv_id, bool_or(quality = 1) AS hit, bool_or(toxic = 1) AS error FROM conversations c JOIN labels l ON l.doc_id = c.conv_id GROUP BY conv_id)
    SELECT count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (error) AS errors, count(*) FILTER (hit) / count(*) AS recall,
           count(*) FILTER (hit) / count(*) >= 0.8 AND count(*) FILTER (error) <= 10 AS passed FROM h"""
)
def recall_gate(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id").join(t.labels, F.col("conv_id") == F.col("doc_id")).withColumn("hit", F.col("quality") == 1)
    return V.recall_gate(rows, "conv_id", 0.8, F.col("toxic") == 1, 10)


@query(
    """
    WITH p AS (SELECT p_brand = 'Brand#1' AS exact, lower(trim(p_name)) AS a, lower(trim(p_type)) AS b FROM part)
    SELECT count(*) AS n, count(*) FILTER (exact) AS exact, count(*) FILTER (exact OR 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.3) AS combined,
           avg((exact OR 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.3)::INT) AS recall FROM p"""
)
def text_gate(t: Tables) -> DataFrame:
    return V.text_gate(t.part, F.col("p_brand") == "Brand#1", F.col("p_name"), F.col("p_type"), 0.3)


@query("SELECT count(*) AS n, avg((best < 90)::INT) AS refused FROM (SELECT user_id, max(value) AS best FROM events GROUP BY user_id)")
def refusal_rate(t: Tables) -> DataFrame:
    return V.refusal_rate(t.events, "user_id", "value", 90.0)


@query(
    """
    WITH a AS (SELECT c_custkey AS id, 0 AS l, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer WHERE c_mktsegment = 'BUILDING'),
    b AS (SELECT o_custkey AS id, 1 AS l, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS rank FROM orders GROUP BY o_custkey),
    u AS (SELECT id, l, rank, row_number() OVER (PARTITION BY id ORDER BY l, rank) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT id, rank FROM u WHERE n = 1 ORDER BY l, rank LIMIT 400"""
)
def merged_lists(t: Tables) -> DataFrame:
    rich = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("s"))
    spent = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("s"))
    ranked = [R.top(rows.withColumn("g", F.lit(1)), ["g"], [F.desc("s"), F.col("id")], 400).select("id", "rank") for rows in (rich, spent)]
    return V.merged_lists(*ranked, keys=["id"], most=400)


@query(
    """
    SELECT source, substr(text, 1, 120) AS head, max(doc_id) AS doc_id FROM documents GROUP BY source, substr(text, 1, 120)"""
)
def best_passages(t: Tables) -> DataFrame:
    best = V.best_per_passage(t.documents.select("source", "text", "doc_id"), "source", "text", "doc_id")
    return best.select("source", F.substring("text", 1, 120).alias("head"), "doc_id")


@query(
    rf"""
    SELECT conv_id, turn, regexp_matches(text, '(?:^|{_APART})(?:{any_case("section")}|{any_case("rule")}|{any_case("article")})[\x09-\x0D\x20]*[0-9]') AS cites, len(regexp_extract_all(text, '\?')) AS asks,
           {VERDICT} AS verdict FROM conversations"""
)
def answer_profile(t: Tables) -> DataFrame:
    text = F.col("text")
    # Words are whole among letters of any script ("ñno" holds no "no"), in both engines.
    return t.conversations.select("conv_id", "turn", text.rlike(rf"(?i)(?<!{E.IN_WORD})(section|rule|article)[\x09-\x0D\x20]*[0-9]").alias("cites"), F.regexp_count(text, F.lit(r"\?")).cast("long").alias("asks"), E.verdict(text).alias("verdict"))


@query(
    """
    SELECT page_id, lower(string_split(regexp_replace(url, '^https?://', ''), '/')[2]) AS subcategory, nullif(regexp_extract(url, '(?:19|20)[0-9]{2}', 0), '')::INT AS year FROM pages"""
)
def url_parts(t: Tables) -> DataFrame:
    parts = E.path_parts(F.regexp_replace("url", "^https?://", ""), {})
    return t.pages.select("page_id", parts.alias("p")).select("page_id", "p.subcategory", "p.year")


@query(
    f"""
    SELECT doc_id, regexp_matches(text, '^\\s*($|{E.BAD_CUT})') AS cut_badly, length(text) < 180 AND NOT regexp_matches(text, '(?i)\\b(section|rule|notification|circular|act)\\b') AS wants_passage, len(list_distinct(regexp_extract_all(lower(text), ' (the|and|of|der|und|les|que|los) ', 1))) AS anchors FROM documents"""
)
def cut_and_anchors(t: Tables) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit(" (the|and|of|der|und|les|que|los) "), 1)
    return t.documents.select("doc_id", E.cut_badly(F.col("text")).alias("cut_badly"), E.wants_passage(F.col("text")).alias("wants_passage"), F.size(F.array_distinct(found)).cast("long").alias("anchors"))


@query(
    """
    WITH p AS (SELECT DISTINCT vec_id AS query_id FROM embeddings WHERE label = 3), s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, abs(a.vec_id - b.vec_id) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label + 1 WHERE a.label = 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rank FROM s)
    SELECT p.query_id, coalesce(list(item_id ORDER BY rank) FILTER (rank <= 3), []) AS negatives FROM p LEFT JOIN r ON p.query_id = r.query_id GROUP BY p.query_id"""
)
def pairs_with_negatives(t: Tables) -> DataFrame:
    queries = t.embeddings.where("label = 3").select(F.col("vec_id").alias("query_id"))
    near = V.near_ids(queries, t.embeddings.where("label = 2").select(F.col("vec_id").alias("item_id")), 3)
    return V.attach_negatives(queries.distinct(), R.top(near, ["query_id"], [F.col("d"), F.col("item_id")], 3), "query_id", 3)


def _entities(t: Tables) -> DataFrame:
    """The three longest distinct words of each benchmark item."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0))
    longest = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 3)
    return t.benchmark.select("item_id", F.explode(longest).alias("e")).select("item_id", F.col("e.w").alias("entity"))


@query(
    f"""
    WITH {BM25}, e AS (SELECT item_id, unnest(list_slice(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')), lambda w: struct_pack(n := -length(w), w := w))), 1, 3)).w AS entity FROM benchmark),
    found AS (SELECT e.item_id, entity, b.rank FROM e JOIN bm25 b ON e.item_id = b.item_id JOIN documents d ON d.doc_id = b.doc_id WHERE contains(lower(d.text), entity))
    SELECT e.item_id, e.entity, coalesce(list(rank ORDER BY rank) FILTER (rank IS NOT NULL), []) AS ranks FROM e LEFT JOIN found h ON e.item_id = h.item_id AND e.entity = h.entity GROUP BY ALL"""
)
def entity_ranks(t: Tables) -> DataFrame:
    """For each item's entities the ranks of the hits that contain them: items meet hits on their id."""
    hits = bm25_hits(t).join(t.documents.select("doc_id", F.lower("text").alias("body")), "doc_id")
    found = _entities(t).join(hits, "item_id").where(F.col("body").contains(F.col("entity")))
    ranks = found.groupBy("item_id", "entity").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    return _entities(t).join(ranks, ["item_id", "entity"], "left").select("item_id", "entity", F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"))


#: Languages by words that only one of them has, and the same rule as SQL.
LANGUAGE_WORDS = (("en", "(^|[ \n])the[ .,]"), ("es", "(^|[ \n])para[ .,]|ción"), ("de", "(^|[ \n])(und|der)[ .,]"), ("fr", "(^|[ \n])(les|une)[ .,]"))
_DETECTED = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{w}') THEN '{lang}'" for lang, w in LANGUAGE_WORDS) + " END"


def detected_language(text: Column) -> Column:
    """A language by telling words, null if none occurs: then there is no filter."""
    found = None
    for lang, words in LANGUAGE_WORDS:
        hit = F.lower(text).rlike(words)
        found = F.when(hit, lang) if found is None else found.when(hit, lang)
    return found


_VARIANTS = f"""
    {_POSTS}, qt AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
    qi AS (SELECT item_id, term, count(*) AS qf FROM qt GROUP BY ALL), {scores_sql("s", "qi")},
    al AS (SELECT item_id, {_DETECTED} AS asked FROM benchmark),
    base AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 50),
    cover AS (SELECT item_id, doc_id, count(*) AS shared FROM qi JOIN posts USING (term) GROUP BY ALL),
    wide AS (SELECT item_id, doc_id, place AS rank FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, rank) AS place FROM base JOIN cover USING (item_id, doc_id)) WHERE place <= 5),
    within AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN al USING (item_id) JOIN documents USING (doc_id) WHERE asked IS NULL OR lang = asked QUALIFY rank <= 5),
    filtered AS (SELECT * FROM within UNION ALL SELECT * FROM base WHERE rank <= 5 AND item_id NOT IN (SELECT item_id FROM within)),
    more AS (SELECT item_id, unnest(ts[1:30]) AS term FROM base JOIN dt USING (doc_id) WHERE rank = 1), qr AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, term FROM qt UNION ALL SELECT item_id, term FROM more) GROUP BY ALL),
    {scores_sql("sr", "qr")}, rewritten AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sr QUALIFY rank <= 5),
    v AS (SELECT 'baseline' AS variant, * FROM base WHERE rank <= 5 UNION ALL SELECT 'wide', * FROM wide UNION ALL SELECT 'filtered', * FROM filtered UNION ALL SELECT 'rewritten', * FROM rewritten)"""


def _variants(t: Tables) -> DataFrame:
    """variant, item_id, doc_id, rank: five hits an item under four ways of retrieval.

    ``wide`` takes a pool of 50 and orders it by how many of the item's terms a document
    has; ``filtered`` searches documents of the item's language only, and all where that
    leaves none; ``rewritten`` asks with the first 30 terms of the best document added.
    """
    items = t.benchmark.select("item_id", "text", detected_language(F.col("text")).alias("asked_lang"))
    asked = durable(R.postings(items, "item_id", "text").join(items.select("item_id", "asked_lang"), "item_id"))
    asked_terms = asked.drop("asked_lang")
    weighed = lambda asked, k, *given: durable(R.term_channels(t.documents, "doc_id", "text", asked, "item_id", k, *given).where("channel = 'score'").drop("channel"))
    pool = weighed(asked_terms, 50)
    wide = R.top(pool.withColumnRenamed("rank", "pooled"), ["item_id"], [F.desc("shared"), F.col("pooled")], 5)
    within = weighed(asked, 5, F.col("lang"), F.coalesce("asked_lang", F.lit("")))
    filtered = within.unionByName(pool.where("rank <= 5").join(within.select("item_id").distinct(), "item_id", "left_anti"))
    best = pool.where("rank = 1").select("item_id", "doc_id").join(t.documents.select("doc_id", F.col("text").alias("body")), "doc_id")
    added = best.select("item_id", F.array_join(F.slice(T.terms(F.col("body")), 1, 30), " ").alias("added"))
    longer = items.join(added, "item_id", "left").select("item_id", F.concat_ws(" ", "text", "added").alias("text"))
    asked_more = durable(R.postings(longer, "item_id", "text"))
    rewritten = weighed(asked_more, 5)
    named = lambda rows, name: rows.where("rank <= 5").select(F.lit(name).alias("variant"), "item_id", "doc_id", "rank")
    return named(pool, "baseline").unionByName(named(wide, "wide")).unionByName(named(filtered, "filtered")).unionByName(named(rewritten, "rewritten"))


@query(f"WITH {_VARIANTS} SELECT variant, item_id, doc_id, rank FROM v")
def variant_hits(t: Tables) -> DataFrame:
    return _variants(t)


@query(
    f"""
    WITH {_VARIANTS}, e AS (SELECT item_id, unnest(list_slice(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')), lambda w: struct_pack(n := -length(w), w := w))), 1, 3)).w AS entity FROM benchmark),
    f AS (SELECT variant, v.item_id, min(rank) AS first FROM v JOIN e ON v.item_id = e.item_id JOIN documents d ON d.doc_id = v.doc_id WHERE contains(lower(d.text), entity) GROUP BY ALL),
    a AS (SELECT DISTINCT variant, item_id FROM v)
    SELECT variant, count(*) AS n, count(*) FILTER (first = 1) AS hit_at_1, count(first) AS hit_at_k FROM a LEFT JOIN f USING (variant, item_id) GROUP BY variant"""
)
def variant_sweep(t: Tables) -> DataFrame:
    """For each way of retrieval the items with a hit (one that contains one of the item's entities) in first place and among five."""
    hits = _variants(t)
    bodies = hits.join(t.documents.select("doc_id", F.lower("text").alias("body")), "doc_id").join(_entities(t), "item_id").where(F.col("body").contains(F.col("entity")))
    first = bodies.groupBy("variant", "item_id").agg(F.min("rank").alias("first"))
    rows = hits.select("variant", "item_id").distinct().join(first, ["variant", "item_id"], "left")
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") == 1).alias("hit_at_1"), F.count("first").alias("hit_at_k"))


@query(
    """
    SELECT d.lang, count(*) AS n, round(avg((quality = 1)::INT), 6) AS hit_old, round(avg((quality = 1 AND toxic = 0)::INT), 6) AS hit_new, round(avg((quality = 1 AND toxic = 0)::INT) - avg((quality = 1)::INT), 6) AS delta
    FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang"""
)
def category_hit_rates(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    old, new = F.avg((F.col("quality") == 1).cast("int")), F.avg(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(old, 6).alias("hit_old"), F.round(new, 6).alias("hit_new"), F.round(new - old, 6).alias("delta"))


_PLAIN = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_IN = "len(list_filter({}, lambda e: contains(a, trim(regexp_replace(lower(e), '\\s+', ' ', 'g')))))"


@query(
    f"""
    WITH p AS (SELECT u.conv_id, u.turn, x.text AS raw, {_PLAIN.format("x.text")} AS a, regexp_extract_all(u.text, '[A-Za-z]{{3,}}') AS ws FROM conversations u JOIN conversations x ON x.conv_id = u.conv_id AND x.turn = u.turn + 1 WHERE u.role = 'user' AND x.role = 'assistant'),
    e AS (SELECT *, ws[1:3] AS secs, CASE WHEN len(ws) >= 5 THEN [ws[4] || '   ' || ws[5]] ELSE [] END AS rules, ws[6:9] AS kws, ws[10:11] AS bad, len(ws) % 2 = 0 AS need, len(list_filter(ws, lambda w: length(w) > 8 AND contains(raw, w))) AS quotes FROM p),
    s AS (SELECT *, {_IN.format("secs")} + {_IN.format("rules")} + {_IN.format("kws")} - {_IN.format("bad")} + (need AND quotes > 0)::INT AS points, len(secs) + len(rules) + len(kws) + need::INT AS most, {_IN.format("bad")} AS forbidden_hits, NOT need OR quotes > 0 AS verbatim_pass FROM e)
    SELECT conv_id, turn, points, most, forbidden_hits, verbatim_pass, CASE WHEN most > 0 THEN round(points / most * 100, 6) END AS percent FROM s"""
)
def answer_scores(t: Tables) -> DataFrame:
    """Answers by what they contain of what their question names, less what they must not say, with the gate of a verbatim quote."""
    asked = t.conversations.where("role = 'user'").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("ws"))
    given = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows, ws = asked.join(given, ["conv_id", "turn"]), F.col("ws")
    pair = F.when(F.size(ws) >= 5, F.array(F.concat(F.get(ws, F.lit(3)), F.lit("   "), F.get(ws, F.lit(4))))).otherwise(F.array().cast("array<string>"))
    quotes = F.filter(ws, lambda w: (F.length(w) > 8) & F.contains(F.col("answer"), w))
    found = V.answer_points(F.col("answer"), [F.slice(ws, 1, 3), pair, F.slice(ws, 6, 4)], F.slice(ws, 10, 2), F.size(ws) % 2 == 0, quotes)
    scored = rows.select("conv_id", "turn", found.alias("p")).select("conv_id", "turn", "p.*")
    return scored.withColumn("percent", F.when(F.col("most") > 0, F.round(F.col("points") / F.col("most") * 100, 6)))


@query(
    f"""
    WITH {BM25}, canon AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first, source, text FROM documents),
    holds AS (SELECT item_id, min(doc_id) AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
    g AS (SELECT b.item_id, b.text, gold, c.first AS gold_first, c.source AS section FROM benchmark b LEFT JOIN holds h USING (item_id) LEFT JOIN canon c ON c.doc_id = gold)
    SELECT b.item_id, b.doc_id, rank, coalesce(c.first = gold_first, false) OR coalesce(c.source = section, false) OR (length(trim(g.text)) > 20 AND coalesce(contains(lower(c.text), lower(trim(g.text))), false)) AS hit
    FROM bm25 b JOIN canon c ON c.doc_id = b.doc_id JOIN g ON g.item_id = b.item_id"""
)
def expected_hits(t: Tables) -> DataFrame:
    """Ten hits an item against what is expected: the first document that holds the item, its copies, its source, or the item's text."""
    same = t.documents.select("doc_id", "source", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    first = same.groupBy("sha").agg(F.min("doc_id").alias("first"))
    canon = same.join(first, "sha").select("doc_id", F.col("source").alias("section"), "text", F.array("first").alias("linked"))
    items = t.benchmark.select("item_id", "text")
    gold = first_holders(t.documents, "doc_id", "text", items, "item_id", "text").join(canon.select("doc_id", "linked", "section"), "doc_id")
    known = gold.select("item_id", F.col("linked").alias("docs"), F.array("section").alias("sections"))
    asked = items.join(known, "item_id", "left").select("item_id", "docs", "sections", F.col("text").alias("expected_text"))
    hits = bm25_hits(t).select("item_id", "doc_id", "rank").join(canon, "doc_id")
    return V.expectation_hits(hits, asked, "item_id").select("item_id", "doc_id", "rank", "hit")
