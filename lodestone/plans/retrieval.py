"""Retrieval queries: term statistics, BM25, neighbours, fusion, negatives, hit rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import retrieval as R
from lodestone.operators import temporal
from lodestone.session import durable

from .registry import Tables, query

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TERMS = f"list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_]+'), lambda t: t NOT IN ({_STOP}))"
_POSTS = f"""
    dt AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
    posts AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS length FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM dt) GROUP BY doc_id, term),
    size AS (SELECT count(*) AS n_docs, avg(length) AS mean_length FROM (SELECT doc_id, any_value(length) AS length FROM posts GROUP BY doc_id)),
    df AS (SELECT term, count(*) AS df FROM posts GROUP BY term)"""
BM25 = f"""
    {_POSTS}, qt AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark), q AS (SELECT item_id, term, count(*) AS qf FROM qt GROUP BY ALL),
    h AS (SELECT item_id, doc_id, round(sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(mean_length, 1))) * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * qf), 6) AS score
          FROM q JOIN df USING (term) JOIN posts USING (term), size GROUP BY item_id, doc_id),
    bm25 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM h QUALIFY rank <= 10)"""


@query(f"WITH {_POSTS} SELECT term, df, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 9) AS idf FROM df, size")
def idf(t: Tables) -> DataFrame:
    found = durable(R.term_frequencies(t.documents, "doc_id", "text"))
    rows = found.where(F.col("term") != R.WHOLE).join(F.broadcast(found.where(F.col("term") == R.WHOLE).select(F.col("df").alias("n_docs"))))
    return rows.select("term", "df", F.round(V.inverse_frequency(F.col("n_docs"), F.col("df")), 9).alias("idf"))


def _channels(t: Tables, k: int) -> DataFrame:
    """The benchmark's items against all documents, by weight and by shared terms."""
    return R.term_channels(t.documents, "doc_id", "text", R.postings(t.benchmark, "item_id", "text"), "item_id", k)


def bm25_hits(t: Tables, k: int = 10) -> DataFrame:
    return _channels(t, k).where("channel = 'score'").select("item_id", "doc_id", "score", "rank")


@query(f"WITH {BM25} SELECT item_id, doc_id, rank FROM bm25")
def bm25_topk(t: Tables) -> DataFrame:
    return bm25_hits(t).select("item_id", "doc_id", "rank")


_KNN = """
    v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS l FROM v),
    s AS (SELECT q.vec_id AS query_id, d.vec_id AS item_id, q.label AS query_label, d.label AS item_label, round(list_dot_product(q.e, d.e) / (q.l * d.l), 9) AS score
          FROM n q JOIN n d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
    knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 10)"""


def _knn(t: Tables) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 20: a stated query set against all vectors."""
    found = R.nearest(t.embeddings.where("vec_id % 20 = 0"), "vec_id", t.embeddings, "vec_id", "embedding", 10)
    labels = t.embeddings.select("vec_id", "label")
    found = found.join(labels.select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_label")), "item_id")
    return found.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")


@query(f"WITH {_KNN} SELECT query_id, item_id, rank FROM knn")
def knn_cosine(t: Tables) -> DataFrame:
    return _knn(t).select("query_id", "item_id", "rank")


@query(
    f"""
    WITH {_KNN}, f AS (SELECT query_id, min(CASE WHEN item_label = query_label THEN rank END) AS first FROM knn GROUP BY query_id)
    SELECT count(*) AS n_queries, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(coalesce(first <= 1, false)::INT), 6) AS hit_at_1,
           round(avg(coalesce(first <= 5, false)::INT), 6) AS hit_at_5, round(avg(coalesce(first <= 10, false)::INT), 6) AS hit_at_10 FROM f"""
)
def recall_and_mrr(t: Tables) -> DataFrame:
    return R.ranked_quality(_knn(t), "query_id", F.col("item_label") == F.col("query_label"), [1, 5, 10])


@query(f"WITH {_KNN} SELECT query_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS m FROM knn WHERE item_label <> query_label) WHERE m <= 5")
def hard_negatives(t: Tables) -> DataFrame:
    return R.hard_negatives(_knn(t), "query_id", F.col("item_label") == F.col("query_label"), 5).select("query_id", "item_id", "rank")


@query(
    """
    WITH v AS (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS l FROM v),
    s AS (SELECT q.vec_id AS query_id, d.vec_id AS item_id, round(list_dot_product(q.e, d.e) / (q.l * d.l), 9) AS score FROM n q JOIN n d ON q.vec_id <> d.vec_id AND q.label = d.label WHERE q.vec_id % 20 = 0),
    b AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM s WHERE score BETWEEN 0.60 AND 0.85) SELECT query_id, item_id, r + 1 AS rank FROM b WHERE r <= 5"""
)
def hard_negatives_band(t: Tables) -> DataFrame:
    """Five negatives out of the query's own document (its label) with cosines of 0.60 to 0.85, by the vectors' first eight components."""
    head = t.embeddings.select("vec_id", "label", F.slice("embedding", 1, 8).alias("e"))
    return R.negatives_in_group(head, "vec_id", "label", "e", F.col("vec_id") % 20 == 0, 0.60, 0.85, 5).select("query_id", "item_id", "rank")


@query(
    f"""
    WITH {BM25}, lng AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM (
        SELECT item_id, doc_id, count(*) AS shared FROM (SELECT DISTINCT item_id, term FROM qt) JOIN posts USING (term) GROUP BY ALL) QUALIFY rank <= 10),
    f AS (SELECT item_id, doc_id, round(sum(1 / (60.0 + rank)), 9) AS score, count(*) AS lists FROM (SELECT item_id, doc_id, rank FROM bm25 UNION ALL SELECT * FROM lng) GROUP BY ALL)
    SELECT item_id, doc_id, lists, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f"""
)
def rrf_fusion(t: Tables) -> DataFrame:
    return _fused(t, 10).select("item_id", "doc_id", "lists", "rank")


def _fused(t: Tables, pool: int) -> DataFrame:
    """Two channels of ``pool`` documents each, fused; both come out of one pass over the texts."""
    found = _channels(t, pool)
    return R.fuse(*[found.where(F.col("channel") == c) for c in ("score", "shared")], query_id="item_id", item_id="doc_id")


_SCORE = "round(sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(mean_length, 1))) * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * qf), 6)"


def scores_sql(name: str, asked: str) -> str:
    """BM25 scores of all documents for the postings (item_id, term, qf) of a common table expression."""
    return f"{name} AS (SELECT item_id, doc_id, {_SCORE} AS score FROM {asked} JOIN df USING (term) JOIN posts USING (term), size GROUP BY item_id, doc_id)"


_HYBRID = f"""
    {_POSTS}, x AS (SELECT d.doc_id, d.lang, ts[1:12] AS ts, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM dt JOIN documents d USING (doc_id) JOIN embeddings v ON v.vec_id = d.doc_id),
    n AS (SELECT *, sqrt(list_dot_product(e, e)) AS l FROM x), q AS (SELECT doc_id AS item_id, term, count(*) AS qf FROM (SELECT doc_id, unnest(ts) AS term FROM x WHERE doc_id % 20 = 0) GROUP BY ALL),
    {scores_sql("h", "q")},
    sparse AS (SELECT item_id, h.doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, h.doc_id) AS rank FROM h JOIN n d ON d.doc_id = h.doc_id JOIN n i ON i.doc_id = item_id WHERE item_id <> h.doc_id AND d.lang = i.lang QUALIFY rank <= 50),
    dense AS (SELECT i.doc_id AS item_id, d.doc_id, row_number() OVER (PARTITION BY i.doc_id ORDER BY round(list_dot_product(i.e, d.e) / (i.l * d.l), 9) DESC, d.doc_id) AS rank FROM n i JOIN n d ON i.doc_id <> d.doc_id AND i.lang = d.lang WHERE i.doc_id % 20 = 0 QUALIFY rank <= 50),
    fused AS (SELECT item_id, doc_id, round(sum(1 / (60.0 + rank)), 9) AS score, count(*) AS lists FROM (SELECT * FROM sparse UNION ALL SELECT * FROM dense) GROUP BY ALL)"""


def hybrid_hits(t: Tables, pool: int = 50) -> DataFrame:
    """item_id, doc_id, score, lists, rank: a term channel and a vector channel of ``pool`` each, both filtered by the question's language before they rank, fused.

    Questions are the documents with a vector whose id is divisible by 20: the first
    twelve terms and the vector. Candidates are all documents with a vector.
    """
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = durable(t.documents.select("doc_id", "lang", "text").join(vectors, "doc_id"))
    own = F.array_join(F.slice(T.terms(F.col("text")), 1, 12), " ")
    questions = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("asked_lang"), own.alias("text"), "embedding")
    asked = R.postings(questions, "item_id", "text").join(questions.select("item_id", "asked_lang"), "item_id")
    texts = t.documents.join(docs.select("doc_id", F.lit(True).alias("has_vector")), "doc_id", "left")
    of_channel = R.term_channels(texts, "doc_id", "text", asked, "item_id", pool, F.when(F.col("has_vector"), F.concat(F.lit("="), "lang")), F.concat(F.lit("="), "asked_lang"), apart=True)
    by_terms = of_channel.where("channel = 'score'").select("item_id", "doc_id", "rank")
    found = R.nearest(questions.withColumnRenamed("asked_lang", "lang"), "item_id", docs, "doc_id", "embedding", pool, same="lang")
    by_vectors = found.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("doc_id"), "rank")
    return R.fuse(by_terms, by_vectors, query_id="item_id", item_id="doc_id")


@query(f"WITH {_HYBRID} SELECT item_id, doc_id, lists, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fused QUALIFY rank <= 10")
def hybrid_fusion(t: Tables) -> DataFrame:
    return hybrid_hits(t).where("rank <= 10").select("item_id", "doc_id", "lists", "rank")


@query(
    f"""
    WITH {_HYBRID}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fused QUALIFY rank <= 20),
    m AS (SELECT r.*, d.source, substr(d.text, 1, 40) AS head, i.source AS own_source, substr(i.text, 1, 40) AS own_head FROM r JOIN documents d ON d.doc_id = r.doc_id JOIN documents i ON i.doc_id = item_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS n FROM m WHERE source IS DISTINCT FROM own_source AND head IS DISTINCT FROM own_head)
    SELECT item_id, doc_id, rank FROM o WHERE n <= 10"""
)
def mined_negatives(t: Tables) -> DataFrame:
    """Ten of twenty hits a question that share neither chunk (the row), document (its source) nor section (its heading, the first 40 characters) with it."""
    hits = hybrid_hits(t).where("rank <= 20")
    of = lambda prefix, key: t.documents.select(F.col("doc_id").alias(key), F.col("source").alias(f"{prefix}source"), F.substring("text", 1, 40).alias(f"{prefix}head"))
    rows = hits.join(of("", "doc_id"), "doc_id").join(of("own_", "item_id"), "item_id")
    positive = F.col("source").eqNullSafe(F.col("own_source")) | F.col("head").eqNullSafe(F.col("own_head"))
    return R.hard_negatives(rows, "item_id", positive, 10).select("item_id", "doc_id", "rank")


_PARTS = "regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{2,}')"


@query(
    """
    WITH p AS (SELECT p_partkey AS doc_id, TERMS AS ts FROM part), posts AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS length FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM p) GROUP BY doc_id, term),
    size AS (SELECT count(*) AS n_docs, avg(length) AS mean_length FROM (SELECT doc_id, any_value(length) AS length FROM posts GROUP BY doc_id)), df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
    a AS (SELECT o_orderkey AS item_id, o_orderdate AS day, ts FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN p ON doc_id = l_partkey WHERE o_orderkey % 20 = 0),
    q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(ts) AS term FROM a) GROUP BY ALL), SCORES,
    v AS (SELECT l_partkey AS doc_id, l_shipdate AS valid_from, lead(l_shipdate) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS valid_to, l_discount AS rate, l_orderkey, l_linenumber FROM lineitem),
    c AS (SELECT a.item_id, h.doc_id, rate, score, l_orderkey, l_linenumber FROM h JOIN a USING (item_id) JOIN v ON v.doc_id = h.doc_id AND valid_from <= day AND (valid_to IS NULL OR valid_to > day))
    SELECT item_id, doc_id, rate, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, l_orderkey, l_linenumber) AS rank FROM c QUALIFY rank <= 5""".replace("TERMS", _PARTS).replace("SCORES", scores_sql("h", "q"))
)
def dated_rates(t: Tables) -> DataFrame:
    """The five best matches of an order's first part, each with the rate in force on the order's day; parts without one that day do not count."""
    words = F.array_join(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z]{2,}"), F.lit(0)), " ")
    parts = durable(t.part.select(F.col("p_partkey").alias("doc_id"), words.alias("text")))
    first = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("doc_id"))
    asked_rows = t.orders.where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("day")).join(first, "item_id").join(parts, "doc_id").select("item_id", "day", "text")
    history = t.lineitem.select(F.col("l_partkey").alias("doc_id"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_discount").alias("rate"))
    rates = temporal.to_intervals(history, ["doc_id"], "l_shipdate", "l_orderkey", "l_linenumber")
    found = R.in_force_search(parts, "doc_id", "text", asked_rows, "item_id", "day", rates, 5, ["l_orderkey", "l_linenumber"])
    return found.select("item_id", "doc_id", "rate", "rank")


_WIDE = BM25.replace("QUALIFY rank <= 10", "QUALIFY rank <= {n}")


@query(
    f"""
    WITH {_WIDE.format(n=20)}, lng AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM (
        SELECT item_id, doc_id, count(*) AS shared FROM (SELECT DISTINCT item_id, term FROM qt) JOIN posts USING (term) GROUP BY ALL) QUALIFY rank <= 20),
    f AS (SELECT item_id, doc_id, round(sum(1 / (60.0 + rank)), 9) AS score, count(*) AS lists FROM (SELECT item_id, doc_id, rank FROM bm25 UNION ALL SELECT * FROM lng) GROUP BY ALL)
    SELECT item_id, doc_id, lists, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 5"""
)
def rrf_overfetch(t: Tables) -> DataFrame:
    """Five documents an item, fused from channels that fetch four times as many."""
    return _fused(t, R.pool_size(5, 4)).where("rank <= 5").select("item_id", "doc_id", "lists", "rank")


@query(
    f"""
    WITH {_WIDE.format(n=24)}, r AS (SELECT b.item_id, b.doc_id, rank AS old_rank, round(b.score / 1000 + CASE WHEN (item_id % 2 = 0 AND (contains(source, '1') OR contains(source, 'src2'))) THEN 1.5 ELSE 0 END, 6) AS boosted FROM bm25 b JOIN documents USING (doc_id))
    SELECT item_id, doc_id, old_rank, row_number() OVER (PARTITION BY item_id ORDER BY boosted DESC, old_rank) AS rank FROM r QUALIFY rank <= 8"""
)
def boosted_pool(t: Tables) -> DataFrame:
    """Eight documents an item out of a pool of max(3k, 24), those of the named sources first; even items name SRC2 and 1."""
    hits = bm25_hits(t, R.pool_size(8, 3, 24)).join(t.documents.select("doc_id", "source"), "doc_id")
    acts = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("1"), F.lit("SRC2"))).otherwise(F.array().cast("array<string>"))
    rows = hits.select("item_id", "doc_id", F.col("rank").alias("old_rank"), F.round(F.col("score") / 1000 + R.act_boost(acts, F.col("source")), 6).alias("boosted"))
    return R.top(rows, ["item_id"], [F.desc("boosted"), F.col("old_rank")], 8).select("item_id", "doc_id", "old_rank", "rank")


_FEATURES = "list_concat(ts, CASE WHEN len(ts) > 1 THEN list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]) ELSE [] END)"


@query(
    f"""
    WITH dt AS (SELECT doc_id, {_TERMS} AS ts FROM documents), qt AS (SELECT item_id, {_TERMS} AS ts FROM benchmark),
    p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_FEATURES}) AS term FROM dt) GROUP BY ALL), c AS (SELECT term, sum(tf) AS a, count(*) AS df FROM p GROUP BY term ORDER BY a DESC, term LIMIT 10000),
    i AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM c, (SELECT count(*) AS n FROM documents)),
    d AS (SELECT doc_id, term, tf * idf AS w FROM p JOIN i USING (term)), q AS (SELECT item_id, term, count(*) * any_value(idf) AS q FROM (SELECT item_id, unnest({_FEATURES}) AS term FROM qt) JOIN i USING (term) GROUP BY ALL),
    dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM d GROUP BY doc_id), qn AS (SELECT item_id, sqrt(sum(q * q)) AS m FROM q GROUP BY item_id),
    s AS (SELECT item_id, doc_id, round(sum(w * q) / (any_value(n) * any_value(m)), 6) AS score FROM d JOIN q USING (term) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY ALL)
    SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5"""
)
def tfidf_topk(t: Tables) -> DataFrame:
    return R.tfidf_search(t.documents, "doc_id", t.benchmark, "item_id", "text", 5).select("item_id", "doc_id", "rank")


@query(
    f"""
    WITH {BM25}, m AS (SELECT b.*, d.lang, d.source, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS base
                        FROM bm25 b JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY item_id))
    SELECT item_id, doc_id, round(CASE WHEN rank = 1 THEN greatest(1.0 / rank * 0.7 + (base + CASE WHEN lang = 'en' THEN 0.15 WHEN lang = 'fr' THEN 0.08 ELSE 0 END + CASE WHEN source = 'src0' THEN 0.1 ELSE 0 END) * 0.3, 0.95)
           ELSE 1.0 / rank * 0.7 + (base + CASE WHEN lang = 'en' THEN 0.15 WHEN lang = 'fr' THEN 0.08 ELSE 0 END + CASE WHEN source = 'src0' THEN 0.1 ELSE 0 END) * 0.3 END, 5) AS blended FROM m"""
)
def blended_scores(t: Tables) -> DataFrame:
    rows = R.scaled(bm25_hits(t).join(t.documents.select("doc_id", "lang", "source"), "doc_id"), ["item_id"], "score")
    tier = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    score = R.blend(1.0 / F.col("rank"), F.col("scaled"), tier, F.col("source") == "src0", F.col("rank") == 1)
    return rows.select("item_id", "doc_id", F.round(score, 5).alias("blended"))


@query(
    f"""
    WITH {BM25}, r AS (SELECT b.item_id, b.doc_id, b.rank, d.lang <> 'en' AS w FROM bm25 b JOIN documents d USING (doc_id)),
    n AS (SELECT *, row_number() OVER (PARTITION BY item_id, w ORDER BY rank) AS m FROM r),
    o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY (w AND m <= 2) DESC, rank) AS place FROM n) SELECT item_id, doc_id, rank FROM o WHERE place <= 5"""
)
def class_backfill(t: Tables) -> DataFrame:
    ranked = bm25_hits(t).join(t.documents.select("doc_id", "lang"), "doc_id")
    return R.ensure_class(ranked, "item_id", F.col("lang") != "en", 5, 2).select("item_id", "doc_id", "rank")


@query(
    """
    WITH h AS (SELECT event_id, user_id, value, CASE WHEN event_type = 'click' THEN value * 2 END AS rerank FROM events)
    SELECT event_id, user_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(rerank, -1e9) DESC, value DESC, event_id) AS rank FROM h) WHERE rank <= 8"""
)
def rerank_order(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "value", F.when(F.col("event_type") == "click", F.col("value") * 2).alias("rerank"))
    return R.top(rows, ["user_id"], R.by_rerank(F.col("rerank"), F.col("value"), "event_id"), 8).select("event_id", "user_id", "rank")


@query(
    f"""
    WITH {_POSTS}, w AS (SELECT doc_id, term, tf * ln(n_docs / df::DOUBLE) AS x FROM posts JOIN df USING (term), size),
    l AS (SELECT doc_id, sqrt(sum(x * x)) AS norm, count(*) AS n FROM w GROUP BY doc_id) SELECT doc_id, n, round(norm, 5) AS norm FROM l"""
)
def tfidf_norms(t: Tables) -> DataFrame:
    return R.tfidf_norms(t.documents, "doc_id", "text").withColumn("norm", F.round("norm", 5))
