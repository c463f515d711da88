"""Report queries: scoreboards, misses, status shares, warnings, rates before and after, links with audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import dedup
from lodestone.operators import measures as S

from .evaluation import VERDICT
from .registry import Tables, query
from .retrieval import BM25, bm25_hits

_JUDGED = "SELECT d.source, d.lang, d.n_chars, quality AS hit, CASE WHEN toxic = 1 THEN 0 WHEN n_chars > 1500 THEN 2 ELSE 1 END AS answer FROM labels l JOIN documents d USING (doc_id)"


@query(
    f"""
    WITH j AS ({_JUDGED}), b AS (SELECT source AS bucket, hit, answer FROM j UNION ALL SELECT 'all', hit, answer FROM j)
    SELECT bucket, count(*) AS n, count(*) FILTER (hit = 1) AS hit, count(*) FILTER (answer = 2) AS full_correct, count(*) FILTER (answer = 1) AS partly, count(*) FILTER (answer = 0) AS wrong,
           round(count(*) FILTER (hit = 1) / count(*), 6) AS hit_rate, round(count(*) FILTER (answer = 2) / count(*), 6) AS full_rate FROM b GROUP BY bucket"""
)
def scoreboard(t: Tables) -> DataFrame:
    """Hits and answers of judged items by bucket and over all."""
    rows = t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id")
    answer = F.when(F.col("toxic") == 1, 0).when(F.col("n_chars") > 1500, 2).otherwise(1)
    return S.scoreboard(rows.select(F.col("source").alias("bucket"), F.col("quality").alias("hit"), answer.alias("answer")))


@query(
    f"""
    WITH {BM25}, own AS (SELECT item_id, length(text) AS n, item_id % 4 AS category, item_id * 3 AS gold FROM benchmark),
    got AS (SELECT DISTINCT own.item_id FROM own JOIN bm25 b ON b.item_id = own.item_id AND b.doc_id % 40 = own.gold % 40),
    m AS (SELECT category, CASE WHEN n < 100 THEN 'short<100' WHEN n < 300 THEN 'mid100-300' WHEN n < 600 THEN 'long300-600' ELSE 'xlong>=600' END AS band, item_id NOT IN (SELECT item_id FROM got) AS miss FROM own)
    SELECT category, band, count(*) AS n, count(*) FILTER (miss) AS misses FROM m GROUP BY ALL"""
)
def miss_analysis(t: Tables) -> DataFrame:
    """Items whose gold document (its number modulo 40 here) is not among their ten hits, by category and length of the question."""
    n = F.length("text")
    band = F.when(n < 100, "short<100").when(n < 300, "mid100-300").when(n < 600, "long300-600").otherwise("xlong>=600")
    items = t.benchmark.select("item_id", (F.col("item_id") % 4).alias("category"), (F.col("item_id") * 3).alias("gold"), band.alias("band"))
    hits = items.join(bm25_hits(t).select("item_id", "doc_id"), "item_id").where("doc_id % 40 = gold % 40").select("item_id").distinct()
    rows = items.join(hits.withColumn("found", F.lit(True)), "item_id", "left")
    return rows.groupBy("category", "band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("found").isNull()).alias("misses"))


@query(
    """
    SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS percent FROM orders GROUP BY o_orderpriority, o_orderstatus"""
)
def status_percentages(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy("o_orderpriority")), 6))


@query(
    """
    WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (n_chars < 800) / count(*) AS low, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY lang)
    SELECT lang, n, share, array_to_string(list_filter([CASE WHEN share > 0.40 THEN 'over_cap' END, CASE WHEN share < 0.05 THEN 'under_floor' END, CASE WHEN abs(low - 0.35) > 0.10 THEN 'mix_off' END], lambda x: x IS NOT NULL), ',') AS warnings FROM c"""
)
def share_warnings(t: Tables) -> DataFrame:
    """Shares of languages with warnings: over 40 %, under 5 %, or a share of short texts more than 10 points off 35 %."""
    counts = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("n_chars") < 800).cast("int")).alias("low"))
    return S.share_warnings(counts, "n", "low", 0.35).select("lang", "n", "share", F.array_join("warnings", ",").alias("warnings"))


@query(
    """
    WITH h AS (SELECT doc_id, quality = 1 AS hit, toxic = 1 AS error FROM labels) SELECT doc_id, error, (SELECT count(*) FILTER (hit) / count(*) FROM h) AS recall, (SELECT count(*) FILTER (error) FROM h) = 0 AS within_budget FROM h WHERE NOT hit"""
)
def gate_misses(t: Tables) -> DataFrame:
    """The misses behind a recall gate, each with the gate's recall and whether no error occurred at all."""
    rows = t.labels.select("doc_id", (F.col("quality") == 1).alias("hit"), (F.col("toxic") == 1).alias("error"))
    gate = rows.agg((F.count_if("hit") / F.count(F.lit(1))).alias("recall"), (F.count_if("error") == 0).alias("within_budget"))
    return rows.where(~F.col("hit")).join(F.broadcast(gate)).select("doc_id", "error", "recall", "within_budget")  # one row


@query(
    """
    WITH e AS (SELECT conv_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS entity FROM conversations WHERE turn = 0), a AS (SELECT conv_id, lower(text) AS answer FROM conversations WHERE turn = 1),
    h AS (SELECT e.conv_id, entity, coalesce(contains(answer, entity), false) AS hit FROM e LEFT JOIN a ON e.conv_id = a.conv_id)
    SELECT conv_id, count(*) AS entities, count(*) FILTER (hit) AS found, count(*) FILTER (hit) / count(*) AS rate FROM h GROUP BY conv_id"""
)
def entity_hit_rates(t: Tables) -> DataFrame:
    """Of the long words of a first turn, how many the second one has."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0))).alias("entity")
    asked = t.conversations.where("turn = 0").select("conv_id", words)
    said = t.conversations.where("turn = 1").select("conv_id", F.lower("text").alias("answer"))
    rows = asked.join(said, "conv_id", "left").select("conv_id", F.coalesce(F.col("answer").contains(F.col("entity")), F.lit(False)).alias("hit"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("entities"), F.count_if("hit").alias("found"), F.avg(F.col("hit").cast("int")).alias("rate"))


@query(
    f"""
    WITH v AS (SELECT {VERDICT} AS verdict, role FROM conversations)
    SELECT role, count(*) AS n, count(*) FILTER (verdict IN ('no', 'partial')) AS caught, round(avg((verdict IN ('no', 'partial'))::INT), 6) AS caught_rate FROM v GROUP BY role"""
)
def grounded_gate(t: Tables) -> DataFrame:
    """Share of answers that a judge calls ungrounded or partly grounded."""
    from lodestone.functions.evidence import verdict

    caught = verdict(F.col("text")).isin("no", "partial")
    return t.conversations.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(caught).alias("caught"), F.round(F.avg(caught.cast("int")), 6).alias("caught_rate"))


@query(
    """
    WITH p AS (SELECT d.doc_id, count(c.conv_id) AS pairs FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY d.doc_id) SELECT pairs, count(*) AS n FROM p GROUP BY pairs"""
)
def pairs_per_document(t: Tables) -> DataFrame:
    """How many documents have so many pairs, those without any among them."""
    per = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("pairs"))
    rows = t.documents.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("pairs", F.lit(0)).alias("pairs"))
    return rows.groupBy("pairs").agg(F.count(F.lit(1)).alias("n"))


_CANON = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(
    f"""
    WITH h AS (SELECT doc_id, source, sha256({_CANON}) AS k FROM documents), f AS (SELECT k, min(doc_id) AS c FROM h GROUP BY k), k AS (SELECT h.*, doc_id = c AS canonical FROM h JOIN f USING (k)),
    b AS (SELECT k, count(*) AS n FROM h GROUP BY k), a AS (SELECT k, count(*) AS n FROM k WHERE canonical GROUP BY k)
    SELECT (SELECT count(*) FILTER (n > 1) / count(*) FROM b) AS rate_before, (SELECT count(*) FILTER (n > 1) / count(*) FROM a) AS rate_after, (SELECT count(*) FROM h) AS rows_before, (SELECT count(*) FROM k WHERE canonical) AS rows_after"""
)
def duplicate_rates(t: Tables) -> DataFrame:
    """Share of texts in more than one document, before and after the copies are dropped."""
    rows = dedup.canonical_rows(t.documents.select("doc_id", T.content_hash(F.col("text")).alias("k")), F.col("k"), "doc_id")
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_canonical").alias("m"))
    rate = lambda c: F.avg((F.col(c) > 1).cast("int"))
    return per.agg(rate("n").alias("rate_before"), rate("m").alias("rate_after"), F.sum("n").alias("rows_before"), F.sum("m").alias("rows_after"))


@query(
    """
    WITH need AS (SELECT DISTINCT lang AS category, source AS topic FROM documents), a AS (SELECT * FROM (VALUES ('src1', 'src2'), ('src3', 'src2')) v(alias, topic)),
    h AS (SELECT lang AS category, coalesce(a.topic, d.source) AS topic FROM documents d JOIN labels USING (doc_id) LEFT JOIN a ON a.alias = d.source WHERE quality = 1), c AS (SELECT category, topic, count(*) AS n FROM h GROUP BY ALL)
    SELECT need.category, need.topic, coalesce(c.n, 0) AS n, coalesce(c.n, 0) >= 3 AS covered FROM need LEFT JOIN a ON a.alias = need.topic LEFT JOIN c ON c.category = need.category AND c.topic = coalesce(a.topic, need.topic)"""
)
def coverage_with_aliases(t: Tables) -> DataFrame:
    """Each category and topic needs three good documents; two topics are other names of a third."""
    aliases = F.broadcast(t.spark.createDataFrame([("src1", "src2"), ("src3", "src2")], "alias string, real string"))  # a table of the call
    named = lambda rows, c: rows.join(aliases, F.col(c) == F.col("alias"), "left").withColumn("key", F.coalesce("real", c)).drop("alias", "real")
    need = named(t.documents.select(F.col("lang").alias("category"), F.col("source").alias("topic")).distinct(), "topic")
    good = t.documents.select("doc_id", F.col("lang").alias("category"), F.col("source").alias("topic")).join(t.labels.where("quality = 1"), "doc_id")
    have = named(good, "topic").groupBy("category", "key").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return need.join(have, ["category", "key"], "left").select("category", "topic", n.alias("n"), (n >= 3).alias("covered"))


@query(
    """
    WITH h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY source || '/' || substr(md5(text), 1, 2)) AS c FROM documents WHERE length(text) >= 40) SELECT c AS canonical_id, doc_id AS linked_id FROM h WHERE c <> doc_id"""
)
def linked_by_path(t: Tables) -> DataFrame:
    """Links of documents that share a path, among those that passed their phase (40 characters here): one row a further member."""
    rows = t.documents.where(F.length("text") >= 40).select("doc_id", F.concat_ws("/", "source", F.substring(F.md5(F.col("text").cast("binary")), 1, 2)).alias("path"))
    return dedup.link_pairs(rows, F.col("path"), "doc_id")


@query(
    f"""
    WITH h AS (SELECT doc_id, source, sha256({_CANON}) AS k FROM documents), g AS (SELECT k, min(doc_id) AS c FROM h GROUP BY k), r AS (SELECT h.*, c FROM h JOIN g USING (k)),
    l AS (SELECT c, list_sort(list(DISTINCT source)) AS linked FROM r WHERE doc_id <> c GROUP BY c)
    SELECT doc_id::VARCHAR AS chunk_key, NULL AS duplicate_of, coalesce(linked, []) AS linked FROM r LEFT JOIN l ON l.c = r.doc_id WHERE r.doc_id = r.c
    UNION ALL SELECT source || '::' || doc_id, c, [] FROM r WHERE doc_id <> c"""
)
def duplicate_audit(t: Tables) -> DataFrame:
    """Canonical rows with the sources of their copies, and an audit row "source::doc_id" for every copy."""
    return dedup.audit_rows(t.documents.select("doc_id", "source", "text"), T.content_hash(F.col("text")), "doc_id", "source")


@query(
    """
    WITH r AS (SELECT p_partkey, p_brand, lower(trim(p_name)) AS title, p_size % 3 IN (0, 1) AS en, p_size % 3 IN (0, 2) AS hi FROM part),
    m AS (SELECT p_brand, title, min(p_partkey) FILTER (en) AS en_id, min(p_partkey) FILTER (hi) AS hi_id FROM r GROUP BY ALL)
    SELECT p_partkey, CASE WHEN en AND hi THEN p_partkey WHEN en THEN hi_id ELSE en_id END AS twin_id FROM r JOIN m USING (p_brand, title)"""
)
def bilingual_twins(t: Tables) -> DataFrame:
    """Each row's twin in the other language: itself if it has both, else the first other one with equal keys and title."""
    rows = t.part.select("p_partkey", "p_brand", F.lower(F.trim("p_name")).alias("title"), (F.col("p_size") % 3).isin(0, 1).alias("en"), (F.col("p_size") % 3).isin(0, 2).alias("hi"))
    return dedup.language_twins(rows, ["p_brand", "title"], "p_partkey", "en", "hi")


@query(
    """
    WITH r AS (SELECT source, quality = 1 AS ok, toxic = 1 AS bad FROM labels JOIN documents USING (doc_id))
    SELECT source, count(*) FILTER (ok) - count(*) FILTER (bad) + 2 * count(*) FILTER (ok AND NOT bad) AS points, count(*) * 3 AS most,
           round((count(*) FILTER (ok) - count(*) FILTER (bad) + 2 * count(*) FILTER (ok AND NOT bad)) / (count(*) * 3) * 100, 6) AS percent FROM r GROUP BY source"""
)
def judged_points(t: Tables) -> DataFrame:
    """One point for a match, one off for a forbidden one, two of a judge for clean matches, in percent of what is possible."""
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    ok, bad = F.col("quality") == 1, F.col("toxic") == 1
    points = F.count_if(ok) - F.count_if(bad) + 2 * F.count_if(ok & ~bad)
    most = F.count(F.lit(1)) * 3
    return rows.groupBy("source").agg(points.alias("points"), most.alias("most"), F.round(points / most * 100, 6).alias("percent"))
