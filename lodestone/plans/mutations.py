"""Mutation queries: upserts, first and last wins, retention, links, once-only enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import identifiers as I
from lodestone.functions import text as T
from lodestone.operators import mutations as M
from lodestone.operators import temporal

from .registry import Tables, query

_OLD = "SELECT user_id, event_type AS state, value, ts, event_id FROM events WHERE ts < TIMESTAMP '2024-01-15'"
_NEW = "SELECT user_id, event_type AS state, value, ts, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'"


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.events.select("user_id", F.col("event_type").alias("state"), "value", "ts", "event_id")
    half = F.lit("2024-01-15").cast("timestamp")
    return rows.where(F.col("ts") < half), rows.where(F.col("ts") >= half)


@query(
    f"""
    WITH o AS ({_OLD}), lo AS (SELECT user_id, max(struct_pack(ts, event_id, state, value)) AS r FROM o GROUP BY user_id),
    ln AS (SELECT user_id, max(struct_pack(ts, event_id, state, value)) AS r FROM ({_NEW}) GROUP BY user_id)
    SELECT coalesce(ln.user_id, lo.user_id) AS user_id, coalesce(ln.r, lo.r).state AS state, coalesce(ln.r, lo.r).value AS value, coalesce(ln.r, lo.r).event_id AS event_id
    FROM lo FULL JOIN ln ON lo.user_id = ln.user_id"""
)
def upsert_replace(t: Tables) -> DataFrame:
    old, new = _halves(t)
    current = temporal.latest(old, ["user_id"], "ts", "event_id")
    return M.replace_by_key(current, new, ["user_id"], ["ts", "event_id"]).select("user_id", "state", "value", "event_id")


@query(
    """
    WITH o AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_nationkey < 15),
    n AS (SELECT c_custkey AS k, c_acctbal + 1 AS balance, c_mktsegment AS segment FROM customer WHERE c_nationkey >= 10)
    SELECT coalesce(o.k, n.k) AS k, o.name, coalesce(n.balance, o.balance) AS balance, coalesce(o.segment, n.segment) AS segment FROM o FULL JOIN n ON o.k = n.k"""
)
def upsert_keep_columns(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    old = rows.where("c_nationkey < 15").drop("c_nationkey")
    changes = rows.where("c_nationkey >= 10").select("k", (F.col("balance") + 1).alias("balance"), "segment")
    return M.upsert(old, changes, ["k"], ["balance"])


@query(
    f"""
    WITH f AS (SELECT user_id, min(struct_pack(event_id, state, value)) AS r FROM ({_NEW}) GROUP BY user_id), o AS (SELECT user_id, max(struct_pack(event_id, state, value)) AS r FROM ({_OLD}) WHERE value > 45 GROUP BY user_id)
    SELECT user_id, r.event_id AS event_id, r.state AS state, r.value AS value FROM o UNION ALL
    SELECT user_id, r.event_id, r.state, r.value FROM f WHERE user_id NOT IN (SELECT user_id FROM o)"""
)
def insert_or_ignore(t: Tables) -> DataFrame:
    old, new = _halves(t)
    kept = temporal.latest(old.where("value > 45").select("user_id", "event_id", "state", "value"), ["user_id"], "event_id")
    return M.insert_ignore(kept, new.select("user_id", "event_id", "state", "value"), ["user_id"], ["event_id"])


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE o_orderstatus END AS status,
           CASE WHEN o_orderstatus = 'F' THEN substr('error: ' || o_orderpriority, 1, 2000) END AS last_error FROM orders"""
)
def mark_errors(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("last_error"), "o_orderpriority")
    failed = F.col("status") == "F"
    error = F.substring(F.concat(F.lit("error: "), F.col("o_orderpriority")), 1, 2000)
    return M.update_where(M.update_where(rows, failed, last_error=error), failed, status=F.lit("failed")).drop("o_orderpriority")


@query("SELECT event_id, user_id, event_type, ts FROM events ORDER BY event_id DESC LIMIT 500")
def retain_newest(t: Tables) -> DataFrame:
    return M.newest_page(t.events.select("event_id", "user_id", "event_type", "ts"), 2000, F.desc("event_id"))


@query(
    """
    WITH n AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
    SELECT l_partkey, l_suppkey FROM n WHERE (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'A')"""
)
def append_unseen(t: Tables) -> DataFrame:
    pairs = t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag")
    old, new = pairs.where("l_returnflag = 'A'").drop("l_returnflag"), pairs.where("l_returnflag = 'R'").drop("l_returnflag")
    return M.append_new(old, new, ["l_partkey", "l_suppkey"])


@query(
    """
    WITH q AS (SELECT conv_id AS doc_id, list(substr(text, 1, 80) ORDER BY turn) AS qs FROM conversations WHERE role = 'user' GROUP BY conv_id),
    r AS (SELECT d.doc_id, text, lang, source, CASE WHEN d.doc_id % 4 = 0 THEN text || ' [ENRICHED] ' WHEN d.doc_id % 4 = 1 THEN text END AS embed_text, qs FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
    f AS (SELECT *, coalesce(NOT contains(coalesce(embed_text, ''), '[ENRICHED]') AND length(text) >= 100 AND len(qs) > 0, false) AS fresh FROM r)
    SELECT doc_id, CASE WHEN fresh THEN 0 ELSE 1 END AS upserted,
           sha256(CASE WHEN fresh THEN lang || chr(10) || chr(10) || text || chr(10) || chr(10) || '[ENRICHED] User questions answered by this passage:' || chr(10) || array_to_string(list_transform(qs, lambda x: '- ' || x), chr(10)) ELSE embed_text END) AS embed_sha FROM f"""
)
def enrich_once(t: Tables) -> DataFrame:
    """The questions of a conversation go behind the marker of the document of its number; a fourth of the documents carry the marker already."""
    asked = t.conversations.where("role = 'user'").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 80).alias("q")))).alias("l"))
    questions = asked.select("doc_id", F.transform("l", lambda x: x["q"]).alias("questions"))
    embed = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text"), F.lit(" [ENRICHED] "))).when(F.col("doc_id") % 4 == 1, F.col("text"))
    rows = t.documents.select("doc_id", "text", F.col("lang").alias("parent"), embed.alias("embed_text"), F.lit(1).alias("upserted"))
    return M.enrich_once(rows, questions, "doc_id").select("doc_id", "upserted", F.sha2(F.col("embed_text").cast("binary"), 256).alias("embed_sha"))


@query(
    """
    SELECT c.conv_id, c.turn, c.turn % 7 AS rating, l.quality FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id WHERE c.turn % 7 BETWEEN 1 AND 5"""
)
def valid_ratings(t: Tables) -> DataFrame:
    rated = t.conversations.select("conv_id", "turn", (F.col("turn") % 7).alias("rating")).where(F.col("rating").between(1, 5))
    return rated.join(t.labels.select(F.col("doc_id").alias("conv_id"), "quality"), "conv_id", "left")


@query(
    """
    SELECT vec_id, ('0x' || substr(sha256(vec_id || '|' || label), 1, 15))::BIGINT % 1000000000000000 AS point_id, len(embedding) AS dims,
           round(list_sum(list_transform(embedding, lambda x: CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x::DOUBLE END)), 6) AS component_sum FROM embeddings"""
)
def vector_points(t: Tables) -> DataFrame:
    from lodestone.functions.vectors import doubles, finite

    clean = finite(doubles(F.col("embedding")))
    return t.embeddings.select(
        "vec_id", I.point_id(F.col("vec_id"), F.col("label")).alias("point_id"), F.size("embedding").cast("long").alias("dims"),
        F.round(F.aggregate(clean, F.lit(0.0), lambda s, x: s + x), 6).alias("component_sum"),
    )


@query(
    """
    WITH s AS (SELECT l_shipdate AS day, 'shipped' AS kind, l_quantity AS amount, l_tax AS tax, NULL::VARCHAR AS priority FROM lineitem WHERE l_linestatus = 'F'),
    o AS (SELECT o_orderdate AS day, 'ordered' AS kind, NULL::DOUBLE AS amount, NULL::DOUBLE AS tax, o_orderpriority AS priority FROM orders)
    SELECT kind, year(day)::BIGINT AS y, count(*) AS n, sum(amount) AS amount, count(priority) AS with_priority FROM (SELECT * FROM s UNION ALL SELECT * FROM o) GROUP BY ALL"""
)
def heterogeneous_union(t: Tables) -> DataFrame:
    shipped = t.lineitem.where("l_linestatus = 'F'").select(F.col("l_shipdate").alias("day"), F.lit("shipped").alias("kind"), F.col("l_quantity").alias("amount"), F.col("l_tax").alias("tax"))
    ordered = t.orders.select(F.col("o_orderdate").alias("day"), F.lit("ordered").alias("kind"), F.col("o_orderpriority").alias("priority"))
    rows = shipped.unionByName(ordered, allowMissingColumns=True)
    return rows.groupBy("kind", F.year("day").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.count("priority").alias("with_priority"))


@query(
    """
    SELECT coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END), ''), source) AS label, count(*) AS n FROM documents GROUP BY ALL"""
)
def first_filled_field(t: Tables) -> DataFrame:
    lang = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("lang"))
    return t.documents.groupBy(T.first_filled(lang, F.col("source")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    SELECT 'documents' AS table_name, count(*) AS seen, count(*) FILTER (length(text) >= 200) AS loaded, count(*) FILTER (length(text) < 200) AS failed FROM documents
    UNION ALL SELECT 'pages', count(*), count(*) FILTER (html LIKE '%<body%'), count(*) FILTER (html NOT LIKE '%<body%') FROM pages"""
)
def run_records(t: Tables) -> DataFrame:
    def record(df: DataFrame, name: str, ok) -> DataFrame:
        return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("seen"), F.count_if(ok).alias("loaded"), F.count_if(~ok).alias("failed"))

    return record(t.documents, "documents", F.length("text") >= 200).unionByName(record(t.pages, "pages", F.col("html").contains("<body")))
