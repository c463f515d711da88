"""Filter queries: payload and typed filters, lookups, hard filters, maps, texts of varied rows, plans by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import evidence as E
from lodestone.functions import text as T
from lodestone.operators import filters as P

from .registry import Tables, query


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND source = 'src1'")
def payload_filter(t: Tables) -> DataFrame:
    return t.documents.where(P.payload_filter({"lang": ["en", "fr"], "source": "src1"})).select("doc_id", "lang", "source")


@query("SELECT o_orderkey, year(o_orderdate)::INT AS order_year FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) >= 1996")
def typed_filter(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("order_year", F.year("o_orderdate"))
    return rows.where(P.typed_filter({"o_orderstatus": "F", "o_orderpriority": ""}, {"order_year": 1996, "o_totalprice": 0})).select("o_orderkey", "order_year")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 50")
def exact_lookup(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_name", "p_brand", "p_type")
    return P.exact_lookup(rows, {"p_brand": "Brand#2", "p_type": "ECONOMY", "p_name": None}, ["p_partkey"]).select("p_partkey", "p_name", "p_brand")


@query(
    """
    SELECT d.doc_id, coalesce(quality = 1 AND toxic = 0, false) AS passed, coalesce(quality = 1 AND toxic = 0 AND n_chars >= 400, false) AS strict FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def hard_filter(t: Tables) -> DataFrame:
    """Graded documents: quality stands for answerable, not toxic for specific, length for realistic; ungraded ones fail."""
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    grading = F.when(F.col("quality").isNotNull(), F.struct(F.col("quality").alias("answerable"), (F.col("toxic") == 0).alias("specific"), (F.col("n_chars") >= 400).alias("realistic")))
    rows = rows.withColumn("grading", grading)
    return rows.select("doc_id", P.hard_filter(F.col("grading")).alias("passed"), P.hard_filter(F.col("grading"), strict=True).alias("strict"))


@query(
    """
    WITH r AS (SELECT count(*) AS n, count(*) FILTER (trim(lang) = '' OR lang IS NULL OR source IS NULL OR trim(source) = '' OR text IS NULL OR trim(text) = '') AS rejected FROM documents)
    SELECT n, rejected, rejected / n AS reject_rate, rejected / n <= 0.02 AS passed FROM r"""
)
def required_fields(t: Tables) -> DataFrame:
    return P.required_rate(t.documents, ["lang", "source", "text"])


@query(
    """
    WITH m AS (SELECT o_orderkey, lower(split_part(o_orderpriority, '-', 2)) AS p, CASE WHEN o_orderkey % 10 = 0 THEN 'sonnet_HighComplex' ELSE 'plain' END AS g FROM orders)
    SELECT o_orderkey, CASE p WHEN 'low' THEN 'basic' WHEN 'medium' THEN 'medium' WHEN 'high' THEN 'hard' ELSE p END AS difficulty,
           CASE WHEN contains(lower(g), 'highcomplex') THEN 'high' WHEN p IN ('low', 'easy', 'beginner') THEN 'low' WHEN p IN ('medium', 'intermediate') THEN 'medium' WHEN p IN ('hard', 'high', 'advanced', 'expert') THEN 'high' END AS complexity FROM m"""
)
def difficulty_maps(t: Tables) -> DataFrame:
    stated = F.element_at(F.split("o_orderpriority", "-"), 2)
    generator = F.when(F.col("o_orderkey") % 10 == 0, "sonnet_HighComplex").otherwise("plain")
    return t.orders.select("o_orderkey", P.difficulty(stated).alias("difficulty"), P.complexity_hint(generator, stated).alias("complexity"))


@query(
    """
    WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE 'short' END AS text, CASE WHEN turn % 3 = 1 THEN role ELSE '  ' END AS prompt, CASE WHEN turn % 3 = 1 THEN substr(text, 1, 40) END AS answer, role FROM conversations)
    SELECT conv_id, turn, sha256(CASE WHEN length(text) >= 50 THEN text WHEN trim(prompt) <> '' OR trim(answer) <> '' THEN concat_ws(chr(10), nullif(trim(prompt), ''), nullif(trim(answer), '')) ELSE concat_ws(' ', text, prompt, answer, role) END) AS text_sha,
           sha256(CASE WHEN trim(prompt) <> '' AND trim(answer) <> '' THEN 'Q: ' || trim(prompt) || chr(10) || 'A: ' || trim(answer) ELSE trim(text) END) AS pair_sha FROM r"""
)
def row_texts(t: Tables) -> DataFrame:
    turn = F.col("turn") % 3
    rows = t.conversations.select(
        "conv_id", "turn", F.when(turn == 0, F.col("text")).otherwise("short").alias("text"), F.when(turn == 1, F.col("role")).otherwise("  ").alias("prompt"),
        F.when(turn == 1, F.substring("text", 1, 40)).alias("answer"), "role",
    )
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("conv_id", "turn", sha(P.row_text(rows)).alias("text_sha"), sha(P.question_and_answer(rows, [("prompt", "answer"), ("text",)])).alias("pair_sha"))


@query(
    """
    WITH d AS (SELECT CASE WHEN doc_id % 5 = 0 THEN doc_id::VARCHAR ELSE source || ':' || doc_id END AS id, lang FROM documents), s AS (SELECT source || ':' || doc_id AS id FROM documents WHERE doc_id % 7 = 0 AND doc_id % 5 <> 0)
    SELECT d.id, CASE WHEN s.id IS NOT NULL THEN 'stored plan' WHEN d.id LIKE 'src1:%' THEN 'sections' WHEN d.id LIKE 'src2:%' THEN 'windows' ELSE 'two_pass' END AS plan,
           CASE WHEN s.id IS NOT NULL THEN 'stored' WHEN d.id LIKE 'src1:%' OR d.id LIKE 'src2:%' THEN 'prefix' ELSE 'general' END AS plan_source FROM d LEFT JOIN s ON d.id = s.id"""
)
def plans_by_prefix(t: Tables) -> DataFrame:
    """The chunking plan of each document: a stored one, that of its source, or the general one."""
    named = F.concat_ws(":", "source", F.col("doc_id").cast("string"))
    docs = t.documents.select(F.when(F.col("doc_id") % 5 == 0, F.col("doc_id").cast("string")).otherwise(named).alias("id"))
    stored = t.documents.where("doc_id % 7 = 0").select(named.alias("doc_id"), F.lit("stored plan").alias("plan"))
    defaults = t.spark.createDataFrame([("src1", "sections"), ("src2", "windows"), ("_GENERIC_", "two_pass")], "prefix string, plan string")
    return P.with_plan(docs, "id", stored, defaults)


@query(
    """
    WITH q AS (SELECT conv_id, turn, text, CASE WHEN turn % 5 = 4 THEN 'refuse' ELSE role END AS sub, CASE WHEN length(text) > 600 THEN 'advanced' ELSE 'basic' END AS d, regexp_extract_all(text, '[0-9]{4}') AS s FROM conversations)
    SELECT conv_id, turn, (d = 'advanced' OR len(s) > 0 OR contains(lower(text), 'section') OR contains(lower(text), 'notification')) AND sub <> 'refuse' AS must_cite FROM q"""
)
def must_cite(t: Tables) -> DataFrame:
    text = F.col("text")
    sub = F.when(F.col("turn") % 5 == 4, "refuse").otherwise(F.col("role"))
    hard = F.when(F.length(text) > 600, "advanced").otherwise("basic")
    return t.conversations.select("conv_id", "turn", E.must_cite(text, sub, hard, F.regexp_extract_all(text, F.lit("[0-9]{4}"), 0)).alias("must_cite"))


@query(
    """
    WITH c AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, ' th', ' companyth', 'g') ELSE regexp_replace(text, ' th', ' numberth', 'g') END AS bad FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM documents))
    SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(bad, '\\bcompany([a-z])', 'con\\1', 'g'), '\\bCompany([a-z])', 'Con\\1', 'g'), '\\bnumber([a-z]{2,})', 'non\\1', 'g')) AS mended_sha FROM c"""
)
def mended_scans(t: Tables) -> DataFrame:
    """Documents with scanning faults put in and taken out again (what is not ASCII as question marks, as word bounds differ between engines beyond it)."""
    text = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", " th", " companyth")).otherwise(F.regexp_replace("text", " th", " numberth"))
    return t.documents.withColumn("text", T.ascii_only(F.col("text"))).select("doc_id", F.sha2(T.mended_scan(text).cast("binary"), 256).alias("mended_sha"))
