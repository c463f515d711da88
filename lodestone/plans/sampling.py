"""Sampling queries: quotas, strata, splits, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.identifiers import shuffle_key
from lodestone.operators import sampling as S

from .registry import Tables, query

_HASH = "sha256({seed} || '|' || {key})"


@query(
    """
    WITH c AS (SELECT lang, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY lang),
    k AS (SELECT *, least(0.4, greatest(0.05, share)) AS c FROM c)
    SELECT lang, n, share, round_even(c * 500 / sum(c) OVER (), 0)::BIGINT AS quota FROM k"""
)
def quota_clamp(t: Tables) -> DataFrame:
    return S.clamped_quotas(t.documents, "lang", 500)


_STRATA = """
    c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), p AS (SELECT *, round_even(n * 200 / sum(n) OVER (), 0)::BIGINT AS part, row_number() OVER (ORDER BY n DESC, lang) AS r, count(*) OVER () AS k FROM c),
    q AS (SELECT lang, greatest(0, least(n, CASE WHEN r = k THEN 200 - coalesce(sum(part) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE part END)) AS quota FROM p)"""


@query(
    f"""
    WITH {_STRATA}, d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_HASH.format(seed=7, key="doc_id")}, doc_id) AS r FROM documents)
    SELECT doc_id, d.lang FROM d JOIN q ON d.lang = q.lang WHERE r <= quota"""
)
def stratified_pick(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang")
    return S.pick(docs, ["lang"], S.proportional_quotas(docs, "lang", 200), [shuffle_key(7, F.col("doc_id")), F.col("doc_id")], most=200)


@query(
    f"""
    WITH c AS (SELECT lang, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY lang),
    q AS (SELECT lang, round_even(least(0.4, greatest(0.05, share)) * 300 / sum(least(0.4, greatest(0.05, share))) OVER (), 0) AS quota FROM c),
    d AS (SELECT doc_id, lang, CASE WHEN n_chars < 800 THEN 'LOW' WHEN n_chars < 3000 THEN 'MEDIUM' ELSE 'HIGH' END AS band, {_HASH.format(seed=3, key="doc_id")} AS h FROM documents),
    f AS (SELECT d.*, quota, row_number() OVER (PARTITION BY d.lang, band ORDER BY h, doc_id) <= round_even(quota * CASE band WHEN 'LOW' THEN 0.35 WHEN 'MEDIUM' THEN 0.45 ELSE 0.20 END, 0) AS first FROM d JOIN q ON d.lang = q.lang),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY first DESC, h, doc_id) AS place FROM f) SELECT doc_id, lang, band FROM o WHERE place <= quota"""
)
def two_way_quota(t: Tables) -> DataFrame:
    band = F.when(F.col("n_chars") < 800, "LOW").when(F.col("n_chars") < 3000, "MEDIUM").otherwise("HIGH")
    docs = t.documents.select("doc_id", "lang", band.alias("band"))
    return S.two_way_pick(docs, "lang", "band", {"LOW": 0.35, "MEDIUM": 0.45, "HIGH": 0.20}, S.clamped_quotas(docs, "lang", 300), 3, "doc_id", most=300)


@query(
    f"""
    WITH k AS (SELECT conv_id, {_HASH.format(seed=11, key="conv_id")} AS h FROM (SELECT DISTINCT conv_id FROM conversations)),
    c AS (SELECT max(h) AS cut FROM (SELECT h FROM k ORDER BY h LIMIT (SELECT greatest(1, (count(*) * 0.05)::INT) FROM k)))
    SELECT x.conv_id, turn, CASE WHEN h <= cut THEN 'val' ELSE 'train' END AS split FROM conversations x JOIN k ON x.conv_id = k.conv_id, c"""
)
def train_val_split(t: Tables) -> DataFrame:
    return S.split_by_key(t.conversations.select("conv_id", "turn"), "conv_id", 0.05, 11)


@query(
    f"""
    WITH b AS (SELECT doc_id, source, {_HASH.format(seed=5, key="doc_id")} AS h FROM documents)
    SELECT doc_id, source FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY h, doc_id) <= 5"""
)
def per_bucket_sample(t: Tables) -> DataFrame:
    return S.pick(t.documents.select("doc_id", "source"), ["source"], 5, [shuffle_key(5, F.col("doc_id")), F.col("doc_id")])


@query(
    f"""
    WITH b AS (SELECT doc_id, CASE WHEN n_chars < 800 THEN 's' WHEN n_chars < 3000 THEN 'm' ELSE 'l' END AS size_band, {_HASH.format(seed=9, key="doc_id")} AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
    SELECT doc_id, size_band FROM b QUALIFY row_number() OVER (PARTITION BY size_band ORDER BY h, doc_id) <= CASE size_band WHEN 's' THEN 50 WHEN 'm' THEN 35 ELSE 15 END"""
)
def size_band_sample(t: Tables) -> DataFrame:
    band = F.when(F.col("n_chars") < 800, "s").when(F.col("n_chars") < 3000, "m").otherwise("l")
    docs = t.documents.select("doc_id", band.alias("size_band")).join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    quota = F.when(F.col("size_band") == "s", 50).when(F.col("size_band") == "m", 35).otherwise(15)
    return S.pick(docs, ["size_band"], docs.select("size_band").distinct().withColumn("quota", quota), [shuffle_key(9, F.col("doc_id")), F.col("doc_id")], most=50)


@query(
    f"""
    WITH b AS (SELECT doc_id, CASE WHEN n_chars < 800 THEN 's' WHEN n_chars < 3000 THEN 'm' ELSE 'l' END AS size_band, {_HASH.format(seed=9, key="doc_id")} AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
    f AS (SELECT *, row_number() OVER (PARTITION BY size_band ORDER BY h, doc_id) <= CASE size_band WHEN 's' THEN 50 WHEN 'm' THEN 35 ELSE 15 END AS first FROM b)
    SELECT doc_id, size_band FROM f QUALIFY row_number() OVER (ORDER BY first DESC, h, doc_id) <= 100"""
)
def size_band_filled(t: Tables) -> DataFrame:
    """As :func:`size_band_sample`, filled up to 100 rows when a band is short."""
    band = F.when(F.col("n_chars") < 800, "s").when(F.col("n_chars") < 3000, "m").otherwise("l")
    docs = t.documents.select("doc_id", band.alias("size_band")).join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return S.filled_pick(docs, "size_band", {"s": 50, "m": 35, "l": 15}, [shuffle_key(9, F.col("doc_id")), F.col("doc_id")])


@query(
    """
    WITH p AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations)
    SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN 'missing:text' WHEN n < 10 THEN 'question_too_short' WHEN n < 30 THEN 'text_too_short' ELSE 'ok' END AS reason FROM p"""
)
def pair_validation(t: Tables) -> DataFrame:
    n = F.length("text")
    reason = F.when(F.col("text").isNull() | (n == 0), "missing:text").when(n < 10, "question_too_short").when(n < 30, "text_too_short").otherwise("ok")
    return t.conversations.select("conv_id", "turn", reason.alias("reason"))


@query(
    f"""
    WITH d AS (SELECT doc_id, source, {_HASH.format(seed=13, key="doc_id")} AS h, doc_id IN (SELECT doc_id FROM labels) AS covered FROM documents WHERE source IN ('src1', 'src2', 'src3')),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY covered DESC, h, doc_id) AS n FROM d) SELECT doc_id, source, covered FROM r WHERE n <= CASE source WHEN 'src1' THEN 20 WHEN 'src2' THEN 12 ELSE 8 END"""
)
def prefix_mix(t: Tables) -> DataFrame:
    """A fixed number of rows of each source, labelled ones first."""
    labelled = t.labels.select("doc_id").distinct().withColumn("covered", F.lit(True))
    docs = t.documents.where(F.col("source").isin("src1", "src2", "src3")).select("doc_id", "source").join(labelled, "doc_id", "left").select("doc_id", "source", F.coalesce("covered", F.lit(False)).alias("covered"))
    quota = F.when(F.col("source") == "src1", 20).when(F.col("source") == "src2", 12).otherwise(8)
    return S.pick(docs, ["source"], docs.select("source").distinct().withColumn("quota", quota), [F.desc("covered"), shuffle_key(13, F.col("doc_id")), F.col("doc_id")], most=20)


@query(
    f"""
    WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT *, least(20, n) AS base, n - least(20, n) AS rest FROM c),
    a AS (SELECT *, base + coalesce(least(round_even(greatest(380 - sum(base) OVER (), 0) * rest / nullif(sum(rest) OVER (), 0), 0)::BIGINT, rest), 0) AS quota FROM b),
    q AS (SELECT source, CASE WHEN source = 'src0' THEN greatest(0, least(n, quota + 380 - sum(quota) OVER ())) ELSE quota END AS quota FROM a),
    d AS (SELECT doc_id, d.source, quota, sha256(lower(trim(text))) AS k, {_HASH.format(seed=17, key="doc_id")} AS h, row_number() OVER (PARTITION BY d.source ORDER BY (l.doc_id IS NULL), {_HASH.format(seed=17, key="d.doc_id")}, d.doc_id) AS n
          FROM documents d JOIN q ON d.source = q.source LEFT JOIN labels l USING (doc_id)),
    o AS (SELECT *, row_number() OVER (ORDER BY n > quota, CASE WHEN n <= quota THEN source END, CASE WHEN n <= quota THEN n END, h, doc_id) AS place, n <= quota AS first FROM d),
    u AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place) AS r FROM o), t AS (SELECT * FROM u WHERE r = 1 ORDER BY place LIMIT 380)
    SELECT doc_id, source FROM t WHERE first OR (SELECT count(*) FROM t WHERE first) < 350"""
)
def floored_sample(t: Tables) -> DataFrame:
    """380 documents: 20 of each source and the rest in proportion, labelled ones first, one for each text (case and outer blanks aside), filled up."""
    labelled = t.labels.select("doc_id").distinct().withColumn("covered", F.lit(True))
    docs = t.documents.select("doc_id", "source", F.sha2(F.lower(F.trim("text")).cast("binary"), 256).alias("head")).join(labelled, "doc_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    quotas = S.floored_quotas(docs, "source", 380, 20, "src0")
    order = [F.desc("covered"), shuffle_key(17, F.col("doc_id")), F.col("doc_id")]
    return S.distinct_pick(docs, "source", quotas, order, F.col("head"), 380, 350, 17, "doc_id").select("doc_id", "source")


@query(
    f"""
    WITH u AS (SELECT conv_id, turn, role, CASE WHEN length(text) < 300 THEN 'LOW' WHEN length(text) < 900 THEN 'MEDIUM' ELSE 'HIGH' END AS band, conv_id * 1000 + turn AS id FROM conversations),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {_HASH.format(seed=19, key="id")}, id) AS k FROM u), d AS (SELECT id, role, band, conv_id, {_HASH.format(seed=19, key="id")} AS h FROM o WHERE k = 1),
    c AS (SELECT role, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM d GROUP BY role), q AS (SELECT role, round_even(least(0.4, greatest(0.05, share)) * 60 / sum(least(0.4, greatest(0.05, share))) OVER (), 0) AS quota FROM c),
    f AS (SELECT d.*, quota, row_number() OVER (PARTITION BY d.role, band ORDER BY h, id) <= round_even(quota * CASE band WHEN 'LOW' THEN 0.35 WHEN 'MEDIUM' THEN 0.45 ELSE 0.20 END, 0) AS first FROM d JOIN q ON d.role = q.role),
    p AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY first DESC, h, id) AS place FROM f) SELECT id, role, band, conv_id FROM p WHERE place <= quota"""
)
def one_row_a_unit(t: Tables) -> DataFrame:
    """The two-way quota over conversations, with one turn of each."""
    n = F.length("text")
    band = F.when(n < 300, "LOW").when(n < 900, "MEDIUM").otherwise("HIGH")
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", band.alias("band"), "conv_id")
    units = turns.groupBy("conv_id").agg(F.min_by(F.struct("id", "role", "band"), F.struct(shuffle_key(19, F.col("id")), "id")).alias("r")).select("conv_id", "r.*")
    return S.two_way_pick(turns, "role", "band", {"LOW": 0.35, "MEDIUM": 0.45, "HIGH": 0.20}, S.clamped_quotas(units, "role", 60), 19, "id", most=60, unit="conv_id").select("id", "role", "band", "conv_id")
