"""Queries over single documents: canonical text, classes, flags, tags, identifiers, fixed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import identifiers as I
from lodestone.functions import text as T
from lodestone.operators import dedup, tagging

from .registry import Tables, query

CANON = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
TOPICS = {
    "art:the": ["the", "of the"], "form:ing": ["ing ", "ion"], "stop:and": ["and", "that"],
    "lang:fr": ["le ", "les ", "que "], "lang:de": ["der ", "die ", "und "], "lang:es": ["de ", "la ", "ció"],
}
#: Blanks bound the words, as word boundaries differ between regex engines beyond ASCII.
ROUTES = {"en": [" the ", " and ", " of "], "fr": [" le ", " des ", " que "], "de": [" der ", " und ", " die "], "es": [" la ", " para ", " del "]}


@query(
    f"""
    WITH h AS (SELECT doc_id, sha256({CANON}) AS k FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS canonical_id, count(*) OVER (PARTITION BY k) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY k) AS is_canonical FROM h"""
)
def exact_dedup(t: Tables) -> DataFrame:
    return dedup.dedup_documents(t.documents)


@query(
    f"""
    SELECT sha256({CANON}) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1
    ORDER BY n DESC, content_hash LIMIT 15"""
)
def dup_hash_groups(t: Tables) -> DataFrame:
    groups = t.documents.groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1").orderBy(F.desc("n"), "content_hash").limit(15)


@query(
    f"""
    WITH h AS (SELECT sha256({CANON}) AS k, source FROM documents), g AS (SELECT k, count(DISTINCT source) AS s, count(*) AS n FROM h GROUP BY k)
    SELECT count(*) AS n_hashes, sum((s > 1)::INT)::BIGINT AS cross_source, avg((s > 1)::INT) AS cross_rate, sum(n)::BIGINT AS n_rows FROM g"""
)
def cross_source_dups(t: Tables) -> DataFrame:
    pairs = t.documents.groupBy(T.content_hash(F.col("text")).alias("k"), "source").agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy("k").agg(F.count("source").alias("s"), F.sum("n").alias("n"))
    crossed = (F.col("s") > 1).cast("int")
    return per.agg(F.count(F.lit(1)).alias("n_hashes"), F.sum(crossed).alias("cross_source"), F.avg(crossed).alias("cross_rate"), F.sum("n").alias("n_rows"))


@query(
    f"""
    WITH h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256({CANON})) AS c FROM documents)
    SELECT c AS canonical_id, doc_id AS linked_id FROM h WHERE c <> doc_id"""
)
def linked_docs(t: Tables) -> DataFrame:
    return dedup.link_pairs(t.documents.select("doc_id", "text"), T.content_hash(F.col("text")), "doc_id")


@query(
    """
    SELECT doc_id, CASE WHEN length(text) < 500 THEN 'ocr' WHEN length(text) / greatest(pages, 1) < 200 THEN 'low_density' ELSE 'born' END AS text_source
    FROM (SELECT *, len(string_split(text, chr(10))) AS pages FROM documents)"""
)
def text_source_class(t: Tables) -> DataFrame:
    pages = F.size(F.split("text", "\n"))
    return t.documents.select("doc_id", tagging.text_source(F.length("text"), pages).alias("text_source"))


@query(
    """
    SELECT CASE WHEN n_chars < 200 THEN '<200' WHEN n_chars < 500 THEN '200-500' WHEN n_chars < 1000 THEN '500-1000'
                WHEN n_chars < 2000 THEN '1000-2000' WHEN n_chars < 4000 THEN '2000-4000' ELSE '>=4000' END AS bucket,
           lang, count(*) AS n, avg(n_chars) AS mean_chars FROM documents GROUP BY ALL"""
)
def length_buckets(t: Tables) -> DataFrame:
    bucket = tagging.length_bucket(F.col("n_chars"), [200, 500, 1000, 2000, 4000])
    return t.documents.groupBy(bucket.alias("bucket"), "lang").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars"))


@query(
    """
    SELECT source, count(*) AS n, avg(n_chars) AS mean_chars, median(n_chars) AS median_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars,
           count(DISTINCT md5(text)) AS distinct_texts FROM documents GROUP BY source"""
)
def length_stats(t: Tables) -> DataFrame:
    docs = t.documents.select("source", "n_chars", F.md5(F.col("text").cast("binary")).alias("h"))
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars"), F.median("n_chars").alias("median_chars"),
        F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.countDistinct("h").alias("distinct_texts"),
    )


@query(
    r"""
    WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS clean, text FROM documents)
    SELECT doc_id, length(clean) AS clean_chars,
           CASE WHEN length(clean) < 40 THEN 'too_short' WHEN length(clean) > 50000 THEN 'too_long'
                WHEN length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / greatest(length(text), 1) < 0.7 THEN 'not_ascii' ELSE 'keep' END AS decision
    FROM c"""
)
def curate_filter(t: Tables) -> DataFrame:
    clean = F.length(T.fold_blanks(F.col("text")))
    decision = tagging.cascade((clean < 40, "too_short"), (clean > 50_000, "too_long"), (T.ascii_ratio(F.col("text")) < 0.7, "not_ascii"), otherwise="keep")
    return t.documents.select("doc_id", clean.alias("clean_chars"), decision.alias("decision"))


@query(
    """
    SELECT doc_id, length(text) >= 200 AND NOT contains(text, '|') AND NOT (len(string_split(text, chr(10))) - 1 > 20
           AND length(text) / (len(string_split(text, chr(10)))) < 30) AS substantive FROM documents"""
)
def substantive_chunks(t: Tables) -> DataFrame:
    lines = F.size(F.split("text", "\n"))
    ok = (F.length("text") >= 200) & ~F.col("text").contains("|") & ~((lines - 1 > 20) & (F.length("text") / lines < 30))
    return t.documents.select("doc_id", ok.alias("substantive"))


@query(
    """
    SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 300 THEN 'STUB' END, CASE WHEN n_chars > 10000 THEN 'LARGE' END,
           CASE WHEN NOT regexp_matches(lower(text), 'the|der|les|que') THEN 'KW-MISS' END,
           CASE WHEN regexp_matches(lower(text), 'licen[cs]e') THEN 'LICENCE' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents"""
)
def quality_flags(t: Tables) -> DataFrame:
    low = F.lower("text")
    found = tagging.flags((F.col("n_chars") < 300, "STUB"), (F.col("n_chars") > 10_000, "LARGE"), (~low.rlike("the|der|les|que"), "KW-MISS"), (low.rlike("licen[cs]e"), "LICENCE"))
    return t.documents.select("doc_id", F.array_join(found, ",").alias("flags"))


def _topic_sql(restricted: bool = False) -> str:
    # All phrases of a topic in one alternation, as the operator does; distinct matches count.
    given = "CASE WHEN doc_id % 3 = 0 THEN 'lang' WHEN doc_id % 3 = 1 THEN 'stop' END" if restricted else "NULL"
    rows = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS topic, len(list_distinct(regexp_extract_all(lower(text), '(?:{'|'.join(v)})'))) AS score FROM documents WHERE coalesce({given}, '{k.partition(':')[0]}') = '{k.partition(':')[0]}'"
        for k, v in TOPICS.items()
    )
    return f"""
        WITH s AS ({rows}), h AS (SELECT * FROM s WHERE score > 0),
        p AS (SELECT doc_id, topic, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(topic), topic) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM h)
        SELECT d.doc_id, p.topic AS primary_topic, coalesce(p.n, 0) AS n_topics FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id AND p.r = 1"""


@query(_topic_sql())
def topic_tag(t: Tables) -> DataFrame:
    return tagging.tag(t.documents, "text", TOPICS).select("doc_id", "primary_topic", F.size("topics").cast("long").alias("n_topics"))


@query(_topic_sql(restricted=True))
def topics_in_category(t: Tables) -> DataFrame:
    """Topics of documents, two thirds of which have a category that the topics must have too."""
    third = F.col("doc_id") % 3
    docs = t.documents.select("doc_id", "text", F.when(third == 0, "lang").when(third == 1, "stop").alias("category"))
    return tagging.tag(docs, "text", TOPICS, "category").select("doc_id", "primary_topic", F.size("topics").cast("long").alias("n_topics"))


@query(
    """
    WITH d AS (SELECT doc_id, text, n_chars, CASE lang WHEN 'en' THEN 'license' WHEN 'fr' THEN 'LES' WHEN 'de' THEN 'und' END AS kw, len(string_split(text, chr(10))) AS pages FROM documents),
    f AS (SELECT *, kw IS NOT NULL AND contains(lower(text), lower(kw)) AS in_body, kw IS NOT NULL AND contains(lower(substr(text, 1, 60)), lower(kw)) AS in_first FROM d)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars / pages < 100 THEN 'SCANNED' END, CASE WHEN kw IS NOT NULL AND NOT in_body THEN 'KW-MISS(' || kw || ')' END, CASE WHEN in_body AND NOT in_first THEN 'KW-LATE' END,
           CASE WHEN pages < 8 THEN 'STUB' END, CASE WHEN n_chars > 8000 THEN 'LARGE' END], lambda x: x IS NOT NULL), ',') AS flags FROM f"""
)
def audit_flags(t: Tables) -> DataFrame:
    """Audit flags of documents: lines stand for pages, characters for kilobytes, and each language has an expected word."""
    pages = F.size(F.split("text", "\n"))
    keyword = F.when(F.col("lang") == "en", "license").when(F.col("lang") == "fr", "LES").when(F.col("lang") == "de", "und")
    found = tagging.audit_flags(F.col("n_chars") / pages < 100, keyword, F.substring("text", 1, 60), F.col("text"), pages, F.col("n_chars"))
    return t.documents.select("doc_id", F.array_join(found, ",").alias("flags"))


@query(
    r"""
    WITH q AS (SELECT doc_id, text, len(regexp_extract_all(text, '[0-9]{3,}')) AS entities, source, regexp_matches(text, '(?i)\bhouse\b')::INT + regexp_matches(text, '(?i)\bwater\b')::INT + regexp_matches(text, '(?i)\bpeople\b')::INT AS places FROM (SELECT doc_id, source, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text FROM documents)),
    s AS (SELECT doc_id, CASE WHEN entities >= 4 THEN 3 WHEN entities >= 2 THEN 1 ELSE 0 END + least(places, 2) + regexp_matches(text, '(?i)\b(?:then|after)\b')::INT * 2 + (len(regexp_extract_all(text, '(?i)\b(?:is|are|was)\b')) >= 3)::INT
          + (len(string_split_regex(trim(text), '\s+')) >= 40)::INT - (regexp_matches(text, '(?i)^(?:the|a|in)\b') AND entities <= 1 AND places = 0)::INT * 2 + CASE source WHEN 'src1' THEN 1 WHEN 'src2' THEN -1 ELSE 0 END AS score FROM q)
    SELECT doc_id, score, CASE WHEN score <= 0 THEN 'LOW' WHEN score <= 3 THEN 'MEDIUM' ELSE 'HIGH' END AS complexity FROM s"""
)
def question_scores(t: Tables) -> DataFrame:
    """Complexity of texts (what is not ASCII as question marks, as word bounds differ between engines beyond it) as if they were questions: long numbers stand for entities, common words for places."""
    text = F.col("text")
    difficulty = F.when(F.col("source") == "src1", "complex").when(F.col("source") == "src2", "basic").otherwise("")
    entities = F.regexp_count(text, F.lit("[0-9]{3,}"))
    score = tagging.question_score(text, entities, difficulty, ["house", "water", "people"], r"\b(?:is|are|was)\b", r"\b(?:then|after)\b", r"^(?:the|a|in)\b")
    rows = t.documents.withColumn("text", T.ascii_only(F.col("text"))).select("doc_id", score.alias("score"))
    return rows.withColumn("complexity", tagging.complexity(F.col("score")))


def _route_sql() -> str:
    score = {k: " + ".join(f"regexp_matches(text, '(?i){p}')::INT" for p in v) for k, v in ROUTES.items()}
    rows = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS k, {s} AS s FROM documents" for k, s in score.items())
    return f"""
        WITH r AS ({rows}), m AS (SELECT doc_id, max(s) AS top FROM r GROUP BY doc_id)
        SELECT m.doc_id, CASE WHEN any_value(top) > 0 AND count(*) = 1 THEN min(k) END AS route
        FROM m JOIN r ON r.doc_id = m.doc_id AND r.s = m.top GROUP BY m.doc_id"""


@query(_route_sql())
def keyword_route(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tagging.route(F.col("text"), ROUTES).alias("route"))


@query(
    r"""
    SELECT item_id, len(string_split_regex(trim(text), '\s+')) AS n_words, (len(string_split_regex(trim(text), '\s+')) >= 40)::INT * 1
           + regexp_matches(lower(text), '\b(if|then|and then)\b')::INT * 2 + CASE WHEN len(regexp_extract_all(text, '[.?!]')) >= 3 THEN 1 ELSE 0 END
           - regexp_matches(lower(text), '^(what|which|define)')::INT * 2 AS score,
           CASE WHEN score <= 0 THEN 'LOW' WHEN score <= 3 THEN 'MEDIUM' ELSE 'HIGH' END AS complexity FROM benchmark"""
)
def question_complexity(t: Tables) -> DataFrame:
    n = F.size(F.split(F.trim("text"), r"\s+"))
    low = F.lower("text")
    score = (
        (n >= 40).cast("int") + low.rlike(r"\b(if|then|and then)\b").cast("int") * 2
        + (F.regexp_count("text", F.lit("[.?!]")) >= 3).cast("int") - low.rlike("^(what|which|define)").cast("int") * 2
    )
    rows = t.benchmark.select("item_id", n.alias("n_words"), score.alias("score"))
    return rows.withColumn("complexity", tagging.complexity(F.col("score")))


@query(
    """
    SELECT doc_id, ('0x' || substr(sha256(doc_id || '|' || source || '|' || n_chars), 1, 15))::BIGINT % 1000000000000000 AS point_id,
           substr(md5(doc_id || source), 1, 12) AS citation_id,
           ('0x' || substr(md5(lang), 7, 2) || substr(md5(lang), 5, 2) || substr(md5(lang), 3, 2) || substr(md5(lang), 1, 2))::BIGINT & 2147483647 AS term_id,
           ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 5 AS gate FROM documents"""
)
def stable_ids(t: Tables) -> DataFrame:
    doc, source = F.col("doc_id"), F.col("source")
    return t.documents.select(
        "doc_id", I.point_id(doc, source, F.col("n_chars")).alias("point_id"), I.citation_id(doc, source).alias("citation_id"),
        I.term_id(F.col("lang")).alias("term_id"), I.gate(doc, 5).alias("gate"),
    )


@query(
    """
    SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
           concat_ws(' > ', nullif(trim(p_type), ''), nullif(trim(p_brand), ''), nullif(trim(p_name), '')) AS breadcrumb FROM part"""
)
def slugs_and_breadcrumbs(t: Tables) -> DataFrame:
    c = F.col
    return t.part.select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), T.breadcrumb(c("p_type"), c("p_brand"), c("p_name")).alias("breadcrumb"))


@query(
    """
    SELECT doc_id, g.i AS chunk_no, g.i * 3500 AS char_start, least((g.i + 1) * 3500, length(text)) AS char_end, sha256(substr(text, g.i * 3500 + 1, 3500)) AS chunk_sha
    FROM documents, LATERAL (SELECT unnest(range((length(text) + 3499) // 3500)) AS i) g"""
)
def fixed_chunks(t: Tables) -> DataFrame:
    docs = t.documents.where(F.length("text") > 0)
    numbered = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 3500).cast("int"))).alias("chunk_no"))
    piece = F.substr("text", F.col("chunk_no") * 3500 + 1, F.lit(3500))
    return numbered.select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), (F.col("chunk_no") * 3500).cast("long").alias("char_start"),
        F.least((F.col("chunk_no") + 1) * 3500, F.length("text")).cast("long").alias("char_end"), F.sha2(piece.cast("binary"), 256).alias("chunk_sha"),
    )


@query(
    """
    WITH p AS (SELECT page_id, url, lower(html) AS h FROM pages)
    SELECT page_id, nullif(regexp_extract(url, '://([^/]+)', 1), '') AS host, regexp_extract(url, '(?:19|20)[0-9]{2}', 0) AS year_text,
           len(regexp_extract_all(h, '<script')) AS scripts, len(regexp_extract_all(h, '<(?:p|div|li|h[1-6])[ >]')) AS blocks FROM p"""
)
def page_profile(t: Tables) -> DataFrame:
    h = F.lower("html")
    return t.pages.select(
        "page_id", F.nullif(F.regexp_extract("url", "://([^/]+)", 1), F.lit("")).alias("host"), F.regexp_extract("url", "(?:19|20)[0-9]{2}", 0).alias("year_text"),
        F.regexp_count(h, F.lit("<script")).cast("long").alias("scripts"), F.regexp_count(h, F.lit("<(?:p|div|li|h[1-6])[ >]")).cast("long").alias("blocks"),
    )


@query(
    """
    WITH s AS (SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS b FROM part)
    SELECT p_partkey, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END AS similarity,
           similarity >= 0.5 AS passed FROM s"""
)
def edit_similarity_gate(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", T.edit_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))
    return rows.withColumn("passed", F.col("similarity") >= 0.5)


@query(
    """
    WITH w AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS ws FROM conversations),
    g AS (SELECT conv_id, turn, role, CASE WHEN len(ws) >= 3 THEN list_distinct([array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)]) ELSE [] END AS grams FROM w),
    p AS (SELECT a.conv_id, a.turn, a.grams AS own, b.grams AS previous FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
    SELECT conv_id, turn, len(own) AS n_grams, len(list_intersect(own, previous)) / nullif(len(own), 0) AS coverage,
           len(list_intersect(own, previous)) / nullif(len(own) + len(previous) - len(list_intersect(own, previous)), 0) AS jaccard FROM p"""
)
def turn_overlap(t: Tables) -> DataFrame:
    grams = t.conversations.select("conv_id", "turn", T.word_grams(F.col("text"), 3).alias("grams"))
    before = grams.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("grams").alias("previous"))
    rows = grams.join(before, ["conv_id", "turn"])
    return rows.select(
        "conv_id", "turn", F.size("grams").cast("long").alias("n_grams"), T.coverage(F.col("grams"), F.col("previous")).alias("coverage"),
        T.jaccard(F.col("grams"), F.col("previous")).alias("jaccard"),
    )


@query(
    """
    WITH m AS (SELECT doc_id, length(text) AS n, CASE WHEN length(text) > 4000 THEN substr(text, (length(text) // 2 - 1999)::INT, 4000) ELSE text END AS body FROM documents),
    p AS (SELECT doc_id, n, unnest(list_transform(range(1, greatest(length(body) - 30, 1) + 1, 5), lambda i: substr(body, i::INT, 30))) AS piece FROM m WHERE n >= 120),
    c AS (SELECT doc_id, max(k) AS k FROM (SELECT doc_id, piece, count(*) AS k FROM p GROUP BY ALL) GROUP BY doc_id)
    SELECT m.doc_id, coalesce(k >= 4, false) AS loops FROM m LEFT JOIN c ON m.doc_id = c.doc_id"""
)
def repetition_loops(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.repeats_itself(F.col("text")).alias("loops"))


@query(
    r"""
    SELECT doc_id, nullif(regexp_extract(text, '\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b', 0), '') AS iso_date,
           CASE WHEN regexp_matches(text, '(?i)\b(?:hsn|sac|chapter\s+heading)\s*(\d{2,8})\b') THEN 1
                WHEN regexp_matches(text, '(?i)\b(?:rate|duty|gst)\s+(?:on|of|for)\b') THEN 2 ELSE 0 END AS lookup_kind,
           len(regexp_extract_all(text, '[0-9]{4,8}')) AS numbers FROM documents"""
)
def lookup_features(t: Tables) -> DataFrame:
    text = F.col("text")
    kind = tagging.cascade((text.rlike(r"(?i)\b(?:hsn|sac|chapter\s+heading)\s*(\d{2,8})\b"), "1"), (text.rlike(r"(?i)\b(?:rate|duty|gst)\s+(?:on|of|for)\b"), "2"), otherwise="0")
    return t.documents.select(
        "doc_id", F.nullif(F.regexp_extract(text, r"\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b", 0), F.lit("")).alias("iso_date"),
        kind.cast("int").alias("lookup_kind"), F.regexp_count(text, F.lit("[0-9]{4,8}")).cast("long").alias("numbers"),
    )
