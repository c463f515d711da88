"""Join queries: as-of lookups, anti and semi joins, full outer differences, containment, shared-gram matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.arrays import sums_before
from lodestone.operators import dedup, scans, temporal
from lodestone.operators import retrieval as R
from lodestone.operators.phrases import gram_hits
from lodestone.operators.retrieval import measured
from lodestone.operators.scans import Segments

from .registry import Tables, query


def _probes(t: Tables) -> DataFrame:
    ships = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return ships.select("l_orderkey", "l_linenumber", "o_custkey", "l_shipdate")


_SHIPS = "SELECT l_orderkey, l_linenumber, o_custkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(
    f"""
    WITH h AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS last_order FROM orders GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, last_order FROM ({_SHIPS}) p ASOF JOIN h ON p.o_custkey = h.o_custkey AND p.l_shipdate >= h.o_orderdate"""
)
def asof_latest(t: Tables) -> DataFrame:
    history = t.orders.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("last_order"))
    found = temporal.as_of(_probes(t), history, ["o_custkey"], "l_shipdate", "o_orderdate", ["last_order"])
    return found.where("last_order is not null").select("l_orderkey", "l_linenumber", "last_order")


def _interval_sql(end: str) -> str:
    return f"""
        WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders),
        p AS ({_SHIPS})
        SELECT v.o_custkey, count(*) AS n_rows, sum(v.o_orderkey)::BIGINT AS key_sum FROM p JOIN v ON p.o_custkey = v.o_custkey
        WHERE v.valid_from <= p.l_shipdate AND (v.valid_to IS NULL OR v.valid_to {end} p.l_shipdate) GROUP BY v.o_custkey"""


def _intervals(t: Tables, closed: bool) -> DataFrame:
    versions = temporal.to_intervals(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey")
    found = temporal.version_join(_probes(t), versions.select("o_custkey", "o_orderkey", "valid_from", "valid_to"), ["o_custkey"], "l_shipdate", closed)
    return found.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


@query(_interval_sql(">"))
def asof_interval(t: Tables) -> DataFrame:
    return _intervals(t, closed=False)


@query(_interval_sql(">="))
def asof_closed(t: Tables) -> DataFrame:
    return _intervals(t, closed=True)


@query("SELECT o_custkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def latest_version(t: Tables) -> DataFrame:
    return temporal.latest(t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query(
    """
    SELECT p_brand, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY p_brand"""
)
def membership_join(t: Tables) -> DataFrame:
    lines = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")))
    joined = lines.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query(
    """
    WITH h AS (SELECT md5(text) AS k, lang, source, count(*) AS n FROM documents GROUP BY ALL)
    SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared_texts, sum(a.n * b.n)::BIGINT AS row_pairs
    FROM h a JOIN h b ON a.k = b.k AND a.lang = b.lang AND a.source < b.source GROUP BY ALL"""
)
def same_content_across_sources(t: Tables) -> DataFrame:
    # Rows collapse to one for each text and source before the self-join, so a hot text joins sources, not rows.
    h = t.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("k"), "lang", "source").agg(F.count(F.lit(1)).alias("n"))
    a, b = h.alias("a"), h.alias("b")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source")))
    return pairs.groupBy(F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b")).agg(
        F.count(F.lit(1)).alias("shared_texts"), F.sum(F.col("a.n") * F.col("b.n")).alias("row_pairs")
    )


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_with_default(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("SELECT source, count(*) AS pending FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def resume_pending(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels.select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("pending"))


@query("SELECT source, count(*) AS scoped, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source")
def scoped_rows(t: Tables) -> DataFrame:
    toxic = t.labels.where("toxic = 1").select("doc_id")
    return t.documents.select("doc_id", "source", "n_chars").join(toxic, "doc_id", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("scoped"), F.sum("n_chars").alias("chars"))


@query(
    """
    WITH t AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal > 4000 AS side FROM customer),
    m AS (SELECT c_nationkey, c_mktsegment, side, min(c_custkey) AS twin_id FROM t GROUP BY ALL)
    SELECT t.c_custkey, t.side, m.twin_id FROM t LEFT JOIN m ON t.c_nationkey = m.c_nationkey AND t.c_mktsegment = m.c_mktsegment AND t.side <> m.side"""
)
def twin_rows(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("side", F.col("c_acctbal") > 4000)
    return dedup.twins(rows, [F.col("c_nationkey"), F.col("c_mktsegment")], "c_custkey", "side")


@query(
    """
    WITH a AS (SELECT doc_id, quality::DOUBLE AS base FROM labels), b AS (SELECT doc_id, (CASE WHEN n_chars >= 400 THEN 1.0 ELSE 0.5 END)::DOUBLE AS score FROM documents WHERE lang = 'en')
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, base, score, CASE WHEN base IS NULL THEN 'added' WHEN score IS NULL THEN 'removed'
           WHEN score - base <= -0.5 THEN 'regressed' WHEN score - base > 0 THEN 'improved' ELSE 'same' END AS change
    FROM a FULL JOIN b ON a.doc_id = b.doc_id"""
)
def run_diff(t: Tables) -> DataFrame:
    base = t.labels.select("doc_id", F.col("quality").cast("double").alias("base"))
    score = t.documents.where("lang = 'en'").select("doc_id", F.when(F.col("n_chars") >= 400, 1.0).otherwise(0.5).alias("score"))
    delta = F.col("score") - F.col("base")
    change = F.when(F.col("base").isNull(), "added").when(F.col("score").isNull(), "removed").when(delta <= -0.5, "regressed").when(delta > 0, "improved").otherwise("same")
    return base.join(score, "doc_id", "full").select("doc_id", "base", "score", change.alias("change"))


@query(
    """
    SELECT count(*) FILTER (toxic = 0 AND n_chars >= 400) AS fixed, count(*) FILTER (toxic = 1 AND n_chars < 400) AS broken, count(*) AS compared
    FROM labels JOIN documents USING (doc_id)"""
)
def variant_fixed(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    miss, hit = F.col("toxic") == 0, F.col("n_chars") >= 400
    return rows.agg(F.count_if(miss & hit).alias("fixed"), F.count_if(~miss & ~hit).alias("broken"), F.count(F.lit(1)).alias("compared"))


@query(
    """
    WITH r AS (SELECT DISTINCT o_custkey AS k, o_orderdate AS a, o_orderdate + to_days((10 + o_orderkey % 50)::INT) AS b FROM orders)
    SELECT x.k AS o_custkey, count(*) AS contained FROM r x WHERE EXISTS (
        SELECT 1 FROM r y WHERE x.k = y.k AND y.a <= x.a AND y.b >= x.b AND (y.a, y.b) <> (x.a, x.b)) GROUP BY x.k"""
)
def contained_ranges(t: Tables) -> DataFrame:
    # Distinct ranges inside another one of the same key, whatever the order of rows: by running maxima, without pairs.
    spans = t.orders.select("o_custkey", F.col("o_orderdate").alias("a"), F.expr("o_orderdate + make_dt_interval(10 + o_orderkey % 50)").alias("b")).distinct()
    # Of ranges that begin together the longest comes first.
    spans = spans.withColumn("_less", -F.unix_micros(F.col("b").cast("timestamp")))
    rows = Segments.of(spans, ["o_custkey"], ["a", "_less"]).add(_upto=scans.highest(F.col("b"))).add(reach=scans.previous(F.col("_upto"))).result()
    inside = rows.where(F.col("reach") >= F.col("b"))
    return inside.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("contained"))


@query(
    """
    WITH RECURSIVE o AS (SELECT o_custkey, o_orderdate AS s, o_orderdate + INTERVAL 60 DAY AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
    f AS (SELECT c_custkey, 0::BIGINT AS n, TIMESTAMP '1992-01-01' AS cur, NULL::TIMESTAMP AS gap_start, NULL::TIMESTAMP AS gap_end FROM customer
          UNION ALL SELECT c_custkey, o.n, greatest(cur, e), CASE WHEN cur < s THEN cur END, CASE WHEN cur < s THEN s END FROM f JOIN o ON o_custkey = c_custkey AND o.n = f.n + 1),
    l AS (SELECT c_custkey, max(cur) AS cur FROM f GROUP BY c_custkey)
    SELECT c_custkey, gap_start, gap_end FROM f WHERE gap_start IS NOT NULL UNION ALL SELECT c_custkey, cur, TIMESTAMP '2010-01-01' FROM l WHERE cur < TIMESTAMP '2010-01-01'"""
)
def uncovered_gaps(t: Tables) -> DataFrame:
    """The parts of 18 years in which a customer has no order of the last 60 days; all of it for customers without orders."""
    spans = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("s"), F.expr("o_orderdate + interval 60 days").alias("e"))
    day = lambda d: F.lit(d).cast(t.orders.schema["o_orderdate"].dataType)
    bounds = t.customer.select("c_custkey", day("1992-01-01").alias("low"), day("2010-01-01").alias("high"))
    return temporal.gaps(spans, bounds, ["c_custkey"], "s", "e", "low", "high")


@query(
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    o AS (SELECT doc_id, n, regexp_matches(line, '[0-9]') AS taken, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(line) + 1 AS size FROM l),
    i AS (SELECT *, sum(taken::INT) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM o),
    g AS (SELECT doc_id, min(s) AS s, max(s + size) AS e, max(n) AS n FROM i WHERE NOT taken GROUP BY doc_id, island)
    SELECT g.doc_id, s::BIGINT AS span_start, least(e, length(text))::BIGINT AS span_end FROM g JOIN documents d ON d.doc_id = g.doc_id WHERE s < length(text)"""
)
def remaining_spans(t: Tables) -> DataFrame:
    """What of a text is left when the lines with a digit are taken out, as spans of characters."""
    # Offsets of lines are sums inside a document's array; only the taken spans are dealt.
    lines = F.split("text", "\n")
    spans = lambda x: F.zip_with(sums_before(F.transform(x, lambda s: F.length(s) + 1)), x, lambda at, s: F.when(s.rlike("[0-9]"), F.struct(at.alias("s"), (at + F.length(s) + 1).alias("e"))))
    taken = t.documents.select("doc_id", F.explode(F.array_compact(T.let(lines, spans))).alias("x")).select("doc_id", "x.*")
    bounds = t.documents.select("doc_id", F.lit(0).cast("long").alias("low"), F.length("text").cast("long").alias("high"))
    found = temporal.gaps(taken, bounds, ["doc_id"], "s", "e", "low", "high")
    return found.select("doc_id", F.col("gap_start").alias("span_start"), F.col("gap_end").alias("span_end"))


@query(
    """
    WITH o AS (SELECT o_custkey, o_orderdate AS s, o_orderdate + INTERVAL 60 DAY AS e, o_orderstatus AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderstatus) AS n FROM orders),
    w AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM o),
    i AS (SELECT *, sum(CASE WHEN p >= s THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY n ROWS UNBOUNDED PRECEDING) AS island FROM w)
    SELECT o_custkey, min(s) AS merged_start, max(e) AS merged_end, count(*) AS n_merged, min(struct_pack(s, e, kind)).kind AS kind FROM i GROUP BY o_custkey, island"""
)
def merged_spans(t: Tables) -> DataFrame:
    spans = t.orders.select("o_custkey", F.col("o_orderdate").alias("s"), F.expr("o_orderdate + interval 60 days").alias("e"), F.col("o_orderstatus").alias("kind"))
    return temporal.merged(spans, ["o_custkey"], "s", "e", "kind")


_GRAMS = "unnest(list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)])) AS g"


@query(
    f"""
    WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS ws FROM benchmark),
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    bg AS (SELECT item_id, {_GRAMS} FROM b WHERE len(ws) >= 5), dg AS (SELECT doc_id, {_GRAMS} FROM d WHERE len(ws) >= 5)
    SELECT item_id, arg_max(doc_id, (shared, -doc_id)) AS doc_id, max(shared) AS shared
    FROM (SELECT item_id, doc_id, count(*) AS shared FROM bg JOIN dg USING (g) GROUP BY ALL) GROUP BY item_id"""
)
def contamination(t: Tables) -> DataFrame:
    """For each benchmark item the document with most shared word 5-grams: grams meet in an equi-join, never item by item.

    Items have few grams; as long as a count says so, hashes of a document's grams are
    tested inside its array and only those that an item has become rows.
    """
    b = t.benchmark.select("item_id", F.explode(T.word_grams(F.col("text"), 5)).alias("gram"))
    words = t.documents.select("doc_id", T.words(F.col("text")).alias("_words"))
    d = gram_hits(words, ["doc_id"], "_words", b.select("gram").distinct(), 5).select("doc_id", "gram")
    shared = d.join(measured(b), "gram").groupBy("item_id", "doc_id").agg(F.countDistinct("gram").alias("shared"))
    best = shared.groupBy("item_id").agg(F.max_by(F.struct("doc_id", "shared"), F.struct("shared", -F.col("doc_id"))).alias("r"))
    return best.select("item_id", "r.doc_id", "r.shared")


_TITLE = "regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z ]+', '', 'g')"


@query(
    f"""
    WITH i AS (SELECT p_partkey AS k, trim({_TITLE}) AS t FROM part), o AS (SELECT t, min(k) AS k FROM i WHERE k % 3 = 0 AND len(string_split(t, ' ')) >= 2 GROUP BY t), n AS (SELECT t, min(k) AS k FROM i WHERE k % 3 = 1 GROUP BY t),
    w AS (SELECT o.t AS old_title, n.t AS new_title, n.k, len(list_filter(list_distinct(string_split(o.t, ' ')), lambda x: length(x) > 3)) AS size,
          len(list_intersect(list_filter(list_distinct(string_split(o.t, ' ')), lambda x: length(x) > 3), list_filter(list_distinct(string_split(n.t, ' ')), lambda x: length(x) > 3))) AS shared FROM o, n),
    f AS (SELECT old_title, new_title, k, shared, row_number() OVER (PARTITION BY old_title ORDER BY (new_title = old_title) DESC, shared DESC, k) AS r FROM w WHERE new_title = old_title OR shared >= greatest(2, size // 2))
    SELECT i.k AS p_partkey, f.k AS matched_key, f.new_title = f.old_title AS exact, CASE WHEN f.new_title <> f.old_title THEN shared END AS shared FROM i JOIN f ON i.t = f.old_title AND r = 1 WHERE i.k % 3 = 0"""
)
def title_concordance(t: Tables) -> DataFrame:
    title = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    rows = t.part.select(F.col("p_partkey").alias("k"), title.alias("title"))
    found = R.concordance(rows.where("k % 3 = 0"), rows.where("k % 3 = 1"), "k", "title")
    return found.select(F.col("k").alias("p_partkey"), "matched_key", "exact", "shared")


@query(
    """
    WITH g AS (SELECT item_id, list_distinct([substr(lower(text), i::INT, 5) FOR i IN range(1, length(text) - 3)]) AS a FROM benchmark WHERE length(text) >= 5),
    c AS (SELECT conv_id * 1000 + turn AS chunk_id, list_distinct([substr(lower(text), i::INT, 5) FOR i IN range(1, length(text) - 3)]) AS b FROM conversations WHERE length(text) >= 5),
    s AS (SELECT item_id, chunk_id, len(list_intersect(a, b)) AS shared FROM g, c)
    SELECT item_id, arg_max(chunk_id, (shared, -chunk_id)) AS chunk_id, max(shared) AS shared FROM s WHERE shared >= 40 GROUP BY item_id"""
)
def rationale_match(t: Tables) -> DataFrame:
    """For each benchmark item the conversation turn with most shared distinct 5-grams of characters, 40 at least."""
    grams = lambda key, rows: rows.select(key, F.explode(T.char_grams(F.lower("text"), 5)).alias("g"))
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "text")
    shared = grams("chunk_id", turns).join(measured(grams("item_id", t.benchmark)), "g").groupBy("item_id", "chunk_id").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 40")
    best = shared.groupBy("item_id").agg(F.max_by(F.struct("chunk_id", "shared"), F.struct("shared", -F.col("chunk_id"))).alias("r"))
    return best.select("item_id", "r.chunk_id", "r.shared")


@query(
    """
    SELECT p_partkey, EXISTS (SELECT 1 FROM nation WHERE contains(lower(p_name), lower(n_name))) AS named, length(p_name) AS n FROM part"""
)
def entity_containment(t: Tables) -> DataFrame:
    # Nations are a dimension of fixed size (25 rows), so their names go along as one array.
    names = t.nation.agg(F.collect_list(F.lower("n_name")).alias("names"))
    rows = t.part.select("p_partkey", "p_name").join(F.broadcast(names))
    return rows.select("p_partkey", F.exists("names", lambda n: F.lower("p_name").contains(n)).alias("named"), F.length("p_name").cast("long").alias("n"))
