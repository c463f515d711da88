"""Queries of references and phrase tables: alias classes, parent codes, topics from a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import phrases as P
from lodestone.operators import references as R

from .registry import Tables, query

_GOLD_TEXT = """'Section ' || (1 + o_orderkey % 7) || CASE WHEN o_orderkey % 3 > 0 THEN ' (' || (1 + o_custkey % 3) || ')' ELSE '' END || CASE WHEN o_orderkey % 3 = 2 THEN '(A)' ELSE '' END
         || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' of the ' || n_name || ' act' END"""
_HIT_TEXT = """CASE WHEN l_partkey % 5 = 0 THEN 'Rule ' ELSE 'See sec. ' END || (1 + l_partkey % 14) || CASE WHEN l_quantity > 10 THEN '(' || (1 + l_suppkey % 3) || ')' ELSE '' END
         || CASE WHEN l_quantity > 30 THEN '(b)' ELSE '' END || ', law no. ' || s_nationkey || ' x'"""
_MATCH = f"""
    WITH RECURSIVE pairs AS (SELECT lower(n_name) AS a, 'law no ' || n_nationkey AS b FROM nation UNION SELECT 'law no ' || n_nationkey, lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey),
    e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), classes AS (SELECT a AS name, min(b) AS class FROM reach GROUP BY a),
    gt AS (SELECT o_orderkey AS item, o_orderkey::VARCHAR AS gold_ref, {_GOLD_TEXT} AS text FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
    ht AS (SELECT l_orderkey AS item, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ref, {_HIT_TEXT} AS text FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
    g AS (SELECT *, 'section' AS kind, regexp_extract(text, 'Section ([0-9]+)', 1) AS x, lower(regexp_extract(text, '[0-9]+ ?\\(([^)]*)\\)', 1)) AS y, lower(regexp_extract(text, '\\([^)]*\\)\\(([^)]*)\\)', 1)) AS z FROM gt),
    h AS (SELECT *, CASE WHEN starts_with(text, 'Rule') THEN 'rule' ELSE 'section' END AS kind, regexp_extract(text, '(?:Rule|sec.) ([0-9]+)', 1) AS x, regexp_extract(text, '[0-9]+\\(([^)]*)\\)', 1) AS y, regexp_extract(text, '\\([^)]*\\)\\(([^)]*)\\)', 1) AS z FROM ht),
    toks AS (SELECT 'g' AS side, gold_ref AS ref, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS s FROM g UNION ALL SELECT 'h', ref, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' FROM h),
    named AS (SELECT DISTINCT side, ref, class FROM toks JOIN classes ON contains(s, ' ' || array_to_string(regexp_extract_all(name, '[a-z0-9]+'), ' ') || ' '))
    SELECT DISTINCT g.item AS o_orderkey, h.ref FROM g JOIN h ON g.item = h.item AND g.kind = h.kind AND g.x = h.x
    WHERE RULE AND (NOT EXISTS (FROM named n WHERE n.side = 'g' AND n.ref = g.gold_ref) OR EXISTS (FROM named n JOIN named m ON n.class = m.class WHERE n.side = 'g' AND n.ref = g.gold_ref AND m.side = 'h' AND m.ref = h.ref))"""


def _references(t: Tables, strict: bool) -> DataFrame:
    names = t.nation.select("n_nationkey", "n_regionkey", F.col("n_name").alias("name"), F.concat(F.lit("law no "), F.col("n_nationkey")).alias("alias"))
    regions = names.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("alias").alias("name"), F.col("r_name").alias("alias"))
    classes = R.alias_classes(names.select("name", "alias").unionByName(regions))
    nation = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit(" of the "), "n_name", F.lit(" act")))
    s = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    text = s("Section ", 1 + F.col("o_orderkey") % 7, F.when(F.col("o_orderkey") % 3 > 0, s(" (", 1 + F.col("o_custkey") % 3, ")")).otherwise(""), F.when(F.col("o_orderkey") % 3 == 2, "(A)").otherwise(""), nation)
    buyers = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    gold = t.orders.join(buyers, "o_custkey").select(F.col("o_orderkey").alias("item"), F.col("o_orderkey").cast("string").alias("ref"), text.alias("text"))
    law = s(F.when(F.col("l_partkey") % 5 == 0, "Rule ").otherwise("See sec. "), 1 + F.col("l_partkey") % 14, F.when(F.col("l_quantity") > 10, s("(", 1 + F.col("l_suppkey") % 3, ")")).otherwise(""), F.when(F.col("l_quantity") > 30, "(b)").otherwise(""), ", law no. ", F.col("s_nationkey"), " x")
    lines = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    hits = lines.select(F.col("l_orderkey").alias("item"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ref"), law.alias("text"))
    return R.reference_matches(gold, hits, "item", "text", classes, strict).select(F.col("item").alias("o_orderkey"), "ref")


@query(_MATCH.replace("RULE", "(g.y = '' OR h.y = '' OR (g.y = h.y AND (g.z = '' OR h.z = '' OR g.z = h.z)))"))
def references_strict(t: Tables) -> DataFrame:
    """Lines whose text names the provision of their order's text, or a parent or child of it, under a name of the same class."""
    return _references(t, True)


@query(_MATCH.replace("RULE", "(g.y = '' OR h.y = '' OR g.y = h.y)"))
def references_lenient(t: Tables) -> DataFrame:
    """The same for codes that agree in their first two parts."""
    return _references(t, False)


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9ß-ÿ]+')"
_PHRASES = f"""
    WITH RECURSIVE b AS (SELECT item_id, {_TOKENS} AS ts FROM benchmark), s AS (SELECT item_id, ts, unnest(range(0, len(ts))) AS i FROM b),
    ph AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END || ':item ' || item_id AS topic, array_to_string(ts[i + 1 : i + 1 + i % 3], ' ') AS gram, min(i) AS place, any_value(1 + i % 3) AS n FROM s WHERE i + i % 3 < len(ts) GROUP BY 1, 2),
    d AS (SELECT doc_id, lang, {_TOKENS} AS ts FROM documents), w AS (SELECT doc_id, lang, ts, unnest(range(0, len(ts))) AS pos FROM d),
    g AS (SELECT doc_id, lang, pos, k, array_to_string(ts[pos + 1 : pos + k], ' ') AS gram FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE pos + k <= len(ts)),
    h AS (SELECT doc_id, topic, pos, n, ph.gram, row_number() OVER (PARTITION BY doc_id, topic ORDER BY pos, place, n, ph.gram) AS r FROM g JOIN ph ON ph.gram = g.gram AND GIVEN),
    f AS (SELECT doc_id, topic, 0::BIGINT AS r, 0::BIGINT AS upto, NULL::VARCHAR AS taken FROM h WHERE r = 1
          UNION ALL SELECT f.doc_id, f.topic, h.r, CASE WHEN h.pos >= upto THEN h.pos + h.n ELSE upto END, CASE WHEN h.pos >= upto THEN h.gram END FROM f JOIN h ON h.doc_id = f.doc_id AND h.topic = f.topic AND h.r = f.r + 1),
    t AS (SELECT doc_id, topic, count(DISTINCT taken) AS score FROM f GROUP BY ALL)"""


def _phrase_table(t: Tables) -> DataFrame:
    """A table of phrases: runs of one to three words of each benchmark item, under a topic "language:item"."""
    words = t.benchmark.select("item_id", P.tokens(F.col("text")).alias("ts")).select("item_id", "ts", F.posexplode("ts").alias("place", "_"))
    words = words.where(F.col("place") + F.col("place") % 3 < F.size("ts"))
    phrase = F.array_join(F.slice("ts", F.col("place") + 1, F.col("place") % 3 + 1), " ")
    topic = F.concat(F.when(F.col("item_id") % 2 == 0, "en").otherwise("fr"), F.lit(":item "), "item_id")
    return words.select(topic.alias("topic"), phrase.alias("phrase"), "place")


@query(
    _PHRASES.replace("GIVEN", "true")
    + """
    SELECT doc_id, arg_min(topic, struct_pack(a := -score, b := length(topic), c := topic)) AS primary_topic, count(*) AS n_topics, sum(score)::BIGINT AS scores FROM t GROUP BY doc_id"""
)
def phrase_topics(t: Tables) -> DataFrame:
    """Topics of documents by a table of phrases: the best one, how many there are, and the sum of their scores."""
    return P.summaries(t.documents, "doc_id", "text", _phrase_table(t))


@query(_PHRASES.replace("GIVEN", "(lang IS NULL OR split_part(topic, ':', 1) = lang)") + " SELECT doc_id, topic, score FROM t")
def phrase_topics_in_category(t: Tables) -> DataFrame:
    """Scores of the topics of a document's own category (its language)."""
    return P.topics(t.documents, "doc_id", "text", _phrase_table(t), "lang")
