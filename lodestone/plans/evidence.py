"""Queries over questions, answers, evidence and sources built from the given tables; the SQL states what the parts they are built from imply."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import evidence as E
from lodestone.functions import identifiers as I
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import retrieval as R
from lodestone.operators import router, tagging
from lodestone.session import shared_folder
from lodestone.sources import readers, writers

from .registry import Tables, query


def _s(*parts) -> F.Column:
    """Parts joined to a string; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _sha(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


@query(
    """
    WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_custkey % 99 + 1 AS n, o_custkey % 60 + 1 AS s, (1000 + o_custkey % 900)::VARCHAR AS c, (30000000 + o_custkey * 7)::VARCHAR AS long_c, strftime(o_orderdate, '%Y') AS y FROM orders)
    SELECT o_orderkey, CASE k WHEN 2 THEN c WHEN 4 THEN long_c END AS code,
           CASE WHEN k IN (0, 5) THEN CASE WHEN n < 10 THEN '0' || n ELSE n::VARCHAR END || '/2017-' || CASE k WHEN 0 THEN 'CT(R)' ELSE 'Cus' END END AS notif_id, CASE k WHEN 0 THEN s::INT END AS serial,
           CASE k WHEN 1 THEN 'RCM' WHEN 6 THEN 'NIL' END AS list_type, CASE k WHEN 1 THEN '2019-03-05' WHEN 3 THEN '2019-12-31' WHEN 6 THEN '2020-12-31' END AS as_of,
           CASE k WHEN 0 THEN 'serial' WHEN 1 THEN 'list' WHEN 2 THEN 'rate' WHEN 4 THEN 'rate' WHEN 5 THEN 'notification' WHEN 6 THEN 'list' END AS route FROM o"""
)
def router_features(t: Tables) -> DataFrame:
    """Questions of eight forms and what the router finds in them."""
    n, s = F.col("o_custkey") % 99 + 1, F.col("o_custkey") % 60 + 1
    forms = [
        _s("What is S.No ", s, " of notification ", n, "/2017-CT(R)?"), F.lit("services under reverse charge on 5/3/2019"), _s("rate of tax on HSN ", 1000 + F.col("o_custkey") % 900), F.lit("GST rate on 2019"),
        _s("customs duty on ", 30_000_000 + F.col("o_custkey") * 7), _s("notification ", n, "/2017-Cus"), F.lit("nil rated goods as of 2020"), F.lit("How do I file an appeal?"),
    ]
    asked = t.orders.select("o_orderkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("q"))
    return router.features(asked, "q").select("o_orderkey", "code", "notif_id", "serial", "list_type", "as_of", "route")


@query(
    """
    WITH r AS (SELECT (1000 + p_partkey % 500)::VARCHAR AS code, p_partkey % 3 > 0 AS open FROM part), q AS (SELECT c_custkey, (1000 + c_custkey % 700)::VARCHAR AS code, c_custkey % 2 = 1 AS dated FROM customer)
    SELECT c_custkey, 'rate' AS route, count(r.code) AS n_rows FROM q LEFT JOIN r ON q.code = r.code AND (open OR dated) GROUP BY c_custkey"""
)
def router_answers(t: Tables) -> DataFrame:
    """Rate questions against a table of rates; undated ones see open rows only, dated ones what held on the day."""
    day = lambda d: F.lit(d).cast("date")
    rates = t.part.select((1000 + F.col("p_partkey") % 500).cast("string").alias("code"), F.concat_ws("-", F.lit("levy"), "p_partkey").alias("levy_type"), F.col("p_size").cast("double").alias("rate_pct"), day("2017-07-01").alias("effective_from"), F.when(F.col("p_partkey") % 3 == 0, day("2020-01-01")).alias("effective_to"))
    none = t.spark.createDataFrame([], "notif_id string, sno int, code string, list_type string, description string, effective_from date, effective_to date")
    asked = t.customer.select("c_custkey", _s("rate of tax on HSN ", 1000 + F.col("c_custkey") % 700, F.when(F.col("c_custkey") % 2 == 1, " as of 2018").otherwise("")).alias("q"))
    tables = {"rates": rates, "lists": none, "exemptions": none.drop("list_type"), "notifications": none.select("notif_id")}
    return router.answer(asked, "c_custkey", "q", tables).select("c_custkey", "route", "n_rows")


@query(
    r"""
    WITH q AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Section ' || (conv_id % 90 + 1) || ' says ' || text WHEN 1 THEN 'CGST and IGST: ' || text WHEN 2 THEN 'compare this: ' || text ELSE text END AS q FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(?i)\b(?:section|sec\.?|rule|article)\s*[0-9]+[A-Z]?') THEN 'hard' WHEN regexp_matches(q, '(?i)\b(?:act|rules?|section|provision|notification)\b') THEN 'soft' ELSE 'none' END AS tier,
           turn % 4 IN (1, 2) OR len(regexp_extract_all(q, '\?')) > 2 OR length(q) > 500 OR regexp_matches(q, '(?i)\b(?:versus|vs\.?|compare|difference|whereas)\b') OR len(list_distinct(regexp_extract_all(q, '(?i)\b(?:section|sec\.?|rule|article)\s*([0-9]+[A-Z]?)', 1))) >= 3
           OR (contains(lower(q), 'cgst') AND contains(lower(q), 'igst')) OR regexp_matches(q, '(?m)^\s*[0-9]+[.)]\s') AS parts FROM q"""
)
def question_classes(t: Tables) -> DataFrame:
    forms = [_s("Section ", F.col("conv_id") % 90 + 1, " says ", F.col("text")), _s("CGST and IGST: ", F.col("text")), _s("compare this: ", F.col("text")), F.col("text")]
    q = F.element_at(F.array(*forms), (F.col("turn") % 4 + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", E.query_tier(q).alias("tier"), E.needs_decomposition(q, ["CGST", "IGST"]).alias("parts"))


_ANCHORS = ["the", "and", "der", "und", "les", "que", "los", "para", "of", "in", "des", "den"]


@query(
    f"""
    WITH f AS (SELECT doc_id, text, regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z]+', '  ', 'g') || ' ', ' ({'|'.join(_ANCHORS)}) ', 1) AS w FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM documents))
    SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:8], ' ') AS anchors,
           array_to_string(list_filter([CASE WHEN contains(lower(text), 'the') THEN 'art' END, CASE WHEN contains(lower(text), 'ing ') OR contains(lower(text), 'ion') THEN 'form' END], lambda x: x IS NOT NULL), ',') AS topics FROM f"""
)
def anchors_and_triggers(t: Tables) -> DataFrame:
    """First keyword anchors of documents, ASCII letters only, and the topics whose triggers they hold."""
    docs = t.documents.select("doc_id", T.ascii_only(F.col("text")).alias("text"))
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), "[^a-z]+", "  "), F.lit(" "))
    return docs.select("doc_id", F.array_join(E.anchors(plain, _ANCHORS), " ").alias("anchors"), F.array_join(E.triggered(F.col("text"), {"art": ["the"], "form": ["ing ", "ion"]}), ",").alias("topics"))


@query(
    """
    SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 5 = 1 THEN 'corrupt' WHEN page_id % 5 = 2 THEN 'error_page' WHEN page_id % 3 = 0 THEN 'corrupt' WHEN page_id % 120 < 50 THEN 'image_only' ELSE 'ok' END AS status FROM pages"""
)
def file_statuses(t: Tables) -> DataFrame:
    kind = F.col("page_id") % 5
    body = F.when(kind == 1, F.col("html")).when(kind == 2, F.lit("%PDF short")).when(kind > 2, F.concat(F.lit("%PDF"), F.rpad("html", 500, "x")))
    return t.pages.select("page_id", E.file_status(body.cast("binary"), F.col("page_id") % 3, F.col("page_id") % 120).alias("status"))


@query(
    """
    WITH w AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: length(x) >= 5)) AS ws, (p_size % 10)::VARCHAR AS num, lower(p_name || ' no ' || p_size) AS body FROM part),
    k AS (SELECT p_partkey, body, list_concat(list_transform(list_slice(list_sort(list_transform(ws, lambda x: struct_pack(n := -length(x), w := x))), 1, 4), lambda s: s.w), [num]) AS wanted FROM w)
    SELECT p_partkey, len(list_filter(wanted, lambda x: contains(body, x))) * 2 >= greatest(len(wanted), 1) AS relevant FROM k"""
)
def title_relevance(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", E.relevant(_s(F.col("p_name"), " no ", F.col("p_size")), F.concat_ws(" ", "p_name", "p_type"), (F.col("p_size") % 10).cast("string")).alias("relevant"))


@query(
    """
    WITH q AS (SELECT conv_id, turn, translate(text, '"“”', '   ') AS body, translate(substr(text, 1, 60), '"“”', '   ') AS head FROM conversations WHERE length(text) >= 60)
    SELECT conv_id, turn, turn + 1 AS source, CASE turn % 3 WHEN 0 THEN 'exact' WHEN 1 THEN CASE WHEN contains(head, ' ') THEN 'normalised' ELSE 'exact' END ELSE 'missing' END AS checked FROM q"""
)
def quote_checks(t: Tables) -> DataFrame:
    """Answers that quote their source as it is, with a doubled blank, or wrongly."""
    plain = lambda c: F.translate(c, '"“”', "   ")
    rows = t.conversations.where(F.length("text") >= 60).select("conv_id", "turn", plain(F.col("text")).alias("body"), plain(F.substring("text", 1, 60)).alias("head"))
    doubled = F.concat(F.substring_index("head", " ", 1), F.when(F.col("head").contains(" "), "  ").otherwise(""), F.expr("substr(head, length(substring_index(head, ' ', 1)) + 2)"))
    said = F.when(F.col("turn") % 3 == 0, F.col("head")).when(F.col("turn") % 3 == 1, doubled).otherwise(_s("zzqx ", F.col("head")))
    answer = _s('It says *"', said, '"* [S', F.col("turn") + 1, ']. Also "short" [S9].')
    found = rows.select("conv_id", "turn", "body", F.explode(E.quotes(answer)).alias("q"))
    return found.select("conv_id", "turn", F.col("q.source").cast("long").alias("source"), E.quote_check(F.col("q.quote"), F.col("body")).alias("checked"))


@query(
    """
    WITH o AS (SELECT o_orderkey, o_orderkey % 30 AS k, o_custkey % 30 AS j, o_orderkey % 11 = 0 AS leak, o_orderkey % 7 = 0 AS thrice FROM orders)
    SELECT o_orderkey, 'Section 16 applies.' || CASE WHEN k = 16 OR k = j THEN ' Section ' || k || ' applies too.' ELSE '' END || ' Pay tax.' || CASE WHEN leak THEN ' TODO.' ELSE '' END || CASE WHEN thrice THEN ' Pay tax. Pay tax.' ELSE '' END AS kept,
           array_to_string(list_filter([CASE WHEN leak THEN 'placeholder' END, CASE WHEN NOT (k = 16 OR k = j) THEN 'unsupported_section' END, CASE WHEN thrice THEN 'repeated_sentence' END], lambda x: x IS NOT NULL), ',') AS warned,
           k = j AS same, NOT (k = 16 OR k = j) AS other FROM o"""
)
def citation_checks(t: Tables) -> DataFrame:
    """Answers with a sentence whose section the context may lack: what is kept, what is warned of, and how codes compare."""
    k, j = F.col("o_orderkey") % 30, F.col("o_custkey") % 30
    answer = _s("Section 16 applies. Section ", k, " applies too. Pay tax.", F.when(F.col("o_orderkey") % 11 == 0, " TODO.").otherwise(""), F.when(F.col("o_orderkey") % 7 == 0, " Pay tax. Pay tax.").otherwise(""))
    context = _s("Under section 16 and rule ", j, " credit is allowed.")
    same = E.same_provision(k.cast("string"), _s("Section ", j, F.when(F.col("o_orderkey") % 2 == 0, "(2)(b)").otherwise("")))
    return t.orders.select("o_orderkey", E.supported_sentences(answer, context).alias("kept"), F.array_join(E.warnings(answer, context), ",").alias("warned"), same.alias("same"), F.array_contains(E.warnings(answer, context), "unsupported_section").alias("other"))


@query(
    """
    WITH o AS (SELECT o_orderkey, o_custkey AS s, o_orderpriority AS p, o_orderstatus AS z FROM orders)
    SELECT o_orderkey, (s // 86400) || 'd ' || lpad((s % 86400 // 3600)::VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS took,
           CASE WHEN p = z THEN p ELSE p || ',' || z END AS terms, '[S1] ' || substr(p, 1, 5) || chr(10) || chr(10) || '[S2] ' || z AS block FROM o"""
)
def small_assemblies(t: Tables) -> DataFrame:
    """Durations, distinct terms whatever their case, and numbered evidence cut to five characters."""
    p, z = F.col("o_orderpriority"), F.col("o_orderstatus")
    return t.orders.select("o_orderkey", E.duration(F.col("o_custkey")).alias("took"), F.array_join(E.distinct_terms(F.array(p, z, F.lower(p), F.lower(z))), ",").alias("terms"), E.evidence_block(F.array(p, z), 5).alias("block"))


@query(
    """
    SELECT event_id, CASE WHEN event_id % 5 < 4 THEN (props->>'k')::BIGINT END AS k FROM events"""
)
def tolerant_props(t: Tables) -> DataFrame:
    """Event properties whole, fenced, cut off, with a comma too many, or absent, read by the tolerant parser."""
    p, kind = F.col("props"), F.col("event_id") % 5
    text = F.when(kind == 0, p).when(kind == 1, _s("```json\n", p, "\n```")).when(kind == 2, F.regexp_replace(p, "}$", "")).when(kind == 3, F.regexp_replace(p, "}$", ",}")).otherwise("no properties")
    return t.events.select("event_id", F.get_json_object(E.tolerant_json(text), "$.k").cast("long").alias("k"))


@query(
    """
    WITH h AS (SELECT doc_id, text, sha1(source || '#' || doc_id) AS h FROM documents)
    SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id, length(text[:16000]) AS answer_chars, '[{"id":' || doc_id || ',"page":' || doc_id % 9 || ',"section":"s' || doc_id % 4 || '"}]' AS citations FROM h"""
)
def logged_answers(t: Tables) -> DataFrame:
    """Log rows of answers: a stable id, the answer cut to its limit and slimmed citations."""
    long = F.struct(F.col("doc_id").alias("id"), (F.col("doc_id") % 9).alias("page"), _s("s", F.col("doc_id") % 4).alias("section"), F.col("text").alias("body"))
    answer, citations = writers.log_row(F.col("text"), F.array(long))
    rows = t.documents.select("doc_id", I.uuid_of(_s(F.col("source"), "#", F.col("doc_id"))).alias("id"), answer, citations)
    return rows.select("doc_id", "id", F.length("answer_markdown").cast("long").alias("answer_chars"), F.col("citations_json").alias("citations"))


@query(
    r"""
    WITH c AS (SELECT conv_id, turn, text, regexp_replace(substr(text, 1, 150), '[.?!;]', ',', 'g') || '.' AS changed FROM conversations WHERE length(text) >= 200)
    SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'null_input' WHEN 1 THEN 'length' WHEN 2 THEN 'no_terminator' WHEN 3 THEN CASE WHEN regexp_matches(substr(text, 1, 150), '[.?!;]') THEN 'exact' ELSE 'no_terminator' END
           ELSE CASE WHEN contains(lower(text), lower(changed)) THEN 'exact' ELSE 'table_exact_miss' END END AS verdict FROM c"""
)
def span_ladder(t: Tables) -> DataFrame:
    """Spans that fail or pass at each step of the ladder; changed ones are checked as tables."""
    text, kind = F.col("text"), F.col("turn") % 5
    plain = F.regexp_replace(F.substring(text, 1, 150), "[.?!;]", ",")
    span = F.when(kind == 1, "short").when(kind == 2, F.substring(plain, 1, 100)).when(kind == 3, F.substring(text, 1, 150)).when(kind == 4, F.concat(plain, F.lit(".")))
    return t.conversations.where(F.length("text") >= 200).select("conv_id", "turn", tagging.span_check(span, text, kind == 4).alias("verdict"))


@query(
    """
    WITH g AS (SELECT p_partkey, list_distinct([substr(lower(p_name), i::INT, 3) FOR i IN range(1, greatest(length(p_name) - 1, 1))]) AS a, list_distinct([substr(lower(p_name || p_type), i::INT, 3) FOR i IN range(1, length(p_name || p_type) - 1)]) AS b FROM part WHERE length(p_name) >= 3)
    SELECT p_partkey, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS jaccard, round(len(list_intersect(b, a)) / len(b), 6) AS coverage FROM g"""
)
def gram_similarity(t: Tables) -> DataFrame:
    a, b = T.char_grams(F.lower("p_name"), 3), T.char_grams(F.lower(F.concat("p_name", "p_type")), 3)
    return t.part.where(F.length("p_name") >= 3).select("p_partkey", F.round(T.jaccard(a, b), 6).alias("jaccard"), F.round(T.coverage(b, a), 6).alias("coverage"))


@query(
    """
    WITH v AS (SELECT vec_id, [list_transform(embedding[i * 16 + 1:i * 16 + 16], lambda x: x::DOUBLE) FOR i IN range(4)] AS parts FROM embeddings)
    SELECT a.vec_id, round(list_sum(list_transform(a.parts, lambda q: list_max(list_transform(b.parts, lambda d: list_dot_product(q, d))))), 6) AS max_sim FROM v a JOIN v b ON b.vec_id = a.vec_id + 1"""
)
def late_scores(t: Tables) -> DataFrame:
    """Late interaction of each vector with the next one, both as four token vectors of sixteen components."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(V.doubles(F.col("embedding")), i * 16 + 1, F.lit(16)))
    rows = t.embeddings.select("vec_id", tokens.alias("q"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q").alias("d")), "vec_id")
    return R.late_interaction(pairs, "q", "d").select("vec_id", F.round("max_sim", 6).alias("max_sim"))


@query(
    """
    WITH c AS (SELECT conv_id, turn, trim(translate(substr(text, 1, length(text) // 2), chr(10), ' ')) AS a, trim(translate(substr(text, length(text) // 2 + 1), chr(10), ' ')) AS b FROM conversations)
    SELECT conv_id, turn, sha256(CASE WHEN turn % 2 = 0 THEN CASE WHEN a <> '' AND b <> '' THEN 'Q: ' || a || chr(10) || 'A: ' || b ELSE a || b END ELSE a END) AS text_sha FROM c"""
)
def unwrapped_turns(t: Tables) -> DataFrame:
    """Instruction tags put around turns and taken off again."""
    half = F.floor(F.length("text") / 2).cast("int")
    line = lambda part: F.translate(part, "\n", " ")
    first, second = line(F.substring(F.col("text"), F.lit(1), half)), line(F.substring(F.col("text"), half + 1, F.length("text")))
    wrapped = F.when(F.col("turn") % 2 == 0, _s("<s>[INST] <<SYS>>be kind<</SYS>> ", first, " [/INST] ", second, " </s>")).otherwise(_s("<s> ", first, " </s>"))
    return t.conversations.select("conv_id", "turn", _sha(T.unwrap_instruction(wrapped)).alias("text_sha"))


@query(
    r"""
    WITH c AS (SELECT doc_id, translate('“' || text || '” — § 5 ₹ 10 ,', '“”„"‘’‚′″–—−', '''''''''''''''''''---') AS x FROM documents),
    r AS (SELECT doc_id, lower(trim(regexp_replace(replace(replace(replace(replace(x, '§', 'section '), '₹', 'rs.'), 'Rs.', 'rs.'), 'INR', 'rs.'), '\s+', ' ', 'g'))) AS y FROM c)
    SELECT doc_id, sha256(trim(regexp_replace(y, '\s+([,;:.)\]])', '\1', 'g'))) AS folded_sha FROM r"""
)
def folded_texts(t: Tables) -> DataFrame:
    text = _s("“", F.col("text"), "” — § 5 ₹ 10 ,")
    return t.documents.select("doc_id", _sha(T.folded(text)).alias("folded_sha"))


@query(
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS page, len(string_split(text, chr(10))) AS n FROM documents),
    o AS (SELECT *, coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM l)
    SELECT doc_id, page::BIGINT AS page, char_start, length(part) AS chars FROM o WHERE NOT (page = n AND trim(part) = '')"""
)
def page_offsets(t: Tables) -> DataFrame:
    """Documents with form feeds for line ends, as pages with their offsets; an empty last page is dropped."""
    docs = t.documents.select("doc_id", F.translate("text", "\n", "\f").alias("text"))
    return readers.pages_of(docs, "doc_id", "text").select("doc_id", F.col("page").cast("long").alias("page"), F.col("char_start").cast("long").alias("char_start"), F.length("text").cast("long").alias("chars"))


@query(
    """
    WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE NOT contains(text, '--- PAGE')) SELECT conv_id, turn + 1 AS page, length(text) + 7 AS chars FROM u WHERE turn < 3"""
)
def marked_pages(t: Tables) -> DataFrame:
    """The first turns of a conversation as pages of one text behind markers, split again."""
    rows = t.conversations.where("turn < 3").where(~F.col("text").contains("--- PAGE"))
    texts = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", _s("--- PAGE ", F.col("turn") + 1, " ---\n", F.col("text"), "\n\n").alias("p")))).alias("l"))
    joined = texts.select("conv_id", F.array_join(F.transform("l", lambda x: x["p"]), "").alias("body"))
    return readers.page_markers(joined, "conv_id", "body").select("conv_id", F.col("page").cast("long").alias("page"), F.length("text").cast("long").alias("chars"))


@query(
    """
    WITH m AS (SELECT doc_id, text AS t FROM documents), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM m),
    o AS (SELECT doc_id, n, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM l)
    SELECT doc_id, list_concat([0], coalesce(list(pos ORDER BY n) FILTER (WHERE starts_with(line, 'The ')), [])) AS page_offsets FROM o GROUP BY doc_id"""
)
def page_offsets_of_marks(t: Tables) -> DataFrame:
    """Pages of documents that begin at lines with a mark, by their offsets."""
    return t.documents.where("text is not null").select("doc_id", readers.marker_offsets(F.col("text"), "The ").alias("page_offsets"))


@query("SELECT DISTINCT unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, 'x' || o_custkey % 50]) AS id FROM orders")
def listed_ids(t: Tables) -> DataFrame:
    cells = t.orders.select(_s(F.col("o_orderkey"), ", ", F.col("o_custkey"), "\nx", F.col("o_custkey") % 50, ",,").alias("ids"))
    return readers.id_list(cells, "ids")


@query(
    """
    SELECT p_partkey, '| name | size |' || chr(10) || '|---|---|' || chr(10) || '| ' || p_name || ' | ' || p_size || ' |' || chr(10) || '| ' || p_type || ' |  |' AS md FROM part"""
)
def part_tables(t: Tables) -> DataFrame:
    rows = F.array(F.array(F.lit("name"), F.lit("size")), F.array(F.col("p_name"), F.col("p_size").cast("string")), F.array(F.col("p_type"), F.lit(None).cast("string")))
    return t.part.select("p_partkey", readers.table_markdown(rows).alias("md"))


@query("SELECT page_id, page_id % 3 < 2 AS is_pdf, CASE page_id % 3 WHEN 0 THEN length('%PDF' || page_id) WHEN 1 THEN 8 ELSE strlen(html) END AS bytes FROM pages")
def downloaded_bodies(t: Tables) -> DataFrame:
    """Bodies wrapped as base64 in JSON, plain files, and error pages."""
    kind = F.col("page_id") % 3
    body = F.when(kind == 0, _s('{"data":"', F.base64(_s("%PDF", F.col("page_id")).cast("binary")), '"}')).when(kind == 1, "%PDF-raw").otherwise(F.col("html"))
    return readers.download_body(t.pages.select("page_id", body.alias("body")), "body").select("page_id", "is_pdf", F.octet_length("content").cast("long").alias("bytes"))


@query(
    """
    SELECT user_id, event_id AS task, (event_id % 97)::BIGINT AS tokens, CASE WHEN event_id % 4 > 0 THEN round(value, 2) END AS ms, (event_id % 4 > 0)::INT AS done FROM events"""
)
def request_records(t: Tables) -> DataFrame:
    """Server logs of three or two lines a task, read back as one record a task; every fourth task is not done."""
    lines = F.array_compact(F.array(_s("task ", F.col("event_id"), " start"), _s("tokens=", F.col("event_id") % 97), F.when(F.col("event_id") % 4 > 0, _s("task ", F.col("event_id"), " done in ", F.format_string("%.2f", "value"), " ms"))))
    rows = t.events.select("user_id", "event_id", F.posexplode(lines).alias("at", "value")).withColumn("line_no", F.col("event_id") * 4 + F.col("at"))
    return readers.request_log(rows, "line_no", "value", ["user_id"]).select("user_id", "task", "tokens", F.round("ms", 2).alias("ms"), "done")


def _folder(t: Tables) -> str:
    """A new folder where all executors can read and write."""
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


@query("SELECT p_partkey::VARCHAR AS code, p_name AS description, p_size AS level, CASE WHEN p_size % 2 = 0 THEN p_brand END AS parent_code FROM part")
def typed_csv(t: Tables) -> DataFrame:
    """Parts written as CSV with blanks around and empty cells, read by header, typed and trimmed."""
    path = _folder(t)
    cells = t.part.select(_s(" ", F.col("p_partkey"), " ").alias("code"), F.col("p_name").alias("description"), "p_size", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("  ").alias("parent_code"))
    writers.write_table(cells.withColumnRenamed("p_size", "level"), path)
    return readers.codes(t.spark, path).select("code", "description", "level", "parent_code")


@query(
    """
    SELECT o_custkey % 3 AS tag, count(*) FILTER (o_orderkey % 10 <> 0) AS good, count(*) FILTER (o_orderkey % 10 = 0) AS bad, sum(o_orderkey) FILTER (o_orderkey % 10 <> 0)::BIGINT AS keys FROM orders GROUP BY 1"""
)
def json_line_files(t: Tables) -> DataFrame:
    """Orders written as JSON lines in three files' folders, every tenth line broken, read back with the bad lines kept."""
    path = _folder(t)
    line = F.when(F.col("o_orderkey") % 10 == 0, "not json").otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("id"))))
    parts = {}
    for k in range(3):
        t.orders.where(F.col("o_custkey") % 3 == k).select(line.alias("value")).write.text(f"{path}/{k}")
        rows = readers.json_lines(t.spark, f"{path}/{k}", "id long", drop_bad=False)
        parts[str(k)] = rows.select("id", "_bad")
    rows = readers.tagged_union(**parts)
    # The parser makes the bad column only beside others that are read.
    return rows.groupBy(F.col("tag").cast("long").alias("tag")).agg(F.count("id").alias("good"), F.count_if(F.col("id").isNull()).alias("bad"), F.sum("id").alias("keys"))
