"""Expressions over questions, answers and evidence: tiers, gates, quotes, citations, verdicts, tolerant JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions.text import folded
from lodestone.operators.tagging import cascade
from lodestone.session import ship

# Words with which a piece of text cannot stand alone, and verbs that a cut leaves without a subject.
ENGLISH_CONNECTORS = ("Provided", "Except", "However", "For the purposes of this", "Explanation", "Illustration", "Notwithstanding", "Subject to", "Where", "In case")
HINDI_CONNECTORS = ("बशर्ते कि", "परंतु", "किंतु", "तथापि", "स्पष्टीकरण", "व्याख्या", "परिभाषा", "उदाहरणार्थ", "दृष्टांत", "अपवाद", "इसके बावजूद", "परंतुक")
ORPHAN_VERBS = ("means", "includes", "applies", "refers", "denotes", "shall", "may", "must", "applies to", "refers to")
#: A letter (with its marks), digit or underscore of any script. ``\b`` is not used where engines and versions must agree: some count ASCII letters only.
IN_WORD = r"[\p{L}\p{M}\p{N}_]"
BAD_CUT = "(?:" + "|".join((*ENGLISH_CONNECTORS, *HINDI_CONNECTORS)) + r")|(?:" + "|".join(ORPHAN_VERBS) + r")\b"
# Words of a question that already names a statute, and limits of a file's status in bytes and characters.
_STATUTE_WORDS = r"(?i)\b(section|rule|notification|circular|act)\b"
_LEAST_BYTES, _LEAST_CHARS = 400, 50
# Answers that must refuse, and difficulties whose answers must cite.
REFUSALS, CITING = ("refuse", "refuse_direct_tax"), ("complex", "advanced")

_CITED = r"(?i)\b(?:section|sec\.?|rule|article)\s*(\d+[A-Z]?)"


def query_tier(text: Column) -> Column:
    """hard: a numbered provision is asked for; soft: statute words; none."""
    return cascade((text.rlike(_CITED), "hard"), (text.rlike(r"(?i)\b(?:act|rules?|section|provision|notification)\b"), "soft"), otherwise="none")


def needs_decomposition(text: Column, acts: list[str]) -> Column:
    """Two acts, a contrast, three provisions, several questions, a long text or a numbered list."""
    named = sum((F.lower(text).contains(a.lower()).cast("int") for a in acts), F.lit(0))
    provisions = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(_CITED), 1)))
    contrast = text.rlike(r"(?i)\b(?:versus|vs\.?|compare|difference|whereas)\b")
    return (named >= 2) | contrast | (provisions >= 3) | (F.regexp_count(text, F.lit(r"\?")) > 2) | (F.length(text) > 500) | text.rlike(r"(?m)^\s*\d+[.)]\s")


def wants_passage(text: Column) -> Column:
    """Whether a question of under 180 characters without statute words should be expanded by a hypothetical passage."""
    return (F.length(text) < 180) & ~text.rlike(_STATUTE_WORDS)


def must_cite(question: Column, subcategory: Column, difficulty: Column, sections: Column) -> Column:
    """Whether an answer has to cite: a hard question, one with expected sections, or one that says section or notification; never a refusal."""
    low = F.lower(F.coalesce(question, F.lit("")))
    wanted = F.coalesce(difficulty, F.lit("")).isin(*CITING) | (F.coalesce(F.size(sections), F.lit(0)) > 0) | low.contains("section") | low.contains("notification")
    return wanted & ~F.coalesce(subcategory, F.lit("")).isin(*REFUSALS)


def anchors(text: Column, words: list[str], most: int = 8) -> Column:
    """Distinct keyword anchors in order of their first use, ``most`` at most."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(map(re.escape, words)) + r")\b"), 1)
    return F.slice(F.array_distinct(found), 1, most)


def triggered(text: Column, triggers: dict[str, list[str]]) -> Column:
    """The topics one of whose trigger phrases a text contains, in the order given."""
    low = F.lower(text)
    hit = lambda phrases: F.coalesce(*[F.when(low.contains(p.lower()), F.lit(True)) for p in phrases])
    return F.array_compact(F.array(*[F.when(hit(phrases), topic) for topic, phrases in triggers.items()]))


def relevant(text: Column, title: Column, number: Column) -> Column:
    """At least half of the title's four longest words (five letters and more) and the number are in the text."""
    long_words = F.filter(F.array_distinct(F.split(F.lower(title), r"[^\p{L}\p{N}]+")), lambda w: F.length(w) >= 5)
    top = F.transform(F.slice(F.array_sort(F.transform(long_words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 4), lambda x: x["w"])
    wanted = F.array_compact(F.concat(top, F.array(F.nullif(F.lower(number), F.lit("")))))
    hits = F.size(F.filter(wanted, lambda w: F.lower(text).contains(w)))
    return hits * 2 >= F.greatest(F.size(wanted), F.lit(1))


def path_parts(path: Column, names: dict[str, str]) -> Column:
    """category (by canonical name), subcategory and year of a path."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first = F.lower(F.get(parts, F.lit(0)))
    canonical = F.coalesce(*[F.when(first == k, F.lit(v)) for k, v in names.items()], first)
    year = F.nullif(F.regexp_extract(path, r"(?:19|20)\d{2}", 0), F.lit("")).cast("int")
    return F.struct(canonical.alias("category"), F.lower(F.get(parts, F.lit(1))).alias("subcategory"), year.alias("year"))


def file_status(content: Column, pages: Column, chars: Column) -> Column:
    """missing, corrupt, error_page, image_only or ok, from bytes, page count and text length of the first pages."""
    magic = F.substring(content.cast("string"), 1, 4) == "%PDF"
    return cascade(
        (content.isNull(), "missing"), (~magic, "corrupt"), (F.octet_length(content) < _LEAST_BYTES, "error_page"), (F.coalesce(pages, F.lit(0)) == 0, "corrupt"), (chars < _LEAST_CHARS, "image_only"), otherwise="ok"
    )


def cut_badly(text: Column) -> Column:
    """Whether a piece is blank or begins with a connector (English and Hindi) or an orphan verb."""
    return text.rlike(r"^\s*(?:$|" + BAD_CUT + ")")


def quotes(answer: Column) -> Column:
    """Quoted spans with their source number: array of (quote, source), 15 to 400 characters."""
    pattern = r"\*?\"([^\"]{15,400})\"\*?\s*\[S(\d+)\]"
    spans, sources = F.regexp_extract_all(answer, F.lit(pattern), 1), F.regexp_extract_all(answer, F.lit(pattern), 2)
    return F.zip_with(spans, sources, lambda q, s: F.struct(q.alias("quote"), s.cast("int").alias("source")))


def quote_check(quote: Column, source: Column) -> Column:
    """exact, normalised or missing."""
    return cascade((source.contains(quote), "exact"), (folded(source).contains(folded(quote)), "normalised"), otherwise="missing")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def supported_sentences(answer: Column, context: Column) -> Column:
    """The answer without sentences that cite provisions none of which the context has."""
    cited = lambda s: F.regexp_extract_all(s, F.lit(_CITED), 1)
    there = F.array_distinct(cited(context))
    return F.array_join(F.filter(sentences(answer), lambda s: (F.size(cited(s)) == 0) | F.arrays_overlap(cited(s), there)), " ")


def warnings(answer: Column, context: Column) -> Column:
    """placeholder, unsupported_section and repeated_sentence, as far as they apply."""
    cited, there = (F.array_distinct(F.regexp_extract_all(x, F.lit(_CITED), 1)) for x in (answer, context))
    own = F.transform(sentences(answer), lambda s: F.lower(F.trim(s)))
    repeated = F.size(own) - F.size(F.array_distinct(own)) >= 2
    return F.array_compact(F.array(
        F.when(answer.rlike(r"\{\{|\[PLACEHOLDER|TODO|lorem ipsum"), "placeholder"), F.when(F.size(F.array_except(cited, there)) > 0, "unsupported_section"), F.when(repeated, "repeated_sentence")
    ))


def verdict(text: Column) -> Column:
    """yes, no, partial or unknown of a judge's answer: a JSON field first, else the first such word, whole among letters of any script."""
    field = F.lower(F.get_json_object(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "$.verdict"))
    word = F.nullif(F.lower(F.regexp_extract(text, rf"(?i)(?<!{IN_WORD})(yes|no|partial)(?!{IN_WORD})", 1)), F.lit(""))
    return F.when(field.isin("yes", "no", "partial"), field).otherwise(F.coalesce(word, F.lit("unknown")))


def same_provision(a: Column, b: Column) -> Column:
    """Equal provision codes, or one the parent of the other (16 and 16(2)(b)); "1" is not "12"."""
    x, y = (F.regexp_replace(F.lower(c), r"\s|section|sec\.?|rule", "") for c in (a, b))
    return (x == y) | F.startswith(x, F.concat(y, F.lit("("))) | F.startswith(y, F.concat(x, F.lit("(")))


def distinct_terms(values: Column) -> Column:
    """Distinct values, case aside, in order of their first use."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda acc, v: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(v)), acc).otherwise(F.concat(acc, F.array(v))))


def evidence_block(texts: Column, most: int = 1_800) -> Column:
    """Numbered evidence for a prompt, each piece cut at ``most`` characters."""
    numbered = F.transform(texts, lambda t, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("] "), F.substring(t, 1, most)))
    return F.array_join(numbered, "\n\n")


def duration(seconds: Column) -> Column:
    """"1d 02:03:04"."""
    s = seconds.cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(s % 86_400 / 3_600)), two(F.floor(s % 3_600 / 60)), two(s % 60))
    return F.concat(F.floor(s / 86_400).cast("string"), F.lit("d "), clock)


def repaired_json(text: str | None) -> str | None:
    """A JSON object out of loose text: fences and comments off, trailing commas off, cut-off ends closed; null if nothing parses."""
    if not text:
        return None
    body = re.sub(r"```(?:json)?", "", text)
    start = body.find("{")
    if start < 0:
        return None
    body = re.sub(r"(?m)^\s*//.*$", "", body[start:])
    tries = [body, body[: body.rfind("}") + 1]]
    stack, quoted, escaped = [], False, False
    for c in body:
        if quoted:
            escaped = c == "\\" and not escaped
            quoted = c != '"' or escaped or (escaped := False)
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    tries.append(body + '"' * quoted + "".join(reversed(stack)))
    tries.append(re.sub(r",[^,]*$", "", body) + "".join(reversed(stack)))
    for attempt in tries:
        try:
            return json.dumps(json.loads(re.sub(r",\s*([}\]])", r"\1", attempt)), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def _repaired(text: pd.Series) -> pd.Series:
    return text.map(repaired_json)


def tolerant_json(text: Column) -> Column:
    """The JSON of a text: Spark's parser first, the repairing one only for what it refuses."""
    strict = F.when(F.try_parse_json(text).isNotNull(), text)
    ship()
    return F.coalesce(strict, _repaired(F.when(F.try_parse_json(text).isNull(), text)))
