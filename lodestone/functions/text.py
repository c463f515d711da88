"""Text expressions, all JVM-side but NFKC (Spark has no built-in for it) and repeated windows (slices of an array are far slower there)."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.session import ship

# The words that carry no meaning for ranking.
STOP_WORDS = (
    "a an the of in on at by for to from with and or but not is are was were be been "
    "being have has had do does did can could would should shall will may might must this that these "
    "those it its as if then than there here which who whom whose what when where why how"
).split()
# Forms of instruction tags and of dates in questions.
_INSTRUCTION, _SYSTEM, _TAGS = r"(?s)\[INST\](.*?)\[/INST\](.*?)(?:\[INST\]|</s>|$)", r"(?s)<<SYS>>.*?<</SYS>>", r"</?s>|\[/?INST\]"
_YMD, _DMY, _AS_OF = r"\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b", r"\b(\d{1,2})[-/](\d{1,2})[-/](20\d{2})\b", r"\b(?:as\s+of|on)\s+(20\d{2})\b"
TERM = "[a-z][a-z0-9_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda, a plain expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode compatibility form, a batch at a time."""
    ship()
    return _nfkc(text)


def canonical(text: Column, compatibility: bool = False) -> Column:
    """Blanks (any Unicode ones) folded to a space, ends trimmed, lower case; optionally NFKC first."""
    text = nfkc(text) if compatibility else text
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def content_hash(text: Column, compatibility: bool = False) -> Column:
    return F.sha2(canonical(text, compatibility).cast("binary"), 256)


def folded(text: Column) -> Column:
    """Quotes, primes, dashes, soft hyphens, section and currency marks in one plain form, blanks before closing marks off, then canonical."""
    plain = F.translate(text, "“”„\"‘’‚′″–—−\u200b\u2028\u2029\u00a0\u00ad", "'''''''''---    ")
    plain = F.regexp_replace(F.regexp_replace(plain, "§", "section "), "₹|Rs\\.|INR", "rs.")
    return F.trim(F.regexp_replace(canonical(plain), r"\s+([,;:.)\]])", "$1"))


def ascii_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.greatest(F.length(text), F.lit(1))


def ascii_only(text: Column) -> Column:
    """Every character beyond ASCII as a question mark: for patterns whose classes and bounds differ beyond it."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def terms(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-case terms of two or more characters without stop words, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)
    return F.filter(found, lambda t: ~t.isin(stop))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[^\x20\x09-\x0D]+"), 0)


def char_grams(text: Column, n: int) -> Column:
    """Distinct character n-grams; empty for shorter texts."""
    last = F.length(text) - n + 1
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(last >= 1, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def word_grams(text: Column, n: int, distinct: bool = True) -> Column:
    """Distinct word n-grams, or all (joined by a space); empty for shorter texts."""

    def grams(parts: Column) -> Column:
        last = F.size(parts) - n + 1
        found = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(parts, i, n), " "))
        return F.when(last >= 1, F.array_distinct(found) if distinct else found).otherwise(F.array().cast("array<string>"))

    return let(words(text), grams)


def jaccard(a: Column, b: Column) -> Column:
    """Shared by united elements of two distinct arrays; null if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def coverage(part: Column, whole: Column) -> Column:
    """Share of ``part``'s elements that ``whole`` has; null if ``part`` is empty."""
    return F.size(F.array_intersect(part, whole)) / F.nullif(F.size(part), F.lit(0))


def overlap_divergence(a: Column, b: Column) -> Column:
    """1 - shared / larger size (not Jaccard); 0 if both are empty."""
    larger = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(larger == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / larger)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length on canonical texts; 1 if both are empty."""
    a, b = canonical(a), canonical(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def breadcrumb(*parts: Column, mark: str = " > ") -> Column:
    """Filled parts joined by a mark."""
    return F.concat_ws(mark, *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def unwrap_instruction(text: Column) -> Column:
    """``[INST] q [/INST] a`` becomes ``Q: q`` and ``A: a``; stray tags go."""
    q = F.trim(F.regexp_replace(F.regexp_extract(text, _INSTRUCTION, 1), _SYSTEM, ""))
    a = F.trim(F.regexp_extract(text, _INSTRUCTION, 2))
    both = F.when((q != "") & (a != ""), F.concat(F.lit("Q: "), q, F.lit("\nA: "), a)).otherwise(F.concat(q, a))
    return F.when(text.rlike(_INSTRUCTION), both).otherwise(F.trim(F.regexp_replace(F.regexp_replace(text, _SYSTEM, ""), _TAGS, "")))


def mended_scan(text: Column) -> Column:
    """Scanning faults undone: "company" run into a letter stands for "con", "number" run into two for "non"."""
    text = F.regexp_replace(F.regexp_replace(text, r"\bcompany([a-z])", "con$1"), r"\bCompany([a-z])", "Con$1")
    return F.regexp_replace(text, r"\bnumber([a-z]{2,})", "non$1")


def fold_blanks(text: Column) -> Column:
    """Runs of blanks to one space, three and more line ends to two."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"))


def query_date(text: Column) -> Column:
    """ISO date of a question: y-m-d, d-m-y, or the year's last day for "as of 2023" and "on 2023"."""
    def dated(pattern: str, y: int, m: int, d: int) -> Column:
        part = lambda k: F.regexp_extract(text, pattern, k)
        return F.when(text.rlike(pattern), F.concat_ws("-", part(y), F.lpad(part(m), 2, "0"), F.lpad(part(d), 2, "0")))

    return F.coalesce(
        dated(_YMD, 1, 2, 3), dated(_DMY, 3, 2, 1), F.when(text.rlike(_AS_OF), F.concat(F.regexp_extract(text, _AS_OF, 1), F.lit("-12-31")))
    )


def path_year(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?:19|20)\d{2}", 0), F.lit("")).cast("int")


def repeats_itself(text: Column, window: int = 30, step: int = 5, times: int = 4, sample: int = 4000) -> Column:
    """Whether one window of characters occurs ``times`` or more at places ``step`` apart in the middle ``sample`` characters."""
    ship()

    @F.arrow_udf("boolean")
    def often(bodies: pa.Array) -> pa.Array:
        def loops(body: str) -> bool:
            pieces = [body[i : i + window] for i in range(0, max(len(body) - window, 1), step)]
            return len(pieces) - len(set(pieces)) >= times - 1 and max(Counter(pieces).values()) >= times

        return pa.array([b.is_valid and loops(b.as_py()) for b in bodies], pa.bool_())

    n = F.length(text)
    middle = F.when(n > sample, F.substr(text, F.floor(n / 2).cast("int") - sample // 2 + 1, F.lit(sample))).otherwise(text)
    return often(F.when(n >= window * times, middle))
