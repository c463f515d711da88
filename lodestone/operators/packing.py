"""Sections and paragraphs packed to chunks as folds over a document's own array: no Python, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import let

# Characters of a packed chunk, at most and at least.
TARGET, HARD_MOST, LEAST = 1_400, 2_200, 120
# Words a chunk, words that the next one repeats, and the words under which headings end none and none is kept.
WORDS, OVERLAP, FLUSH_OVER, KEEP_OVER = 180, 30, 60, 20
#: Stands before the parts of a text; no text holds it.
_CUT = "\u0001"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s]+|[\s]+$", "")


def parts_at(text: Column, head: str) -> Column:
    """A text cut before every line that begins with ``head`` (blanks before it aside), parts stripped, blank ones dropped."""
    marked = F.regexp_replace(text, f"(?m)^([ \\t]*(?:{head}))", f"{_CUT}$1")
    return F.filter(F.transform(F.split(marked, _CUT), stripped), lambda p: p != "")


def _start() -> Column:
    return F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))


def _rest(state: Column) -> Column:
    return F.when(state["buf"] != "", F.concat(state["out"], F.array(state["buf"]))).otherwise(state["out"])


def packed(parts: Column, target: int = TARGET) -> Column:
    """Consecutive parts joined by a blank line as long as they fit into ``target`` characters; a longer part stands alone."""

    def step(a: Column, p: Column) -> Column:
        fits = F.length(a["buf"]) + F.length(p) + 2 <= target
        buf = F.when(fits & (a["buf"] != ""), stripped(F.concat_ws("\n\n", a["buf"], p))).otherwise(p)
        return F.struct(buf.alias("buf"), F.when(fits, a["out"]).otherwise(_rest(a)).alias("out"))

    return F.aggregate(parts, _start(), step, _rest)


def packed_paragraphs(text: Column, target: int = TARGET, most: int = HARD_MOST) -> Column:
    """A long text by paragraphs, packed as :func:`packed`; a paragraph over ``most`` characters is cut at every ``most``."""

    def step(a: Column, p: Column) -> Column:
        fits = F.length(a["buf"]) + F.length(p) + 2 <= target
        cuts = F.greatest(F.ceil(F.length(p) / most).cast("int") - 1, F.lit(0))
        whole = F.when(cuts > 0, F.transform(F.sequence(F.lit(0), F.greatest(cuts - 1, F.lit(0))), lambda i: F.substring(p, i * most + 1, F.lit(most)))).otherwise(F.array().cast("array<string>"))
        joined = F.when(a["buf"] != "", stripped(F.concat_ws("\n\n", a["buf"], p))).otherwise(p)
        buf = F.when(fits, joined).otherwise(F.substring(p, cuts * most + 1, F.lit(most)))
        return F.struct(buf.alias("buf"), F.when(fits, a["out"]).otherwise(F.concat(_rest(a), whole)).alias("out"))

    return F.aggregate(F.split(text, r"\n\n+"), _start(), step, _rest)


def section_chunks(text: Column, head: str, target: int = TARGET, most: int = HARD_MOST, least: int = LEAST) -> Column:
    """Chunks of a text: sections packed to ``target``, those over ``most`` again by paragraphs, and only those of ``least`` characters or more."""
    chunks = F.flatten(F.transform(packed(parts_at(text, head), target), lambda c: F.when(F.length(c) <= most, F.array(c)).otherwise(packed_paragraphs(c, target, most))))
    return F.filter(chunks, lambda c: F.length(c) >= least)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def _flushed(a: Column, overlap: int) -> Column:
    """A chunk of more than KEEP_OVER words goes out with the headings so far; its last words stay."""
    chunk = F.struct(a["buf"].alias("text"), a["chapter"].alias("chapter"), a["section"].alias("section"), a["anchor"].alias("anchor"))
    tail = let(_words(a["buf"]), lambda w: F.slice(w, F.greatest(F.size(w) - overlap + 1, F.lit(1)), F.lit(overlap)))
    return let(tail, lambda t: F.struct(
        F.array_join(t, " ").alias("buf"), F.size(t).alias("n"), a["chapter"].alias("chapter"), a["section"].alias("section"), a["anchor"].alias("anchor"),
        F.when(a["n"] > KEEP_OVER, F.concat(a["out"], F.array(chunk))).otherwise(a["out"]).alias("out"),
    ))


def hierarchy_chunks(paragraphs: Column, chapter: str, section: str, anchor: str, words: int = WORDS, overlap: int = OVERLAP) -> Column:
    """Chunks (text, chapter, section, anchor) of paragraphs, each with the headings that are current when it ends.

    The patterns' first group is a heading's number. A chapter or section ends a chunk of
    more than FLUSH_OVER words, ``words`` end any; the next one begins with the last
    ``overlap`` words.
    """
    kind = "array<struct<text:string,chapter:string,section:string,anchor:string>>"
    start = F.struct(F.lit("").alias("buf"), F.lit(0).alias("n"), *[F.lit("").alias(c) for c in ("chapter", "section", "anchor")], F.array().cast(kind).alias("out"))
    found = lambda p, pattern: F.when(p.rlike(pattern), F.trim(F.regexp_extract(p, pattern, 1)))

    def step(a: Column, p: Column) -> Column:
        c, s, x = found(p, chapter), found(p, section), found(p, anchor)
        turned = let(F.when((c.isNotNull() | s.isNotNull()) & (a["n"] > FLUSH_OVER), _flushed(a, overlap)).otherwise(a), lambda b: F.struct(
            F.when(b["n"] > 0, F.concat_ws(" ", b["buf"], p)).otherwise(p).alias("buf"), (b["n"] + F.size(_words(p))).alias("n"),
            F.coalesce(c, b["chapter"]).alias("chapter"), F.coalesce(s, b["section"]).alias("section"), F.coalesce(x, b["anchor"]).alias("anchor"), b["out"].alias("out"),
        ))
        return let(turned, lambda b: F.when(b["n"] >= words, _flushed(b, overlap)).otherwise(b))

    last = lambda a: F.when(a["n"] > KEEP_OVER, F.concat(a["out"], F.array(F.struct(a["buf"].alias("text"), a["chapter"].alias("chapter"), a["section"].alias("section"), a["anchor"].alias("anchor"))))).otherwise(a["out"])
    return F.aggregate(paragraphs, start, step, last)
