"""Chunkers: one text to many pieces with exact offsets, as batched table functions.

Each chunker is a small scan over one text (breaks depend on where the last piece
ended, which column expressions cannot say); Spark deals the texts and runs the scans
in Arrow batches. ``fixed`` needs no scan and is a column expression.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.evidence import BAD_CUT
from lodestone.session import map_arrow

Span = tuple[int, int, str, str]  # start, end, kind, section
BLANKS = " \t\n\r\f"
SENTENCE_END = re.compile(r"[.!?।](?=\s)")
SENTENCE_BLANKS = re.compile(rf"[.?!][{BLANKS}]+")
SECTION = re.compile(r"(?m)^[ \t]*((?:section|rule|article|chapter|part)\s+\w+|\d{1,3}[A-Z]?\.(?=\s+\S))", re.IGNORECASE)
TABLE_LINE = re.compile(r"(?m)^[^\n|]*\|[^\n]*\|?[^\n]*$")
TABLE_MARK = re.compile(r"(?m)^[ \t]*(?:chapter|heading|sub-heading)[ \t]+\d+[^\n]*", re.IGNORECASE)
WHOLE_UNIT = re.compile(r"^\s*(?:provided\s+(?:further\s+)?that|explanation\b|illustration\b)", re.IGNORECASE)
BAD_START = re.compile(r"^\s*(?:" + BAD_CUT + ")")


def best_break(text: str, low: int, high: int) -> int:
    """Where to end a piece in [low, high]: the last paragraph end, else sentence end, else blank, else high."""
    for mark in ("\n\n", "\n"):
        at = text.rfind(mark, low, high)
        if at >= 0:
            return at + len(mark)
    ends = [m.end() for m in SENTENCE_END.finditer(text, low, min(high + 1, len(text)))]
    if ends:
        return ends[-1]
    at = text.rfind(" ", low, high)
    return at + 1 if at >= 0 else high


def windows(text: str, target: int = 1800, cap: int = 2400, overlap: int = 270, floor: int = 60, start: int = 0, end: int | None = None) -> Iterator[Span]:
    """Overlapping windows that end at natural breaks between target and cap; a rest under the floor joins the last one."""
    end = len(text) if end is None else end
    at = start
    while at < end:
        if end - at <= cap:
            stop = end
        else:
            stop = best_break(text, at + target, at + cap)
            if end - stop < floor:
                stop = end
        yield at, stop, "prose", ""
        if stop >= end:
            return
        at = max(stop - overlap, at + 1)
        if overlap:
            blank = text.find(" ", at, stop)
            at = blank + 1 if 0 <= blank < stop - 1 else at


def stepped(text: str, stop_of: Callable[[int], int], overlap: int, floor: int) -> Iterator[Span]:
    """Windows from each stop back by the overlap until a stop is the end; those under the floor without outer blanks are dropped."""
    at, stop = 0, 0
    while stop < len(text):
        stop = stop_of(at)
        if len(text[at:stop].strip(BLANKS)) >= floor:
            yield at, stop, "prose", ""
        at = max(stop - overlap, at + 1)


def char_windows(text: str, target: int = 1800, cap: int = 2400, overlap: int = 270, floor: int = 60) -> Iterator[Span]:
    """Windows of ``target`` characters that go on, below the cap, to the next paragraph end, else to the last sentence end."""

    def stop_of(at: int) -> int:
        least, most = at + target, min(at + cap, len(text))
        if least >= len(text):
            return len(text)
        paragraph = text.find("\n\n", least, most)
        return paragraph if paragraph >= 0 else max((m.end() for m in SENTENCE_BLANKS.finditer(text, least, most)), default=least)

    return stepped(text, stop_of, overlap, floor)


def half_windows(text: str, size: int = 500, overlap: int = 50, floor: int = 50) -> Iterator[Span]:
    """Windows of ``size`` characters, cut after the last ". " if that lies beyond their half; a text of one window stays at any length."""

    def stop_of(at: int) -> int:
        if at + size >= len(text):
            return len(text)
        dot = text.rfind(". ", at, at + size)
        return dot + 1 if dot - at > size // 2 else at + size

    return stepped(text, stop_of, overlap, floor if len(text) > size else 1)


def separator_windows(text: str, size: int = 500, overlap: int = 50, floor: int = 60, separators: tuple[str, ...] = (". ", "! ", "? ", "\n")) -> Iterator[Span]:
    """Windows of ``size`` characters, cut behind the last occurrence, in their second half, of the first separator that is there."""

    def stop_of(at: int) -> int:
        end = at + size
        if end >= len(text):
            return len(text)
        cuts = (text.rfind(s, at + size // 2, end) + len(s) for s in separators)
        return next((c for c in cuts if c > at + size // 2), end)

    return stepped(text, stop_of, overlap, floor)


def paragraphs(text: str) -> list[tuple[int, int]]:
    edges = [0, *(m.end() for m in re.finditer(r"\n\s*\n", text)), len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if text[a:b].strip()]


def packed(text: str, words: int = 250, overlap: int = 40) -> Iterator[Span]:
    """Paragraphs packed to about ``words`` words; the next piece begins ``overlap`` words back."""
    places = [m.start() for m in re.finditer(r"\S+", text)]
    heads = sorted({bisect_left(places, b) for _, b in paragraphs(text)[:-1]})  # words that begin a paragraph
    at = 0
    while at < len(places):
        stop = min(at + words, len(places))
        if stop < len(places):
            last = bisect_right(heads, stop) - 1
            stop = heads[last] if last >= 0 and heads[last] > at + words // 2 else stop
        yield places[at], places[stop] if stop < len(places) else len(text), "prose", ""
        if stop >= len(places):
            return
        at = max(stop - overlap, at + 1)


def section_starts(text: str, keep_last: bool = True) -> list[tuple[int, str]]:
    """Places and labels of section heads; of equal labels the last counts, since earlier ones are contents lists."""
    found = [(m.start(1), " ".join(m.group(1).lower().split())) for m in SECTION.finditer(text)]
    if keep_last:
        last = {label: at for at, label in found}
        found = [(at, label) for at, label in found if last[label] == at]
    return found


def sections(text: str, target: int = 3500, cap: int = 5500, floor: int = 500, keep_short: bool = True) -> Iterator[Span]:
    """Sections whole if at most 1.5 targets, else windows inside; text before the first is kept."""
    heads = section_starts(text)
    edges = [(0, "")] + heads if not heads or heads[0][0] > 0 else heads
    for (a, label), b in zip(edges, [h[0] for h in edges[1:]] + [len(text)], strict=True):
        if not text[a:b].strip() or (b - a < floor and not keep_short):
            continue
        if b - a <= 1.5 * target:
            yield a, b, "section", label
        else:
            for x, y, _, _ in windows(text, target, cap, 0, floor, a, b):
                yield x, y, "section", label


def table_regions(text: str) -> list[tuple[int, int]]:
    """Runs of two or more lines with bars."""
    runs: list[list[int]] = []
    for m in TABLE_LINE.finditer(text):
        if runs and not text[runs[-1][1] : m.start()].strip():
            runs[-1][1] = m.end()
            runs[-1][2] += 1
        else:
            runs.append([m.start(), m.end(), 1])
    return [(a, b) for a, b, n in runs if n >= 2]


def table_parts(text: str, a: int, b: int, cap: int, ceiling: int) -> Iterator[Span]:
    """A table whole up to the ceiling, else by its marked subtables, else by rows up to the cap.

    Parts by rows carry, as their section, the table's first line and its last chapter
    or heading line, as far as the part itself has none of them.
    """
    marks = list(TABLE_MARK.finditer(text, a, b))
    edges = sorted({a, b, *(m.start() for m in marks)})
    whole = b - a <= ceiling
    if a < b and (whole or (len(marks) >= 2 and all(y - x <= ceiling for x, y in zip(edges, edges[1:])))):
        yield from ((x, y, "table", "") for x, y in ([(a, b)] if whole else zip(edges, edges[1:])))
        return
    carried = [next((line.strip() for line in text[a:b].split("\n") if line.strip()), ""), marks[-1].group().strip() if marks else ""]
    while a < b:
        stop = b if b - a < cap else text.rfind("\n", a, a + cap) + 1 or text.find("\n", a, b) + 1 or b
        yield a, stop, "table", "\n".join(line for line in carried if line and line not in text[a:stop])
        a = stop


def two_pass(text: str, target: int = 3500, cap: int = 5500, ceiling: int = 8000, floor: int = 500, overlap: int = 700) -> Iterator[Span]:
    """Tables whole (by parts above the ceiling), then prose between them; provisos stay with what they qualify, short rests join."""
    out: list[Span] = []
    at = 0
    for a, b in [*table_regions(text), (len(text), len(text))]:
        prose = [s for s in windows(text, target, cap, overlap, floor, at, a)] if text[at:a].strip() else []
        for s in prose:
            head = text[s[0] : s[0] + 80]
            if out and out[-1][2] == "prose" and (WHOLE_UNIT.match(head) or BAD_START.match(head)) and s[1] - out[-1][0] <= ceiling:
                out[-1] = (out[-1][0], s[1], "prose", "")
            elif out and out[-1][2] == "prose" and s[1] - s[0] < floor and s[1] - out[-1][0] <= ceiling:
                out[-1] = (out[-1][0], s[1], "prose", "")
            else:
                out.append(s)
        out += table_parts(text, a, b, cap, ceiling)
        at = b
    yield from out


def hierarchy(text: str, words: int = 180, overlap: int = 30) -> Iterator[Span]:
    """Word windows that never run over a section head; each carries its section as a breadcrumb."""
    heads = section_starts(text, keep_last=False)
    edges = [(0, "")] + heads if not heads or heads[0][0] > 0 else heads
    chapter = ""
    for (a, label), b in zip(edges, [h[0] for h in edges[1:]] + [len(text)], strict=True):
        if label.startswith(("chapter", "part")):
            chapter = label
        trail = " > ".join(x for x in dict.fromkeys((chapter, label)) if x)
        for x, y, kind, _ in packed(text[a:b], words, overlap) if text[a:b].strip() else ():
            yield a + x, a + y, kind, trail


METHODS: dict[str, Callable[..., Iterator[Span]]] = {"char_windows": char_windows, "half_windows": half_windows, "separator_windows": separator_windows, "windows": windows, "packed": packed, "sections": sections, "two_pass": two_pass, "hierarchy": hierarchy}
SLICE_CHARS = 1_000_000  # of text whose pieces are held at once
CHUNKS = "chunk_no int, char_start int, char_end int, kind string, section string, text string"


def chunk(df: DataFrame, id_column: str, text: str, method: str, texts: bool = True, **options) -> DataFrame:
    """Pieces of each text: id, chunk_no, char_start, char_end, kind, section, text. Null and blank texts have none.

    The text of a table's part begins with the lines it carries (its section), which its offsets do not count.
    Without ``texts`` the column is left out. Texts become objects one at a time, pieces up to :data:`SLICE_CHARS`.
    """
    split = METHODS[method]
    schema = pa.schema([("chunk_no", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("kind", pa.string()), ("section", pa.string()), *([("text", pa.string())] if texts else [])])

    def pieces(value: str) -> Iterator[tuple]:
        for n, (a, b, kind, label) in enumerate(split(value, **options)):
            own = (f"{label}\n{value[a:b]}" if label and kind == "table" else value[a:b],) if texts else ()
            yield n, a, b, kind, label, *own

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(id_column), batch.column(text)
            rows, of, size = [], [], 0
            for at in range(len(batch)):
                value = values[at].as_py()
                if value and value.strip():
                    before = len(rows)
                    rows.extend(pieces(value))
                    of += [at] * (len(rows) - before)
                    size += len(value)
                if rows and (size >= SLICE_CHARS or at + 1 == len(batch)):
                    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), schema.types, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *columns], [id_column, *schema.names])
                    rows, of, size = [], [], 0

    kind, columns = df.schema[id_column].dataType.simpleString(), CHUNKS if texts else CHUNKS.removesuffix(", text string")
    return map_arrow(df.select(id_column, text), apply, f"{id_column} {kind}, {columns}")


def fixed(df: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """Non-overlapping pieces of ``size`` characters, as a column expression."""
    rows = df.where(F.length(text) > 0).select(id_column, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))).alias("chunk_no"))
    start = F.col("chunk_no") * size
    return rows.select(id_column, "chunk_no", start.alias("char_start"), F.least(start + size, F.length("_t")).alias("char_end"), F.substr("_t", start + 1, F.lit(size)).alias("text"))


def contents_list(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, number, title) of lines "N. Title", the first of each number."""
    rows = df.select(id_column, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^[ \t]*(\d{1,3}\.[ \t]+[^\n]{3,120})$"), 1)).alias("at", "line"))
    number = F.regexp_extract("line", r"^(\d+)\.", 1).cast("int")
    rows = rows.select(id_column, "at", number.alias("number"), F.regexp_replace("line", r"^\d+\.[ \t]+", "").alias("title"))
    return rows.groupBy(id_column, "number").agg(F.min_by("title", "at").alias("title"))
