"""Packing folds against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import packing


def plain_pack(parts, target):
    out, buf = [], ""
    for p in parts:
        if len(buf) + len(p) + 2 <= target:
            buf = f"{buf}\n\n{p}".strip() if buf else p
        else:
            out += [buf] if buf else []
            buf = p
    return out + ([buf] if buf else [])


def plain_sections(text, head, target, most, least):
    parts = [p.strip() for p in re.split(rf"(?m)(?=^[ \t]*(?:{head}))", text) if p.strip()]
    out = []
    for chunk in plain_pack(parts, target):
        if len(chunk) <= most:
            out.append(chunk)
            continue
        cur = ""
        for p in re.split(r"\n\n+", chunk):
            if len(cur) + len(p) + 2 <= target:
                cur = f"{cur}\n\n{p}".strip() if cur else p
            else:
                out += [cur] if cur else []
                cur = p
                while len(cur) > most:
                    out.append(cur[:most])
                    cur = cur[most:]
        out += [cur] if cur else []
    return [c for c in out if len(c) >= least]


def texts():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randint(1, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    made = ["", "   \n ", "short", line(900), "Rule 1\n" + line(5), "x" * 700]
    for _ in range(12):
        made.append("".join(draw.choice(["Rule 7 ", "", "\n", "  Rule ", "\n\n", "\n\n\n"]) + line(draw.randint(1, 60)) + draw.choice(["\n", "\n\n", " "]) for _ in range(draw.randint(1, 25))))
    return made


@pytest.mark.parametrize(("target", "most", "least"), [(1400, 2200, 120), (60, 100, 10), (20, 30, 1)])
def test_sections_equal_a_plain_loop(spark, target, most, least):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "id int, t string").repartition(3)
    got = {r.id: r.c for r in df.select("id", packing.section_chunks(F.col("t"), "Rule ", target, most, least).alias("c")).collect()}
    assert got == {k: plain_sections(t, "Rule ", target, most, least) for k, t in enumerate(texts())}


def plain_hierarchy(paragraphs, words, overlap):
    out, buf, n, state = [], [], 0, ["", "", ""]

    def flush():
        nonlocal buf, n
        text = " ".join(buf)
        if n > 20:
            out.append((text, *state))
        tail = text.split()[-overlap:]
        buf, n = ([" ".join(tail)] if tail else []), len(tail)

    for p in paragraphs:
        found = [re.search(x, p) for x in (r"Chapter (\w+)", r"Section (\w+)", r"\[(\w+)\]")]
        if (found[0] or found[1]) and n > 60:
            flush()
        state = [m.group(1) if m else s for m, s in zip(found, state, strict=True)]
        buf.append(p)
        n += len(p.split())
        if n >= words:
            flush()
    return out + ([(" ".join(buf), *state)] if n > 20 else [])


@pytest.mark.parametrize(("words", "overlap"), [(180, 30), (70, 5), (25, 24)])
def test_headings_equal_a_plain_loop(spark, words, overlap):
    draw = random.Random(9)
    rows = [(0, []), (1, ["one two"])]
    for k in range(2, 14):
        heads = ["", "", "", "Chapter {} ", "Section {} ", "[{}] ", "Chapter {} Section 9 "]
        rows.append((k, [draw.choice(heads).format(draw.randint(1, 30)) + " ".join("w" * draw.randint(1, 3) for _ in range(draw.randint(1, 90))) for _ in range(draw.randint(1, 20))]))
    df = spark.createDataFrame(rows, "id int, p array<string>").repartition(2)
    chunks = packing.hierarchy_chunks(F.col("p"), r"Chapter (\w+)", r"Section (\w+)", r"\[(\w+)\]", words, overlap)
    got = {r.id: [tuple(c) for c in r.c] for r in df.select("id", chunks.alias("c")).collect()}
    assert got == {k: plain_hierarchy(p, words, overlap) for k, p in rows}
