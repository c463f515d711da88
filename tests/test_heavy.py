"""Most frequent values, running sums inside arrays, and page sources."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions.arrays import sums_before
from lodestone.operators import heavy
from lodestone.sources import readers


@pytest.mark.parametrize(("tracked", "most"), [(4096, 10**6), (16, 10**6), (16, 16)])
def test_top_values_are_exact(spark, monkeypatch, tracked, most):
    monkeypatch.setattr(heavy, "MOST_TRACKED", most)
    draw = random.Random(2)
    rows = [("hot", f"v{min(int(draw.expovariate(0.02)), 400)}") for _ in range(4000)] + [("flat", f"f{k % 300}") for k in range(900)] + [("few", "x"), ("few", None), (None, "y"), (None, "y")]
    got = heavy.top_values(spark.createDataFrame(rows, "g string, v string").repartition(4), "v", 7, "g", tracked).collect()
    want = {}
    for g in {g for g, _ in rows}:
        counts = Counter(v for x, v in rows if x == g and v is not None)
        want[g] = [(v, n) for v, n in sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:7]]
    for g, top in want.items():
        assert [(r.value, r.n) for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == top


def test_top_values_of_nothing(spark):
    empty = spark.createDataFrame([], "v string")
    assert heavy.top_values(empty, "v", 5).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_sums_before(spark, n):
    values = [(k * 7919) % 31 for k in range(n)]
    got = spark.createDataFrame([(values,), (None,)], "v array<int>").select(sums_before(F.col("v")).alias("s")).collect()
    assert got[0].s == [sum(values[:k]) for k in range(n)] and got[1].s is None


def test_pages_of_files_with_offsets(spark, tmp_path):
    texts = {"a": "one\ftwo pages\f", "b": "x", "c": "intro\n--- PAGE 1 ---\nfirst\n--- PAGE 2 ---\nsecond"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    files = readers.page_files(spark, str(tmp_path)).withColumn("name", F.substring_index("path", "/", -1))
    pages = {(r.name, r.page): (r.char_start, r.text) for r in readers.pages_of(files, "name", "text").collect()}
    assert pages[("a", 1)] == (0, "one") and pages[("a", 2)] == (4, "two pages") and ("a", 3) not in pages and pages[("b", 1)] == (0, "x")
    plan = readers.pages_of(files, "name", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    offsets = files.where("name = 'c'").select(readers.marker_offsets(F.col("text")).alias("o")).first().o
    assert offsets == [0, texts["c"].index("--- PAGE 1"), texts["c"].index("--- PAGE 2")]
    assert {r.path.rsplit("/", 1)[1]: r.length for r in readers.listing(spark, str(tmp_path)).collect()} == {k: len(v) for k, v in texts.items()}


def test_text_sources_prefer_files_that_exist(spark):
    docs = spark.createDataFrame([(1, "/en/1", "/hi/1"), (2, "/en/2", "/hi/2"), (3, None, "/hi/3"), (4, None, None), (5, "/en/5", None)], "doc_id long, en string, hi string")
    there = spark.createDataFrame([("/en/1",), ("/hi/1",), ("/hi/2",), ("/hi/2",)], "path string")
    long = "intro\n--- PAGE 1 ---\n" + "x" * 600
    cache = spark.createDataFrame([(3, long), (4, "short"), (1, long)], "doc_id long, text string")
    got = {r.doc_id: (r.path, r.text, r.page_offsets, r.reason) for r in readers.text_sources(docs, ["en", "hi"], there, cache).collect()}
    assert got == {1: ("/en/1", None, None, None), 2: ("/hi/2", None, None, None), 3: (None, long, [0, 6], None), 4: (None, None, None, "missing"), 5: (None, None, None, "missing")}


def test_counted_values_are_those_of_sketches_and_are_not_written(spark, monkeypatch):
    rows = spark.createDataFrame([(None if n % 7 == 0 else "ab"[n % 2], None if n % 11 == 0 else f"w{n % 5}") for n in range(300)], "g string, v string")
    for group in (None, "g"):
        plain = sorted(map(repr, heavy.top_values(rows, "v", 3, group).collect()))
        with monkeypatch.context() as closed:
            closed.setattr(heavy, "durable", None)
            assert sorted(map(repr, heavy.counted_values(rows, "v", 3, group).collect())) == plain
