"""Readers, writers, chunkers, lookup and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, router
from lodestone.sources import readers, writers
from lodestone.streaming import monitors


def test_csv_is_typed_trimmed_and_dispatched(spark, tmp_path):
    (tmp_path / "r.csv").write_text("code,levy_type,rate_pct,effective_from,effective_to\n 0101 ,CGST, 2.5,2017-07-01,\n")
    kind, rows = readers.notification_rows(spark, str(tmp_path / "r.csv"), "01/2017-CT(R)")
    row = rows.first()
    assert kind == "rates" and row.code == "0101" and row.rate_pct == 2.5 and row.effective_to is None and row.notif_id == "01/2017-CT(R)"
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.notification_rows(spark, str(tmp_path / "bad.csv"), "x")


def test_json_forms(spark, tmp_path):
    (tmp_path / "lines.jsonl").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    (tmp_path / "array.json").write_text(json.dumps([{"id": 3}, {"id": 4}]))
    path = str(tmp_path / "lines.jsonl")
    assert sorted(r.id for r in readers.json_lines(spark, path, "id int").collect()) == [1, 2]
    assert readers.json_lines(spark, path, "id int", drop_bad=False).cache().where("_bad is not null").count() == 1
    assert sorted(r.id for r in readers.json_any(spark, str(tmp_path / "array.json"), "id int").collect()) == [3, 4]
    assert readers.discovered(spark, str(tmp_path)).count() == 3


def test_pages_and_markers(spark):
    rows = spark.createDataFrame([(1, "one\ftwo\f"), (2, "x")], "id int, t string")
    assert sorted((r.id, r.page, r.char_start, r.text) for r in readers.pages_of(rows, "id", "t").collect()) == [(1, 1, 0, "one"), (1, 2, 4, "two"), (2, 1, 0, "x")]
    rows = spark.createDataFrame([(1, "--- PAGE 1 ---a--- PAGE 2 ---b")], "id int, t string")
    assert [r.page for r in readers.page_markers(rows, "id", "t").orderBy("page").collect()] == [1, 2]


def test_html_drops_scripts_and_prefers_main():
    html = "<html><body><nav>menu</nav><main><p>One</p><script>x()</script><p>Two &amp; three</p></main></body></html>"
    assert readers.page_text(html) == "One\nTwo & three"
    assert readers.page_text("<div>a</div><style>b</style>") == "a"
    assert readers.page_text(None) is None


def test_log_records(spark):
    lines = ["boot", "task 7 start", "tokens=12", "task 7 done in 3.5 ms", "task 8 start"]
    rows = spark.createDataFrame([("s", k, v) for k, v in enumerate(lines)], "server string, n int, value string")
    got = {r.task: (r.first_line, r.tokens, r.ms, r.done) for r in readers.request_log(rows, "n", "value", ["server"]).collect()}
    assert got == {7: (1, 12, 3.5, 1), 8: (4, None, None, 0)}


def test_other_sources(spark):
    rows = spark.createDataFrame([("a, b\nc,,a",)], "ids string")
    assert sorted(r.id for r in readers.id_list(rows, "ids").collect()) == ["a", "b", "c"]
    table = spark.createDataFrame([([["h", "k"], ["1", None]],)], "rows array<array<string>>")
    assert table.select(readers.table_markdown(F.col("rows"))).first()[0] == "| h | k |\n|---|---|\n| 1 |  |"
    body = spark.createDataFrame([(json.dumps({"data": "JVBERi0="}),), ("%PDF-1",), ("<html>",)], "body string")
    assert [r.is_pdf for r in readers.download_body(body, "body").collect()] == [True, True, False]
    docs = spark.createDataFrame([(1, "h1"), (2, "h9"), (3, "h8")], "doc_id int, sha256 string")
    cache = spark.createDataFrame([(9, "h1", "by hash"), (2, "hx", "by id")], "doc_id int, sha256 string, text string")
    assert {r.doc_id: r.text for r in readers.cached_text(docs, cache).collect()} == {1: "by hash", 2: "by id", 3: None}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    writers.write_lines(df, str(tmp_path / "j"))
    writers.write_table(df, str(tmp_path / "c"), tab=True)
    writers.write_parquet(df, str(tmp_path / "p"), ["k"])
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).where("k = 'a' or k = 'b'").count() == 2
    rows = spark.createDataFrame([("x" * 20_000, [(1, 2, "s", "long")])], "a string, c array<struct<id:int,page:int,section:string,text:string>>")
    row = rows.select(*writers.log_row(F.col("a"), F.col("c"))).first()
    assert len(row.answer_markdown) == 16_000 and json.loads(row.citations_json) == [{"id": 1, "page": 2, "section": "s"}]


PROSE = "\n\n".join(f"Sentence number {k} speaks of goods and of services. It goes on for a while, and ends." for k in range(200))
TABLE = "\n".join(f"| row {k} | {k * 7} |" for k in range(30))
LAW = "Section 1\nContents\nSection 2\nContents\n" + "".join(f"Section {n}\n" + f"Words of section {n}. " * 60 + "\n" for n in (1, 2, 3))


@pytest.mark.parametrize("method", sorted(chunking.METHODS))
def test_chunks_cover_the_text(spark, method):
    texts = [PROSE, LAW, PROSE[:3000] + "\n" + TABLE + "\n" + PROSE[:4000], "short text here", "", None, "   "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    options = {"floor": 1} if method in ("char_windows", "half_windows", "separator_windows") else {}  # these drop what is under it
    for r in chunking.chunk(rows, "id", "text", method, **options).collect():
        assert r.text == texts[r.id][r.char_start : r.char_end]
        got.setdefault(r.id, []).append((r.char_start, r.char_end))
    assert set(got) == {0, 1, 2, 3}
    for k, spans in got.items():
        spans.sort()
        covered = 0
        for a, b in spans:
            assert not texts[k][covered:a].strip() and b > a
            covered = max(covered, b)
        assert not texts[k][covered:].strip()


@pytest.mark.parametrize("at_once", [1, 9_000, 10**6])
def test_pieces_leave_a_batch_in_slices(spark, monkeypatch, at_once):
    """Texts are read one at a time out of Arrow batches; pieces are the same however many leave together, with their texts or without."""
    monkeypatch.setattr(chunking, "SLICE_CHARS", at_once)
    texts = [None, PROSE, "  ", LAW, PROSE[:3000] + "\n" + TABLE + "\n" + PROSE[:4000], "", "short", None]
    rows = spark.createDataFrame([(f"d{k}" if k else None, t) for k, t in enumerate(texts)], "id string, text string").coalesce(1)
    wanted = [(f"d{k}", n, *span) for k, t in enumerate(texts) if t and t.strip() for n, span in enumerate(chunking.two_pass(t))]
    bare = chunking.chunk(rows, "id", "text", "two_pass", texts=False)
    assert bare.columns == ["id", "chunk_no", "char_start", "char_end", "kind", "section"] and [tuple(r) for r in bare.collect()] == wanted
    whole = chunking.chunk(rows, "id", "text", "two_pass")
    assert [tuple(r) for r in whole.collect()] == [(*w, texts[int(w[0][1:])][w[2] : w[3]]) for w in wanted]
    assert "MapInArrow" in whole._jdf.queryExecution().executedPlan().toString()


def test_tables_stay_whole_and_long_ones_split_by_rows():
    text = PROSE[:2000] + "\n" + TABLE + "\n" + PROSE[:2000]
    tables = [text[a:b] for a, b, kind, _ in chunking.two_pass(text) if kind == "table"]
    assert tables == [TABLE]
    long = "\n".join(f"| row {k} | {'x' * 90} |" for k in range(200))
    parts = [long[a:b] for a, b, kind, _ in chunking.two_pass(long) if kind == "table"]
    assert len(parts) > 1 and "".join(parts) == long and all(p.startswith("| row") for p in parts)


def test_parts_of_a_table_carry_its_head(spark):
    row = f"| a row | {'x' * 90} |"
    long = "\n".join(["| goods | rate |", "Chapter 84 | machines", *[row] * 100])
    parts = list(chunking.two_pass(long, cap=3000))
    assert "".join(long[a:b] for a, b, _, _ in parts) == long and all(b - a <= 3000 for a, b, _, _ in parts)
    assert [s for *_, s in parts] == [""] + ["| goods | rate |\nChapter 84 | machines"] * (len(parts) - 1)
    got = chunking.chunk(spark.createDataFrame([(1, long)], "id int, text string"), "id", "text", "two_pass", cap=3000).orderBy("chunk_no").collect()
    assert got[1].text == "| goods | rate |\nChapter 84 | machines\n" + long[got[1].char_start : got[1].char_end]
    marked = "\n".join(f"Chapter {k} | part\n" + "\n".join([row] * 50) for k in (1, 2))
    assert [marked[a:b][:9] for a, b, _, _ in chunking.two_pass(marked)] == ["Chapter 1", "Chapter 2"]
    wide = "| a |\n| " + "y" * 9000 + " |\n| b |"
    assert [b - a for a, b, _, _ in chunking.two_pass(wide)] == [6, 9005, 5]


def test_windows_by_characters():
    spans = lambda method, text, **o: [(a, b) for a, b, _, _ in chunking.METHODS[method](text, **o)]
    text = "a" * 1850 + "\n\n" + "b" * 100 + "\n\n" + "c" * 2500
    assert spans("char_windows", text)[0] == (0, 1850)  # the first paragraph end behind the target
    assert spans("char_windows", "a" * 1850 + ". " + "b" * 100 + "!  " + "c" * 900)[0] == (0, 1955)  # the last sentence end
    assert spans("char_windows", "a" * 1900)[:2] == [(0, 1800), (1530, 1900)]
    assert spans("char_windows", "a" * 59) == [] and spans("char_windows", " " * 9 + "a" * 60) == [(0, 69)]
    assert spans("half_windows", "a" * 300 + ". " + "b" * 400) == [(0, 301), (251, 702)]
    assert spans("half_windows", "a" * 100 + ". " + "b" * 500) == [(0, 500), (450, 602)]
    assert spans("half_windows", "tiny") == [(0, 4)]
    assert spans("separator_windows", "a" * 300 + ". " + "b" * 100 + "\n" + "c" * 300)[0] == (0, 302)  # a dot goes before a later line end
    assert spans("separator_windows", "a" * 200 + ". " + "b" * 100 + "\n" + "c" * 300)[0] == (0, 303)
    assert spans("separator_windows", "tiny") == []


def test_sections_keep_the_last_of_a_label():
    spans = list(chunking.sections(LAW))
    assert [s[3] for s in spans] == ["", "section 1", "section 2", "section 3"]
    assert [s[3] for s in chunking.hierarchy("Chapter I\nSection 1\n" + "word " * 50)] == ["chapter i", "chapter i > section 1"]


def test_contents_list_and_fixed(spark):
    rows = spark.createDataFrame([(1, "1. First title\n2. Second title\n1. Again later")], "id int, text string")
    assert sorted((r.number, r.title) for r in chunking.contents_list(rows, "id", "text").collect()) == [(1, "First title"), (2, "Second title")]
    assert [r.text for r in chunking.fixed(rows, "id", "text", 20).orderBy("chunk_no").collect()] == ["1. First title\n2. Se", "cond title\n1. Again ", "later"]


def lookup_tables(spark):
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    import datetime as dt

    start, change = dt.date(2017, 7, 1), dt.date(2022, 10, 1)
    return {
        "rates": of([("8703", "CGST", 14.0, start, change), ("8703", "CGST", 9.0, change, None), ("0101", "IGST", 5.0, start, None)], "code string, levy_type string, rate_pct double, effective_from date, effective_to date"),
        "lists": of([("9983", "RCM", 1, "legal services", "13/2017-CT(R)", start, None), (None, "INVERTED_DUTY", 2, "fabrics", "05/2017-CT(R)", start, None), ("9992", "EXEMPT", 66, "education", "12/2017-CT(R)", start, None)], "code string, list_type string, sno int, description string, notif_id string, effective_from date, effective_to date"),
        "exemptions": of([("50/2017-Cus", 404, "8703", "cars", start, None)], "notif_id string, sno int, code string, description string, effective_from date, effective_to date"),
        "notifications": of([("50/2017-Cus", "Cus"), ("01/2017-CT(R)", "CT(R)")], "notif_id string, series string"),
    }


QUESTIONS = [
    ("What is S.No 404 of notification 50/2017-Cus?", "serial", 1), ("services under reverse charge", "list", 1), ("Is 9983 in RCM, SAC 9983?", "list", 1),
    ("inverted duty goods", "list", 1), ("Is education exempt?", "list", 1), ("rate of tax on HSN 8703", "rate", 1), ("CGST rate on 8703 as of 2020", "rate", 1),
    ("customs duty on 8703", "rate", 2), ("rate on HSN 0101 on 2018-01-05", "rate", 1), ("notification 50/2017-Cus", "notification", 1),
    ("notification 1/2017 for goods", "notification", 1), ("rate on 2019", None, None), ("How do I file an appeal?", None, None), ("nil rated goods", "list", 0),
]


def test_lookup_routes_and_rows(spark):
    rows = spark.createDataFrame([(k, q) for k, (q, _, _) in enumerate(QUESTIONS)], "id int, q string")
    got = {r.id: (r.route, r.n_rows) for r in router.answer(rows, "id", "q", lookup_tables(spark)).collect()}
    assert {k: got[k] for k in got} == {k: (route, n) for k, (_, route, n) in enumerate(QUESTIONS)}


def test_notification_ids_match_stored_ones(spark):
    texts = ["01/2017-CT(R)", "notification 50/2017-Cus", "notif 1/2017 customs", "123/2018-CUS", "nothing 12"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(router.notification(F.col("t")).alias("n"))
    assert [r.n for r in rows.collect()] == ["01/2017-CT(R)", "50/2017-Cus", "01/2017-Cus", "123/2018-Cus", None]


def test_newest_rows_merge_over_batches(spark, tmp_path):
    a = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k int, n int, v string")
    b = spark.createDataFrame([(1, 2, "z"), (2, 0, "old")], "k int, n int, v string")
    for version, batch in enumerate((a, b)):
        monitors.merge_latest(batch, str(tmp_path), ["k"], ["n"], version)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/1").collect()) == [(1, 2, "z"), (2, 1, "y")]


def test_questions_of_equal_features_are_looked_up_once(spark, monkeypatch):
    looked_up, durable = [], router.durable
    monkeypatch.setattr(router, "durable", lambda df: (lambda kept: (looked_up.append((kept.columns, kept.count())), kept)[1])(durable(df)))
    asked = F.element_at(F.array(F.lit("rate of tax on HSN 8703"), F.lit("customs duty on 8703"), F.lit("How do I file an appeal?")), (F.col("id") % 3 + 1).cast("int"))
    got = {r.id: (r.route, r.n_rows) for r in router.answer(spark.range(300).select("id", asked.alias("q")), "id", "q", lookup_tables(spark)).collect()}
    assert got == {k: [("rate", 1), ("rate", 2), (None, None)][k % 3] for k in range(300)}
    assert [n for columns, n in looked_up if "id" not in columns] == [3]


def test_few_pages_are_objects_at_once(spark, monkeypatch):
    import pyarrow as pa

    from lodestone.sources import readers

    pages = [None if k % 50 == 0 else f"<p>page {k}</p><script>x</script>" for k in range(200)]
    made = []
    monkeypatch.setattr(readers, "map_arrow", lambda df, function, schema: made.append(function))
    readers.html_text(spark.createDataFrame([(1, "")], "page_id long, html string"), "page_id", "html")
    out = list(made[0](iter([pa.RecordBatch.from_pydict({"page_id": list(range(200)), "html": pages})])))
    assert max(map(len, out)) <= 64 and sum(map(len, out)) == 200
    assert [t for b in out for t in b.column("text").to_pylist()] == [readers.page_text(p) for p in pages]
