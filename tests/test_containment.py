"""Texts looked for in all documents: as ``in`` says, for texts of any length at any place."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestone.operators import containment as C
from lodestone.plans import registry


@pytest.mark.parametrize(("slice_bytes", "texts_at_once"), [(1 << 19, 50_000), (37, 50_000), (1 << 19, 40)])
def test_least_holders_are_those_of_a_plain_search(spark, monkeypatch, slice_bytes, texts_at_once):
    monkeypatch.setattr(C, "TEXTS_AT_ONCE", texts_at_once)
    monkeypatch.setattr(C, "SLICE_BYTES", slice_bytes)
    draw = random.Random(5)
    some = lambda n: "".join(draw.choice("abé😀  ") for _ in range(n))
    docs = [(k if k else None, None if k % 17 == 3 else some(draw.choice([0, 3, 40, 200]))) for k in range(150)]
    docs += [(500, "x" * 90), (499, "y" + "x" * 70 + "y"), (501, "red fish swims far away"), (498, "xred fish swims far awayx"), (0, None)]
    draw.shuffle(docs)
    whole = [t for _, t in docs if t]
    cut = lambda t: (lambda a: t[a : a + draw.choice([1, 2, 3, 5, 8, 13, 33, 70])])(draw.randrange(len(t)))
    items = [(k, cut(draw.choice(whole)) if k % 2 else some(draw.choice([1, 2, 4, 7]))) for k in range(120)]
    items += [(200, "x" * 70), (201, "x" * 71), (202, "red fish swims far away"), (203, "ed"), (204, None), (205, "nowhere"), (206, "x"), (206, "red"), (None, "red"), (207, whole[0]), (208, whole[0])]
    found = C.first_holders(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "i int, w string"), "i", "w")
    wanted = {}
    for i, w in items:
        ids = [d for d, t in docs if i is not None and w is not None and d is not None and t is not None and w in t]
        if ids:
            wanted[i] = min(wanted.get(i, min(ids)), min(ids))
    assert found.columns == ["i", "d"] and dict(found.dtypes) == {"i": "int", "d": "bigint"}
    assert dict(map(tuple, found.collect())) == wanted and len(wanted) > 70


def test_an_empty_text_is_in_every_document_and_ids_may_be_strings(spark):
    docs = spark.createDataFrame([("b", "tea"), ("a", None), ("c", "")], "d string, t string")
    found = lambda *items: dict(map(tuple, C.first_holders(docs, "d", "t", spark.createDataFrame(list(items), "i long, w string"), "i", "w").collect()))
    assert found((1, ""), (2, "e")) == {1: "b", 2: "b"}
    assert found((1, "z")) == found() == {}


def test_expected_documents_of_short_items_and_within_words(spark, tmp_path):
    """Items of under five words, and such whose outer words are cut out of a document's, are expected in the documents that hold them."""
    texts = ["red fish", "a red fishing boat at sea", "the whale is blue today", "stranger tides rise and fall nowhere", "strange tides", "range tides rise and fall now", "old blue whales", "blue", "range tides", "fish red", "x y", ""]
    docs = pa.table({"doc_id": range(1, len(texts) + 1), "text": texts, "lang": ["en"] * len(texts), "source": [f"src{k % 3}" for k in range(len(texts))]})
    items = ["red fish", "range tides rise and fall now", "whale is", "blue whale", "fish", "x", "", "red fish boat", "d fish", "a b b b b b b b"]
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": range(len(items)), "text": items}), tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    wanted = sorted(con.execute(f"SELECT item_id, doc_id, rank, hit FROM ({registry.ORACLE_SQL['expected_hits']})").fetchall())
    got = sorted(map(tuple, registry.QUERIES["expected_hits"](spark, str(tmp_path)).select("item_id", "doc_id", "rank", "hit").collect()))
    assert got == wanted and {h for *_, h in wanted} == {True, False}
