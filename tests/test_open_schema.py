"""Open schemas on hand-made JSON."""

import json

import pytest

from lodestone.operators import open_schema as O
from lodestone.sources import readers

TEXTS = ['{"a":1,"b":{"c":"x","d":[1,"y",{"e":null}]}}', '{"a":"z","b":3}', "[1,2]", "bad{", None, "5", "{}", '{"a":"  ","b":{"c":null}}', '{"a":true,"d":[]}']


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id int, j string").repartition(3)


def test_fields_types_and_rates(rows):
    got = {r.field: (r.types, r.present, round(r.fill_rate, 6)) for r in O.field_rates(rows, "j").collect()}
    n = len(TEXTS)
    rate = lambda k: round(k / n, 6)
    assert got == {
        "a": ("BIGINT,BOOLEAN,STRING", 3, rate(3)), "b": ("BIGINT", 1, rate(1)), "b.c": ("STRING", 1, rate(1)), "b.d[]": ("BIGINT,STRING", 1, rate(1)),
        "b.d[].e": ("", 0, 0.0), "[]": ("BIGINT", 1, rate(1)), "$": ("BIGINT", 1, rate(1)),
    }


def test_rates_of_nothing(rows):
    assert O.field_rates(rows.where("id < 0"), "j").count() == 0
    assert O.field_rates(rows.where("j is null"), "j").count() == 0


def test_nesting_beyond_the_deepest_level_is_one_field(spark):
    deep = spark.createDataFrame([(1, json.dumps({"a": {"b": {"c": 1}}}))], "id int, j string")
    values = O.variants(deep, "j")
    assert [r.field for r in O.leaves(values).collect()] == ["a.b.c"]
    assert [(r.field, r.kind) for r in O.leaves(values, deepest=2).collect()] == [("a.b", "OBJECT<c: BIGINT>")]


def test_merged_schema(spark, rows):
    assert O.merged_schema(rows.where("id in (1, 7)"), "j") == "OBJECT<a: STRING, b: VARIANT>"
    assert O.merged_schema(rows.where("id < 0"), "j") in (None, "VOID")


def test_texts_of_rows(rows):
    got = {r.id: r.text for r in O.texts_of_rows(rows, "id", "j", ["x", "a"]).collect()}
    assert got[0] == "1" and got[1] == "z" and got[2] == "[]: 1; []: 2" and got[3] is None and got[4] is None and got[5] == "$: 5"
    assert got[6] is None and got[7] == "a:   " and got[8] == "true"


def test_json_lines_with_defaults(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "tier": null}\n{"id": 2, "tier": 3, "lang": "fr"}\nbroken\n')
    got = readers.json_with_defaults(spark, str(tmp_path / "x.jsonl"), "id long, tier int, lang string, note string", {"tier": 9, "lang": "en"}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 9, "en", None), (2, 3, "fr", None)]
