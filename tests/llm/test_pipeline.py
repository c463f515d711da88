"""The pipeline's stages and the registered queries of the corpus operators."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from lodestone.llm import pieces, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_reduce(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= kept
        kept = docs.count()
    texts = docs.select("text").collect()
    assert len({r.text for r in texts}) == len(texts)
    result = corpus_pipeline.run(spark, SF)
    assert result.columns == ["doc_id", "n_tokens", "token_ids", "parity"]
    assert result.where("parity").count() == result.count() > 0


@pytest.fixture(scope="module")
def clashing_ids(spark, messy):
    """The messy documents with ids that name several texts, several rows without an id, and wholly equal rows of both kinds."""
    first = messy.where("doc_id = 20").first()
    near = first.text + " one more word"
    extra = [(1, "alpha beta"), (None, "alpha beta"), (None, "a unique text of its own"), (7, "alpha beta gamma"), (7, "second text under id seven"), (5, "alpha beta gamma"), (7, near), (21, near + " and another")]
    extra += [(None, "twice without an id"), (None, "twice without an id"), (30, "twice with one"), (30, "twice with one"), (None, None), (None, None)]
    rows = [(d, t, "en", "src1") + tuple(first)[4:] for d, t in extra]
    return messy.unionByName(spark.createDataFrame(rows, messy.schema)).repartition(3).checkpoint()


def _pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_quality_stage_equals_a_plain_version(spark, clashing_ids):
    rows = _pairs(clashing_ids)
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    expected = Counter(r for r, score in zip(rows, brute.quality(rows, labels)) if score >= 0.3)
    assert Counter(_pairs(corpus_pipeline.quality_stage(spark, clashing_ids, SF))) == expected and 0 < sum(expected.values())


def test_exact_stage_equals_a_plain_version(spark, clashing_ids):
    got = Counter((d, re.sub(r"[\x20\x09-\x0D]", "", t or "")) for d, t in _pairs(corpus_pipeline.exact_dedup_stage(spark, clashing_ids, SF)))
    assert got == brute.exact_rows(_pairs(clashing_ids))


def test_near_stage_equals_a_plain_version(spark, clashing_ids):
    alone, groups = brute.near_rows(_pairs(clashing_ids))
    got = Counter((d, frozenset(brute.shingles(t))) for d, t in _pairs(corpus_pipeline.near_dedup_stage(spark, clashing_ids, SF)))
    for row, n in alone.items():
        assert got.pop(row) == n
    assert sum(got.values()) == len(groups)
    for members in groups:
        least = min(d for d, _ in members)
        kept = [m for m in set(members) if m[0] == least and got[m]]
        assert len(kept) == 1 and got[kept[0]] == 1


def test_mixing_stage_equals_a_plain_version(spark, clashing_ids):
    """Documents whose id occurs once are taken as their hash says; each source comes within half a document of its target, repeated ids or not."""
    rows = [(r.doc_id, r.text, r.source) for r in clashing_ids.select("doc_id", "text", "source").collect()]
    times, per_id = brute.copies(rows), Counter((s, d) for d, _, s in rows)
    got = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mixing_stage(spark, clashing_ids, SF).select("doc_id", "text", "source").collect())
    targets, boundary = brute.mix_targets(rows), set()
    for source, (target, size, largest) in targets.items():
        words = sum(n * len(brute.WORD.findall(r[1] or "")) for r, n in got.items() if r[2] == source)
        assert abs(words - target) <= largest / 2 + 1e-6
        every = int(target // size) if size else 0
        for row, n in Counter(r for r in rows if r[2] == source).items():
            assert every * n <= got[row] <= (every + 1) * n
            if per_id[(source, row[0])] == 1 and got[row] != times[(source, row[0])]:
                boundary.add((source, row[0]))
    # A repeated id on the boundary leaves out less than before, so at most the document behind it changes.
    assert len(boundary) <= len(targets) and sum(got.values()) > 0


def test_encoding_stage_equals_the_library(spark, clashing_ids):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    got = Counter((r.doc_id, tuple(r.token_ids)) for r in corpus_pipeline.encoding_stage(spark, clashing_ids, SF).collect())
    assert got == Counter((d, tuple(library.encode(t or ""))) for d, t in _pairs(clashing_ids))


def test_run_of_the_whole_pipeline_on_messy_documents(spark, clashing_ids, tmp_path):
    from sentencepiece import SentencePieceProcessor

    clashing_ids.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {d for d, _ in _pairs(clashing_ids)}
    library = SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    texts = {(d, tuple(library.encode(t or ""))) for d, t in _pairs(clashing_ids)}
    assert got and all(r.parity and r.doc_id in ids and (r.doc_id, tuple(r.token_ids)) in texts for r in got)
    assert max(Counter((r.doc_id, tuple(r.token_ids)) for r in got).values()) <= 3


def test_run_is_the_stages_in_order(spark, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "source_mixing", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in found.fetchall())
    assert sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in df.select(*columns).collect()) == expected
