"""Spelling variants against deletion neighbourhoods and all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import queries, variants

SF = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def differ_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain_near(words):
    cut = defaultdict(set)
    for w in words:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            cut[k].add(w)
    near = defaultdict(set)
    for group in cut.values():
        for a in group:
            near[a] |= {b for b in group if a != b and differ_by_one(a, b)}
    return near


def plain_variants(rows):
    n = plain_words(rows)
    near = plain_near(n)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def compare(mine, plain):
    order = lambda rows: sorted(rows, key=lambda r: r[0])
    assert order(mine) == order(plain)


def test_variants_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = queries.op13_spelling_variants(spark, SF)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    plain = plain_variants(rows)
    assert sum(r[1] is not None for r in plain) > 100
    compare(got(df), plain)


@pytest.fixture(scope="module")
def spelled(spark):
    """Words of few letters, chains of forms, long runs of one letter, capitals, accents, repeated rows, odd documents."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abé") for _ in range(draw.randint(6, 9))) for _ in range(300)]
    texts = [" ".join(draw.choice(words) for _ in range(80)) for _ in range(60)]
    chain = ["testing1 ".replace("1", "e") * 1200, "testinge testinga " * 3 + "testinga " * 100, "testingb testingab testinga " * 2 + "ttestinga ttestinga"]
    texts += [*chain, "a" * 300 + " " + "a" * 301 + " " + "a" * 300 + ";" + "a" * 301, "ÉCOLIERS écoliers Écoliers_ÉCOLIERS", "naïveté×naïveté " * 3, "Straßenbahn9straßenbahn STRAßENBAHN"]
    rows = [*enumerate(texts), (None, "unnamed unnamed unnamed"), (900, None), (901, ""), (902, "1234 \n"), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return df.withColumn("word", variants.F.lit(1)).withColumn("n", variants.F.lit("n")).withColumn("key", variants.F.lit(2)), rows


@pytest.mark.parametrize("limit", [variants.WORDS_A_SHARD, 40, 7])
def test_variants_of_odd_documents_and_hot_shards(spelled, limit):
    compare(got(variants.spelling_variants(spelled[0], limit)), plain_variants(spelled[1]))


def test_variants_of_nothing(spelled):
    assert variants.spelling_variants(spelled[0].where("1 = 0")).count() == 0
    assert variants.spelling_variants(spelled[0].where("text is null")).count() == 0


def test_hot_shards_are_split(spark):
    words = spark.createDataFrame([(f"abc{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}x", 2) for k in range(900)], "word string, n long")
    per = variants._dealt(words, 100).groupBy("shard", "part").agg(variants.F.sum(variants.F.col("own").cast("int")).alias("n")).collect()
    assert max(r.n for r in per) < 200


def test_search_finds_each_near_word_once():
    draw = random.Random(8)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(7, 9))).encode() for _ in range(800)})
    index = variants.Index(words)
    asked = [*words, b"zzzzzzzz", b"abcabcz"]
    pairs = Counter()
    for kind in (variants.PREFIX, variants.SUFFIX):
        for a, p in zip(*(x.tolist() for x in index.within_one_error(asked, kind)), strict=True):
            if kind == variants.PREFIX or not words[p].startswith(asked[a][: len(asked[a]) // 2]):
                pairs[asked[a], words[p]] += 1
    assert set(pairs.values()) == {1}
    assert set(pairs) == {(a, b) for a in asked for b in words if differ_by_one(a.decode(), b.decode())}


def test_intervals_agree_in_both_directions():
    words = sorted({b"banana", b"bandana", b"ananas", b"cabana", b"anagram"})
    index = variants.Index(words)
    text = b"\1" + b"".join(w + b"\1" for w in words)
    for pattern in (b"ana", b"an", b"\1ban", b"na\1", b"zz"):
        codes = index.table[np.frombuffer(pattern, dtype=np.uint8)]
        left, right = index.everything(1), index.everything(1)
        for c in codes[::-1]:
            left = index.extend(left, np.array([c]), True)
        for c in codes:
            right = index.extend(right, np.array([c]), False)
        count = sum(text[i : i + len(pattern)] == pattern for i in range(len(text)))
        assert left.size[0] == right.size[0] == count
        assert not count or (left.low[0] == right.low[0] and left.back[0] == right.back[0])


def test_suffixes_are_sorted():
    draw = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        text = np.append(draw.integers(1, 4, size=n), 0)
        assert variants.suffix_array(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
