"""Substring, near and exact dedup against plain versions, over messy documents and a given table."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, minhash, rlz, suffixes
from tests.llm import brute


def _distinct(df):
    rows = df.where("doc_id is not null").select("doc_id", "text").distinct()
    return rows, [(r.doc_id, r.text) for r in rows.collect()]


@pytest.mark.parametrize("source", ["messy", "table"])
def test_rlz_equals_brute_force(spark, messy, sf_dir, source):
    docs = messy if source == "messy" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, rows = _distinct(docs)
    expected = brute.rlz(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rlz.substring_dedup(docs).collect()}
    assert got == expected


def test_rlz_spans_point_to_equal_words(messy):
    docs, rows = _distinct(messy)
    words = {d: brute.WORD.findall(t or "") for d, t in rows}
    found = 0
    for row in rlz.factors(docs).collect():
        for s in row.spans:
            assert words[row.doc_id][s.start : s.start + s.length] == words[s.source_doc][s.source_start : s.source_start + s.length]
            assert (s.source_doc, s.source_start) < (row.doc_id, s.start) and s.length >= 20
            found += 1
    assert found


def test_rlz_null_ids_and_repeated_rows(messy, empty):
    rows = rlz.substring_dedup(messy).collect()
    assert len(rows) == messy.count()
    assert sum(r.doc_id is None for r in rows) == 2
    assert rlz.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("source", ["messy", "table"])
def test_suffixes_equal_brute_force(spark, messy, sf_dir, source):
    docs = messy if source == "messy" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, rows = _distinct(docs)
    expected = brute.suffixes(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.suffix_dedup(docs).collect()}
    assert got == expected


def test_suffixes_repeated_rows_and_empty(messy, empty):
    assert suffixes.suffix_dedup(messy).count() == messy.count()
    assert suffixes.suffix_dedup(empty).count() == 0


@pytest.fixture(scope="module")
def hot_line(spark):
    """A line of 150 bytes, and a passage of 260, between different texts of each document."""
    draw = np.random.default_rng(9)
    other = lambda n: bytes(draw.integers(97, 123, size=n).astype(np.uint8)).decode()
    line, passage = other(150), other(260)
    rows = [(k, other(220) + (line if k % 3 else passage) + other(220)) for k in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows


def test_hot_anchors_are_split(hot_line):
    blocks = suffixes.make_blocks(hot_line[0])

    def contexts(payload):
        cut = suffixes._Cut(suffixes.Block(payload), suffixes.LENGTH, suffixes.GRAM)
        return cut.anchor, cut.context

    hot, _ = suffixes.hot_anchors(blocks, contexts, hot=10)
    per_anchor = {}
    for r in blocks.collect():
        cut = suffixes._Cut(suffixes.Block(r.payload), suffixes.LENGTH, suffixes.GRAM, hot)
        for a, c in zip(cut.anchor.tolist(), cut.context.tolist(), strict=True):
            per_anchor.setdefault(a, set()).add(c)
    assert len(hot) and max(map(len, per_anchor.values())) <= 10 + blocks.count()
    whole = suffixes._Cut(suffixes.Block(blocks.first().payload), suffixes.LENGTH, suffixes.GRAM)
    assert np.unique(whole.anchor, return_counts=True)[1].max() > 10 + blocks.count()


@pytest.mark.parametrize("hot", [2, 10])
@pytest.mark.parametrize("source", ["hot", "messy"])
def test_suffixes_of_hot_anchors_equal_brute_force(hot_line, messy, source, hot):
    docs, rows = hot_line if source == "hot" else _distinct(messy)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.suffix_dedup(docs, hot=hot).collect()}
    assert got == brute.suffixes(rows)


@pytest.fixture(scope="module")
def hot_words(spark):
    """Twelve words, and a passage of thirty, between different words of each document."""
    draw = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{x}" for x in draw.integers(0, 10**6, size=n))
    line, passage = words(12), words(30)
    rows = [(k, words(25) + " " + (line if k % 3 else passage) + " " + words(25)) for k in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows


@pytest.mark.parametrize("hot", [2, 10])
@pytest.mark.parametrize("source", ["hot", "messy"])
def test_rlz_of_hot_anchors_equals_brute_force(hot_words, messy, source, hot):
    docs, rows = hot_words if source == "hot" else _distinct(messy)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rlz.substring_dedup(docs, hot=hot).collect()}
    assert got == brute.rlz(rows)


def test_rlz_hot_anchors_are_split(hot_words):
    blocks = rlz.make_blocks(hot_words[0])

    def contexts(payload):
        p = rlz._Parsed(rlz.Block(payload), rlz.WINDOW, rlz.GRAM)
        return p.anchor, p.context

    hot, buckets = rlz.hot_anchors(blocks, contexts, hot=10)
    per_anchor = {}
    for r in blocks.collect():
        p = rlz._Parsed(rlz.Block(r.payload), rlz.WINDOW, rlz.GRAM, hot)
        for a, c in zip(p.anchor.tolist(), p.context.tolist(), strict=True):
            per_anchor.setdefault(a, set()).add(c)
    assert len(hot) and max(map(len, per_anchor.values())) <= 10 + blocks.count() and buckets >= 3


def test_two_stage_order_is_the_sorted_order():
    draw = np.random.default_rng(3)
    length = 12
    for trial in range(20):
        base = draw.integers(97, 100, size=300).astype(np.uint8)
        data, begins, counts, ends, windows, at = [], [], [], [], [], 0
        for _ in range(10):
            doc = base[draw.integers(0, 200) :][: draw.integers(length, 80)]
            doc = np.repeat(doc[:20], 4) if trial % 3 == 0 else doc
            high = len(doc) - length
            stops = suffixes.direct_stops(doc, np.array([0, len(doc)]))
            last = int(stops[np.searchsorted(stops, high)])
            piece = np.append(doc[: min(last + length, len(doc))], np.uint8(0))
            data.append(piece)
            begins.append(at)
            counts.append(last + 1)
            ends.append(last == len(doc))
            windows.append(high + 1)
            at += len(piece)
        order = suffixes.SuffixOrder(np.concatenate(data), np.array(begins), np.array(counts), np.array(ends), length)
        rank = np.arange(len(order.at)) - np.repeat(np.cumsum(counts) - counts, counts)
        real = order.order[(rank < np.array(windows)[order.string])[order.order]]
        keys = [bytes(order.data[order.at[x] : order.at[x] + length]) for x in real]
        assert keys == sorted(keys)
        common = [next((k for k in range(length) if a[k] != b[k]), length) for a, b in zip(keys, keys[1:])]
        assert order.common_prefixes(real).tolist() == common


@pytest.mark.parametrize("source", ["messy", "table"])
def test_near_duplicates_equal_brute_force(spark, messy, sf_dir, source):
    docs = messy if source == "messy" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, rows = _distinct(docs)
    expected = brute.near(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == expected


def test_near_links_that_a_star_misses(spark):
    """Two close documents whose bucket's hub is close to neither: the exact join of what is left finds them."""
    base = [f"w{k}" for k in range(400)]
    hub = base[:230] + [f"h{k}" for k in range(170)]
    a = base[:330] + [f"a{k}" for k in range(70)]
    b = base[:330] + [f"a{k}" for k in range(35)] + [f"b{k}" for k in range(35)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate([hub, a, b])], "doc_id long, text string")
    multi = spark.createDataFrame([(7, 0, 0), (7, 1, 0), (7, 2, 0)], "key long, node long, hub long")
    sets = docs.withColumnRenamed("doc_id", "node").mapInArrow(minhash._set_rows, "node long, codes binary")
    none = spark.createDataFrame([], "node long, label long")
    pairs = minhash.rest_pairs(multi, none, sets)
    assert {(r.a, r.b) for r in minhash.confirm(pairs, sets).collect()} == {(2, 1)}


def test_a_family_of_letters_pairs_only_what_is_close(spark):
    """Letters with four fifths of their text in common share buckets but no link; a few are close in pairs."""
    common = [f"c{k}" for k in range(160)]
    letter = lambda k: common + [f"u{k}_{i}" for i in range(40)]
    rows = [(k, " ".join(letter(k))) for k in range(300)]
    rows += [(1000 + k, " ".join(letter(k)[:-2] + ["other", "end"])) for k in range(0, 300, 50)]
    rows += [(2000 + n, " ".join(letter(7)[: 200 - n])) for n in (10, 30, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()} == brute.near(rows)
    multi = docs.select(F.lit(7).cast("long").alias("key"), F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("hub"))
    sets = docs.withColumnRenamed("doc_id", "node").mapInArrow(minhash._set_rows, "node long, codes binary")
    none = spark.createDataFrame([], "node long, label long")
    pairs = {(r.hub, r.node) for r in minhash.rest_pairs(multi, none, sets).collect()}
    linked = {(r.a, r.b) for r in minhash.confirm(minhash.rest_pairs(multi, none, sets), sets).collect()}
    sets = {k: brute.shingles(t) for k, t in rows}
    close = {(b, a) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked == close and len(pairs) < 20 * len(close)


def test_near_null_ids_empty_and_columns(messy, empty):
    rows = minhash.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    assert all(r.kept for r in rows if r.doc_id is None)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_representatives(messy)
    assert kept.columns == messy.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in rows if r.kept}


def test_exact_dedup_equals_plain_grouping(messy, empty):
    groups = {}
    for r in messy.select("doc_id", "text").collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((r.doc_id, len(r.text or "")))
    expected = []
    for text, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        expected += [(d, keep, len(members), d == keep, hashlib.sha256(text.encode()).hexdigest()) for d, _ in members]
    got = [tuple(r) for r in exact_dedup.exact_dedup(messy).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_first(messy).columns == messy.columns


def test_documents_under_one_id_or_none_are_not_lost(spark):
    rows = [(1, "alpha beta"), (None, "alpha beta"), (None, "a unique text of its own"), (7, "alpha beta gamma"), (7, "second text under id seven"), (5, "alpha beta gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expected = [(1, "alpha beta"), (5, "alpha beta gamma"), (7, "second text under id seven"), (None, "a unique text of its own")]
    assert sorted((tuple(r) for r in exact_dedup.keep_first(docs).collect()), key=key) == expected
    expected = sorted([*expected, (None, "alpha beta")], key=key)
    assert sorted((tuple(r) for r in minhash.keep_representatives(docs).collect()), key=key) == expected


def _digests(values):
    return np.sort(np.frombuffer(b"".join(hashlib.sha256(str(v).encode()).digest() for v in values), dtype="S32"))


def test_cuckoo_index_inserts_deletes_and_grows():
    index, keys = exact_dedup.DigestIndex(buckets=2), _digests(range(3000))
    zero = np.zeros(1000, dtype=np.int64)
    for k in range(3):
        part = np.sort(keys[k::3])
        assert (index.find(part) == -1).all()
        index.add(part, zero, zero, zero == 0, zero + k + 1)
    assert index.rebuilt > 0 and len(index) == 3000
    at = index.find(keys)
    assert (at == np.arange(3000)).all() and index.filter.contains(keys).all() and (index.count == np.arange(3000) % 3 + 1).all()
    assert (index.find(_digests(range(5000, 9000))) == -1).all()
    index.delete(np.arange(0, 3000, 2))
    assert [x == -1 for x in index.find(keys)] == [k % 2 == 0 for k in range(3000)]
    assert len(index) == 1500 and (index.filter.table > 0).sum() == 1500


def test_a_full_filter_says_so_and_kicks_keep_all_marks():
    keys = _digests(range(40))
    small = exact_dedup.CuckooFilter(4)
    assert not small.insert(keys)
    fits = exact_dedup.CuckooFilter(8)
    assert fits.insert(keys[:24]) and fits.contains(keys[:24]).all() and (fits.table > 0).sum() == 24


def test_buckets_catch_close_sets_of_all_sizes():
    """Share of pairs of similarity 0.75 and more that meet in a bucket, nested and edited, down to sets of five."""
    draw, met, tried = np.random.default_rng(6), 0, 0
    for _ in range(3000):
        n = int(draw.integers(5, 160))
        a = draw.integers(0, 2**63, size=n, dtype=np.int64).astype(np.uint64)
        cut = int(draw.integers(0, n // 4 + 1))
        b = a[cut:] if draw.random() < 0.5 else np.concatenate((a[: n - cut // 2], draw.integers(0, 2**63, size=cut // 2, dtype=np.int64).astype(np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        tried += 1
        keys = [minhash.band_keys(minhash.signatures(np.sort(s), np.array([0, len(s)])))[0] for s in (a, b)]
        met += bool((keys[0] == keys[1]).any())
    assert tried > 1500 and met / tried > 0.9999


def test_index_updates_keep_counts(spark):
    of = lambda rows: spark.createDataFrame(rows, "text_sha256 string")
    sha = [hashlib.sha256(x).hexdigest() for x in (b"a", b"b", b"c")]
    index = spark.createDataFrame([(sha[0], 2), (sha[1], 1)], "text_sha256 string, group_size long")
    after = exact_dedup.update_index(index, of([(sha[2],), (sha[2],), (sha[0],)]), of([(sha[1],), (sha[0],)]))
    assert {r.text_sha256: r.live for r in after.collect()} == {sha[0]: 2, sha[2]: 2}
    none = of([(None,), (None,)])
    assert {r.text_sha256: r.live for r in exact_dedup.update_index(index, none, none).collect()} == {sha[0]: 2, sha[1]: 1}
    fresh = exact_dedup.update_index(index.where("group_size > 9"), of([(sha[2],), (sha[2],), (None,)]), of([(sha[1],)]))
    assert {r.text_sha256: r.live for r in fresh.collect()} == {sha[2]: 2}
    assert exact_dedup.update_index(index.where("group_size > 9"), none, none).count() == 0
