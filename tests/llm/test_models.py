"""Neighbours, quality, languages: recall and held-out accuracy; sharding and mixing: plain versions; pieces: parity."""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import langid, mih, mixing, pieces, quality, sharding
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_neighbours_reach_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = mih.nearest(rows).collect()
    table = rows.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in table], dtype=float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(table), 50):
        score = unit @ unit[q]
        score[q] = -2
        best = np.lexsort((np.arange(len(x)), -score))[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == table[q].vec_id)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in own)
        hits += len({table[b].vec_id for b in best} & {r[1] for r in own})
    assert hits / (len(got)) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [1.0]), (100, [float("inf"), 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", mih.F.lit(1))
    got = sorted(tuple(r) for r in mih.nearest(vectors).collect())
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 5), (0, 2, 6), (0, 3, 50), (50, 1, 0), (50, 2, 5), (50, 3, 6)]
    assert mih.nearest(vectors.where("1 = 0")).count() == 0


def _coded(spark, x, codes):
    rows = [(k, v.tolist(), *c) for k, (v, c) in enumerate(zip(x, codes.view(np.int64).tolist(), strict=True))]
    return spark.createDataFrame(rows, mih._INDEX).repartition(3).checkpoint()


@pytest.mark.parametrize("radius", [7, 20, 40])
def test_pigeonhole_finds_every_code_within_the_radius(spark, radius):
    """Both ways of probing give all codes within the radius, once each, and no other."""
    draw = np.random.default_rng(2)
    codes = draw.integers(0, 2**63, size=(300, 4), dtype=np.int64).astype(np.uint64)
    near = codes[:40].copy()
    for row in near:
        for b in draw.choice(256, size=int(draw.integers(1, 2 * radius)), replace=False):
            row[b // 64] ^= np.uint64(1 << int(b % 64))
    codes = np.concatenate((codes, near))
    table = _coded(spark, draw.normal(size=(len(codes), 4)), codes)
    apart = np.bitwise_count(codes[:40, None] ^ codes[None]).sum(2, dtype=int)
    expected = sorted((q, int(v)) for q in range(40) for v in np.flatnonzero(apart[q] <= radius) if v != q)
    for found in (mih.by_keys(table, table.where("vec_id < 40"), radius, 1000), mih.by_parts(table, table.where("vec_id < 40"), radius, 1000, 340)):
        assert sorted((r.query_id, r.vec_id) for r in found.collect()) == expected and expected


def test_clustered_vectors_are_found_by_listed_keys(spark, monkeypatch):
    """On clustered vectors the index is probed by keys; under a quarter of the pairs is ranked, and recall holds."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(60, 32))
    x = centres[draw.integers(0, 60, size=6000)] + 0.15 * draw.normal(size=(6000, 32))
    coder = mih.learn(x)
    codes = coder.codes(x)
    apart = np.concatenate([np.bitwise_count(codes[q, None] ^ codes[None]).sum(2, dtype=int) for q in np.array_split(np.arange(0, 6000, 50), 8)])
    assert (apart <= coder.radius).mean() < 0.25 and coder.reached <= mih.LISTED_SHARE
    used = []
    listed = mih.by_keys
    monkeypatch.setattr(mih, "by_keys", lambda *a: used.append(1) or listed(*a))
    monkeypatch.setattr(mih, "LISTED_LESS", 1 / 8)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = mih.nearest(vectors).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        score = unit @ unit[q]
        score[q] = -2
        hits += len(set(np.argsort(-score)[:5]) & {r.vec_id for r in got if r.query_id == q})
    assert used and hits / len(got) >= 0.9 and len(got) == 600


def test_equal_vectors_and_repeated_ids(spark):
    """Ties at the last rank go to the smallest ids, however many rows have one vector; rows of one vec_id are one."""
    draw = np.random.default_rng(3)
    other = draw.normal(size=(300, 8))
    rows = [(k, [1.0] * 8) for k in range(400)] + [(1000 + k, v.tolist()) for k, v in enumerate(other)]
    rows += [(0, [1.0] * 8)] * 4 + [(50, [2.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in mih.nearest(vectors).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert got[0] == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5} and got[100] == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4} and got[50] == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    index = mih.encode(mih.usable(vectors), mih.learn(other))
    assert mih.entries_of(index, 5).where("vec_id < 1000").count() == 6
    assert mih.search(index.where("1 = 0"), index, 30).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert np.mean([a == b for a, b in held]) >= 0.95
    assert np.mean([a for a, b in held if b == 1]) >= 0.98


def test_quality_messy_and_without_labels(spark, messy, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(messy, none).where("score = 1.0 and predicted = 1").count() == messy.count()
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(messy, labels).collect()
    assert len(rows) >= messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(empty, labels).count() == 0
    assert quality.keep_good(messy, none).count() == messy.count()
    assert quality.keep_good(messy, labels).columns == messy.columns


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    held = [d for d in truth if got[d].held_out]
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) >= 0.97


def test_languages_messy(spark, messy, empty):
    rows = langid.identify(messy).collect()
    assert len(rows) == messy.count()
    texts = {r.doc_id: r.text for r in messy.select("doc_id", "text").collect()}
    for r in rows:
        if r.doc_id is not None and not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1
    assert langid.identify(empty).count() == 0
    unlabelled = messy.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


@pytest.mark.parametrize("classes", [2, 3, 5, 7, 12])
def test_codewords_differ(classes):
    code = langid.codewords(classes)
    apart = [(code[a] != code[b]).sum() for a in range(classes) for b in range(a)]
    assert len(code) == classes and min(apart) >= 1
    assert min(apart) >= (code.shape[1] // 4 if classes > 2 else 1)


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_shards_are_minimax(messy, shards):
    docs = messy.select("doc_id", "text").collect()
    sizes = {}
    for r in docs:
        key = hashlib.sha256((r.text or "").encode()).hexdigest()
        sizes[key] = sizes.get(key, 0) + len((r.text or "").encode()) + 1
    got = sharding.shard(messy, shards).collect()
    assert len(got) == len(docs)
    total = {}
    for r in got:
        total[r.shard] = total.get(r.shard, 0) + r.size
    assert max(total.values()) == brute.smallest_capacity([sizes[k] for k in sorted(sizes)], shards)
    for k in total:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    crc = {r.doc_id: zlib.crc32((r.text or "").encode()) for r in docs if r.doc_id is not None}
    assert all(r.text_crc32 == crc[r.doc_id] for r in got if r.doc_id is not None)
    by_text = {}
    for r in got:
        by_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_shards_of_nothing(empty):
    assert sharding.shard(empty).count() == 0


def _targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        capped = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not capped:
            return target | {s: level * weight[s] for s in free}
        for s in capped:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= capped
    return target


def test_mix_meets_targets(spark, messy, empty):
    for docs in (messy, spark.read.parquet(f"{SF}/documents.parquet")):
        source = {r.doc_id: (r.source, len(brute.WORD.findall(r.text or ""))) for r in docs.select("doc_id", "text", "source").collect() if r.doc_id is not None}
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count()
        sizes, taken, largest = {}, {}, {}
        for s, n in ((r.source, len(brute.WORD.findall(r.text or ""))) for r in docs.select("text", "source").collect()):
            sizes[s] = sizes.get(s, 0) + n
            largest[s] = max(largest.get(s, 0), n)
        expected = _targets(sizes)
        for r in rows:
            assert r.taken <= 3 * r.size
            if r.doc_id is not None:
                s, n = source[r.doc_id]
                assert r.size == n and abs(r.target - expected[s]) < 1e-6 * max(1, expected[s]) and r.source_size == sizes[s]
                taken[s] = taken.get(s, 0) + r.taken
        for s, n in taken.items():
            if s != "src2":
                assert abs(n - expected[s]) <= 3 * largest[s]
        again = {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
        assert again == {(r.doc_id, r.taken) for r in rows}
    assert mixing.mix(empty).count() == 0
    mixed = mixing.take(messy)
    assert mixed.columns == messy.columns
    assert mixed.count() == sum(r.copies for r in mixing.mix(messy).collect())


@pytest.mark.parametrize(("repeated", "equal"), [(400, False), (990, True)])
def test_mix_meets_targets_under_a_repeated_id(spark, repeated, equal):
    """A source in which one id names many rows: different texts, or wholly equal rows."""
    one = lambda k: "ten words " + " ".join(f"w{0 if equal else k}" for _ in range(8))
    rows = [(7 if k < repeated else 1000 + k, one(k), "a") for k in range(1000)] + [(k, "one two three " * 3, "b") for k in range(2000, 3200)] + [(None, one(1), "a")] * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix(docs).collect()
    for source, (target, size, largest) in brute.mix_targets(rows).items():
        name = {"a": 10, "b": 9}[source]
        own = [r for r in got if r.size == name]
        assert sum(r.taken for r in own) == pytest.approx(target, abs=largest / 2 + 1e-6)
        assert {r.source_size for r in own} == {size} and all(r.taken in (r.size * int(target // size), r.size * (int(target // size) + 1)) for r in own)
    key = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.taken) for r in rows)
    assert key(got) == key(mixing.mix(docs.repartition(3)).collect())
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got)


def test_larger_budgets_take_more(spark):
    rows = [("0s", 7 if k < 60 else k, k % 5, 3) for k in range(100)]
    sized = spark.createDataFrame(rows, "source_key string, hash long, mark long, size long")
    reached = []
    for budget in (0, 50, 120, 170, 290):
        targets = spark.createDataFrame([("0s", 100_000, float(budget))], "source_key string, source_size long, target double")
        limit = mixing.thresholds(sized, targets, 1).first()
        reached.append((limit.threshold, limit.mark_threshold, limit.number))
        taken = sum(h < limit.threshold or (h == limit.threshold and m < limit.mark_threshold) for _, h, m, _ in rows) + limit.number
        assert abs(3 * taken - budget) <= 1.5
    assert reached == sorted(reached)


def test_pieces_keep_parity(spark, messy, empty):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    extra = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(["a  b", "  x   y  ", "trail ", "日本語 テスト", "😀 a", "<s> </s> <0x0A>", "tab\tnew\n"])], "doc_id long, text string")
    docs = messy.select("doc_id", "text").where("doc_id is not null").distinct().unionByName(extra)
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = pieces.encode(docs)
    for r in rows.collect():
        assert list(r.token_ids) == library.encode(text[r.doc_id] or "") and r.n_tokens == len(r.token_ids) and r.parity
    assert {r.doc_id: r.text for r in pieces.decode(rows).collect()} == {d: t or "" for d, t in text.items()}
    assert pieces.encode(empty).count() == 0
    assert pieces.encode(messy).count() == messy.count()


def test_unigram_models_with_byte_fallback():
    from tokenizers import Tokenizer

    model = pieces.PieceModel(
        pieces=[("<unk>", 0.0, pieces.UNKNOWN), ("<0x41>", 0.0, pieces.BYTE), ("▁ab", -1.0, 1), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1)],
        kind=pieces.UNIGRAM, byte_fallback=True, fold_spaces=False,
    )
    tokenizer, steps = pieces.rebuild(model)
    assert isinstance(tokenizer, Tokenizer) and steps is None
    assert tokenizer.encode(" ab ba", add_special_tokens=False).ids == [2, 3, 5, 4]
    assert tokenizer.encode("A", add_special_tokens=False).ids == [1]


def test_cosines_only_of_codes_within_the_radius():
    """A far code's vector, whose product with any query is not a number, is not multiplied."""
    near = [[1.0, 0.1 * j] for j in range(5)]
    vectors = [*near, [float("inf"), float("-inf")], [1.0, 1.0]]
    n = len(vectors)
    codes = {c: pa.array([0] * 5 + [-1, 0], pa.int64()) for c in mih.CODE}
    batch = pa.RecordBatch.from_pydict({
        "part": pa.array([0] * n, pa.int32()), "role": pa.array([0] * (n - 1) + [1], pa.int32()),
        "vec_id": pa.array(range(n), pa.int64()), "vector": pa.array(vectors, pa.list_(pa.float64())), **codes,
    })
    with np.errstate(invalid="raise"):
        (out,) = mih._search_part(4, 3)(iter([batch]))
    assert out.column("vec_id").to_pylist() == [4, 3, 2]


def test_quality_scores_equal_a_plain_version(spark, messy):
    for docs, labels in ((messy, spark.createDataFrame([(d, d % 2, 0) for d in range(60)], "doc_id long, quality int, toxic int")), tuple(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        plain = brute.quality(rows, [(r.doc_id, r.quality) for r in labels.collect()])
        expected = sorted((d is None, d or 0, round(s, 7)) for (d, _), s in zip(rows, plain, strict=True))
        got = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 7)) for r in quality.classify(docs, labels).collect())
        assert len(got) == len(expected) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, expected, strict=True))


def test_languages_equal_a_plain_version(spark, messy):
    for docs in (messy.where("doc_id is not null").dropDuplicates(["doc_id"]), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        model = langid.fit(docs)
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        for r in langid.identify(docs, model).collect():
            label, score = brute.language(model, texts[r.doc_id])
            assert r.lang_pred == label and abs(r.score - score) < 1e-6


def test_rare_languages_are_learned(spark):
    """A language with one row in a thousand is in the sample, within its bound."""
    rows = [(k, f"text number {k} of many", "common") for k in range(3000)] + [(5000 + k, f"zyx wvu qpo {k}", "rare") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, rows=100)
    assert model.languages == ["common", "rare"]


def _field(number, value):
    """A field of a protobuf message: a varint, a float or bytes."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def _model_file(pieces_, kind, fallback, dummy, fold):
    """The file of a model: pieces (text, score, type), then the trainer's and the normaliser's settings."""
    own = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, t)) for p, s, t in pieces_)
    return own + _field(2, _field(3, kind) + _field(35, int(fallback))) + _field(3, _field(1, b"identity") + _field(3, int(dummy)) + _field(4, int(fold)) + _field(5, 1))


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize(("dummy", "fold"), [(True, False), (True, True), (False, False)])
def test_unigram_models_have_the_library_s_ids(spark, fallback, dummy, fold):
    """A unigram model made by rule (letters, and words by length) against the model's own library, over given and odd texts."""
    from sentencepiece import SentencePieceProcessor

    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    words = sorted({w for t in docs for w in t.split()[:40]})
    letters = sorted({c for w in words for c in w} - {"x"}) + ["\n"]
    made = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL)]
    made += [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)] if fallback else []
    made += [("▁", -2.5, 1)] + [(c, -4.0 - k / 100, 1) for k, c in enumerate(letters)] + [("▁" + w, -6.0 - len(w) / 50 - k / 10_000, 1) for k, w in enumerate(words) if 1 < len(w) < 12]
    raw = _model_file(made, pieces.UNIGRAM, fallback, dummy, fold)
    library, own = SentencePieceProcessor(model_proto=raw), pieces.Codec(raw)
    texts = [*docs, "", " ", "two  blanks", "  ends  ", "x xx 日本 y", "a\nb", "unknown x日x"]
    ids, bounds, parity = own.encode(texts)
    same = [ids[a:b].tolist() == library.encode(t) for a, b, t in zip(bounds[:-1], bounds[1:], texts, strict=True)]
    # Parity tells exactly where the ids are the library's (and spell back), and they are for all given texts without unknown letters.
    assert all(s or not p for s, p in zip(same, parity.tolist(), strict=True))
    assert np.mean(same) >= 0.95 and (not fallback or np.mean(parity) >= 0.9)
