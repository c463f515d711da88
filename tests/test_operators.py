"""Small hand-made cases of the operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import identifiers, text as T, vectors as V
from lodestone.operators import dedup, islands, measures, mutations, retrieval, sampling, tagging, temporal

D = dt.date


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def rates(spark):
    rows = [("a", 1.0, D(2017, 7, 1), D(2018, 1, 1)), ("a", 2.0, D(2018, 1, 1), None)]
    return spark.createDataFrame(rows, "code string, rate double, valid_from date, valid_to date")


@pytest.mark.parametrize(("day", "half_open", "closed"), [(D(2017, 6, 30), [], []), (D(2017, 7, 1), [1.0], [1.0]), (D(2017, 12, 31), [1.0], [1.0]), (D(2018, 1, 1), [2.0], [1.0, 2.0])])
def test_intervals_half_open_and_closed(spark, day, half_open, closed):
    probe = spark.createDataFrame([("a", day)], "code string, day date")
    for flag, expected in ((False, half_open), (True, closed)):
        got = temporal.version_join(probe, rates(spark), ["code"], "day", flag)
        assert sorted(r.rate for r in got.collect()) == expected


def test_inclusive_ends_become_half_open(spark):
    rows = spark.createDataFrame([("x", D(2017, 7, 1), D(2022, 9, 30)), ("x", D(2022, 10, 1), None)], "code string, valid_from date, valid_to date")
    last_day = F.lit(D(2022, 9, 30))
    assert rows.where(temporal.valid_at(last_day)).count() == 0
    assert temporal.inclusive_to_half_open(rows, "valid_to").where(temporal.valid_at(last_day)).count() == 1


def test_as_of_takes_the_last_row_at_or_before(spark):
    history = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 3, "z")], "k string, since int, v string")
    probes = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 4, 3), ("a", 9, 4), ("b", 2, 5), ("c", 7, 6)], "k string, at int, id int")
    got = {r.id: r.v for r in temporal.as_of(probes, history, ["k"], "at", "since", ["v"]).collect()}
    assert got == {1: None, 2: "x", 3: "x", 4: "y", 5: None, 6: None}


def test_dedup_of_canonical_texts(spark):
    rows = [(1, "This is a legal provision."), (2, "This  is a\tlegal provision. "), (3, "DIFFERENT."), (4, "different."), (5, "a b"), (6, "A B")]
    got = {r.doc_id: (r.canonical_id, r.group_size) for r in dedup.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2), 5: (5, 2), 6: (5, 2)}


def test_compatibility_form(spark):
    rows = spark.createDataFrame([("ＡＢＣ ﬁ",), (None,)], "t string").select(T.canonical(F.col("t"), compatibility=True).alias("c"))
    assert [r.c for r in rows.collect()] == ["abc fi", None]


@pytest.mark.parametrize(("a", "b", "value"), [("abcd", "abcd", 0.0), ("abcd", "efgh", 1.0), ("abcd", "abef", 0.5), ("", "", 0.0)])
def test_divergence(spark, a, b, value):
    array = lambda s: F.array(*map(F.lit, s)).cast("array<string>")
    assert one(spark, T.overlap_divergence(array(a), array(b)).alias("d")).d == value


@pytest.mark.parametrize(("values", "tripped"), [([0.5] * 200, True), ([0.01] * 200, False), ([0.5] * 199, False), ([0.5] * 200 + [0.0] * 300, True)])
def test_latch(spark, values, tripped):
    rows = spark.createDataFrame([("q", k, v) for k, v in enumerate(values)], "k string, n int, v double")
    last = islands.rolling_latch(rows, ["k"], ["n"], "v", 200, 0.02).orderBy(F.desc("n")).first()
    assert last.tripped is tripped


def test_islands_and_streaks(spark):
    rows = spark.createDataFrame([("g", k, s) for k, s in enumerate("aabbba")], "k string, n int, s string")
    got = [r.island for r in islands.islands(rows, ["k"], ["n"], F.col("s")).orderBy("n").collect()]
    assert got == [1, 1, 2, 2, 2, 3]
    got = [r.streak for r in islands.streak(rows, ["k"], ["n"], F.col("s") == "b").orderBy("n").collect()]
    assert got == [0, 0, 1, 2, 3, 0]


def test_threshold_sweep_separable_and_not(spark):
    rows = lambda good, bad: spark.createDataFrame([(s, True) for s in good] + [(s, False) for s in bad], "s double, p boolean")
    fit = lambda df: df.where("kept_rate >= 0.95 and refused_rate >= 0.9").agg(F.min("theta")).first()[0]
    assert fit(measures.threshold_sweep(rows([0.7, 0.8], [0.1, 0.4]), "s", "p")) == pytest.approx(0.405)
    assert fit(measures.threshold_sweep(rows([0.2, 0.4], [0.3, 0.9]), "s", "p")) is None
    assert fit(measures.threshold_sweep(rows([], []), "s", "p")) is None


@pytest.mark.parametrize("n", [5, 19, 20, 99, 100])
def test_quantile_fallbacks(spark, n):
    import statistics

    values = [float(v) for v in range(n)]
    rows = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    got = measures.group_quantiles(rows, "g", "v", [95, 99]).first()
    exact = statistics.quantiles(values, n=100)
    assert got.median == sorted(values)[n // 2]
    assert got.p95 == pytest.approx(exact[94] if n >= 20 else n - 1)
    assert got.p99 == pytest.approx(exact[98] if n >= 100 else n - 1)


@pytest.mark.parametrize("sizes, thin, severity", [([10, 10, 10, 4, 3], 2, "P0"), ([2, 2, 2, 1], 0, "P2"), ([1, 1, 6, 6], 2, "P0")])
def test_lint_uses_the_median(spark, tmp_path, sizes, thin, severity):
    from lodestone.plans import registry

    rows = [(k, 0.0 if i == 0 else 0.1) for k, n in enumerate(sizes) for i in range(n)]
    spark.createDataFrame(rows, "l_orderkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["batch_lint"](spark, str(tmp_path)).first()
    assert (got.docs, got.thin, got.severity) == (len(sizes), thin, severity)
    assert got.empty_rate == pytest.approx(len(sizes) / sum(sizes))


@pytest.mark.parametrize("stretch", [16, 4096])
def test_group_quantiles_of_a_hot_group(spark, monkeypatch, stretch):
    monkeypatch.setattr(measures, "STRETCH", stretch)
    rows = [(1, (k * 7919 % 3001) / 4) for k in range(3001)] + [(2, 5.0)] * 30 + [(3, v) for v in (1.0, None, 2.0)] + [(None, 7.0), (4, None)]
    rows += [(5, float(k)) for k in range(19)] + [(6, float(k)) for k in range(20)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    ordered = {}
    for g, v in rows:
        ordered.setdefault(g, []).extend([] if v is None else [v])
    expected = []
    for g, values in ordered.items():
        values.sort()
        n, place = len(values), (len(values) + 1) * 95 / 100
        low = max(1, int(place))
        p = None if not n else values[-1] if n * 5 < 100 else values[low - 1] + (values[min(low, n - 1)] - values[low - 1]) * (place - low)
        expected.append((g, values[n // 2] if n else None, p, values[0] if n else None, values[-1] if n else None))
    got = measures.group_quantiles(df, "g", "v", [95])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_latency_percentiles_gather_no_group(spark, sf_dir):
    from lodestone.plans import registry

    plan = registry.QUERIES["latency_percentiles"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_short_size_bands_are_filled(spark, tmp_path):
    from lodestone.plans import registry

    spark.createDataFrame([(k, 100 if k < 60 else 900 if k < 190 else 5000) for k in range(193)], "doc_id long, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bands = lambda name: [r.size_band for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    got = bands("size_band_filled")
    assert len(got) == 100 and got.count("l") == 3 and got.count("s") >= 50 and got.count("m") >= 35
    assert len(bands("size_band_sample")) == 88


@pytest.mark.parametrize("good, bad", [([3.0, 5.5, 7.25], [-4.0, 0.5, 2.0]), ([12.0], [11.0, 11.5]), ([1.0, 2.0], [3.0, 4.0]), ([2.0], [2.0])])
def test_lowest_threshold_on_scores_outside_0_to_1(spark, good, bad):
    grid = [min(good + bad) + (max(good + bad) - min(good + bad)) * i / 200 for i in range(201)]
    rates = [(x, sum(s >= x for s in good) / len(good), sum(s < x for s in bad) / len(bad)) for x in grid]
    exact = [tuple(round(v, 4) for v in r) for r in rates if r[1] >= 0.95 and r[2] >= 0.9][:1]
    rows = spark.createDataFrame([(s, True) for s in good] + [(s, False) for s in bad], "s double, p boolean")
    assert [tuple(r) for r in measures.lowest_threshold(rows, "s", "p", 0.95, 0.9).collect()] == [pytest.approx(e, abs=1.1e-4) for e in exact]  # Spark rounds halves up


def test_text_source_bands(spark):
    got = one(spark, tagging.text_source(F.lit(50), F.lit(10)).alias("a"), tagging.text_source(F.lit(90_000), F.lit(10)).alias("b"), tagging.text_source(F.lit(600), F.lit(10)).alias("c"))
    assert tuple(got) == ("ocr", "born", "low_density")


def test_twins(spark):
    rows = spark.createDataFrame([(1, "Title A", True), (2, " title a", False), (3, "Title A", True), (4, "other", True)], "id int, title string, en boolean")
    got = {r.id: r.twin_id for r in dedup.twins(rows, [F.lower(F.trim("title"))], "id", "en").collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: None}


def test_upsert_keeps_unlisted_columns(spark):
    old = spark.createDataFrame([("a", "first", 1), ("b", "second", 2)], "k string, seen string, v int")
    new = spark.createDataFrame([("a", 9), ("c", 3), ("b", None)], "k string, v int")
    got = sorted(tuple(r) for r in mutations.upsert(old, new, ["k"], ["v"]).collect())
    assert got == [("a", "first", 9), ("b", "second", 2), ("c", None, 3)]


def test_upsert_of_repeated_and_null_keys(spark):
    old = spark.createDataFrame([(None, "n", 1), ("a", "x", 1)], "k string, seen string, v int")
    new = spark.createDataFrame([("a", 5, 2), ("a", None, 3), ("a", 4, 1), (None, 7, 1)], "k string, v int, at int")
    got = sorted((tuple(r) for r in mutations.upsert(old, new, ["k"], ["v"], ["at"]).collect()), key=repr)
    assert got == sorted([("a", "x", 5), (None, "n", 7)], key=repr)
    replaced = mutations.replace_by_key(old.select("k", "v"), new, ["k"], ["at"])
    assert sorted((tuple(r) for r in replaced.collect()), key=repr) == sorted([("a", None), (None, 7)], key=repr)
    first = mutations.insert_ignore(old.select("k", "v"), spark.createDataFrame([("b", 9, 2), ("b", 10, 1), ("a", 3, 0)], "k string, v int, at int").select("k", "v"), ["k"], ["v"])
    assert sorted((tuple(r) for r in first.collect()), key=repr) == sorted([("a", 1), ("b", 9), (None, 1)], key=repr)


def test_enrichment_happens_once(spark):
    rows = spark.createDataFrame([(1, "x" * 120, "H", None, 1), (2, "short", "H", None, 1), (3, "y" * 120, None, "has [ENRICHED] text", 1), (4, "z" * 120, None, None, 1)], "id int, text string, parent string, embed_text string, upserted int")
    asked = spark.createDataFrame([(1, ["a?", "b?"]), (2, ["c?"]), (3, ["d?"])], "id int, questions array<string>")
    once = mutations.enrich_once(rows, asked, "id")
    got = {r.id: (r.upserted, r.embed_text) for r in once.collect()}
    assert got[1] == (0, "H\n\n" + "x" * 120 + "\n\n[ENRICHED] User questions answered by this passage:\n- a?\n- b?")
    assert got[2] == (1, None) and got[3] == (1, "has [ENRICHED] text") and got[4] == (1, None)
    again = mutations.enrich_once(once.select(*rows.columns).withColumn("upserted", F.lit(1)), asked, "id")
    assert {r.id: r.upserted for r in again.collect()} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_fusion_breaks_ties_by_id(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "q int, d int, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2), (1, 10, 2)], "q int, d int, rank int")
    got = [r.d for r in retrieval.fuse(a, b, query_id="q", item_id="d").orderBy("rank").collect()]
    assert got == [10, 20, 30]


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(float("nan")), F.lit(float("inf")), F.lit(4.0))
    got = one(spark, V.norm(V.finite(v)).alias("n"), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"))
    assert got.n == 5.0 and got.z is None
    q, d = [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [0.5, 0.5]]
    rows = spark.createDataFrame([(q, d)], "q array<array<double>>, d array<array<double>>")
    assert retrieval.late_interaction(rows, "q", "d").first().max_sim == 1.5


def test_quotas_are_clamped(spark):
    rows = spark.createDataFrame([("big",)] * 70 + [("mid",)] * 29 + [("tiny",)], "c string")
    got = {r.c: r.quota for r in sampling.clamped_quotas(rows, "c", 100).collect()}
    assert got == {"big": 54, "mid": 39, "tiny": 7}
    picked = sampling.proportional_quotas(rows, "c", 10).collect()
    assert sum(r.quota for r in picked) == 10 and {r.c: r.quota for r in picked}["big"] == 7


def test_kth_smallest_and_positions(spark):
    from lodestone.operators import ordering

    values = sorted(f"{k * 2654435761 % 2**32:08x}" for k in range(500))
    rows = spark.createDataFrame([(v,) for v in values], "h string").repartition(4)
    assert [ordering.kth_smallest(rows, "h", k, 1) for k in (1, 250, 500, 501)] == [values[0], values[249], values[499], None]
    table = spark.createDataFrame([(k % 3 or None, -k, k) for k in range(60)], "g int, o int, id int").repartition(5)
    got = {r.id: r.n for r in ordering.positions(table, "g", ["o"], "n").collect()}
    for g in (None, 1, 2):
        ids = sorted((k for k in range(60) if (k % 3 or None) == g), reverse=True)
        assert [got[k] for k in ids] == list(range(1, 21))


def test_trailing_stats_equal_a_plain_window(spark):
    import random

    draw = random.Random(2)
    rows = [(draw.choice("ab"), draw.randrange(5000), float(k)) for k in range(400)]
    got = islands.trailing_stats(spark.createDataFrame(rows, "k string, at int, v double"), ["k"], F.col("at"), 60, F.col("v")).collect()
    assert len(got) == 400
    for r in got:
        near = [v for k, at, v in rows if k == r.k and r.at - 60 < at <= r.at]
        assert r.recent == len(near) and r.recent_mean == pytest.approx(sum(near) / len(near))


def test_split_keeps_keys_whole(spark):
    rows = spark.createDataFrame([(k % 40, k) for k in range(200)], "chunk int, n int")
    got = sampling.split_by_key(rows, "chunk", 0.05, 3).groupBy("chunk").agg(F.countDistinct("split").alias("s"), F.first("split").alias("x")).collect()
    assert all(r.s == 1 for r in got) and sum(r.x == "val" for r in got) == 2


def test_gaps_and_merges(spark):
    rows = spark.createDataFrame([("d", 0, 10), ("d", 10, 20), ("d", 15, 18), ("d", 30, 40)], "k string, a int, b int")
    assert sorted((r.merged_start, r.merged_end) for r in temporal.merged(rows, ["k"], "a", "b").collect()) == [(0, 20), (30, 40)]


@pytest.mark.parametrize(
    ("spans", "left"),
    [([(5, 9)], [(0, 5), (9, 50)]), ([], [(0, 50)]), ([(0, 50)], []), ([(0, 10), (10, 20), (15, 18), (30, 40)], [(20, 30), (40, 50)]), ([(-5, 60)], []), ([(-5, 3), (48, 99)], [(3, 48)]), ([(0, 0), (50, 50)], [(0, 50)]), ([(60, 70)], [(0, 50)]), ([(-9, -5), (7, 7)], [(0, 7), (7, 50)])],
)
def test_gaps_within_bounds(spark, spans, left):
    rows = spark.createDataFrame([("d", *s) for s in [*spans, *spans[:1]]], "k string, a int, b int")
    bounds = spark.createDataFrame([("d", 0, 50), ("e", 3, 3)], "k string, low int, high int")
    got = sorted((r.gap_start, r.gap_end) for r in temporal.gaps(rows, bounds, ["k"], "a", "b", "low", "high").collect())
    assert got == left


def test_routing_ties_give_null(spark):
    rules = {"x": ["apple", "pear"], "y": ["plum"]}
    got = one(spark, *[tagging.route(F.lit(t), rules).alias(f"c{k}") for k, t in enumerate(("an Apple and a pear", "apple plum", "nothing"))])
    assert tuple(got) == ("x", None, None)


def test_tagging_counts_distinct_phrases(spark):
    rows = spark.createDataFrame([(1, "tax invoice TAX INVOICE credit note"), (2, "appeal")], "id int, t string")
    got = {r.id: (r.primary_topic, {x.topic: x.score for x in r.topics}) for r in tagging.tag(rows, "t", {"g:inv": ["tax invoice", "credit note"], "g:tax": ["tax"]}).collect()}
    assert got[1] == ("g:inv", {"g:inv": 2, "g:tax": 1}) and got[2] == (None, {})


def test_span_ladder(spark):
    chunk = "The supplier shall issue a tax invoice showing the description, quantity and value of goods, the tax charged thereon and such other particulars. It applies to all."
    span = chunk[:120].upper() + "."
    checks = [tagging.span_check(F.lit(s), F.lit(chunk), F.lit(t)) for s, t in ((chunk[:150], False), ("short", False), (chunk[:100].replace(".", ","), False), (span + " 9", True))]
    assert tuple(one(spark, *[c.alias(f"c{k}") for k, c in enumerate(checks)])) == ("exact", "length", "no_terminator", "table_exact_miss")


def test_ids(spark):
    import hashlib

    got = one(spark, identifiers.term_id(F.lit("tax")).alias("t"), identifiers.point_id(F.lit("d"), F.lit(1)).alias("p"), identifiers.uuid_of(F.lit("x")).alias("u"))
    assert got.t == int.from_bytes(hashlib.md5(b"tax").digest()[:4], "little") & 0x7FFFFFFF
    assert got.p == int(hashlib.sha256(b"d|1").hexdigest()[:15], 16) % 10**15
    assert [len(x) for x in got.u.split("-")] == [8, 4, 4, 4, 12]


def test_dates_and_loops(spark):
    texts = ["rate on 2024-3-5", "on 5/3/2024", "as of 2023", "none"]
    got = one(spark, *[T.query_date(F.lit(t)).alias(f"c{k}") for k, t in enumerate(texts)])
    assert tuple(got) == ("2024-03-05", "2024-03-05", "2023-12-31", None)
    rows = spark.createDataFrame([("abcde" * 40,), ("".join(chr(97 + (k * k + k // 7) % 26) for k in range(300)),), ("",)], "t string")
    assert [r.x for r in rows.select(T.repeats_itself(F.col("t")).alias("x")).collect()] == [True, False, False]


def test_repeated_windows_are_those_of_a_plain_count(spark):
    """No array of windows is made and sorted in the plan; characters of any width count as one."""
    draw = random.Random(4)
    unit = "".join(draw.choice("aé😀 \n") for _ in range(30))
    noise = lambda n: "".join(draw.choice("abcdé😀 ") for _ in range(n))
    texts = [None, "", "x" * 119, "x" * 120, unit * 3 + noise(40), unit * 4, unit * 4 + noise(30), noise(5000), noise(3000) + unit * 40 + noise(3000), unit * 40 + noise(8000), unit + noise(5) + unit + noise(35) + unit + noise(10) + unit + noise(50)]

    def plain(text):
        if text is None or len(text) < 120:
            return False
        body = text if len(text) <= 4000 else text[len(text) // 2 - 2000 :][:4000]
        pieces = [body[i : i + 30] for i in range(0, max(len(body) - 30, 1), 5)]
        return any(pieces.count(p) >= 4 for p in pieces)

    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.repeats_itself(F.col("t")).alias("x"))
    wanted = [plain(t) for t in texts]
    assert [r.x for r in sorted(rows.collect())] == wanted and sum(wanted) == 4
    assert "array_sort" not in rows._jdf.queryExecution().executedPlan().toString().lower()


def test_instruction_unwrapping(spark):
    texts = ["<s>[INST] <<SYS>>be kind<</SYS>> What? [/INST] That. </s>", "plain </s>"]
    assert tuple(one(spark, *[T.unwrap_instruction(F.lit(t)).alias(f"c{k}") for k, t in enumerate(texts)])) == ("Q: What?\nA: That.", "plain")
