"""Embedding near-dedup and whitening against plain versions."""

import math

import numpy as np
import pytest

from lodestone.llm import queries, rabitq, whitening

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def plain_links(rows, least=0.93):
    """(n_links, component) of each row (vec_id, vector, label) by all pairs within a label."""
    usable = [i for i, (v, x, label) in enumerate(rows) if v is not None and label is not None and x and None not in x and all(map(math.isfinite, x)) and any(x)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(usable):
        for j in usable[:k]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                a, b = a / abs(a).max(), b / abs(b).max()
                if a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least_id = {}
    for i in usable:
        least_id[root(i)] = min(rows[i][0], least_id.get(root(i), rows[i][0]))
    return [(r[0], links[i], least_id.get(root(i), r[0]) if i in usable else r[0]) for i, r in enumerate(rows)]


def as_rows(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=repr)


def chain(draw, width, steps, angle):
    """Vectors each ``angle`` from the one before: linked in a row, the ends far apart."""
    x = draw.normal(size=width)
    out = []
    for _ in range(steps):
        x = x / np.linalg.norm(x)
        side = draw.normal(size=width)
        side -= side @ x * x
        x = math.cos(angle) * x + math.sin(angle) * side / np.linalg.norm(side)
        out.append(x)
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(7)
    rows = []
    add = lambda x, label: rows.append((len(rows), [float(v) for v in x], label))
    for k in range(60):
        add(draw.normal(size=24), k % 3)
    for x in chain(draw, 24, 12, 0.36):
        add(x * draw.uniform(0.01, 100), 1)
    centre = draw.normal(size=24)
    for _ in range(150):  # a heavy group of near copies, and a ring around it that its pivot cannot settle
        add(centre + draw.normal(size=24) * 0.05 * np.linalg.norm(centre) / 5, 1)
    for w in np.linspace(0.05, 0.6, 60):
        side = draw.normal(size=24)
        add(centre / np.linalg.norm(centre) + w * side / np.linalg.norm(side), 1)
    for x in [r[1] for r in rows[:4]] * 3:
        add(x, rows[0][2])
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [1.0, None], 1), (903, [NAN] * 24, 1), (904, [INF] + [0.0] * 23, 1), (905, rows[80][1], None), (None, rows[80][1], 1), (906, [], 1)]
    rows += [(907, rows[80][1][:5], 1), (908, [2 * v for v in rows[80][1][:5]], 1), (909, [v * 1e300 for v in rows[81][1]], 1), (910, [v * 1e-300 for v in rows[81][1]], 1)]
    rows += [rows[90], rows[90], (5, rows[95][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    return df.withColumn("node", rabitq.F.lit(1)).withColumn("keys", rabitq.F.lit("x")).withColumn("cell", rabitq.F.lit(2)), rows


@pytest.mark.parametrize("heavy", [8, 10**9])
def test_links_equal_all_pairs(vectors, monkeypatch, heavy):
    monkeypatch.setattr(rabitq, "HEAVY", heavy)
    assert as_rows(rabitq.near_duplicates(vectors[0])) == sorted(plain_links(vectors[1]), key=repr)


def test_links_by_keys_and_small_blocks(vectors, monkeypatch):
    monkeypatch.setattr(rabitq, "WHOLE_LABEL", 16)
    monkeypatch.setattr(rabitq, "KEY_BUCKET", 16)
    monkeypatch.setattr(rabitq, "BLOCK", 24)
    want, got = sorted(plain_links(vectors[1]), key=repr), as_rows(rabitq.near_duplicates(vectors[0]))
    assert [r[0] for r in got] == [r[0] for r in want]
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.999 * there <= found <= there and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_no_link_is_lost_in_large_labels(vectors, monkeypatch):
    """With limits this low a plan by size would have missed most pairs near the threshold."""
    for name, value in (("WHOLE_LABEL", 4), ("KEY_BUCKET", 1), ("BLOCK", 24), ("MISSED", 0.9)):
        monkeypatch.setattr(rabitq, name, value)
    want = sorted(plain_links(vectors[1]), key=repr)
    assert as_rows(rabitq.near_duplicates(vectors[0])) == want
    assert as_rows(rabitq.near_duplicates(vectors[0], by_keys=True)) != want


def test_links_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = queries.op11_embedding_dedup(spark, SF)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert as_rows(got) == sorted(plain_links(rows), key=repr)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_links_of_nothing(vectors):
    assert rabitq.near_duplicates(vectors[0].where("1 = 0")).count() == 0
    assert as_rows(rabitq.near_duplicates(vectors[0].where("label is null"))) == [(905, 0, 905)]


@pytest.mark.parametrize("width", [1, 7, 64, 200])
def test_estimates_are_unbiased_and_bounded(width):
    draw = np.random.default_rng(width)
    x = draw.normal(size=(40, width))
    y = np.concatenate((draw.normal(size=(40, width)), x[:20] + 0.2 * draw.normal(size=(20, width)), x[:5]))
    x, y = rabitq.units(x), rabitq.units(y)
    true = x @ y.T
    errors = []
    for seed in range(30):
        turn = rabitq.rotation(width, seed)
        a, b = rabitq.Codes.of(x, turn), rabitq.Codes.of(y, turn)
        signs = np.where(x @ turn > 0, 1, -1) / math.sqrt(width)
        assert np.allclose(a.factor, (signs * (x @ turn)).sum(1))
        assert np.abs(a.products(b) - signs @ (y @ turn).T).max() <= b.slack.max() + 1e-9
        assert a.may_reach(b, 0.93)[true >= 0.93].all()
        errors.append(a.estimates(b) - true)
    if width > 7:
        assert abs(np.mean(errors)) < 0.01 and np.abs(np.mean(errors, axis=0)).max() < 0.15
        assert a.may_reach(b, 0.93)[true < 0.3].mean() < 0.2


def test_keys_find_pairs_at_the_threshold():
    draw = np.random.default_rng(3)
    bits, tables = rabitq.key_plan(4_000_000, 0.93)
    x = rabitq.units(draw.normal(size=(4000, 64)))
    side = draw.normal(size=x.shape)
    side = rabitq.units(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * side
    met = (rabitq.sign_keys(x, bits, tables) == rabitq.sign_keys(y, bits, tables)).any(1)
    assert bits == 10 and met.mean() > 0.995
    far = (rabitq.sign_keys(x, bits, tables) == rabitq.sign_keys(np.roll(x, 1, 0), bits, tables)).any(1)
    assert far.mean() < 0.1


def test_local_forests_span():
    draw = np.random.default_rng(2)
    a, b = draw.integers(0, 300, 250), draw.integers(0, 300, 250)
    x, y = rabitq.forest(a, b)
    parts = lambda pairs: {n: min(component) for component in _components(pairs) for n in component}
    assert parts(zip(x, y, strict=True)) == {n: c for n, c in parts(zip(a, b, strict=True)).items() if n in set(x) | set(y)}
    assert len(x) < len(set(a) | set(b))


def _components(pairs):
    found = []
    for a, b in pairs:
        hit = [c for c in found if a in c or b in c]
        found = [c for c in found if c not in hit] + [set().union({a, b}, *hit)]
    return found


def plain_whitening(rows, components=32):
    """vec_id -> deviation; eigenvalue shares; whitened rows up to sign."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    centred = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in x])
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    return deviations, e[order] / np.trace(v), centred @ axes[:, order] / np.sqrt(e[order])


def test_whitening_equals_a_plain_version(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    deviations, explained, white = plain_whitening(rows)
    got = sorted(queries.op12_whitening(spark, SF).collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in got] == [(v, k + 1) for v, _ in rows for k in range(32)]
    assert {r.n for r in got} == {len(rows)} and [r.deviation for r in got[::32]] == deviations
    assert np.allclose([r.explained for r in got[:32]], explained, rtol=1e-9)
    mine = np.array([r.whitened for r in got]).reshape(len(rows), 32)
    sign = np.sign((mine * white).sum(0))
    assert np.allclose(mine, white * sign, atol=1e-6)
    error = abs(np.cov(mine.T, bias=True) - np.eye(32)).max()
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9 and error < 1e-9


@pytest.mark.parametrize("high", [1, 2, 200, 1 << 40])
def test_bit_planes_give_exact_sums(high):
    draw = np.random.default_rng(high % 1000)
    x = draw.integers(-high, high, size=(130, 5)).astype(np.int64)
    x[:, 2] = 17
    sums, products = whitening.scatter(x)
    plain = x.astype(object)
    assert sums == list(plain.sum(0)) and products == (plain.T @ plain).tolist()


def test_whitening_of_odd_rows(spark):
    rows = [(1, [0.5, -0.25, 1.0]), (2, [0.5, 0.75, 1.0]), (2, [0.5, 0.75, 1.0]), (None, [0.1, 0.2, 1.0]), (3, [0.0, 0.0, 1.0])]
    odd = [(4, None), (5, [None, 1.0, 1.0]), (6, [NAN, 1.0, 1.0]), (7, [INF, 1.0, 1.0]), (8, [1.0]), (9, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("component", whitening.F.lit("c")).withColumn("z", whitening.F.lit(0))
    got = whitening.whiten(df).collect()
    assert len(got) == 5 * 3 and {r.n for r in got} == {5} and max(r.component for r in got) == 3
    deviations, explained, _ = plain_whitening(rows)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviations)
    assert all((r.whitened is None) == (r.component == 3) for r in got)  # the third dimension never changes
    assert np.allclose(sorted({r.explained for r in got}, reverse=True)[:2], explained[:2]) and got[0].identity_error < 1e-9
    one = whitening.whiten(spark.createDataFrame([(1, [3.0, 4.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, None, 0.0)] * 2
    assert whitening.whiten(df.where("1 = 0")).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 4 and all(r.n == 2 for r in huge)
