"""Segmented scans against plain loops, with a third of all rows under one key."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import islands, scans, temporal
from lodestone.operators.scans import Segments

SCHEMA = "k string, at int, id int, v double, s string"


@pytest.fixture(scope="module")
def events(spark):
    draw = random.Random(6)
    keys = ["hot"] * 700 + [f"k{draw.randint(0, 90)}" for _ in range(1200)] + ["tail"] * 150 + [None] * 50
    rows = [(k, draw.randint(0, 4000), n, draw.choice([None, *range(60)]), draw.choice(["a", "b", "b", None])) for n, k in enumerate(keys)]
    rows = [(k, at, n, None if v is None else float(v), s) for k, at, n, v, s in rows]
    by_key = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by_key[r[0]].append(r)
    return spark.createDataFrame(rows, SCHEMA).repartition(7), by_key


@pytest.fixture(autouse=True)
def many_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def by_id(df, *columns):
    return {r.id: tuple(r[c] for c in columns) for r in df.collect()}


def test_no_partition_holds_the_hot_key_whole(events):
    segments = Segments.of(events[0], ["k"], ["at", "id"])
    per = segments.rows.where("k = 'hot'").groupBy("_part").count().collect()
    assert len(per) >= 4 and max(r["count"] for r in per) < 350
    assert segments.split.where("k = 'hot'").count() == len(per)
    assert segments.split.count() <= 2 * 12


def test_steps_equal_plain_loops(events):
    df, by_key = events
    v = F.col("v")
    got = by_id(
        Segments.of(df, ["k"], ["at", "id"]).add(total=scans.total(v), top=scans.highest(v), known=scans.last_known(v), before=scans.previous(v), behind=scans.following(v), n=scans.row_number()).result(),
        "total", "top", "known", "before", "behind", "n",
    )
    for rows in by_key.values():
        seen = []
        for i, r in enumerate(rows):
            seen += [] if r[3] is None else [r[3]]
            before, behind = (rows[i - 1][3] if i else None), (rows[i + 1][3] if i + 1 < len(rows) else None)
            assert got[r[2]] == (sum(seen) if seen else None, max(seen, default=None), seen[-1] if seen else None, before, behind, i + 1)


@pytest.mark.parametrize("size", [1, 2, 20, 400])
def test_frames_reach_over_segments(events, size):
    df, by_key = events
    frame = Segments.of(df, ["k"], ["at", "id"]).frame(size, ids=lambda w: F.sum("id").over(w), n=lambda w: F.count(F.lit(1)).over(w))
    got = by_id(frame.result(), "ids", "n")
    assert len(got) == sum(map(len, by_key.values())) == frame.result().count()
    for rows in by_key.values():
        for i, r in enumerate(rows):
            last = rows[max(0, i - size + 1) : i + 1]
            assert got[r[2]] == (sum(x[2] for x in last), len(last))


def test_latch_islands_streaks_and_waits(events):
    df, by_key = events
    order = (["k"], ["at", "id"])
    latch = by_id(islands.rolling_latch(df, *order, "v", 5, 40.0), "rolling_mean", "tripped")
    island = by_id(islands.islands(df, *order, F.col("s")), "island")
    streak = by_id(islands.streak(df, *order, F.col("s") == "b"), "streak")
    wait = by_id(islands.progress(df, *order, F.col("at")), "waited_us", "done")
    recent = by_id(islands.trailing(df, ["k"], F.col("at"), 100, F.col("s") == "b"), "recent")
    spaced = set(by_id(islands.spaced(df, *order, F.col("at"), 30)))
    for rows in by_key.values():
        tripped, number, state, run = False, 0, object(), 0
        for i, r in enumerate(rows):
            last = [x[3] for x in rows[max(0, i - 4) : i + 1] if x[3] is not None]
            tripped = tripped or (len(last) == 5 and sum(last) / 5 > 40)
            mean, flag = latch[r[2]]
            assert flag is tripped and (mean == pytest.approx(sum(last) / len(last)) if last else mean is None)
            number, state = number + (state is not r[4] and state != r[4]), r[4]
            run = 0 if r[4] == "a" else run + (r[4] == "b")
            waited = r[1] - rows[i - 1][1] if i else None
            near = [x[4] for x in rows if r[1] - 100 <= x[1] <= r[1] and x[4] is not None]
            assert island[r[2]] == (number,) and streak[r[2]] == (run,) and wait[r[2]] == (waited, i + 1)
            assert recent[r[2]] == (near.count("b") if near else None,) and (r[2] in spaced) == (waited is None or waited >= 30)


def test_as_of_and_intervals_of_a_hot_key(spark, events):
    df, by_key = events
    history = df.where("id % 3 = 0").select("k", F.col("at").alias("since"), F.col("id").alias("version"))
    probes = df.where("id % 3 <> 0").select("k", "at", "id")
    got = by_id(temporal.as_of(probes, history, ["k"], "at", "since", ["version"]), "version")
    spans = {(r.k, r.version): r.valid_to for r in temporal.to_intervals(history, ["k"], "since", "version").collect()}
    for key, rows in by_key.items():
        versions = [(r[1], r[2]) for r in rows if r[2] % 3 == 0]
        for i, (_, version) in enumerate(versions):
            assert spans[key, version] == (versions[i + 1][0] if i + 1 < len(versions) else None)
        for r in rows:
            if r[2] % 3:
                assert got[r[2]] == (max((x for x in versions if x[0] <= r[1]), default=(None, None))[1],)


@pytest.mark.parametrize("n", [0, 1])
def test_scans_of_little(spark, n):
    df = spark.createDataFrame([("x", 1, 1, 2.0, "a")][:n], SCHEMA)
    assert Segments.of(df, ["k"], ["at"]).frame(3, m=lambda w: F.avg("v").over(w)).add(t=scans.total(F.col("v")), b=scans.previous(F.col("v"))).result().count() == n


@pytest.mark.parametrize("name", ["rolling_mean_latch", "idle_islands", "streak_health", "progress_rate", "throttled_heartbeats", "idle_actions", "request_records", "asof_latest", "asof_interval", "merged_spans"])
def test_queries_window_segments_only(spark, sf_dir, name):
    from lodestone.plans import registry

    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Window ")]
    assert windows and all("_part" in w for w in windows)
