"""Queries against their SQL, exactly, on small tables that the given data hardly hold: odd letters, parts of milliseconds, ties."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import sampling
from lodestone.plans import registry


@pytest.fixture()
def both(spark, tmp_path):
    """Runs a query and its SQL on tables given as DataFrames; both results as sorted rows."""

    def run(name, **tables):
        con = duckdb.connect()
        con.execute("SET timezone='UTC'")
        for table, df in tables.items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = registry.QUERIES[name](spark, str(tmp_path))
        found = con.execute(registry.ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        rows = [tuple(r) for r in df.select(*columns).collect()]
        return sorted(rows, key=repr), sorted(found.fetchall(), key=repr)

    return run


ANSWERS = {
    "Sñno es, y no.": "no", "ñno": "unknown", "noñ": "unknown", "Yes!": "yes", "no_more, Partial": "partial", "yeſ": "unknown", "nó yes": "yes", "не no": "no",
    'yes {"verdict": "Partial", "why": "no"}': "partial", 'no {"verdict": "maybe"}': "no", "no {broken": "no", None: "unknown", "": "unknown",
}


def test_verdicts_are_whole_words_of_any_script(spark, both):
    rows = spark.createDataFrame([(k, k % 3, "judge", text) for k, text in enumerate(ANSWERS)], "conv_id long, turn int, role string, text string")
    found, expected = both("answer_profile", conversations=rows)
    assert found == expected
    assert {r[0]: r[4] for r in found} == dict(enumerate(ANSWERS.values()))
    found, expected = both("grounded_gate", conversations=rows)
    assert found == expected == [("judge", 13, 6, 0.461538)]


def test_citations_start_a_word_in_both_engines(spark, both):
    texts = ["see Section 3", "ñsection 3", "rule\u000b7", "ſection 3", "article4", "article 4"]
    rows = spark.createDataFrame([(k, 0, "judge", text) for k, text in enumerate(texts)], "conv_id long, turn int, role string, text string")
    found, expected = both("answer_profile", conversations=rows)
    assert found == expected and [r[2] for r in found] == [True, False, True, False, True, False]


def test_idle_moments_are_begun_milliseconds(spark, both):
    start, hour = datetime.datetime(2024, 1, 1), datetime.timedelta(hours=1)
    micro = datetime.timedelta(microseconds=1)
    rows = [(1, start + 600 * micro, 7), (2, start + 6 * hour + 400 * micro, 7), (3, start + 6 * hour + 999_999 * micro, 8), (4, start + 13 * hour + 500 * micro, 8), (5, start + 40 * hour, 9)]
    events = spark.createDataFrame([(e, ts, u, "click", 1.0, "{}") for e, ts, u in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    found, expected = both("idle_timeouts", events=events)
    assert found == expected
    base = 1_704_067_200_000
    assert (7, base, base + 21_600_000) in found and (8, base + 21_600_999, base + 43_200_999) in found


def test_idle_timers_of_a_stream_count_begun_milliseconds(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * 5003000777) AS ts, i % 5 AS user_id, 'click' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM range(200) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("stream_idle_timers", "idle_timeouts"):
        found = registry.QUERIES[name](spark, str(tmp_path)).select("user_id", "idle_since_ms", "action_at_ms").collect()
        assert sorted(map(tuple, found)) == sorted(con.execute(registry.ORACLE_SQL[name]).fetchall()) and len(found) > 100


def test_equal_spans_are_merged_whatever_their_order(spark, both):
    # Equal (start, end) under several states, first of their run or inside one.
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") * 7919 % 4000).cast("int"))
    rows = spark.range(60_000).select((F.col("id") % 600).alias("o_custkey"), F.col("id").alias("o_orderkey"), day.cast("timestamp_ntz").alias("o_orderdate"), F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("id") % 3 + 1).cast("int")).alias("o_orderstatus"))
    rows = rows.unionByName(rows.withColumn("o_orderstatus", F.lit("A")).withColumn("o_orderkey", F.col("o_orderkey") + 60_000)).orderBy(F.xxhash64("o_orderkey"))
    found, expected = both("merged_spans", orders=rows)
    assert found == expected


@pytest.mark.parametrize(("keys", "held"), [(1, 1), (10, 1), (30, 2), (31, 2), (50, 3), (1_010, 51), (1_012, 51)])
def test_shares_of_keys_are_rounded(keys, held):
    assert sampling.share_of(keys, 0.05) == held


def test_split_of_thirty_keys(spark, both):
    rows = spark.range(60).select((F.col("id") % 30).alias("conv_id"), F.floor(F.col("id") / 30).cast("int").alias("turn"))
    found, expected = both("train_val_split", conversations=rows)
    assert found == expected and sum(r[2] == "val" for r in found) == 4


def test_idle_timers_of_a_table_of_many_files_in_no_order(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * 5003000777) AS ts, i % 5 AS user_id, 'click' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM range(200) t(i)")
    (tmp_path / "events.parquet").mkdir()
    for k in range(20):
        con.execute(f"COPY (SELECT * FROM events WHERE (event_id * 7) % 20 = {k}) TO '{tmp_path}/events.parquet/part-{k}.parquet' (FORMAT parquet)")
    found = registry.QUERIES["stream_idle_timers"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(registry.ORACLE_SQL["stream_idle_timers"]).fetchall()) and len(found) > 100
