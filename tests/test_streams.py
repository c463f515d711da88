"""Stateful streams over several stops and starts against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import islands
from lodestone.streaming import monitors

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def parts(spark):
    """Four parts of events in order of time; a third of all rows under one user."""
    draw = random.Random(4)
    rows, at = [], START
    for n in range(400):
        at += dt.timedelta(minutes=draw.choice([1, 2, 5, 30, 200]))
        user = 7 if n % 3 == 0 else draw.randint(0, 5)
        rows.append((n, at, user, draw.choice(["view", "view", "view", "view", "error", "signup"]), float(draw.randint(0, 100))))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    return [spark.createDataFrame(rows[k : k + 100], schema) for k in range(0, 400, 100)]


def controls(rows):
    return monitors.controlled(rows, (F.col("event_type") == "error") & (F.col("value") > 40), (F.col("event_type") == "signup") & (F.col("value") > 30))


def in_parts(spark, parts, tmp_path, make, mode):
    """The stream stops after every part and goes on from its checkpoint with the next."""
    source, place = f"{tmp_path}/in", f"{tmp_path}/place"
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        rows = spark.readStream.schema(part.schema).parquet(source)
        out = monitors.run_once(make(rows), mode, place)
    return out


@pytest.mark.parametrize("size", [1, 6])
def test_the_latch_goes_on_after_a_restart(spark, parts, tmp_path, size):
    out = in_parts(spark, parts, tmp_path, lambda rows: monitors.latched(controls(rows), size, 55.0), "update")
    fields = ["seen", "rolling_mean", "tripped", "reason", "since_us"]
    last = {r.user_id: r.r for r in out.groupBy("user_id").agg(F.max_by(F.struct(*fields), "_batch").alias("r")).collect()}
    events = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    twin = islands.controlled_latch(controls(events), ["user_id"], ["ts", "event_id"], "value", "control", F.unix_micros("ts"), size, 55.0)
    final = {r.user_id: r.r for r in twin.groupBy("user_id").agg(F.max_by(F.struct("rolling_mean", "tripped", "reason", "since_us"), F.struct("ts", "event_id")).alias("r")).collect()}
    assert set(last) == set(final) and {r.reason for r in final.values()} - {None}
    for user, r in final.items():
        assert (last[user].tripped, last[user].reason, last[user].since_us) == (r.tripped, r.reason, r.since_us)
        assert last[user].rolling_mean == (pytest.approx(r.rolling_mean) if r.rolling_mean is not None else None)
    plain = plain_latch([tuple(r) for r in controls(events).orderBy("ts", "event_id").collect()], size, 55.0)
    assert {u: (r.seen, r.tripped, r.reason) for u, r in last.items()} == plain


def plain_latch(rows, size, limit):
    state = {}
    for user, _, _, value, control in rows:
        recent, seen, tripped, reason = state.get(user, ([], 0, False, None))
        if control == "kill":
            tripped, reason = True, "manual"
        elif control == "resume":
            recent, tripped, reason = [], False, None
        else:
            recent, seen = [*recent, value][-size:], seen + 1
            if len(recent) == size and sum(recent) / size > limit and not tripped:
                tripped, reason = True, "mean"
        state[user] = (recent, seen, tripped, reason)
    return {u: s[1:] for u, s in state.items()}


def test_timers_act_once_over_restarts(spark, parts, tmp_path):
    out = in_parts(spark, parts, tmp_path, lambda rows: monitors.idle_actions(rows, 90, "10 minutes"), "append")
    got = sorted((r.user_id, r.idle_since_ms, r.action_at_ms) for r in out.collect())
    by_user = {}
    for r in sorted((r for p in parts for r in p.collect()), key=lambda r: (r.ts, r.event_id)):
        by_user.setdefault(r.user_id, []).append(int(r.ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
    upto, span, want = max(max(x) for x in by_user.values()) - 600_000, 90 * 60_000, []
    for user, at in by_user.items():
        for a, b in zip(at, [*at[1:], upto], strict=True):
            want += [(user, a, a + span)] if a + span <= b else []
    assert got == sorted(want) and len(got) > 20
