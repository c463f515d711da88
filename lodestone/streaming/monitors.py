"""Streaming monitors over event streams; each has a batch twin in :mod:`lodestone.operators`."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.temporal import latest
from lodestone.session import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """The events table, one file or a folder of them, as a file stream (UTC timestamps, as watermarks need).

    A table's files have no order in time, so by default all that is there is one batch: rows of a later
    batch that lie behind the watermark would be lost. Files that do come in order can be taken a few at once.
    """
    rows = spark.readStream.schema(EVENTS)
    rows = rows if files_per_batch is None else rows.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern the path may be a file as well as a folder.
    return rows.parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def telemetry(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and means by event-time window and type, with a watermark for late rows."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("bucket_start"), "event_type", "n", "total")
    )


def controlled(events: DataFrame, kill: Column | None = None, resume: Column | None = None) -> DataFrame:
    """user_id, ts, event_id, value, control: events with a control stream in them ("kill", "resume", null for values)."""
    control = F.when(F.lit(False) if kill is None else kill, "kill").when(F.lit(False) if resume is None else resume, "resume")
    return events.select("user_id", "ts", "event_id", F.col("value").cast("double").alias("value"), control.alias("control"))


def _latch(size: int, limit: float) -> StatefulProcessor:
    """A class of its own function travels by value: the process that sets up a stream need not find this package."""

    class Latch(StatefulProcessor):
        """A window of the last ``size`` values of a key and a switch: a full window's mean over the limit or a kill trips it, a resume clears both.

        Between two controls values are a block: all of its window means are one array
        operation. The state is the window (a list) and the switch (one row).
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.recent = handle.getListState("recent", "value double")
            self.switch = handle.getValueState("switch", "seen long, tripped boolean, reason string, since long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            frame = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
            seen, tripped, reason, since = self.switch.get() if self.switch.exists() else (0, False, None, None)
            held = np.array([r[0] for r in self.recent.get()], dtype=np.float64)
            at = frame["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            control, values = frame["control"].to_numpy(dtype=object), frame["value"].to_numpy(dtype=np.float64)
            cuts = [k for k in range(len(frame)) if control[k] in ("kill", "resume")]
            begin = 0
            for cut in [*cuts, len(frame)]:
                if cut > begin:
                    window = np.concatenate((held, values[begin:cut]))
                    if len(window) >= size:
                        means = np.lib.stride_tricks.sliding_window_view(window, size).mean(1)
                        over = np.flatnonzero(means > limit) + size - 1 - len(held)
                        if not tripped and len(over) and over[-1] >= 0:
                            tripped, reason, since = True, "mean", int(at[begin + over[over >= 0][0]])
                    seen, held = seen + cut - begin, window[-size :]
                if cut < len(frame):
                    killed = control[cut] == "kill"
                    tripped, reason, since = (True, "manual", int(at[cut])) if killed else (False, None, None)
                    held = held if killed else held[:0]
                begin = cut + 1
            self.switch.update((seen, tripped, reason, since))
            self.recent.put([(float(v),) for v in held]) if len(held) else self.recent.clear()
            yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "rolling_mean": [held.mean() if len(held) else None], "tripped": [tripped], "reason": [reason], "since_us": pd.array([since], dtype="Int64")})

        def close(self) -> None:
            pass

    return Latch()


_LATCHED = "user_id long, seen long, rolling_mean double, tripped boolean, reason string, since_us long"


def latched(rows: DataFrame, size: int = 20, limit: float = 30.0) -> DataFrame:
    """user_id, seen, rolling_mean, tripped, reason, since_us after each batch in which a user has rows; ``rows`` is what :func:`controlled` gives.

    A task holds one user's rows of one batch, so the files a batch are what bounds it.
    """
    return rows.groupBy("user_id").transformWithStateInPandas(_latch(size, limit), _LATCHED, "Update", "None")


def _idle(span_ms: int) -> StatefulProcessor:
    """As :func:`_latch`, for silences."""

    class Idle(StatefulProcessor):
        """Acts once a key has been silent for a span of event time: at the next row if that comes first, else by a timer."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "at long, acted boolean")

        def _action(self, key, at: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"user_id": np.full(len(at), key[0]), "idle_since_ms": at, "action_at_ms": at + span_ms})

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            at = np.sort(np.concatenate([r["ts"].astype("datetime64[ms]").astype("int64").to_numpy() for r in rows]))
            last, acted = self.last.get() if self.last.exists() else (None, False)
            if last is not None:
                at = at[at > last]  # rows from before the last one change nothing
                if not len(at):
                    return
                self.handle.deleteTimer(last + span_ms)
            chain = at if last is None else np.concatenate(([last], at))
            silent = chain[:-1][np.diff(chain) >= span_ms]
            silent = silent[silent != last] if acted else silent
            self.last.update((int(chain[-1]), False))
            self.handle.registerTimer(int(chain[-1]) + span_ms)
            if len(silent):
                yield self._action(key, silent)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            last, acted = self.last.get()
            if not acted and expiredTimerInfo.getExpiryTimeInMs() == last + span_ms:
                self.last.update((last, True))
                yield self._action(key, np.array([last]))

        def close(self) -> None:
            pass

    return Idle()


def idle_actions(events: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """user_id, idle_since_ms, action_at_ms: one action for each time a user is silent for ``minutes``, as soon as the watermark shows it."""
    rows = events.select("user_id", "ts").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(_idle(minutes * 60_000), "user_id long, idle_since_ms long, action_at_ms long", "Append", "EventTime")


def merge_latest(batch: DataFrame, path: str, keys: list[str], order: list[str], version: int) -> None:
    """For foreachBatch: the newest row of each key, merged with version - 1 of the table and written as the next version."""
    spark, newest = batch.sparkSession, latest(batch, keys, *order)
    if version > 0:
        newest = latest(newest.unionByName(spark.read.parquet(f"{path}/{version - 1}").select(*newest.columns)), keys, *order)
    newest.write.mode("overwrite").parquet(f"{path}/{version}")


#: State with lists and timers lies in this store.
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int, str], None], place: str | None = None) -> str:
    """Runs a stream over what there is; ``sink`` gets each batch, its number and the output folder, which is returned.

    Output and state lie in ``place``: a run with the place of an earlier one goes on
    where that stopped. Without one it is a new folder in the shared checkpoint folder; a
    local session without such a folder uses a temporary one.
    """
    spark = stream.sparkSession
    place = place or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
        started = query.foreachBatch(lambda batch, number: sink(batch, number, f"{place}/out")).start()
    finally:
        spark.conf.set(_STORE, before)
    started.awaitTermination()
    return f"{place}/out"


def run_once(stream: DataFrame, mode: str, place: str | None = None) -> DataFrame:
    """All that a stream over what there is wrote (earlier runs in the same place included), with the number of its batch."""
    out = run(stream, mode, lambda batch, number, path: batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}"), place)
    return stream.sparkSession.read.parquet(out)
