"""Online alarms: per run, features and running maxima as its steps arrive.

A run's state is one row of bounded size, which holds up to ``KEPT`` different calls; the calls of a run
with more are in a map with an entry each, so a step reads and writes what concerns it and no more,
however long the run is. Runs are handed over by shares of their ids: most of what a group costs, it costs
once per batch, not once per run. Where idle runs are dropped, a run is a group, since timers belong to
groups, and all its calls are in the map. The maps need Spark's RocksDB state store, which
``score_stream`` sets for the session. Steps at or below the last one seen are late or repeated, and are
passed over. The rows equal those of the batch windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.functions.scalars import call_key

OUT = "uid string, step_idx long, exact_repeat int, steps_since_error long, score double, running_max double, first_alarm boolean"
COLUMNS = ["uid", "step_idx", "exact_repeat", "steps_since_error", "score", "running_max", "first_alarm"]

#: Groups that runs are dealt to, which a stream's checkpoint fixes; calls in the row of a run, and rows of a frame, at most; rows that are
#: read together, per row that is needed, at most.
SHARES, KEPT, ROWS, WIDER = 4096, 64, 10_000, 8
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Alarms(StatefulProcessor):
    """One run at a time. ``idle_ms`` after its last step, all that is known of a run is dropped."""

    def __init__(self, theta: float, idle_ms: int | None = None):
        self.theta, self.idle_ms = theta, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last long, last_error long, top double, alarmed boolean, timer long")
        self.calls = handle.getMapState("calls", "key long", "step_idx long")

    def _seen(self, key: int, step: int, known: set[int], new: bool) -> bool:
        """Whether the run made this call before; from now on it did. ``known`` are those of this batch; a ``new`` run has no others."""
        if key in known:
            return True
        known.add(key)
        if not new and self.calls.containsKey((key,)):
            return True
        self.calls.updateValue((key,), (step,))
        return False

    def _judged(self, uid, before: tuple, steps, seen) -> tuple[tuple, list[tuple]]:
        """(last, last_error, top, alarmed) after steps in order, and the rows of those that are new; ``seen(key, step)`` notes a call."""
        last, last_error, top, alarmed = before
        out = []
        for r in steps:
            if r.step_idx <= last:
                continue
            last = int(r.step_idx)
            repeat = bool(r.call) and seen(int(r.key), last)
            if r.call and r.failed:
                last_error = last
            score = float(r.score) if pd.notna(r.score) else None
            if score is not None:
                top = score if top is None or pd.isna(top) else max(top, score)
            first = not alarmed and score is not None and score > self.theta
            alarmed = bool(alarmed or first)
            out.append((uid, last, int(repeat), last - last_error, score, top, first))
        return (last, last_error, top, alarmed), out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.run.get()  # each access is a message to the JVM
        *old, timer = before or (-1, -1, None, False, None)
        known: set[int] = set()
        steps = sorted((r for f in rows for r in f.itertuples(index=False)), key=lambda r: r.step_idx)
        now, out = self._judged(key[0], tuple(old), steps, lambda call, step: self._seen(call, step, known, before is None))
        if self.idle_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(int(timer))
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.run.update((*now, timer))
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.run.clear()
        self.calls.clear()
        return iter(())

    def close(self) -> None:
        pass


class SharedAlarms(Alarms):
    """A share of all runs at a time; a batch reads and writes one row for each of them that has steps in it."""

    def __init__(self, theta: float):
        super().__init__(theta)
        self.kept, self.rows, self.wider = KEPT, ROWS, WIDER

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "uid string", "last long, last_error long, top double, alarmed boolean, many boolean, calls binary")
        self.calls = handle.getMapState("calls", "uid string, key long", "step_idx long")
        self.number = handle.getValueState("number", "runs long")

    def _known(self, uids, number: int) -> dict:
        """Rows of those runs that have one: all rows of the share at once, or one by one where most are of other runs."""
        if number > self.wider * len(uids):
            return {uid: row for uid in uids if (row := self.runs.getValue((uid,)))}
        return {key[0]: row for key, row in self.runs.iterator() if key[0] in uids} if number else {}

    def _one(self, uid, before: tuple | None, steps: list) -> list[tuple]:
        *old, many, packed = before or (-1, -1, None, False, False, b"")
        known = {} if many else dict.fromkeys(np.frombuffer(packed, np.int64).tolist(), 0)

        def seen(call: int, step: int) -> bool:
            if call in known or many and self.calls.containsKey((uid, call)):
                return True
            known[call] = step
            if many:
                self.calls.updateValue((uid, call), (step,))
            return False

        now, out = self._judged(uid, tuple(old), sorted(steps, key=lambda r: r.step_idx), seen)
        if not out:
            return out
        if not many and len(known) > self.kept:
            many = True
            for call, step in known.items():
                self.calls.updateValue((uid, call), (step,))
        self.runs.updateValue((uid,), (*now, many, b"" if many else np.array(list(known), np.int64).tobytes()))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs: dict = {}
        for f in rows:
            for r in f.itertuples(index=False):
                runs.setdefault(None if pd.isna(r.uid) else r.uid, []).append(r)
        (number,) = self.number.get() or (0,)
        known, out = self._known(runs, number), []
        if len(runs) > len(known):
            self.number.update((number + len(runs) - len(known),))
        for uid, steps in runs.items():
            out += self._one(uid, known.get(uid), steps)
            if len(out) >= self.rows:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)


def score_stream(steps: DataFrame, theta: float, score: str = "latency_s", idle: str | None = None) -> DataFrame:
    """Streaming or batch ``steps`` with uid, step_idx, tool_name, args, tool_error and a score column.

    With ``idle`` (``1 hour``), the state of a run that has had no step for so long is dropped; what
    comes later is a run of its own. Such a query looks at its clock again and again, so it has no end
    of its own, under ``availableNow`` either. Steps without a uid are one run.
    """
    steps.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    steps.sparkSession.streams.active  # a session's first use of them starts what state stores report to; batch tables need it, too
    keyed = steps.select("uid", F.col("step_idx").cast("long").alias("step_idx"), F.xxhash64(call_key(F.col("tool_name"), F.col("args"))).alias("key"), F.col("tool_name").isNotNull().alias("call"), F.coalesce("tool_error", F.lit(False)).alias("failed"), F.col(score).cast("double").alias("score"))
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    if idle:
        return keyed.groupBy("uid").transformWithStateInPandas(Alarms(theta, idle_ms), OUT, "append", "processingTime")
    shares = keyed.withColumn("share", F.pmod(F.xxhash64("uid"), F.lit(SHARES)))
    return shares.groupBy("share").transformWithStateInPandas(SharedAlarms(theta), OUT, "append", "none")


def replay(spark, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A step table's files as a stream, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def alarm_feed(scored: DataFrame) -> DataFrame:
    """Only the steps at which a run alarms for the first time."""
    return scored.where("first_alarm").select("uid", "step_idx", "score")


def lead_times(alarms: DataFrame, runs: DataFrame) -> DataFrame:
    """(uid, lead): steps by which the alarm comes before the onset; negative if after."""
    return alarms.join(runs.select("uid", "tau"), "uid").select("uid", (F.col("tau") - F.col("step_idx")).alias("lead"))
