"""Alarms on streams: state that is kept, dropped, and taken up again."""

import random
import time

import pytest

from tracewell.streaming import alarms

SCHEMA = "uid string, step_idx int, tool_name string, args string, tool_error boolean, latency_s double"


def made(seed, runs, first, last):
    rng = random.Random(seed)
    return [(f"r{k}", i, rng.choice(["a", "b", None]), f'{{"x": {rng.randrange(4)}}}', rng.random() < 0.3, None if rng.random() < 0.1 else rng.random() * 10) for k in range(runs) for i in range(first, last)]


def expected(rows, theta):
    out, state = [], {}
    for uid, i, tool, args, failed, score in sorted(rows, key=lambda r: (r[0], r[1])):
        seen, err, top, alarmed = state.get(uid, (set(), -1, None, False))
        repeat = tool is not None and (tool, args) in seen
        if tool is not None:
            seen = seen | {(tool, args)}
            err = i if failed else err
        if score is not None:
            top = score if top is None else max(top, score)
        first = not alarmed and score is not None and score > theta
        state[uid] = (seen, err, top, alarmed or first)
        out.append((uid, i, int(repeat), i - err, score, top, first))
    return out


def drained(spark, source, schema, sink, log, **how):
    q = alarms.score_stream(alarms.replay(spark, source, schema), 8.0, **how).writeStream.format("parquet").option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start(sink)
    q.awaitTermination()
    return q


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    parts = [made(1, 4, 0, 6), made(2, 4, 6, 9), made(3, 5, 9, 14)]
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for part in parts:  # each time, a query of its own takes up the state of the one before
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        drained(spark, source, schema, sink, log)
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    want = sorted(expected([r for p in parts for r in p], 8.0))
    assert [r[:4] + r[6:] for r in got] == [r[:4] + r[6:] for r in want]
    assert [r[4:6] for r in got] == [pytest.approx(r[4:6]) for r in want]
    assert any(r[2] for r in got if r[1] >= 6)  # repeats of calls that earlier queries saw


def test_a_batch_writes_what_is_new_and_not_all_calls_again(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = spark.createDataFrame([], SCHEMA).schema
    updated = []
    for k, first in enumerate((0, 200, 400)):  # each step a call of its own; then two steps on a long run
        last = first + 200 if k < 2 else first + 2
        spark.createDataFrame([("r", i, "a", str(i), False, 1.0) for i in range(first, last)], schema).coalesce(1).write.mode("append").parquet(source)
        q = drained(spark, source, schema, sink, log)
        updated.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"]))
    assert spark.read.parquet(sink).count() == 402
    assert updated[1] <= updated[0] + 1
    assert updated[2] <= 4


def test_the_state_of_idle_runs_is_dropped(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def put(i):
        spark.createDataFrame([("r", i, "a", "1", False, 9.0)], schema).coalesce(1).write.mode("append").parquet(source)

    def wait(n):
        for _ in range(60):
            time.sleep(0.5)
            assert q.exception() is None
            if list((tmp_path / "out").glob("*.parquet")) and spark.read.schema(alarms.OUT).parquet(sink).count() >= n:
                return

    put(5)
    q = alarms.score_stream(alarms.replay(spark, source, schema), 8.0, idle="3 seconds").writeStream.format("parquet").option("checkpointLocation", log).start(sink)
    try:
        wait(1)
        for _ in range(60):  # until a later batch has no state left
            time.sleep(0.5)
            p = q.lastProgress
            if p and p["stateOperators"] and p["stateOperators"][0]["numRowsRemoved"]:
                break
        put(2)
        wait(2)
    finally:
        q.stop()
    got = sorted((r["uid"], r["step_idx"], r["exact_repeat"], r["first_alarm"]) for r in spark.read.parquet(sink).collect())
    assert got == [("r", 2, 0, True), ("r", 5, 0, True)]


def test_batch_tables_and_empty_ones(spark):
    rows = made(4, 3, 0, 8)
    got = sorted(tuple(r)[:4] for r in alarms.score_stream(spark.createDataFrame(rows, SCHEMA), 8.0).collect())
    assert got == sorted(r[:4] for r in expected(rows, 8.0))
    assert alarms.score_stream(spark.createDataFrame([], SCHEMA), 8.0).count() == 0


def test_a_new_run_is_not_asked_for_its_calls():
    import pandas as pd

    class State:
        def __init__(self, value=None):
            self.value, self.asked = value, []

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def containsKey(self, key):  # noqa: N802
            self.asked.append(key)
            return False

        def updateValue(self, key, value):  # noqa: N802
            pass

    a = alarms.Alarms(5.0)
    a.run, a.calls = State(), State()
    rows = lambda first: iter([pd.DataFrame({"step_idx": [first, first + 1], "key": [7, 7], "call": True, "failed": False, "score": 1.0})])
    (out,) = a.handleInputRows(("r",), rows(0), None)
    assert list(out["exact_repeat"]) == [0, 1] and a.calls.asked == []
    list(a.handleInputRows(("r",), rows(2), None))
    assert a.calls.asked == [(7,)]


def test_runs_share_a_group_and_long_ones_keep_their_calls_apart(spark, tmp_path, monkeypatch):
    # Before, each run was a group of its own, with a message per call.
    for name, value in (("SHARES", 2), ("KEPT", 3), ("ROWS", 7), ("WIDER", 3)):
        monkeypatch.setattr(alarms, name, value)
    plan = alarms.score_stream(spark.createDataFrame([], SCHEMA), 8.0)
    assert "share" in plan._jdf.queryExecution().analyzed().toString()
    parts = [made(1, 12, 0, 6), made(2, 30, 6, 9), [r for r in made(3, 30, 9, 14) if r[0] in ("r1", "r29")], made(4, 33, 14, 16)]
    parts = [[(None if u == "r2" else u, *rest) for u, *rest in p] for p in parts]
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = spark.createDataFrame([], SCHEMA).schema
    updated = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        q = drained(spark, source, schema, sink, log)
        updated.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"]))
    named = lambda rows: sorted(("" if r[0] is None else r[0], *r[1:]) for r in rows)
    got = named(tuple(r) for r in spark.read.parquet(sink).collect())
    want = named((None if r[0] == "" else r[0], *r[1:]) for r in expected([("" if r[0] is None else r[0], *r[1:]) for p in parts for r in p], 8.0))
    assert [r[:4] + r[6:] for r in got] == [r[:4] + r[6:] for r in want]
    assert [r[4:6] for r in got] == [pytest.approx(r[4:6]) for r in want]
    assert updated[2] <= 2 + 2 * 5  # rows of the two runs and their calls, not those of all
