"""The recalibration curve against loops, decisions, clients, blinding."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import curve, decisions, steps, thresholds
from tracewell.schema import STEP
from tracewell.sources import clients


def made(seed):
    rng = np.random.default_rng(seed)
    runs, scores = [], []
    for k in range(60):
        n, failed = int(rng.integers(2, 8)), bool(rng.integers(0, 2))
        runs.append((f"u{k:02d}", n, "looping" if failed else None, int(rng.integers(0, n)) if failed else None, f"g{k % 9}", k % 3))
        scores += [(arm, f"u{k:02d}", i, float(rng.integers(0, 20))) for arm in ("x", "y") for i in range(n)]
    return runs, scores


def test_the_curve_equals_loops(spark):
    runs, scores = made(1)
    r = spark.createDataFrame(runs, "uid string, len int, failure_class string, tau int, task_group string, fold int")
    s = spark.createDataFrame(scores, "arm string, uid string, step_idx int, score double")
    rng = np.random.default_rng(2)
    draws = []
    for t in (2, 3):
        for fold in range(3):
            pool = [u for u, n, f, *_, k in runs if f is None and n >= t + 1 and k != fold]
            draws += [(6, t, fold, d, str(u)) for d in range(3) for u in rng.choice(pool, 6, replace=False)]
    d = spark.createDataFrame(draws, "n int, t int, fold int, draw int, uid string")
    counts = curve.calibration_curve(curve.run_maxima(s, r, (2, 3)), d, r.select("uid", "fold"), ["looping"], (0.2,))
    got = {tuple(x[c] for c in curve.CELL): (x["n_healthy"], x["n_healthy_alarm"], x["n_pos"], x["n_pos_alarm"], x["n_pos_alarm_pre_tau"], x["n_pos_alarm_post"]) for x in curve.cells(counts).collect()}
    by = {}
    for arm, u, i, v in scores:
        by.setdefault((arm, u), []).append(v)
    want = {}
    for arm in ("x", "y"):
        for t in (2, 3):
            for draw in range(3):
                for rule in ("conformal", "plugin"):
                    total = np.zeros(6, int)
                    for fold in range(3):
                        cal = sorted(max(by[arm, u][: t + 1]) for n, tt, f, dd, u in draws if (tt, f, dd) == (t, fold, draw))
                        k = int(np.ceil(7 * 0.8))
                        theta = np.quantile(cal, 0.8) if rule == "plugin" else cal[k - 1] if k <= 6 else np.inf
                        for u, n, f, tau, g, kk in runs:
                            if kk != fold or n < t + 1:
                                continue
                            first = next((i for i, v in enumerate(by[arm, u]) if v > theta), None)
                            alarm = first is not None and first <= t
                            if f is None:
                                total += [1, alarm, 0, 0, 0, 0]
                            elif tau <= t:
                                total += [0, 0, 1, alarm, alarm and first < tau, alarm and first >= tau]
                    want[arm, 6, t, draw, rule, 0.2] = tuple(int(x) for x in total)
    assert got == want
    assert curve.curve_summary(curve.cells(counts), (2, 3)).count() == 4
    w = spark.createDataFrame([(0, f"g{k}", 1) for k in range(9)], "rep int, task_group string, w int")
    plain = {tuple(x[c] for c in curve.CELL): x["fa"] for x in curve.cells(counts).collect()}
    assert {tuple(x[c] for c in curve.CELL): x["rate"] for x in curve.weighted_rates(counts, w, "n_healthy_alarm", "n_healthy").collect()} == plain


def test_units_are_not_shared_between_roles(spark):
    runs, _ = made(3)
    r = spark.createDataFrame(runs, "uid string, len int, failure_class string, tau int, task_group string, fold int")
    got = curve.unit_disjoint_split(r, "task_group", 8, 5, 4).join(r, "uid").collect()
    role = lambda x: [g for g in got if g["role"] == x]
    assert len(got) == 60 and len(role("fit")) == 8 and len(role("validation")) == 5
    assert all(g["failure_class"] is None for g in role("fit") + role("validation"))
    used = {g["task_group"] for g in role("fit") + role("validation")}
    assert used.isdisjoint(g["task_group"] for g in role("test")) and {g["task_group"] for g in role("fit")}.isdisjoint(g["task_group"] for g in role("validation"))


@pytest.mark.parametrize("rule", ["conformal", "plugin"])
def test_simulated_false_alarms_meet_the_closed_forms(spark, rule):
    from tracewell.functions import scalars

    m, alpha = 19, 0.1
    x = np.random.default_rng(1).random((20_000, m + 1))
    k = int(np.ceil((m + 1) * (1 - alpha)))
    theta = np.quantile(x[:, :m], 1 - alpha, axis=1) if rule == "plugin" else np.sort(x[:, :m], axis=1)[:, k - 1]
    got = (x[:, m] > theta).mean()
    form = scalars.conformal_alpha_eff if rule == "conformal" else scalars.plugin_expected_fa
    want = spark.range(1).select(form(F.lit(m), 0.1).cast("double").alias("x")).first()["x"]
    assert got == pytest.approx(want, abs=0.02)


def test_gates_and_readings(spark):
    g = spark.createDataFrame([(0.6, 0.65, 0.8, 0.7, 0.1), (0.6, 0.65, 0.8, 0.6, -0.1), (0.6, 0.65, 0.62, 0.61, 0.01)], "a_point double, a_hi double, b_point double, b_lo double, diff_lo double")
    assert [(r["apart"], r["outcome"]) for r in decisions.gap_gate(g, 0.15).collect()] == [("PASS", "PASS"), ("FAIL", "FAIL"), ("FAIL", "FAIL")]
    d = spark.createDataFrame([(0.8, 0.75), (0.8, 0.5)], "reference double, value double")
    assert [r["outcome"] for r in decisions.drop_verdict(d, 0.1).collect()] == ["HOLDS", "FAILS"]
    sweep = lambda rows: decisions.seed_sweep(spark.createDataFrame(rows, "gap double, hi double"), 0.15, 0.15, 2).first()["outcome"]
    assert [sweep([(0.0, 0.1)] * 3), sweep([(0.2, 0.3)] * 3), sweep([(0.0, 0.2)] * 3)] == ["CLAIM HOLDS", "CLAIM OVERTURNED", "SEED-SENSITIVE"]
    e = spark.createDataFrame([(None, 0.1, 0.0, 0.1), (0.2, 0.3, 0.1, 0.3), (0.2, 0.3, -0.1, 0.3), (0.0, 0.3, -0.1, 0.3)], "r double, excess double, lo double, hi double")
    assert [r["reading"] for r in decisions.excess_reading(e, 0.5, 0.02).collect()] == ["UNDEFINED", "FALLS", "PARTIAL", "DOES NOT FALL"]
    f = spark.createDataFrame([("a", None, 0.1), ("b", 0.1, 0.3), ("c", 0.1, 0.1), ("d", 0.02, 0.1), ("d", 0.3, 0.1)], "k string, fa double, pooled double")
    assert {r["k"]: r["reading"] for r in decisions.fold_reading(f, 0.2, (0.05, 0.15), ["k"]).collect()} == {"a": "UNRATED", "b": "HIGH", "c": "NOMINAL", "d": "OFFSETTING"}
    m = decisions.upper_median(spark.createDataFrame([(k, float(v)) for k, v in enumerate([5, 1, 4, 2])], "draw int, v double"), "v", [], "draw")
    assert m.first()["v"] == 4.0


def test_standardised_maxima(spark):
    s = spark.createDataFrame([(u, i, v) for u, vs in {"a": [1.0, 3.0], "b": [2.0, 5.0], "c": [9.0, 1.0]}.items() for i, v in enumerate(vs)], "uid string, step_idx int, score double")
    val = spark.createDataFrame([("a",), ("b",)], "uid string")
    assert {r["uid"]: r["score"] for r in thresholds.standardised_running_max(s, val, 1).collect()} == {"a": -1.0, "b": 1.0, "c": 5.0}
    with pytest.raises(Exception, match="fewer than two"):
        thresholds.standardised_running_max(s, val.limit(1), 1).collect()


def test_blinded_steps(spark):
    step = {"action": "tool_call", "text": "[f({}) -> abc]", "tool_events": [{"name": "f", "result": "abc"}]}
    df = spark.createDataFrame([("c", json.dumps([step, {"action": "synthesis", "text": "abc"}]))], "corpus string, s string").select("corpus", F.from_json("s", f"array<{STEP.simpleString()}>").alias("steps"))
    got = df.select(steps.blinded(F.col("steps")).alias("s")).first()["s"]
    assert (got[0]["text"], got[0]["tool_events"][0]["result"], got[1]["text"]) == ("[f({}) -> xxx]", "xxx", "abc")
    assert tuple(steps.blinding_counts(df).first()) == ("c", 1, 3)


def test_clients_read_answers_and_raise_what_can_be_tried_again():
    seen = []

    def transport(url, headers, body):
        seen.append(json.loads(body))
        return answers.pop(0)

    answers = [(200, b'{"content": [{"text": "42"}], "usage": {"input_tokens": 3, "output_tokens": 1}}'), (503, b"busy"), (400, b"no")]
    c = clients.hosted("http://h", "m", "k", transport=transport)
    assert c("p") == {"text": "42", "input_tokens": 3, "output_tokens": 1} and seen[0]["messages"][0]["content"] == "p"
    with pytest.raises(OSError):
        c("p")
    with pytest.raises(ValueError):
        c("p")
    answers = [(200, b'{"response": "7", "prompt_eval_count": 2, "eval_count": 1}')]
    assert clients.local("http://l", "m", transport=transport)("p") == {"text": "7", "input_tokens": 2, "output_tokens": 1}


def test_plans_of_single_groups_are_counted_without_their_rows(spark):
    from tracewell.operators import folds

    rows = [(f"u{k}", f"g{k * 7 % 11}", "s" if k % 3 else "t", None if k % 4 else "looping") for k in range(90)]
    runs = spark.createDataFrame(rows, "uid string, task_group string, corpus string, failure_class string")
    whole = folds.plan_leave_one_group_out(runs, "s", "t", 2, 0.25).groupBy("fold", "monitor", "part").count()
    out = folds.leave_one_group_out_counts(runs, "s", "t", 2, 0.25)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect()))
    one = spark.createDataFrame([("a", "g1", "s", None), ("b", "g2", "t", None)], runs.schema)
    with pytest.raises(Exception, match="two task groups"):
        folds.leave_one_group_out_counts(one, "s", "t", 2, 0.25).collect()
