"""Sets, metrics, thresholds, recalibration, splits, groups, bootstrap."""

import random

import numpy as np
import pytest

from tracewell.operators import audit, bootstrap, groups, labels, metrics, recalibrate, splits, thresholds

# Runs by hand.
RUNS = [("h1", 6, None, None, "g1"), ("h2", 5, None, None, "g2"), ("h3", 4, None, None, "g3"), ("h4", 3, None, None, "g1"), ("f1", 6, "looping", 1, "g1"), ("f2", 6, "goal_drift", 3, "g2"), ("f3", 6, "looping", 5, "g3"), ("f4", 4, "goal_drift", 2, "g3")]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(RUNS, "uid string, len int, failure_class string, tau int, task_group string")


def test_evaluation_sets(runs):
    got = {r["uid"]: r["y"] for r in labels.eval_set(runs, [3]).collect()}
    assert got == {"h1": 0, "h2": 0, "h3": 0, "f1": 1, "f2": 1, "f4": 1}
    assert tuple(labels.eval_counts(runs, [3]).first())[1:] == (3, 3, 1, 1)
    assert {r["uid"] for r in labels.eval_set(runs, [3], ["looping"]).collect()} == {"h1", "h2", "h3", "f1"}


def test_the_length_of_a_prefix_says_nothing(spark, runs):
    scores = spark.createDataFrame([(u, i, float(i)) for u, n, *_ in RUNS for i in range(n)], "uid string, step_idx int, score double")
    evals = labels.scores_at(labels.eval_set(runs, [2, 3]), scores)
    assert {r["auroc"] for r in metrics.auroc(evals, ["t"]).collect()} == {0.5}
    with pytest.raises(Exception, match="no score for run"):
        labels.scores_at(labels.eval_set(runs, [3]), scores.where("uid <> 'h1'")).collect()


def pairs(spark, y, s):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")


HAND = ([1, 1, 1, 0, 0, 0], [0.9, 0.7, 0.4, 0.6, 0.3, 0.2])


def test_metrics_by_hand(spark):
    df = pairs(spark, *HAND)
    assert metrics.auroc(df, []).first()["auroc"] == pytest.approx(8 / 9)
    assert metrics.tpr_at_fpr(df, [], 0.05).first()["tpr_at_fpr"] == pytest.approx(2 / 3)
    assert metrics.auroc(pairs(spark, [1, 0], [0.5, 0.5]), []).first()["auroc"] == 0.5
    assert metrics.auroc(pairs(spark, [1, 1], [0.5, 0.6]), []).first()["auroc"] is None
    p = pairs(spark, [1] * 30 + [0] * 20 + [1] * 10 + [0] * 40, [0.8] * 50 + [0.2] * 50)
    assert metrics.ece(p, []).first()["ece"] == pytest.approx(0.10)


def numpy_metrics(y, s, alpha=0.1):
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    ap, best, before = 0.0, 0.0, 0.0
    for c in sorted(set(s), reverse=True):
        tp, fp = (y[s >= c] == 1).sum(), (y[s >= c] == 0).sum()
        recall = tp / (y == 1).sum()
        ap += (recall - before) * tp / (tp + fp)
        before = recall
        if fp / (y == 0).sum() <= alpha:
            best = max(best, recall)
    return auc, ap, best


@pytest.mark.parametrize("seed", range(4))
def test_metrics_equal_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    n = [10, 57, 300, 300][seed]
    y = rng.integers(0, 2, n)
    y[:2] = 0, 1
    s = rng.integers(0, 12, n) / 4.0 if seed % 2 else rng.normal(size=n)
    df = pairs(spark, y, s)
    got = metrics.auroc(df, []).first()["auroc"], metrics.auprc(df, []).first()["auprc"], metrics.tpr_at_fpr(df, [], 0.1).first()["tpr_at_fpr"]
    assert got == pytest.approx(numpy_metrics(y, s), abs=1e-12)


def test_bad_labels_and_scores_fail(spark):
    for y, s in ((2, 0.1), (1, float("nan")), (0, float("inf"))):
        with pytest.raises(Exception, match="labels must be"):
            labels.checked(pairs(spark, [y], [s])).collect()


# Number of scores 1 to m, level, threshold.
CONFORMAL = [(5, 0.10, np.inf), (5, 0.05, np.inf), (9, 0.10, 9), (9, 0.05, np.inf), (19, 0.10, 18), (19, 0.05, 19), (39, 0.05, 38)]
PLUGIN = [(5, 0.10, 4.6), (9, 0.10, 8.2), (19, 0.10, 17.2), (19, 0.05, 18.1)]


def calibration(spark, m):
    values = list(range(1, m + 1))
    random.Random(m).shuffle(values)
    return spark.createDataFrame([(float(v),) for v in values], "score double")


@pytest.mark.parametrize("m, alpha, want", CONFORMAL)
def test_conformal_thresholds(spark, m, alpha, want):
    assert thresholds.conformal_threshold(calibration(spark, m), [], alpha).first()["theta"] == want


@pytest.mark.parametrize("m, alpha, want", PLUGIN)
def test_plugin_thresholds(spark, m, alpha, want):
    assert thresholds.plugin_threshold(calibration(spark, m), [], alpha).first()["theta"] == pytest.approx(want)


def test_thresholds_refuse_bad_input(spark):
    for alpha in (0.0, 1.0, -1):
        with pytest.raises(ValueError):
            thresholds.conformal_threshold(calibration(spark, 5), [], alpha)
    with pytest.raises(Exception, match="must be finite"):
        thresholds.plugin_threshold(spark.createDataFrame([(float("nan"),)], "score double"), [], 0.1).collect()


def test_alarms_are_strict_and_rates_add_up(spark, runs):
    score = {"h1": [0, 2, 0], "f1": [2, 0, 0, 0], "f2": [0, 0, 0, 5], "f4": [1, 1, 1, 1]}
    rows = [(u, i, float((score.get(u, []) + [0] * 9)[i])) for u, n, *_ in RUNS for i in range(n)]
    alarms = thresholds.first_alarms(spark.createDataFrame(rows, "uid string, step_idx int, score double"), 1.0)
    assert {r["uid"]: r["first_alarm"] for r in alarms.collect() if r["first_alarm"] is not None} == {"h1": 1, "f1": 0, "f2": 3}
    classes = ["looping", "goal_drift"]
    r = thresholds.fa_tpr(alarms, runs, [3], classes).first()
    assert (r["n_healthy"], r["n_healthy_alarm"], r["n_pos"], r["n_pos_alarm"], r["n_early"], r["n_healthy_without_step"], r["n_excluded_tau_after_t"]) == (3, 1, 3, 2, 1, 1, 1)
    assert (r["fa"], r["tpr"], r["early_alarm_rate"]) == pytest.approx((1 / 3, 2 / 3, 1 / 2))
    g = thresholds.pooled(thresholds.group_counts(alarms, runs, [3], classes), ["t"]).first()
    assert (g["n_healthy"], g["n_pos"], g["n_pos_alarm"], g["n_pos_alarm_pre_tau"], g["n_pos_alarm_post"]) == (3, 3, 2, 1, 1)
    assert thresholds.headline(thresholds.fa_tpr(alarms, runs, [3, 4], classes), "tpr", (3, 9), []).first()["tpr"] is None


def test_mid_rank_percentiles(spark):
    probes = [0, 1, 2, 2.5, 4, 5, 6]
    rows = [(f"h{k}", 3, v) for k, v in enumerate([1.0, 2.0, 2.0, 3.0, 5.0])] + [(f"p{k}", 3, float(v)) for k, v in enumerate(probes)] + [("p9", 3, None)]
    prefix = spark.createDataFrame(rows, "uid string, t int, f double")
    runs = spark.createDataFrame([(u, "llama", "c", None if u[0] == "h" else "looping") for u, *_ in rows], "uid string, family string, corpus string, failure_class string")
    long = recalibrate.unpivoted(prefix, ["f"])
    ref = recalibrate.fit_reference(long, runs, "family")
    got = {r["uid"]: r["pct"] for r in recalibrate.percentile_transform(recalibrate.with_group(long, runs, "family"), ref).collect()}
    assert [got[f"p{k}"] for k in range(7)] == pytest.approx([0, 0.1, 0.4, 0.6, 0.8, 0.9, 1.0]) and got["p9"] is None
    z = {r["uid"]: r["z"] for r in recalibrate.zscore_transform(recalibrate.with_group(long, runs, "family"), ref, 0.001).collect()}
    assert z["p6"] == pytest.approx((6 - 2.6) / np.std([1, 2, 2, 3, 5]))
    with pytest.raises(Exception, match="no healthy reference"):
        recalibrate.percentile_transform(recalibrate.with_group(long, runs, "family"), ref.where("t = 4")).collect()
    with pytest.raises(ValueError):
        recalibrate.fit_reference(long, runs, "uid")


def test_cross_fitting_leaves_the_own_fold_out(spark):
    rows = [(f"h{k}", 3, float(k)) for k in range(6)]
    runs = spark.createDataFrame([(u, None) for u, *_ in rows], "uid string, failure_class string")
    folds = spark.createDataFrame([(f"h{k}", k % 2) for k in range(6)], "uid string, fold int")
    long = recalibrate.unpivoted(spark.createDataFrame(rows, "uid string, t int, f double"), ["f"])
    got = {r["uid"]: r["pct"] for r in recalibrate.cross_fitted_percentile(long, runs, folds).collect()}
    assert got == pytest.approx({f"h{k}": sum(j < k for j in range(6) if j % 2 != k % 2) / 3 for k in range(6)})


def test_leaving_a_family_out(spark):
    df = spark.createDataFrame([("q1", "qwen", "g1"), ("q2", "qwen", "g2"), ("q3", "qwen", "g3"), ("l1", "llama", "g2"), ("m1", "gemini", "g9")], "uid string, family string, task_group string")
    assert {r["uid"]: r["role"] for r in splits.leave_one_family_out(df, "llama").collect()} == {"q1": "train", "q2": "dropped", "q3": "train", "l1": "test", "m1": "eval_only"}


def test_folds_and_splits_keep_groups_together(spark):
    df = spark.createDataFrame([(f"u{k}", "llama", f"g{k % 7}", None) for k in range(40)], "uid string, family string, task_group string, failure_class string")
    folds = splits.grouped_kfold(df, 3, 5, "llama").join(df, "uid")
    assert folds.count() == 40 and audit.spread_keys(folds, "task_group", "fold").count() == 0
    assert folds.select("fold").distinct().count() == 3
    parts = splits.split_by_task_group(df, 0.3, 1).join(df, "uid")
    assert audit.spread_keys(parts, "task_group", "part").count() == 0 and parts.where("part = 'validation'").count() >= 12
    for bad in (lambda: splits.grouped_kfold(df, 8, 5, "llama"), lambda: splits.grouped_kfold(df, 3, 5, "gemini")):
        with pytest.raises(ValueError):
            bad()
    assert splits.calibration_draws(spark, ["a"], 2, 3, 1) is None
    draws = splits.calibration_draws(spark, [f"u{k}" for k in range(9)], 4, 5, 1)
    assert draws.groupBy("draw", "half").count().where("count <> 2").count() == 0


def test_task_groups_are_components(spark):
    rows = [("a", "s1", "x"), ("b", "s1", "y"), ("c", None, "y"), ("d", "s9", None), ("e", None, None), ("f", None, None)]
    got = {r["uid"]: r["task_group"] for r in groups.task_groups(spark.createDataFrame(rows, "uid string, sha string, task string"), ["sha", "task"]).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "unknown:e", "f": "unknown:f"}


def test_long_chains_of_runs_are_one_group(spark):
    rows = [(f"u{k:03d}", f"k{(k + 1) // 2}", f"m{k // 2}") for k in range(60)]
    got = groups.task_groups(spark.createDataFrame(rows, "uid string, a string, b string"), ["a", "b"]).collect()
    assert len(got) == 60 and {r["task_group"] for r in got} == {"u000"}


@pytest.mark.parametrize("metric, place", [("auroc", 0), ("auprc", 1), ("tpr_at_fpr", 2)])
def test_bootstrap_equals_resampled_rows(spark, metric, place):
    rng = np.random.default_rng(4)
    rows = [(f"u{k}", 3, int(rng.integers(0, 2)), f"g{k % 12}", float(rng.integers(0, 9))) for k in range(120)]
    evals = spark.createDataFrame(rows, "uid string, t int, y int, task_group string, score double")
    got = {r["rep"]: r["value"] for r in bootstrap.replicates(evals, 30, 7, metric).collect()}
    names = sorted({r[3] for r in rows})
    for rep in range(-1, 30):
        groups_ = range(12) if rep < 0 else np.random.default_rng([7, rep]).integers(0, 12, 12)
        picked = [r for g in groups_ for r in rows if r[3] == names[g]]
        assert got[rep] == pytest.approx(numpy_metrics(np.array([r[2] for r in picked]), np.array([r[4] for r in picked]), 0.05)[place])


def test_any_function_can_be_the_metric(spark):
    rows = [(k, 3, k % 2, f"g{k % 4}", float(k)) for k in range(40)]
    evals = spark.createDataFrame(rows, "uid long, t int, y int, task_group string, score double")
    got = {r["rep"]: r["value"] for r in bootstrap.replicates(evals, 5, 1, lambda pos, neg, value: float(pos.sum() / (pos.sum() + neg.sum()))).collect()}
    assert got[-1] == 0.5 and len(got) == 6


@pytest.mark.parametrize("metric", ["auroc", "auprc", "tpr_at_fpr"])
def test_large_bootstraps_take_the_other_way(spark, monkeypatch, metric):
    rng = np.random.default_rng(5)
    rows = [(k, 3, int(rng.integers(0, 2)), f"g{k % 6}", float(rng.integers(0, 5))) for k in range(60)]
    evals = spark.createDataFrame(rows, "uid long, t int, y int, task_group string, score double")
    small = bootstrap.intervals(bootstrap.replicates(evals, 60, 3, metric), 60).collect()
    monkeypatch.setattr(bootstrap, "MOST_SENT", 0)
    # Units have other places there, so replicates differ; the sample itself does not.
    large = bootstrap.intervals(bootstrap.replicates(evals, 60, 3, metric), 60).collect()
    assert {r["set"]: r["point"] for r in large} == pytest.approx({r["set"]: r["point"] for r in small})
    drawn = spark.createDataFrame([(0, f"g{k}", k % 3) for k in range(6)], "rep int, unit string, w int")
    counts = bootstrap.unit_counts(evals, "task_group", "t", ["score"])
    (value,) = [r["value"] for r in bootstrap.weighted_metric(counts, drawn, metric).collect()]
    picked = [r for r in rows for _ in range(int(r[3][1]) % 3)]
    y, s = np.array([r[2] for r in picked]), np.array([r[4] for r in picked])
    assert value == pytest.approx(numpy_metrics(y, s, 0.05)[["auroc", "auprc", "tpr_at_fpr"].index(metric)])


def test_undefined_intervals(spark):
    evals = spark.createDataFrame([("a", 3, 1, "g1", 1.0), ("b", 3, 0, "g2", 0.0)], "uid string, t int, y int, task_group string, score double")
    (r,) = [r for r in bootstrap.intervals(bootstrap.replicates(evals, 50, 1), 50, strict=False).collect() if r["set"] == "3"]
    assert r["point"] == 1.0 and r["lo"] is None and r["hi"] is None and r["n_skipped"] > 5


def test_too_many_one_class_replicates_fail(spark):
    evals = spark.createDataFrame([("a", 3, 1, "g1", 1.0), ("b", 3, 0, "g2", 0.0)], "uid string, t int, y int, task_group string, score double")
    with pytest.raises(Exception, match="one class"):
        bootstrap.matched_step_ci(evals, 50, 1).collect()


def test_paired_differences_share_their_draws(spark):
    rng = np.random.default_rng(6)
    rows = [(f"u{k}", t, int(rng.integers(0, 2)), f"g{k % 9}", float(rng.normal()), float(rng.normal())) for k in range(80) for t in (3, 4)]
    evals = spark.createDataFrame(rows, "uid string, t int, y int, task_group string, a double, b double")
    values = bootstrap.replicates(evals, 40, 2, scorers=("a", "b"))
    diff = bootstrap.intervals(bootstrap.paired_difference(values, "a", "b"), 40)
    point = {(r["set"], r["scorer"]): r["point"] for r in bootstrap.intervals(values, 40).collect()}
    for r in diff.collect():
        assert r["point"] == pytest.approx(point[r["set"], "b"] - point[r["set"], "a"])
        assert r["lo"] <= r["hi"]


def test_the_bounds_of_value_ranges_are_taken_once(spark):
    from pyspark.sql import functions as F

    # Sketches of many tasks' values come out differently with the order in which the tasks end.
    rows = spark.range(0, 40_000, 1, 16).select((F.col("id") % 2).alias("g"), F.rand(3).alias("x"), F.lit(1).alias("n"))
    rows = rows.localCheckpoint()
    out = metrics.running_totals(rows, ["g"], "x", ["n"])
    assert "percentile_approx" not in out._jdf.queryExecution().analyzed().toString()
    got = out.toPandas()
    assert (got["n_below"] == got.groupby("g")["x"].rank().astype(int) - 1).all() and (got["n_total"] == 20_000).all()


def test_a_headline_draws_its_resamples_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"u{k}", 3, int(rng.integers(0, 2)), f"g{k % 9}", float(rng.integers(0, 7)), float(rng.normal())) for k in range(80)]
    evals = spark.createDataFrame(rows, "uid string, t int, y int, task_group string, a double, b double")
    out = bootstrap.headline(evals, 40, 2, "a", "b")
    assert "MapInPandas" not in out._jdf.queryExecution().analyzed().toString()
    got = {(r["metric"], r["scorer"], r["set"]): (r["point"], r["lo"], r["hi"]) for r in out.collect()}
    monkeypatch.setattr(bootstrap, "MOST_UNITS", 0)
    for name in bootstrap.METRICS:
        for r in bootstrap.intervals(bootstrap.replicates(evals, 40, 2, name, scorers=("a", "b")), 40).collect():
            assert got[name, r["scorer"], r["set"]] == pytest.approx((r["point"], r["lo"], r["hi"]))
    assert ("auprc", "b-a", "mean") in got


@pytest.mark.parametrize("size", [1, 3, 7, 50])
def test_wins_by_blocks_of_units(spark, monkeypatch, size):
    rng = np.random.default_rng(9)
    rows = [(3, int(rng.integers(0, 2)), f"g{rng.integers(7)}", float(rng.integers(0, 6))) for _ in range(90)]
    evals = spark.createDataFrame(rows, "t int, y int, task_group string, score double")
    monkeypatch.setattr(bootstrap, "SLICE", 5)
    got = {(r["won"], r["lost"]): r["wins"] for r in bootstrap.win_blocks(bootstrap.unit_counts(evals, "task_group", "t", ["score"]), size).collect()}
    want = {}
    for _, y, g, s in rows:
        for _, z, h, r in rows:
            if y > z and s >= r:
                want[g, h] = want.get((g, h), 0) + (1.0 if s > r else 0.5)
    assert got == want


def test_replicates_under_given_weights_are_kept(spark):
    from tracewell.plans import experiments

    rows = [(f"u{k}", 3, k % 2, f"g{k % 5}", float(k % 7), k % 4) for k in range(40)]
    evals = spark.createDataFrame(rows, "uid string, t int, y int, task_group string, score double, len int")
    values = experiments._replicates(evals, "tpr_at_fpr")
    assert "Window" not in values._jdf.queryExecution().analyzed().toString() and values.count() == 61 * 2


def test_names_of_units_come_to_rows_of_wins_and_not_to_pairs(spark):
    # Before, two joins went over every pair of units.
    evals = spark.createDataFrame([(2, f"g{k % 5}", k % 2, float(k % 7)) for k in range(40)], "t int, task_group string, y int, score double")
    out = bootstrap.win_blocks(bootstrap.unit_counts(evals, "task_group", "t", ["score"]), 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate posexplode") < plan.index("Join")
