"""Models fitted many at a time, against fits one by one and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import boosting, bootstrap, folds, models, refits
from tracewell.operators.monitor import Lag, Monitor, Monitors, Reservoir

STEPS = "uid string, step_idx int, a double, b double"


def signals(seed, n, prefix="h", broken=False):
    rng = np.random.default_rng(seed)
    return [(f"{prefix}{k:02}", i, float(np.sin(i) + rng.normal() * 0.1 + (3.0 if broken and i >= 4 else 0.0)), None if rng.random() < 0.05 else float(rng.normal())) for k in range(n) for i in range(3 + k % 9)]


@pytest.mark.parametrize("predictor", [Reservoir, Lag])
def test_models_of_one_job_are_those_fitted_one_by_one(spark, predictor):
    rows = signals(1, 24) + signals(2, 6, "b", broken=True)
    steps = spark.createDataFrame(rows, STEPS).repartition(3)
    names = sorted({r[0] for r in rows})
    members = [(m, u) for k, m in enumerate("xyz") for u in names if u[0] == "h" and int(u[1:]) % 3 != k]
    many = Monitors({"p": ["a", "b"], "q": ["b"]}, repeats=2, predictor=predictor)
    many.fit(steps, spark.createDataFrame(members, "model string, uid string"))
    got = {(r["model"], r["uid"], r["step_idx"]): (r["score"], r["p"], r["q"]) for r in many.score(steps).collect()}
    assert len(got) == 3 * len(rows)
    for m in "xyz":
        one = Monitors({"p": ["a", "b"], "q": ["b"]}, repeats=2, predictor=predictor)
        # The scale of signals is that of all runs that any model learns from; a second model brings it in.
        rest = [("other", u) for u in names if u[0] == "h"]
        one.fit(steps, spark.createDataFrame([x for x in members if x[0] == m] + rest, "model string, uid string"))
        for r in one.score(steps, spark.createDataFrame([(m, u) for u in names], "model string, uid string")).collect():
            assert np.allclose(got[m, r["uid"], r["step_idx"]], (r["score"], r["p"], r["q"]))
    assert not np.allclose([v[0] for k, v in got.items() if k[0] == "x"], [v[0] for k, v in got.items() if k[0] == "y"])


def test_a_readout_is_the_ridge_solution_over_its_runs(spark):
    rows = [(u, i, a, a) for u, i, a, _ in signals(3, 12)]
    m = Monitor({"p": ["a"]}, reservoirs=1, predictor=Lag).fit(spark.createDataFrame(rows, STEPS))
    x = np.array([r[2] for r in rows])
    x = (x - x.mean()) / x.std()
    first = np.array([r[1] == 0 for r in rows])
    s = np.stack([np.where(first, 0, np.roll(x, 1)), np.ones(len(x))], 1)
    assert np.allclose(m.all.readouts[0, "p", 0].ravel(), np.linalg.solve(s.T @ s + np.eye(2), s.T @ x))
    e = np.abs(x - s @ m.all.readouts[0, "p", 0].ravel())[np.array([r[1] >= 3 for r in rows])]
    assert np.allclose(m.all.scale["p", 0], (e.mean(), e.std()))


def test_runs_longer_than_a_frame_are_scored_whole(spark, monkeypatch):
    from tracewell.operators import monitor

    rows = signals(4, 10) + [("long", i, float(np.cos(i)), 0.0) for i in range(300)]
    steps = spark.createDataFrame(rows, STEPS)
    whole = Monitor({"p": ["a"]}, reservoirs=2).fit(steps).score(steps).toPandas().set_index(["uid", "step_idx"]).score
    monkeypatch.setattr(monitor, "STEPS", 7)
    part = Monitor({"p": ["a"]}, reservoirs=2).fit(steps).score(steps).toPandas().set_index(["uid", "step_idx"]).score
    assert np.allclose(whole.sort_index(), part.sort_index())


def test_folds_fit_both_monitors_in_one_job(spark):
    rng = np.random.default_rng(0)
    runs = spark.createDataFrame([(f"r{k:03}", "src" if k % 2 else "tgt", None if rng.random() < 0.7 else "looping", f"g{k % 17}") for k in range(120)], "uid string, corpus string, failure_class string, task_group string")
    steps = spark.createDataFrame([(f"r{k:03}", i, float(rng.normal() + k % 2), float(rng.normal())) for k in range(120) for i in range(7)], STEPS)
    plans = folds.plan_grouped_folds(runs, "src", "tgt", 3, 1, 0.3).cache()
    out = folds.fitted_plans(steps, plans, Monitors({"p": ["a", "b"]}, repeats=2)).collect()
    raw = {(r["fold"], r["monitor"], r["uid"]): r["raw"] for r in out}
    assert len(raw) == plans.where("part = 'eval'").count()
    both = [(raw[f, "A", u], raw[f, "B", u]) for f, m, u in raw if m == "A"]
    assert any(abs(a - b) > 1e-6 for a, b in both)


def test_draws_are_nested_and_sizes_that_do_not_fit_are_left_out(spark):
    pool = spark.createDataFrame([(f"u{k}",) for k in range(25)], "uid string")
    got = refits.sized_draws(pool, (5, 10, 40), 4, 1).collect()
    sets = {}
    for r in got:
        sets.setdefault((r["size"], r["draw"]), set()).add(r["uid"])
    assert {k[0] for k in sets} == {5, 10} and all(len(v) == k[0] for k, v in sets.items())
    assert all(sets[5, d] < sets[10, d] for d in range(4)) and sets[5, 0] != sets[5, 1]


def test_changed_inputs_are_scored_beside_the_runs_as_they_are(spark):
    steps = spark.createDataFrame(signals(1, 20) + signals(2, 8, "b", broken=True), STEPS)
    m = Monitors({"p": ["a"], "q": ["b"]}, repeats=2).fit(steps, spark.createDataFrame([(0, f"h{k:02}") for k in range(20)], "model long, uid string"))
    evals = spark.createDataFrame([(f"{p}{k:02}", 6, int(p == "b"), "looping" if p == "b" else None) for p in "hb" for k in range(4, 8)], "uid string, t int, y int, failure_class string")
    got = {r["variant"]: (r["auroc"], r["drop"]) for r in refits.input_contrast(m, steps, evals, {"flat": {"a": F.lit(0.0)}, "no_b": {"b": F.lit(None).cast("double")}}).collect()}
    assert got["as_is"][0] == 1.0 and got["as_is"][1] == 0.0 and got["flat"][1] > 0.2 and set(got) == {"as_is", "flat", "no_b"}


def brute_trees(x, y, w, edges, depth, rate, rounds, l2, least):
    """Scores of the rows themselves, grown node by node over raw values; and a function for others."""
    p = (w * y).sum() / w.sum()
    base = np.log(p / (1 - p))
    margin, trees = np.full(len(x), base), []

    def value(g, h):
        return g * g / (h + l2)

    def grow(rows, level, g, h):
        best = None
        if level < depth:
            for f, cut in enumerate(edges):
                null = np.isnan(x[rows, f])
                for c in cut:
                    for nulls_left in (True, False):
                        left = np.where(null, nulls_left, x[rows, f] <= c)
                        if min(left.sum(), (~left).sum()) >= least:
                            a, b = rows[left], rows[~left]
                            gain = value(g[a].sum(), h[a].sum()) + value(g[b].sum(), h[b].sum()) - value(g[rows].sum(), h[rows].sum())
                            if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, f, c, nulls_left, a, b)
        if best is None:
            return float(-rate * g[rows].sum() / (h[rows].sum() + l2))
        _, f, c, nulls_left, a, b = best
        return f, c, nulls_left, grow(a, level + 1, g, h), grow(b, level + 1, g, h)

    def leaf(t, row):
        while isinstance(t, tuple):
            f, c, nulls_left, a, b = t
            t = a if (nulls_left if np.isnan(row[f]) else row[f] <= c) else b
        return t

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        t = grow(np.arange(len(x)), 0, w * (q - y), w * q * (1 - q))
        trees.append(t)
        margin = margin + np.array([leaf(t, r) for r in x])
    return lambda rows: 1 / (1 + np.exp(-(base + np.array([sum(leaf(t, r) for t in trees) for r in rows]))))


def tabled(spark, n=160):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=n) * 0.5 > 0.6).astype(float)
    x[rng.random((n, 3)) < 0.15] = np.nan
    w = rng.choice([0.5, 1.0, 1 / 3], n)
    rows = [(f"u{k:03}", 2, *(None if np.isnan(v) else float(v) for v in x[k]), None, float(y[k]), float(w[k]), k % 3) for k in range(n)]
    return x, y, w, spark.createDataFrame(rows, "uid string, t int, a double, b double, c double, empty double, y double, weight double, part int").repartition(3)


def test_trees_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CUT", 3)
    monkeypatch.setattr(boosting, "ROWS", 50)
    x, y, w, df = tabled(spark)
    m = boosting.BoostedTrees(depth=2, rate=0.3, rounds=7, least=5, bins=20).fit(df, ["a", "b", "c", "empty"])
    assert m.features == ["a", "b", "c"]
    got = {r["uid"]: r["score"] for r in m.score(df).collect()}
    want = brute_trees(x, y, w, m.edges, 2, 0.3, 7, 1.0, 5)(x)
    assert np.allclose([got[f"u{k:03}"] for k in range(len(x))], want)


def test_models_of_folds_grow_side_by_side(spark):
    x, y, w, df = tabled(spark)
    folds_ = df.select("uid", F.col("part").alias("fold"))
    how = boosting.BoostedTrees(depth=2, rate=0.3, rounds=3, least=5, bins=12)
    got = {r["uid"]: r["score"] for r in boosting.out_of_fold_scores(df, folds_, ["a", "b", "c"], how).collect()}
    for k in range(3):
        seen = np.arange(len(x)) % 3 != k
        want = brute_trees(x[seen], y[seen], w[seen], how.edges, 2, 0.3, 3, 1.0, 5)(x[~seen])
        assert np.allclose([got[f"u{i:03}"] for i in np.flatnonzero(~seen)], want)
    both = how.fit(df, ["a", "b", "c"], "part", whole=True)
    alone = boosting.BoostedTrees(depth=2, rate=0.3, rounds=3, least=5, bins=12).fit(df, ["a", "b", "c"])
    some = df.withColumn("part", F.lit(None).cast("int"))
    assert np.allclose([r["score"] for r in both.score(some, fold="part").orderBy("uid").collect()], [r["score"] for r in alone.score(df).orderBy("uid").collect()])


def test_trees_without_features_or_rows_of_a_class_give_the_base_rate(spark):
    df = spark.createDataFrame([(f"u{k}", None, float(k % 2), 1.0) for k in range(10)], "uid string, a double, y double, weight double")
    assert {round(r["score"], 6) for r in boosting.BoostedTrees(rounds=2).fit(df, ["a"]).score(df).collect()} == {0.5}
    same = df.withColumns({"a": F.lit(1.0), "y": F.lit(1.0)})
    assert all(r["score"] > 0.99 for r in boosting.BoostedTrees(rounds=2, least=1).fit(same, ["a"]).score(same).collect())


def test_shuffling_what_a_model_uses_costs_most(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(f"u{k}", 3, float(k % 2 + rng.normal() * 0.3), float(rng.normal()), k % 2) for k in range(200)], "uid string, t int, a double, b double, y int")
    (first, second) = models.permutation_importance(models.Logistic(df, ["a", "b"]), df).collect()
    assert first["feature"] == "a" and first["drop"] > 0.3 and abs(second["drop"]) < 0.1
    assert models.permutation_importance(models.Logistic(df, ["a", "b"]), df, k=1).count() == 1


@pytest.mark.parametrize("ranges", [64, 3, 2])
def test_replicates_by_win_matrices_are_those_by_weighted_rows(spark, monkeypatch, ranges):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(2, 4)), f"g{rng.integers(12)}", float(rng.integers(0, 9)), float(rng.normal()), int(rng.random() < 0.4)) for _ in range(300)]
    evals = spark.createDataFrame(rows, "t int, task_group string, score double, other double, y int")
    monkeypatch.setattr(bootstrap, "RANGES", ranges)
    got = {(r["rep"], r["set"], r["scorer"]): r["value"] for r in bootstrap.replicates(evals, 40, 3, scorers=("score", "other")).collect()}
    monkeypatch.setattr(bootstrap, "MOST_UNITS", 0)
    want = {(r["rep"], r["set"], r["scorer"]): r["value"] for r in bootstrap.replicates(evals, 40, 3, scorers=("score", "other")).collect()}
    assert set(got) == set(want) and len(got) == 41 * 4
    assert all(np.isclose(got[k], want[k]) for k in want)


def test_replicates_without_a_class_have_no_value(spark):
    evals = spark.createDataFrame([(2, "a", 1.0, 1), (2, "b", 2.0, 0)], "t int, task_group string, score double, y int")
    values = {r["rep"]: r["value"] for r in bootstrap.replicates(evals, 20, 1).collect()}
    assert values[-1] == 0.0 and None in values.values()


def test_no_models_give_no_scores(spark):
    steps = spark.createDataFrame(signals(1, 3), STEPS)
    m = Monitors({"p": ["a"]}, repeats=1).fit(steps, spark.createDataFrame([], "model string, uid string"))
    assert m.score(steps).columns == ["model", "uid", "step_idx", "score", "p"] and m.score(steps).count() == 0


def test_histograms_stay_in_tasks(spark, monkeypatch):
    from pyspark import RDD
    from tracewell.operators import boosting

    rng = np.random.default_rng(12)
    rows = [(float(rng.normal()), float(rng.integers(0, 4)) if rng.random() < 0.9 else None, int(rng.random() < 0.5), 1.0, k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, y int, weight double, fold int").repartition(4)
    monkeypatch.setattr(RDD, "treeReduce", None)  # histograms would come to the driver by it
    kinds = []
    for size in (100, 1_000):  # four blocks, in tasks of their own, and one
        monkeypatch.setattr(boosting, "ROWS", size)
        m = boosting.BoostedTrees(rounds=6, least=5).fit(df, ["a", "b"], "fold", whole=True)
        kinds.append([[x.tolist() for x in (*t.feature, *t.bin, *t.left)] for t in m.models])
    assert kinds[0] == kinds[1] and len(kinds[0]) == 3


def test_a_batch_of_many_models_is_small(spark, monkeypatch):
    from tracewell.operators import monitor

    steps = spark.createDataFrame(signals(1, 30), STEPS).coalesce(1)
    names = spark.createDataFrame([(k, f"h{i}") for k in range(20) for i in range(30)], "model int, uid string")
    m = Monitors({"p": ["a"]}, repeats=1, predictor=Lag).fit(steps, names)
    want = {(r["model"], r["uid"], r["step_idx"]): r["score"] for r in m.score(steps).collect()}
    monkeypatch.setattr(monitor, "SCORED", 400)
    sizes = [len(rows) * mine.shape[1] for rows, _, mine in m._batches(iter([m._clean(steps).toPandas()]))]
    assert max(sizes) <= 800 and sum(sizes) == 20 * steps.count()
    got = {(r["model"], r["uid"], r["step_idx"]): r["score"] for r in m.score(steps).collect()}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in want)


def test_importances_of_all_features_at_once_are_those_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{k}", 3, float(a), float(rng.normal()) if k % 5 else None, float(k % 3) if k % 7 else float("nan"), int(a + rng.normal() > 0)) for k, a in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "uid string, t int, a double, b double, c double, y int")

    class Plain:  # features and score alone
        def __init__(self, m):
            self.features, self.score = m.features, m.score

    m = models.Logistic(df, ["a", "b", "c"])
    want = {r["feature"]: r["drop"] for r in models.permutation_importance(Plain(m), df).collect()}
    found = models.permutation_importance(m, df)
    assert "__v_" not in found._jdf.queryExecution().analyzed().toString()
    assert {r["feature"]: r["drop"] for r in found.collect()} == pytest.approx(want)


def test_a_level_is_summed_from_the_margins_of_its_blocks_alone():
    # Before, every level of every tree went through all trees since the last checkpoint again.
    rng = np.random.default_rng(8)
    n, f, n_bins = 400, 5, 9
    cols, fold = rng.integers(0, n_bins, (f, n)).astype(np.uint8), np.sort(rng.integers(0, 3, n)).astype(np.int32)
    block = {"bins": cols, "fold": fold, "margin": rng.normal(size=(4, n)), "y": rng.integers(0, 2, n).astype(float), "w": rng.choice([0.5, 1.0], n)}
    growing = [{"feature": rng.integers(0, f, 7), "bin": rng.integers(0, n_bins, 7), "left": rng.random(7) < 0.5} for _ in range(4)]
    for level in range(3):
        want = np.zeros((4, 1 << level, f, n_bins, 3))
        for k, now in enumerate(growing):
            for r in np.flatnonzero(fold != k):  # the fourth model is of all rows
                node = 0
                for _ in range(level):
                    v = cols[now["feature"][node], r]
                    node = 2 * node + (1 if (now["left"][node] if v == n_bins - 1 else v <= now["bin"][node]) else 2)
                p = 1 / (1 + np.exp(-block["margin"][k, r]))
                for c in range(f):
                    want[k, node - (1 << level) + 1, c, cols[c, r]] += block["w"][r] * (p - block["y"][r]), block["w"][r] * p * (1 - p), 1
        assert np.allclose(boosting._hist(block, growing, level, n_bins), want)
