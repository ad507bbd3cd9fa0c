"""Models that are saved, read back, and applied without fitting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import boosting, frozen
from tracewell.operators.monitor import Lag, Monitor, Monitors, Reservoir

STEPS = "uid string, step_idx int, a double, b double"


def signals(seed, n):
    rng = np.random.default_rng(seed)
    return [(f"r{k}", i, float(rng.normal()), None if rng.random() < 0.1 else float(rng.normal())) for k in range(n) for i in range(4 + k % 5)]


@pytest.mark.parametrize("predictor", [Reservoir, Lag])
def test_a_monitor_comes_back_with_the_same_scores(spark, tmp_path, predictor):
    steps = spark.createDataFrame(signals(1, 12), STEPS)
    members = spark.createDataFrame([(m, f"r{k}") for m in (1, 2) for k in range(12) if k % 3 != m], "model int, uid string")
    many = Monitors({"p": ["a", "b"], "q": ["b"]}, repeats=2, predictor=predictor).fit(steps, members)
    digest = frozen.save(spark, many, f"{tmp_path}/m")
    back = frozen.load(spark, f"{tmp_path}/m", digest)
    other = spark.createDataFrame(signals(2, 5), STEPS)
    assert frozen.apply(back, other).orderBy("model", "uid", "step_idx").collect() == many.score(other).orderBy("model", "uid", "step_idx").collect()
    one = Monitor({"p": ["a"]}, reservoirs=1, predictor=predictor).fit(steps)
    frozen.save(spark, one, f"{tmp_path}/one")
    assert frozen.apply(frozen.load(spark, f"{tmp_path}/one"), other).orderBy("uid", "step_idx").collect() == one.score(other).orderBy("uid", "step_idx").collect()


def test_trees_of_folds_come_back_with_the_same_scores(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f"r{k}", k % 3, float(x), None if k % 7 == 0 else float(rng.normal()), int(x + rng.normal() > 0), 1.0) for k, x in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "uid string, fold int, a double, b double, y int, weight double")
    model = boosting.BoostedTrees(rounds=12).fit(df, ["a", "b"], "fold", whole=True)
    frozen.save(spark, model, f"{tmp_path}/t")
    back = frozen.load(spark, f"{tmp_path}/t")
    asked = df.unionByName(df.withColumn("fold", F.lit(None).cast("int")))
    want = model.score(asked, fold="fold")
    got = frozen.apply(back, asked, fold="fold")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_damaged_files_other_models_and_missing_columns_are_refused(spark, tmp_path):
    steps = spark.createDataFrame(signals(1, 6), STEPS)
    m = Monitor({"p": ["a"]}, reservoirs=1, predictor=Lag).fit(steps)
    frozen.save(spark, m, f"{tmp_path}/m")
    with pytest.raises(frozen.Damaged, match="not 00"):
        frozen.load(spark, f"{tmp_path}/m", "00")
    saved = spark.read.parquet(f"{tmp_path}/m")
    saved.withColumn("body", F.replace("body", F.lit('"drift": 0.5'), F.lit('"drift": 0.4'))).write.parquet(f"{tmp_path}/changed")
    with pytest.raises(frozen.Damaged, match="not as it was saved"):
        frozen.load(spark, f"{tmp_path}/changed")
    saved.unionAll(saved).write.parquet(f"{tmp_path}/two")
    with pytest.raises(frozen.Damaged, match="2 models"):
        frozen.load(spark, f"{tmp_path}/two")
    with pytest.raises(frozen.Damaged, match="no columns"):
        frozen.apply(m, steps.drop("a"))
    with pytest.raises(ValueError, match="fit"):
        frozen.save(spark, Monitor({"p": ["a"]}), f"{tmp_path}/none")
    with pytest.raises(TypeError):
        frozen._packed(object())


def test_scores_must_be_those_kept_with_the_model(spark):
    kept = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.25), ("c", 1, None)], "uid string, t int, score double")
    frozen.must_reproduce(kept, kept, ["uid", "t"])
    near = kept.withColumn("score", F.col("score") + 1e-9)
    frozen.must_reproduce(near, kept, ["uid", "t"], within=1e-8)
    for wrong in (near, kept.where("uid <> 'a'"), kept.where("false"), kept.withColumn("score", F.when(F.col("uid") != "a", F.col("score"))), kept.withColumn("score", F.coalesce("score", F.lit(1.0)))):
        with pytest.raises(frozen.Damaged):
            frozen.must_reproduce(wrong, kept, ["uid", "t"])


def test_arms_on_another_corpus_and_undefined_intervals(spark):
    rng = np.random.default_rng(5)
    evals = spark.createDataFrame([(f"r{k}", t, int(k < 20)) for k in range(40) for t in (3, 4)], "uid string, t int, y int")
    value = {(f"r{k}", t): float((k < 20) + rng.normal()) for k in range(40) for t in (3, 4)}
    good = spark.createDataFrame([(u, t, v) for (u, t), v in value.items()], "uid string, t int, score double")
    flat = good.withColumn("score", F.lit(1.0))
    got = {(r["set"], r["scorer"]): r for r in frozen.evaluation(frozen.by_arm(evals, {"good": good, "flat": flat}), ["good", "flat"], 200, 1).collect()}
    assert set(got) == {(s, a) for s in ("3", "4", "mean") for a in ("good", "flat")}
    for t in (3, 4):
        pos, neg = ([v for (u, s), v in value.items() if s == t and (int(u[1:]) < 20) == y] for y in (True, False))
        assert got[str(t), "good"]["point"] == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]))
    r = got["mean", "good"]
    assert r["lo"] < r["point"] < r["hi"]
    assert got["mean", "flat"]["point"] == 0.5
    # One healthy run: over a third of the resamples have none.
    few = frozen.by_arm(evals.where("y = 1 OR uid = 'r30'"), {"good": good})
    lone = {r["set"]: r for r in frozen.evaluation(few, ["good"], 200, 1).collect()}
    assert lone["mean"]["point"] is not None
    assert lone["mean"]["lo"] is None
    assert lone["mean"]["hi"] is None
    assert lone["mean"]["n_skipped"] > 40


def test_draws_are_held_by_an_actual_fit(spark):
    rng = np.random.default_rng(6)
    rows = [(m, f"r{k}", t, int(k < 15), float((k < 15) * m / 3 + rng.normal())) for m in range(5) for k in range(30) for t in (3, 4)]
    scores = spark.createDataFrame(rows, "model int, uid string, t int, y int, score double")
    head = {r["model"]: r["headline"] for r in frozen.over_models(scores).collect()}
    order = sorted(head, key=lambda m: (head[m], m))
    assert frozen.median_fit(frozen.over_models(scores)).first()["model"] == order[2]
    even = frozen.over_models(scores.where("model < 4"))
    order4 = sorted(range(4), key=lambda m: (head[m], m))
    assert frozen.median_fit(even).first()["model"] == order4[2]
    got = {r["set"]: r for r in frozen.draws_evaluation(scores, 100, 1).collect()}
    assert got["mean"]["point"] == pytest.approx(head[order[2]])
    assert (got["mean"]["draws"], got["mean"]["median"], got["mean"]["least"], got["mean"]["most"]) == (5, pytest.approx(head[order[2]]), pytest.approx(head[order[0]]), pytest.approx(head[order[-1]]))
    # A fit without one class at a checkpoint has no headline.
    gap = scores.where("model <> 0 OR t <> 4 OR y = 1")
    assert {r["model"] for r in frozen.over_models(gap).where("headline IS NULL").collect()} == {0}
