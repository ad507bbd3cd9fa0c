"""Queries that fit models: folds, draws and changed inputs of the monitor, boosted trees.

The monitors of queries with SQL predict from the step before (``Lag``), whose normal equations SQL can
write down; the same code fits the reservoirs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import boosting, bootstrap, folds, frozen, labels, metrics, models, prefix, refits, thresholds
from tracewell.operators.monitor import Lag, Monitors, Reservoir
from tracewell.plans import scratch
from tracewell.plans.catalog import _AUC, _RANKED, on_features, on_scores, r6
from tracewell.plans.experiments import _GROUPED, _plans

_TWO = ["log_latency", "log_output_tokens"]
_LONG = "SELECT {more}uid, step_idx, unnest(['log_latency', 'log_output_tokens']) AS c, unnest([{a}, {b}]) AS v FROM feat"
#: Of ``mb (model, uid)``, the runs that models learn from, ``pr (model, uid)``, those that they score, and
#: steps by column ``fs`` and ``ss``: ``sc (model, uid, step_idx, score)``.
_LAG = """ms AS (SELECT c, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS sd FROM fs WHERE uid IN (SELECT uid FROM mb) GROUP BY c),
fl AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY uid, c ORDER BY step_idx), 0) AS l FROM (SELECT uid, step_idx, c, coalesce((v - m) / sd, 0) AS x FROM fs JOIN ms USING (c))),
ne AS (SELECT model, c, sum(l * l) + 1 AS a, sum(l) AS b, count(*) + 1 AS d, sum(l * x) AS p, sum(x) AS q FROM fl JOIN mb USING (uid) GROUP BY model, c),
wt AS (SELECT model, c, (p * d - b * q) / (a * d - b * b) AS w0, (a * q - b * p) / (a * d - b * b) AS w1 FROM ne),
se AS (SELECT model, c, avg(e) AS em, CASE WHEN stddev_pop(e) > 0 THEN stddev_pop(e) ELSE 1 END AS es FROM (SELECT model, c, abs(x - w0 * l - w1) AS e FROM fl JOIN mb USING (uid) JOIN wt USING (model, c) WHERE step_idx >= 3) GROUP BY ALL),
sl AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY uid, c ORDER BY step_idx), 0) AS l FROM (SELECT uid, step_idx, c, coalesce((v - m) / sd, 0) AS x FROM ss JOIN ms USING (c))),
zz AS (SELECT model, uid, step_idx, c, CASE WHEN step_idx >= 3 THEN (abs(x - w0 * l - w1) - em) / es - 0.5 ELSE 0 END AS z FROM sl JOIN pr USING (uid) JOIN wt USING (model, c) JOIN se USING (model, c)),
cu AS (SELECT *, sum(z) OVER (PARTITION BY model, uid, c ORDER BY step_idx) AS total FROM zz),
cs AS (SELECT model, uid, step_idx, total - least(0, min(total) OVER (PARTITION BY model, uid, c ORDER BY step_idx)) AS s FROM cu),
sc AS (SELECT model, uid, step_idx, max(s) AS score FROM cs GROUP BY ALL)"""
_FS = f"fs AS ({_LONG.format(more='', a='log_latency', b='log_output_tokens')})"
_AS_AUC = _AUC.replace("round(", "(").replace(", 6)", ")")


def lagged() -> Monitors:
    return Monitors({"latency": ["log_latency"], "tokens": ["log_output_tokens"]}, repeats=1, predictor=Lag)


def reservoirs() -> Monitors:
    return Monitors({"m": ["log_latency", "log_output_tokens", "is_error"], "x": ["exact_repeat", "steps_since_error"]}, predictor=Reservoir)


@on_features("score_plans", f"""SELECT * FROM (WITH all_runs AS (SELECT * FROM runs), {_GROUPED}, {_FS}, ss AS (SELECT * FROM fs), pm AS (SELECT fold || ':' || monitor AS model, * FROM pn),
    mb AS (SELECT model, uid FROM pm WHERE part = 'fit'), pr AS (SELECT model, uid FROM pm WHERE part <> 'fit'), {_LAG}, rw AS (SELECT model, uid, max(score) AS raw FROM sc GROUP BY ALL),
    vs AS (SELECT model, avg(raw) AS m, stddev_pop(raw) AS s FROM pm JOIN rw USING (model, uid) WHERE part = 'validation' GROUP BY ALL)
    SELECT fold, monitor, uid, round(raw, 6) AS raw, round((raw - m) / s, 6) AS score FROM pm JOIN rw USING (model, uid) JOIN vs USING (model) WHERE part = 'eval')""")
def _(runs, feats):
    out = folds.fitted_plans(scratch.cut(feats.select("uid", "step_idx", *_TWO)), scratch.cut(_plans(runs)), lagged())
    return out.select("fold", "monitor", "uid", r6("raw", "raw"), r6("score", "score"))


@on_features("score_plans_reservoir")
def _(runs, feats):
    out = folds.fitted_plans(scratch.cut(feats), scratch.cut(_plans(runs)), reservoirs())
    return out.select("fold", "monitor", "uid", r6("raw", "raw"), r6("score", "score"))


_EVALS = "ev AS (SELECT uid, t, y, failure_class FROM d8 WHERE family = 'llama' AND t IN (3, 4))"
_POOL = "pool AS (SELECT uid FROM runs WHERE family = 'qwen' AND failure_class IS NULL)"


def _evals(runs):
    return labels.eval_set(runs.where("family = 'llama'"), (3, 4)).select("uid", "t", "y", "failure_class")


def _pool(runs):
    return runs.where("family = 'qwen' AND failure_class IS NULL")


_SWEEP = f"""{_POOL}, {_EVALS}, dr AS (SELECT draw, uid, row_number() OVER (PARTITION BY draw ORDER BY md5('7:' || draw || ':' || uid), uid) AS k FROM pool, (SELECT unnest(range(30)) AS draw)),
    mb AS (SELECT size || ':' || draw AS model, uid FROM dr, (SELECT unnest([10, 20, 40]) AS size) WHERE k <= size AND size <= (SELECT count(*) FROM pool)),
    {_FS}, ss AS (SELECT * FROM fs WHERE uid IN (SELECT uid FROM ev)), pr AS (SELECT DISTINCT m.model, e.uid FROM mb m, ev e), {_LAG},
    tp AS (SELECT model, t, y, max(s.score) AS score FROM sc s JOIN ev USING (uid) WHERE step_idx <= t GROUP BY model, uid, t, y), {_RANKED.format(by='model, t', src='tp')},
    sw AS (SELECT CAST(split_part(model, ':', 1) AS INT) AS size, CAST(split_part(model, ':', 2) AS INT) AS draw, t, {_AS_AUC} FROM r GROUP BY model, t)"""


def _sweep(runs, feats, monitors):
    draws = scratch.cut(refits.sized_draws(_pool(runs), (10, 20, 40), 30, 7))
    return refits.subset_sweep(scratch.cut(feats), draws, scratch.cut(_evals(runs)), monitors)


@on_features("subset_sweep", f"SELECT * FROM (WITH {_SWEEP} SELECT size, draw, t, round(auroc, 6) AS auroc FROM sw)")
def _(runs, feats):
    return _sweep(runs, feats.select("uid", "step_idx", *_TWO), lagged()).select("size", "draw", "t", r6("auroc", "auroc"))


@on_features("sweep_summary", f"SELECT * FROM (WITH {_SWEEP}, mn AS (SELECT size, draw, avg(auroc) AS a FROM sw GROUP BY ALL) SELECT size, round(median(a), 6) AS median, round(min(a), 6) AS least, round(max(a), 6) AS most, count(a) AS draws FROM mn GROUP BY size)")
def _(runs, feats):
    out = refits.sweep_summary(_sweep(runs, feats.select("uid", "step_idx", *_TWO), lagged()))
    return out.select("size", *(r6(c, c) for c in ("median", "least", "most")), "draws")


@on_features("subset_sweep_reservoir")
def _(runs, feats):
    return refits.sweep_summary(_sweep(runs, feats, reservoirs()))


def _changes():
    return {"constant_latency": {"log_latency": F.lit(1.0)}, "no_tokens": {"log_output_tokens": F.lit(None).cast("double")}}


@on_features("input_contrast", f"""SELECT * FROM (WITH {_POOL}, {_EVALS}, mb AS (SELECT 0 AS model, uid FROM pool), {_FS},
    vr AS (SELECT *, variant || '#' || uid AS vid FROM feat, (SELECT unnest(['as_is', 'constant_latency', 'no_tokens']) AS variant) WHERE uid IN (SELECT uid FROM ev)),
    ss AS (SELECT vid AS uid, step_idx, unnest(['log_latency', 'log_output_tokens']) AS c, unnest([CASE WHEN variant = 'constant_latency' THEN 1.0::DOUBLE ELSE log_latency END, CASE WHEN variant <> 'no_tokens' THEN log_output_tokens END]) AS v FROM vr),
    pr AS (SELECT DISTINCT 0 AS model, vid AS uid FROM vr), {_LAG}, ks AS (SELECT DISTINCT failure_class AS class FROM ev WHERE failure_class IS NOT NULL),
    tp AS (SELECT split_part(s.uid, '#', 1) AS variant, e.uid, t, y, failure_class, max(s.score) AS score FROM sc s JOIN ev e ON e.uid = split_part(s.uid, '#', 2) WHERE step_idx <= t GROUP BY ALL),
    tk AS (SELECT * FROM tp JOIN ks ON failure_class IS NULL OR failure_class = class), {_RANKED.format(by='variant, class, t', src='tk')},
    au AS (SELECT variant, class, t, {_AS_AUC} FROM r GROUP BY ALL)
    SELECT a.variant, a.class, a.t, round(a.auroc, 6) AS auroc, round(b.auroc - a.auroc, 6) AS "drop" FROM au a JOIN au b ON b.variant = 'as_is' AND a.class = b.class AND a.t = b.t)""")
def _(runs, feats):
    rows = scratch.cut(feats.select("uid", "step_idx", *_TWO))
    m = lagged().fit(rows, _pool(runs).select(F.lit(0).alias("model"), "uid"))
    out = refits.input_contrast(m, rows, scratch.cut(_evals(runs)), _changes())
    return out.select("variant", "class", "t", r6("auroc", "auroc"), r6("drop", "drop"))


@on_features("input_contrast_reservoir")
def _(runs, feats):
    rows = scratch.cut(feats)
    changes = _changes() | {"blind_results": {"is_error": F.lit(0), "steps_since_error": F.col("step_idx") + 1}}
    m = reservoirs().fit(rows, _pool(runs).select(F.lit(0).alias("model"), "uid"))
    return refits.input_contrast(m, rows, scratch.cut(_evals(runs)), changes)


def _prefixes(runs, feats):
    """(prefix features, training rows of families other than llama, feature names)."""
    table = scratch.cut(prefix.prefix_features(feats, (2, 3, 4)))
    rows = scratch.cut(labels.training_rows(table, runs.where("family <> 'llama'"), (2, 3, 4)))
    return table, rows, [c for c in table.columns if c.startswith(("tl__", "ms__"))]


@on_features("gbt_score")
def _(runs, feats):
    table, rows, names = _prefixes(runs, feats)
    test = table.join(_tested(runs), ["uid", "t"])
    return metrics.auroc(boosting.BoostedTrees().fit(rows, names).score(test), ["t"])


def _tested(runs):
    return labels.eval_set(runs.where("family = 'llama'"), (2, 3, 4)).select("uid", "t", "y")


@on_features("source_thresholds")
def _(runs, feats):
    """Thresholds without any target run, from scores of source runs by trees that never saw their task groups, and the target's rates under them."""
    table, rows, names = _prefixes(runs, feats)
    dealt = folds.dealt_folds(runs.where("family <> 'llama'"), 3, 1)
    placed = scratch.cut(rows.join(dealt, "uid"))
    model = boosting.BoostedTrees().fit(placed, names, "fold", whole=True)
    theta = thresholds.thresholds(scratch.cut(model.score(placed, fold="fold").where("y = 0").select("t", "score")), ["t"], (0.1,))
    target = model.score(table.join(_tested(runs), ["uid", "t"]).withColumn("fold", F.lit(None).cast("int")), fold="fold")
    alarms = target.select("t", "y", "score").join(theta, "t")
    above = F.col("score") > F.col("theta")
    return alarms.groupBy("t", "rule", "alpha", "theta", "m").agg(F.avg(F.when(F.col("y") == 0, above.cast("int"))).alias("fa"), F.avg(F.when(F.col("y") == 1, above.cast("int"))).alias("tpr"))


@on_features("importances")
def _(runs, feats):
    """The ten features of a logistic model whose shuffling lowers the AUROC on the target most."""
    table, rows, names = _prefixes(runs, feats)
    test = scratch.cut(table.join(_tested(runs), ["uid", "t"]))
    return models.permutation_importance(models.Logistic(rows, names), test)


# Bootstrap by win matrices


@on_scores("win_matrix", """SELECT p.t, p.task_group AS won, n.task_group AS lost, round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END), 6) AS wins
    FROM d8s p JOIN d8s n ON p.t = n.t AND p.y = 1 AND n.y = 0 GROUP BY ALL HAVING wins > 0""")
def _(runs, evals):
    rows = bootstrap.win_blocks(scratch.cut(bootstrap.unit_counts(evals, "task_group", "t", ["score"])))
    return rows.select(F.col("set").cast("int").alias("t"), "won", "lost", "wins")  # halves: nothing to round


@on_scores("bootstrap_kernel")
def _(runs, evals):
    """10,000 replicates of two scorers and their difference."""
    values = bootstrap.replicates(evals.withColumn("length", F.col("len").cast("double")), 10_000, 1, scorers=("score", "length"))
    values = scratch.cut(values)
    return bootstrap.intervals(values.unionByName(bootstrap.paired_difference(values, "score", "length")), 10_000, strict=False)


# Frozen models: learned from one family of runs, saved, read back, and applied to another


def _thawed(spark, model):
    """A model by way of its file."""
    path = scratch.folder(spark, "model")
    digest = frozen.save(spark, model, path)
    back = frozen.load(spark, path, digest)
    scratch.removed(spark, path)
    return back


_FROZEN = f"""{_POOL}, {_EVALS}, mb AS (SELECT 0 AS model, uid FROM pool), {_FS}, ss AS (SELECT * FROM fs WHERE uid IN (SELECT uid FROM ev)), pr AS (SELECT DISTINCT 0 AS model, uid FROM ev), {_LAG},
    tp AS (SELECT uid, t, y, max(s.score) AS score FROM sc s JOIN ev USING (uid) WHERE step_idx <= t GROUP BY uid, t, y)"""


def _frozen(runs, feats):
    """(uid, t, y, score) of the runs of llama, by a monitor of qwen's that has been in a file."""
    rows = scratch.cut(feats.select("uid", "step_idx", *_TWO))
    members = _pool(runs).select(F.lit(0).alias("model"), "uid")
    m = lagged().fit(rows, members)
    back, known = _thawed(rows.sparkSession, m), rows.join(members, "uid", "left_semi")
    frozen.must_reproduce(frozen.apply(back, known), m.score(known), ["model", "uid", "step_idx"], within=1e-9)
    evals = scratch.cut(_evals(runs))
    scores = frozen.apply(back, rows.join(evals.select("uid").distinct(), "uid", "left_semi"))
    return refits.at_checkpoints(scores, evals, ["model"]).select("uid", "t", "y", "score")


@on_features("frozen_scores", f"SELECT * FROM (WITH {_FROZEN} SELECT uid, t, y, round(score, 6) AS score FROM tp)")
def _(runs, feats):
    return _frozen(runs, feats).select("uid", "t", "y", r6("score", "score"))


_HEADS = f"{_SWEEP}, hd AS (SELECT size || ':' || draw AS model, size, avg(auroc) AS headline FROM sw GROUP BY ALL HAVING count(auroc) = count(*))"


def _draws(runs, feats):
    """(model, uid, t, y, score) of 30 fits of 20 runs each, by way of their file."""
    rows = scratch.cut(feats.select("uid", "step_idx", *_TWO))
    drawn = scratch.cut(refits.sized_draws(_pool(runs), (20,), 30, 7))
    m = _thawed(rows.sparkSession, lagged().fit(rows, drawn.select("model", "uid")))
    evals = scratch.cut(_evals(runs))
    scores = frozen.apply(m, rows.join(evals.select("uid").distinct(), "uid", "left_semi"))
    return scratch.cut(refits.at_checkpoints(scores, evals, ["model"]).select("model", "uid", "t", "y", "score"))


_ONE_SIZE = _HEADS.replace("[10, 20, 40]", "[20]")


@on_features("frozen_draws", f"SELECT * FROM (WITH {_ONE_SIZE} SELECT count(*) AS draws, round(median(headline), 6) AS median, round(min(headline), 6) AS least, round(max(headline), 6) AS most FROM hd)")
def _(runs, feats):
    out = frozen.headline_spread(frozen.over_models(_draws(runs, feats)))
    return out.select("draws", *(r6(c, c) for c in ("median", "least", "most")))


@on_features("frozen_arms")
def _(runs, feats):
    """Trees and a monitor that learned from other families, on llama's runs, each run its own unit: 10,000 resamples."""
    table, rows, names = _prefixes(runs, feats)
    spark, evals = rows.sparkSession, scratch.cut(_evals(runs))
    trees = _thawed(spark, boosting.BoostedTrees().fit(rows, names))
    tested = table.join(evals.select("uid", "t"), ["uid", "t"])
    scored = frozen.by_arm(evals, {"trees": frozen.apply(trees, tested), "monitor": _frozen(runs, feats)})
    return frozen.evaluation(scratch.cut(scored), ["trees", "monitor"], 10_000, 1)


@on_features("frozen_draws_interval")
def _(runs, feats):
    """The median fit's intervals beside the spread over fits."""
    return frozen.draws_evaluation(_draws(runs, feats), 10_000, 1)
