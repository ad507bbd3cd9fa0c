"""Readings of the recalibration curve's group counts, and before/after comparisons of scores.

``counts`` are those of ``curve.calibration_curve``: per cell (arm, n, t, draw, rule, alpha), fold and
task group. Folds that are left out are rows that are left out; nothing is scored again.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import conformal_alpha_eff, plugin_expected_fa
from tracewell.operators.metrics import auroc

KEYS = ["arm", "n", "rule", "alpha"]


def uncommon_folds(counts: DataFrame) -> DataFrame:
    """(t, fold): folds that are tested at some budget but not at all of them."""
    budgets = counts.select("t", "n").distinct().groupBy("t").agg(F.count("*").alias("__all"))
    per = counts.select("t", "fold", "n").distinct().groupBy("t", "fold").agg(F.count("*").alias("__n"))
    return per.join(F.broadcast(budgets), "t").where("__n < __all").select("t", "fold")


def common_counts(counts: DataFrame) -> DataFrame:
    """The counts of folds that every budget tests."""
    return counts.join(F.broadcast(uncommon_folds(counts)), ["t", "fold"], "left_anti")


def headline_rates(counts: DataFrame, num: str, den: str, checkpoints) -> DataFrame:
    """(arm, n, rule, alpha, draw, rate): the mean over checkpoints of pooled rates; null unless all have one."""
    per_t = counts.where(F.col("t").isin(*checkpoints)).groupBy(*KEYS, "draw", "t").agg(F.try_divide(F.sum(num), F.sum(den)).alias("rate"))
    return per_t.groupBy(*KEYS, "draw").agg(F.when(F.count("rate") == len(checkpoints), F.avg("rate")).alias("rate"))


def common_fold_effect(counts: DataFrame, checkpoints) -> DataFrame:
    """Per cell over draws: mean false alarms on all folds and on common ones, their difference, median detection on common ones."""
    every = headline_rates(counts, "n_healthy_alarm", "n_healthy", checkpoints).groupBy(*KEYS).agg(F.avg("rate").alias("fa_mean"))
    common = common_counts(counts)
    fa = headline_rates(common, "n_healthy_alarm", "n_healthy", checkpoints).groupBy(*KEYS).agg(F.avg("rate").alias("common_fa_mean"))
    tpr = headline_rates(common, "n_pos_alarm", "n_pos", checkpoints).groupBy(*KEYS).agg(F.median("rate").alias("common_tpr_median"))
    return every.join(fa, KEYS, "left").join(tpr, KEYS, "left").withColumn("delta_fa_mean", F.col("common_fa_mean") - F.col("fa_mean"))


def fold_excess(counts: DataFrame) -> DataFrame:
    """Per cell, t and fold: false alarms pooled over draws, healthy test runs, and alarms per draw beyond the level."""
    per = counts.groupBy(*KEYS, "t", "fold", "draw").agg(F.sum("n_healthy_alarm").alias("alarms"), F.sum("n_healthy").alias("healthy"))
    out = per.groupBy(*KEYS, "t", "fold").agg(F.sum("alarms").alias("alarms"), F.sum("healthy").alias("healthy"), F.max("healthy").alias("n_test_healthy"), F.count("*").alias("n_draws"))
    fa, excess = F.try_divide(F.col("alarms"), F.col("healthy")), (F.col("alarms") - F.col("alpha") * F.col("healthy")) / F.greatest(F.col("n_draws"), F.lit(1))
    return out.select(*KEYS, "t", "fold", fa.alias("fa"), "n_test_healthy", excess.alias("excess_per_draw"))


def concentration(counts: DataFrame, fold: int, fold_above: float, rest_at_most: float, rest_above: float) -> DataFrame:
    """Per cell: whether excess false alarms are one fold's (CONCENTRATED), the others' (SPREAD), or NEITHER."""
    mine = F.col("fold") == fold
    sums = counts.groupBy(*KEYS, "t").agg(*(F.sum(F.when(c, F.col(x))).alias(f"{n}_{x}") for n, c in (("own", mine), ("rest", ~mine)) for x in ("n_healthy_alarm", "n_healthy")))
    per_t = sums.select(*KEYS, "t", F.try_divide("own_n_healthy_alarm", "own_n_healthy").alias("fold_fa"), F.try_divide("rest_n_healthy_alarm", "rest_n_healthy").alias("rest_fa"))
    tested = F.col("fold_fa").isNotNull()
    fits = F.coalesce((F.col("fold_fa") > fold_above) & (F.col("rest_fa") <= rest_at_most), F.lit(False))
    out = per_t.groupBy(*KEYS).agg(F.count_if(tested).alias("n_tested"), F.count_if(tested & ~fits).alias("__not"), F.count_if(F.col("rest_fa") > rest_above).alias("__spread"), F.max("fold_fa").alias("fold_fa"), F.max("rest_fa").alias("rest_fa"))
    reading = F.when((F.col("n_tested") > 0) & (F.col("__not") == 0), "CONCENTRATED").when(F.col("__spread") > 0, "SPREAD").otherwise("NEITHER")
    return out.select(*KEYS, "n_tested", "fold_fa", "rest_fa", reading.alias("reading"))


def rated_folds(counts: DataFrame, high: float, band: tuple[float, float], min_healthy: int) -> DataFrame:
    """Per cell and t: pooled false alarms, and the reading of the folds with enough healthy runs."""
    from tracewell.operators.decisions import fold_reading

    pooled = counts.groupBy(*KEYS, "t").agg(F.try_divide(F.sum("n_healthy_alarm"), F.sum("n_healthy")).alias("pooled"))
    folds = fold_excess(counts).withColumn("fa", F.when(F.col("n_test_healthy") >= min_healthy, F.col("fa")))
    return fold_reading(folds.join(pooled, [*KEYS, "t"]), high, band, [*KEYS, "t"])


def against_expected(counts: DataFrame, sizes: DataFrame, checkpoints) -> DataFrame:
    """Per cell: mean false alarms over draws, those that the rule aims at, and the difference.

    ``sizes`` are (arm, n, t, draw, m): how many scores set each threshold.
    """
    m, alpha = F.col("m"), F.col("alpha")
    levels = [r["alpha"] for r in counts.select("alpha").distinct().collect()]  # a few levels
    aim = F.coalesce(*(F.when(alpha == a, F.when(F.col("rule") == "conformal", conformal_alpha_eff(m, a)).otherwise(plugin_expected_fa(m, a))) for a in levels))
    cells = counts.select(*KEYS, "t", "draw").distinct().where(F.col("t").isin(*checkpoints)).join(sizes, ["arm", "n", "t", "draw"])
    aims = cells.groupBy(*KEYS, "draw").agg(F.avg(aim).alias("__aim"))
    seen = headline_rates(counts, "n_healthy_alarm", "n_healthy", checkpoints).where("rate is not null")
    return seen.join(aims, [*KEYS, "draw"]).groupBy(*KEYS).agg(F.avg("__aim").alias("expected_fa"), F.avg("rate").alias("observed_fa"), F.avg(F.col("rate") - F.col("__aim")).alias("difference"))


def healthy_per_group(counts: DataFrame, fold: int) -> DataFrame:
    """Per (t, task group) of a fold: healthy test runs. They must not differ between cells."""
    per = counts.where(F.col("fold") == fold).groupBy("t", "task_group", *KEYS, "draw").agg(F.sum("n_healthy").alias("__h")).groupBy("t", "task_group").agg(F.min("__h").alias("__least"), F.max("__h").alias("n_healthy"))
    same = F.when(F.col("__least") == F.col("n_healthy"), F.col("n_healthy")).otherwise(F.raise_error(F.lit("healthy test runs of a task group differ between cells")))
    return per.select("t", "task_group", same.alias("n_healthy"))


def alarm_order(counts: DataFrame) -> DataFrame:
    """Entries that break what must hold of counts: alarms after the onset are alarms, and those before make up the rest."""
    first = F.col("n_pos_alarm") - F.col("n_pos_alarm_pre_tau")
    return counts.agg(F.count_if(F.col("n_pos_alarm_post") > F.col("n_pos_alarm")).alias("post_above_alarm"), F.count_if(first < 0).alias("pre_above_alarm"), F.count_if(F.col("n_pos_alarm") > F.col("n_pos")).alias("alarm_above_pos"), F.count("*").alias("n"))


def paired_over_draws(counts: DataFrame, a: tuple[str, int], b: tuple[str, int], num: str, den: str, checkpoints) -> DataFrame:
    """Per (rule, alpha): the difference of two (arm, n) over the draws that both have: median, p10, p90, mean, share above 0."""
    rates = headline_rates(counts, num, den, checkpoints)
    x, y = (rates.where((F.col("arm") == arm) & (F.col("n") == n)).select("rule", "alpha", "draw", F.col("rate").alias(name)) for (arm, n), name in ((a, "__a"), (b, "__b")))
    d = x.join(y, ["rule", "alpha", "draw"]).select("rule", "alpha", (F.col("__a") - F.col("__b")).alias("d"))
    q = lambda p: F.percentile("d", p)  # noqa: E731  of draws, a few hundred
    return d.groupBy("rule", "alpha").agg(q(0.5).alias("median"), q(0.1).alias("p10"), q(0.9).alias("p90"), F.avg("d").alias("mean"), F.avg((F.col("d") > 0).cast("int")).alias("share_above_0"), F.count("d").alias("n"))


def before_after(evals: DataFrame, before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """AUROC per group with scores before and after a change (masking, blinding, another input), and the drop.

    ``evals`` are (uid, t, y, ...), the scores (uid, t, score). A pair that lacks a score fails the query.
    """
    both = evals.join(before.select("uid", "t", F.col("score").alias("before")), ["uid", "t"], "left").join(after.select("uid", "t", F.col("score").alias("after")), ["uid", "t"], "left")
    missing = F.raise_error(F.concat(F.lit("no score for run "), "uid"))
    both = both.withColumns({c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(missing) for c in ("before", "after")})
    a, b = (auroc(both, by, c).select(*by, F.col("auroc").alias(c), *(["n_pos", "n_neg"] if c == "before" else [])) for c in ("before", "after"))
    return a.join(b, by).withColumn("drop", F.col("before") - F.col("after"))


def score_frame(evals: DataFrame, scores: dict[str, DataFrame]) -> DataFrame:
    """(uid, family, t, y, failure_class, one column per arm): all arms' scores side by side, null where an arm has none."""
    out = evals.select("uid", "family", "t", "y", "failure_class")
    for arm, s in scores.items():
        out = out.join(s.select("uid", "t", F.col("score").alias(arm)), ["uid", "t"], "left")
    return out


def sensitive_flags(aurocs: DataFrame, high: float) -> DataFrame:
    """Features that tell a class at a step by themselves, by class, step, and how far from one half."""
    return aurocs.where(F.abs(F.col("auroc") - 0.5) >= high).orderBy("class", "t", F.desc(F.abs(F.col("auroc") - 0.5)), "feature")
