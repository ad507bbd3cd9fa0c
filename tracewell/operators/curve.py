"""The recalibration curve: false alarms and detection by how many healthy runs set the threshold.

Budgets, checkpoints, folds and draws are columns, and one aggregation takes the place of loops.
Whether a run has alarmed by step t, and before its onset, follows from two numbers: its running
maximum at t and just before the onset. So thresholds meet one row per run and checkpoint.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import seeded_order
from tracewell.operators.splits import held_before
from tracewell.operators.thresholds import pooled, thresholds_of_few

CELL = ["arm", "n", "t", "draw", "rule", "alpha"]


def run_maxima(scores: DataFrame, runs: DataFrame, checkpoints) -> DataFrame:
    """(arm, uid, t, top, before): the highest score up to t, and up to t but before the onset.

    ``scores`` are (arm, uid, step_idx, score). Runs that end before t have no row.
    """
    at = scores.join(runs.select("uid", "tau", "len", "failure_class", "task_group"), "uid").withColumn("t", F.explode(F.array(*map(F.lit, checkpoints))))
    seen = at.where((F.col("step_idx") <= F.col("t")) & (F.col("len") >= F.col("t") + 1))
    early = F.when(F.col("step_idx") < F.coalesce("tau", F.col("t") + 1), F.col("score"))
    return seen.groupBy("arm", "uid", "t").agg(F.max("score").alias("top"), F.max(early).alias("before"), F.first("tau").alias("tau"), F.first("failure_class").alias("failure_class"), F.first("task_group").alias("task_group"))


def calibration_curve(maxima: DataFrame, draws: DataFrame, folds: DataFrame, classes, alphas=(0.05, 0.10)) -> DataFrame:
    """Counts per (arm, n, t, draw, rule, alpha, fold, task_group).

    ``draws`` are (n, t, fold, draw, uid): runs outside the fold that set its threshold.
    """
    cal = maxima.join(draws, ["uid", "t"]).withColumnRenamed("top", "cal")
    theta = thresholds_of_few(cal, ["arm", "n", "t", "fold", "draw"], alphas, "cal")  # n scores each
    held = maxima.join(folds, "uid")
    healthy = F.col("failure_class").isNull()
    pos = F.coalesce(F.col("failure_class").isin(*classes) & (F.col("tau") <= F.col("t")), F.lit(False))
    alarm, pre = F.col("top") > F.col("theta"), F.coalesce(F.col("before") > F.col("theta"), F.lit(False))
    rows = held.where(healthy | pos).withColumns({"__h": healthy, "__p": pos}).join(theta, ["arm", "t", "fold"])
    return rows.groupBy(*CELL, "fold", "task_group").agg(
        F.count_if("__h").alias("n_healthy"),
        F.count_if(F.col("__h") & alarm).alias("n_healthy_alarm"),
        F.count_if("__p").alias("n_pos"),
        F.count_if(F.col("__p") & alarm).alias("n_pos_alarm"),
        F.count_if(F.col("__p") & alarm & pre).alias("n_pos_alarm_pre_tau"),
        F.count_if(F.col("__p") & alarm & ~pre).alias("n_pos_alarm_post"),
    )


def cells(counts: DataFrame) -> DataFrame:
    """Rates per cell and draw, folds and groups added up."""
    return pooled(counts, CELL)


def curve_summary(per_draw: DataFrame, checkpoints) -> DataFrame:
    """Per arm, budget, rule and level: mean false alarms and median detection of the headline mean.

    A draw counts if it has a rate at each checkpoint.
    """
    keys = ["arm", "n", "rule", "alpha"]
    full = lambda c: F.when(F.count(c) == len(checkpoints), F.avg(c))
    head = per_draw.where(F.col("t").isin(*checkpoints)).groupBy(*keys, "draw").agg(full("fa").alias("fa"), full("tpr").alias("tpr"))
    above = F.avg((F.col("fa") > 2 * F.col("alpha")).cast("int")).alias("p_fa_above_2_alpha")
    return head.groupBy(*keys).agg(F.avg("fa").alias("mean_fa"), F.percentile("tpr", 0.5).alias("median_tpr"), above, F.count("fa").alias("n_draws"))


def weighted_rates(counts: DataFrame, weights: DataFrame, num: str, den: str) -> DataFrame:
    """(arm, ..., draw, rep, rate): rates of resampled task groups; ``weights`` are (rep, task_group, w)."""
    j = counts.join(weights, "task_group")
    return j.groupBy(*CELL, "rep").agg(F.try_divide(F.sum(F.col(num) * F.col("w")), F.sum(F.col(den) * F.col("w"))).alias("rate"))


def pooled_over_draws(counts: DataFrame, num: str, den: str, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.try_divide(F.sum(num), F.sum(den)).alias("rate"))


def first_crossings(counts: DataFrame) -> DataFrame:
    """The share of positives whose first alarm is at or after the onset, per cell."""
    return counts.groupBy(*CELL).agg(F.try_divide(F.sum("n_pos_alarm_post"), F.sum("n_pos")).alias("tpr_first_crossing"))


def unit_disjoint_split(runs: DataFrame, unit: str, n_fit: int, n_val: int, seed: int) -> DataFrame:
    """(uid, role): healthy runs fill fit, then validation, in whole units by a seeded order.

    A unit that overflows is trimmed and its other runs dropped, as are failed runs of its kind;
    what is in no used unit is test.
    """
    healthy = F.col("failure_class").isNull()
    sizes = runs.groupBy(unit).agg(F.count_if(healthy).alias("h")).withColumn("__order", seeded_order(seed, unit))
    sizes = held_before(sizes, "__order", "h", unit)
    part = F.when(F.col("__before") < n_fit, "fit").when(F.col("__before") < n_fit + n_val, "validation").otherwise("test")
    placed = runs.join(sizes.select(unit, part.alias("part"), "__before"), unit)
    nth = F.col("__before") + F.row_number().over(Window.partitionBy(unit).orderBy(F.when(healthy, 0).otherwise(1), "uid")) - F.when(F.col("part") == "validation", F.col("__start")).otherwise(0)
    starts = sizes.where(F.col("__before") >= n_fit).agg(F.coalesce(F.min("__before"), F.lit(0)).alias("__start"))
    placed = placed.crossJoin(F.broadcast(starts))
    size = F.when(F.col("part") == "fit", n_fit).otherwise(n_val)
    role = F.when(F.col("part") == "test", "test").when(healthy & (F.col("__nth") <= size), F.col("part")).otherwise("dropped")
    return placed.withColumn("__nth", nth).select("uid", role.alias("role"))
