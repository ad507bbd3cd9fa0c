"""Alarm thresholds from calibration scores, first alarms, and their rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import conformal_rank
from tracewell.operators.metrics import matched, quantiles, running_totals
from tracewell.operators.steps import so_far


def _finite(df: DataFrame, score: str) -> DataFrame:
    fine = F.coalesce(F.abs(F.col(score)) < float("inf"), F.lit(False))
    return df.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("calibration scores must be finite"))))


def _level(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie between 0 and 1, got {alpha}")
    return float(alpha)


def conformal_threshold(cal: DataFrame, by: list[str], alpha: float, score: str = "score") -> DataFrame:
    """The k-th smallest of m scores, k = ceil((m + 1)(1 - alpha)); infinite if k > m."""
    alpha = _level(alpha)
    counts = _finite(cal, score).groupBy(*by, F.col(score).cast("double").alias("__s")).agg(F.count("*").alias("__n"))
    ranked = running_totals(counts, by, "__s", ["__n"])
    k = conformal_rank(F.col("__n_total"), alpha)
    theta = F.min(F.when(F.col("__n_below") + F.col("__n") >= k, F.col("__s")))
    return ranked.groupBy(*by).agg(F.coalesce(theta, F.lit(float("inf"))).alias("theta"), F.first("__n_total").alias("m"))


def plugin_threshold(cal: DataFrame, by: list[str], alpha: float, score: str = "score") -> DataFrame:
    """The linear quantile of 1 - alpha."""
    fine = _finite(cal, score)
    sizes = fine.groupBy(*by).agg(F.count("*").alias("m"))
    theta = quantiles(fine, by, score, {"theta": 1.0 - _level(alpha)})
    return matched(theta, sizes, by).select(*by, "theta", "m")


def thresholds(cal: DataFrame, by: list[str], alphas=(0.05, 0.10), score: str = "score") -> DataFrame:
    """Both rules at each level: (by, rule, alpha, theta, m)."""
    out = None
    for rule, make in (("conformal", conformal_threshold), ("plugin", plugin_threshold)):
        for a in alphas:
            one = make(cal, by, a, score).select(*by, F.lit(rule).alias("rule"), F.lit(float(a)).alias("alpha"), "theta", "m")
            out = one if out is None else out.unionByName(one)
    return out


def thresholds_of_few(cal: DataFrame, by: list[str], alphas=(0.05, 0.10), score: str = "score") -> DataFrame:
    """``thresholds`` where each group is a draw of a bounded number of scores: one aggregation for all rules and levels."""
    few = _finite(cal, score).groupBy(*by).agg(F.sort_array(F.collect_list(F.col(score).cast("double"))).alias("__s"))
    s, m = F.col("__s"), F.size("__s").cast("long")
    out = []
    for a in map(_level, alphas):
        k, at = conformal_rank(m, a), (m - 1) * F.lit(1.0 - a)
        lo, hi = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
        conformal = F.when(k <= m, F.get(s, (k - 1).cast("int"))).otherwise(float("inf"))
        for rule, theta in (("conformal", conformal), ("plugin", lo + (hi - lo) * (at - F.floor(at)))):
            out.append(F.struct(F.lit(rule).alias("rule"), F.lit(a).alias("alpha"), theta.alias("theta")))
    return few.select(*by, F.explode(F.array(*out)).alias("__t"), m.alias("m")).select(*by, "__t.*", "m")


def calibration_scores(steps: DataFrame, t: int, score: str = "score") -> DataFrame:
    """Each run's running maximum at step t; a run whose step t has no score fails the query."""
    top = steps.withColumn("__max", F.max(score).over(so_far())).where(F.col("step_idx") == t)
    there = F.when(F.col(score).isNotNull(), F.col("__max")).otherwise(F.raise_error(F.lit("a calibration run is not scored at t")))
    return top.select("uid", there.alias("score"))


def first_alarms(steps: DataFrame, theta, score: str = "score", by: list[str] = []) -> DataFrame:  # noqa: B006
    """(uid, first_alarm): the first step whose score exceeds theta, strictly; null without one."""
    theta = theta if not isinstance(theta, (int, float)) else F.lit(float(theta))
    return steps.groupBy(*by, "uid").agg(F.min(F.when(F.col(score) > theta, F.col("step_idx"))).alias("first_alarm"))


def _at(alarms: DataFrame, runs: DataFrame, checkpoints, classes, by) -> DataFrame:
    joined = runs.join(alarms, "uid", "left" if not by else "inner").withColumn("t", F.explode(F.array(*map(F.lit, checkpoints))))
    reached = F.col("len") >= F.col("t") + 1
    member = F.coalesce(F.col("failure_class").isin(*classes), F.lit(False))
    return joined.withColumns(
        {
            "__healthy": F.col("failure_class").isNull(),
            "__reached": reached,
            "__neg": reached & F.col("failure_class").isNull(),
            "__pos": F.coalesce(reached & member & (F.col("tau") <= F.col("t")), F.lit(False)),
            "__later": F.coalesce(reached & member & (F.col("tau") > F.col("t")), F.lit(False)),
            "__alarm": F.coalesce(F.col("first_alarm") <= F.col("t"), F.lit(False)),
            "__early": F.coalesce(F.col("first_alarm") < F.col("tau"), F.lit(False)),
        }
    )


def fa_tpr(alarms: DataFrame, runs: DataFrame, checkpoints, classes, by: list[str] = []) -> DataFrame:  # noqa: B006
    """False-alarm and detection rates at each checkpoint, and the counts behind them."""
    c = lambda cond: F.count_if(cond)
    neg, pos, alarm = F.col("__neg"), F.col("__pos"), F.col("__alarm")
    counts = _at(alarms, runs, checkpoints, classes, by).groupBy(*by, "t").agg(
        c(neg).alias("n_healthy"),
        c(neg & alarm).alias("n_healthy_alarm"),
        c(pos).alias("n_pos"),
        c(pos & alarm).alias("n_pos_alarm"),
        c(pos & alarm & F.col("__early")).alias("n_early"),
        c(F.col("__healthy") & ~F.col("__reached")).alias("n_healthy_without_step"),
        c(F.col("__later")).alias("n_excluded_tau_after_t"),
    )
    return counts.withColumns({"fa": F.try_divide("n_healthy_alarm", "n_healthy"), "tpr": F.try_divide("n_pos_alarm", "n_pos"), "early_alarm_rate": F.try_divide("n_early", "n_pos_alarm")})


def group_counts(alarms: DataFrame, runs: DataFrame, checkpoints, classes, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts per task group; groups with neither a healthy run nor a positive at t are left out."""
    neg, pos, alarm, early = (F.col(f"__{x}") for x in ("neg", "pos", "alarm", "early"))
    counts = _at(alarms, runs, checkpoints, classes, by).groupBy(*by, "t", "task_group").agg(
        F.count_if(neg).alias("n_healthy"),
        F.count_if(neg & alarm).alias("n_healthy_alarm"),
        F.count_if(pos).alias("n_pos"),
        F.count_if(pos & alarm).alias("n_pos_alarm"),
        F.count_if(pos & alarm & early).alias("n_pos_alarm_pre_tau"),
        F.count_if(pos & alarm & ~early).alias("n_pos_alarm_post"),
    )
    return counts.where("n_healthy + n_pos > 0")


def pooled(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Group counts added up, and their rates."""
    names = ["n_healthy", "n_healthy_alarm", "n_pos", "n_pos_alarm", "n_pos_alarm_pre_tau", "n_pos_alarm_post"]
    out = groups.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in names))
    return out.withColumns({"fa": F.try_divide("n_healthy_alarm", "n_healthy"), "tpr": F.try_divide("n_pos_alarm", "n_pos")})


def default_alarm_stats(alarms: DataFrame, runs: DataFrame) -> DataFrame:
    """Healthy false alarms, detection at or after the onset, early alarms, median delay."""
    j = runs.join(alarms, "uid", "left")
    healthy, failed = F.col("failure_class").isNull(), F.col("failure_class").isNotNull()
    hit = failed & (F.col("first_alarm") >= F.col("tau"))
    share = lambda a, b: F.try_divide(F.count_if(a), F.count_if(b))
    return j.agg(
        share(healthy & F.col("first_alarm").isNotNull(), healthy).alias("healthy_fa"),
        share(hit, failed).alias("detection"),
        share(failed & (F.col("first_alarm") < F.col("tau")), failed).alias("early_rate"),
        F.percentile(F.when(hit, F.col("first_alarm") - F.col("tau")), 0.5).alias("median_delay"),
    )


def headline(rates: DataFrame, value: str, checkpoints, by: list[str]) -> DataFrame:
    """The mean over the report's checkpoints; null unless all are there."""
    return rates.where(F.col("t").isin(*checkpoints)).groupBy(*by).agg(F.when(F.count(value) == len(checkpoints), F.avg(value)).alias(value))


def paired_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """a - b on the keys that both have."""
    return a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys).select(*keys, (F.col("__a") - F.col("__b")).alias("diff"))


def draw_summary(draws: DataFrame, value: str, by: list[str], level: float) -> DataFrame:
    """Over draws: mean, median, 5th and 95th percentile, share above a level; nulls are skipped."""
    x = F.col(value)
    return draws.groupBy(*by).agg(F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.percentile(x, 0.05).alias("p05"), F.percentile(x, 0.95).alias("p95"), F.avg((x > level).cast("int")).alias("p_above"), F.count(x).alias("n"))


def standardised_running_max(steps: DataFrame, validation: DataFrame, t: int, score: str = "score") -> DataFrame:
    """(uid, score): the running maximum at t in units of the validation runs'; centred only if those are all equal."""
    at = steps.withColumn("__max", F.max(score).over(so_far())).where(F.col("step_idx") == t).select("uid", F.col("__max").alias("x"))
    val = at.join(validation.select("uid"), "uid", "left_semi").agg(F.avg("x").alias("__mean"), F.stddev_pop("x").alias("__std"), F.count("x").alias("__n"))
    few = F.raise_error(F.lit("fewer than two validation runs"))
    centred = F.col("x") - F.col("__mean")
    out = F.when(F.col("__n") < 2, few).when(F.col("__std") > 0, centred / F.col("__std")).otherwise(centred)
    return at.join(F.broadcast(val)).select("uid", out.alias("score"))
