"""Evaluation sets: which runs count at a checkpoint, and as what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _status(runs: DataFrame, checkpoints) -> DataFrame:
    """Runs at each checkpoint: y is 1, 0, or null if excluded; ``reached`` if the run has that step."""
    at = runs.withColumn("t", F.explode(F.array(*map(F.lit, checkpoints))))
    failed = F.col("failure_class").isNotNull()
    y = F.when(~failed, 0).when(F.col("tau") <= F.col("t"), 1)
    return at.withColumn("reached", F.col("len") >= F.col("t") + 1).withColumn("y", F.when(F.col("reached"), y))


def eval_set(runs: DataFrame, checkpoints, classes=None) -> DataFrame:
    """(t, uid, y, task_group, ...) of the runs that count: healthy ones, and those failed by t."""
    if classes is not None:
        runs = runs.where(F.col("failure_class").isNull() | F.col("failure_class").isin(*classes))
    return _status(runs, checkpoints).where("y is not null").drop("reached")


def eval_counts(runs: DataFrame, checkpoints, by=()) -> DataFrame:
    """(t, n_pos, n_neg, n_excluded, n_without_step): every run is in one of the four."""
    s = _status(runs, checkpoints)
    return s.groupBy(*by, "t").agg(
        F.count_if(F.col("y") == 1).alias("n_pos"),
        F.count_if(F.col("y") == 0).alias("n_neg"),
        F.count_if(F.col("reached") & F.col("y").isNull()).alias("n_excluded"),
        F.count_if(~F.col("reached")).alias("n_without_step"),
    )


def without_pairs(evals: DataFrame, excluded: DataFrame) -> DataFrame:
    """An evaluation set without the pairs (uid, t)."""
    return evals.join(excluded.select("uid", "t"), ["uid", "t"], "left_anti")


def scores_at(evals: DataFrame, scores: DataFrame, score: str = "score") -> DataFrame:
    """The evaluation set with each run's score at t; a run without one fails the query."""
    s = scores.select("uid", F.col("step_idx").alias("t"), F.col(score).alias("score"))
    joined = evals.join(s, ["uid", "t"], "left")
    missing = F.raise_error(F.concat(F.lit("no score for run "), "uid"))
    return joined.withColumn("score", F.when(F.col("score").isNotNull(), F.col("score")).otherwise(missing))


def checked(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """Labels must be 0 or 1 and scores finite; anything else fails the query."""
    fine = F.coalesce(F.col(label).isin(0, 1) & (F.abs(F.col(score)) < float("inf")), F.lit(False))
    return df.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("labels must be 0 or 1, scores finite"))))


def training_rows(prefix: DataFrame, runs: DataFrame, checkpoints, reference: DataFrame | None = None, group: str = "corpus") -> DataFrame:
    """Labelled prefix rows, those without a healthy reference dropped, weighted by 1 / rows of the run."""
    from pyspark.sql import Window

    rows = prefix.join(eval_set(runs, checkpoints).select("uid", "t", "y", group), ["uid", "t"])
    if reference is not None:
        rows = rows.join(reference.select(F.col("grp").alias(group), "t").distinct(), [group, "t"], "left_semi")
    return rows.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("uid")))


def training_counts(prefix: DataFrame, runs: DataFrame, checkpoints, reference: DataFrame, group: str = "corpus") -> DataFrame:
    """Per (group, t): rows, positives, and those dropped for want of a reference."""
    rows = prefix.join(eval_set(runs, checkpoints).select("uid", "t", "y", group), ["uid", "t"])
    known = reference.select(F.col("grp").alias(group), "t", F.lit(True).alias("known")).distinct()
    marked = rows.join(known, [group, "t"], "left")
    return marked.groupBy(group, "t").agg(F.count("known").alias("n_rows"), F.count_if(F.col("known") & (F.col("y") == 1)).alias("n_pos"), F.count_if(F.col("known").isNull()).alias("n_dropped"))
