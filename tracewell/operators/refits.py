"""What becomes of scores when monitors learn from other runs, or when their input changes.

Fits over draws and sizes of a pool are models of one job; changed inputs are runs of their own, which
go through the fitted models together with the runs as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import seeded_order
from tracewell.operators import metrics
from tracewell.operators.monitor import Monitors


def sized_draws(pool: DataFrame, sizes, draws: int, seed: int) -> DataFrame:
    """(model, size, draw, uid): per draw, the first runs of one seeded order, for each size that the pool has.

    Sizes of a draw are nested. Only the largest size of each task's own order is shuffled.
    """
    most, n = max(sizes), pool.agg(F.count("*").alias("__all"))
    drawn = pool.select("uid").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    nth = F.row_number().over(Window.partitionBy("draw").orderBy(seeded_order(seed, "draw", "uid"), "uid"))
    first = drawn.withColumn("__k", nth).where(F.col("__k") <= most).crossJoin(F.broadcast(n))
    each = first.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where((F.col("__k") <= F.col("size")) & (F.col("size") <= F.col("__all")))
    return each.select(F.concat_ws(":", "size", "draw").alias("model"), "size", "draw", "uid")


def at_checkpoints(scores: DataFrame, evals: DataFrame, by: list[str]) -> DataFrame:
    """``evals (uid, t, ...)`` with the running maximum of each model's scores up to t."""
    top = scores.join(evals.select("uid", "t").distinct(), "uid").where("step_idx <= t").groupBy(*by, "uid", "t").agg(F.max("score").alias("score"))
    return top.join(evals, ["uid", "t"])


def subset_sweep(steps: DataFrame, draws: DataFrame, evals: DataFrame, monitors: Monitors) -> DataFrame:
    """(size, draw, t, auroc, ...): every draw's monitor on the same test rows, all fitted in one pass over the steps."""
    monitors.fit(steps, draws.select("model", "uid"))
    # A step's score depends on nothing after it, so steps after a run's last checkpoint are not scored.
    last = evals.groupBy("uid").agg(F.max("t").alias("__last"))
    tested = steps.join(last, "uid").where(F.col("step_idx") <= F.col("__last")).drop("__last")
    found = metrics.auroc(at_checkpoints(monitors.score(tested), evals, ["model"]), ["model", "t"])
    size, draw = (F.split("model", ":")[k].cast("int") for k in (0, 1))
    return found.withColumns({"size": size, "draw": draw}).drop("model")


def sweep_summary(sweep: DataFrame) -> DataFrame:
    """Per size: median, least and most over draws of the mean over checkpoints, and the number of draws."""
    mean = sweep.groupBy("size", "draw").agg(F.avg("auroc").alias("auroc"))
    return mean.groupBy("size").agg(F.median("auroc").alias("median"), F.min("auroc").alias("least"), F.max("auroc").alias("most"), F.count("auroc").alias("draws"))


def variants(steps: DataFrame, changes: dict[str, dict[str, Column]]) -> DataFrame:
    """Every run once as it is (``as_is``) and once per change, a column to its new value: (variant, uid of its own, ...)."""
    out = steps.withColumn("variant", F.lit("as_is"))
    for name, change in changes.items():
        out = out.unionByName(steps.withColumns(change).withColumn("variant", F.lit(name)))
    return out.withColumn("uid", F.concat_ws("#", "variant", "uid"))


def input_contrast(monitors: Monitors, steps: DataFrame, evals: DataFrame, changes: dict[str, dict[str, Column]]) -> DataFrame:
    """(variant, class, t, auroc, drop): what fitted monitors lose per class and changed input.

    ``evals`` has uid, t, y and failure_class; a class is held against the runs without failure.
    """
    tested = variants(steps.join(evals.select("uid").distinct(), "uid", "left_semi"), changes)
    scores = monitors.score(tested).withColumns({"variant": F.split("uid", "#")[0], "uid": F.substring_index("uid", "#", -1)})
    rows = at_checkpoints(scores, evals, ["variant"])
    kinds = rows.where("failure_class IS NOT NULL").select(F.col("failure_class").alias("class")).distinct()
    per = rows.join(F.broadcast(kinds), F.col("failure_class").isNull() | (F.col("failure_class") == F.col("class")))  # classes are few names
    found = metrics.auroc(per, ["variant", "class", "t"]).select("variant", "class", "t", "auroc")
    before = found.where("variant = 'as_is'").select("class", "t", F.col("auroc").alias("__before"))
    return found.join(before, ["class", "t"]).select("variant", "class", "t", "auroc", (F.col("__before") - F.col("auroc")).alias("drop"))
