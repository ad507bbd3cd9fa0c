"""Splits by family and task group. Draws use the driver's generators, over ids only."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import seeded_order
from tracewell.schema import EVAL_ONLY


def leave_one_family_out(runs: DataFrame, family: str, eval_only=EVAL_ONLY) -> DataFrame:
    """(uid, role): test is the family; others train, unless eval-only or of a task group of the test."""
    test = runs.where(F.col("family") == family)
    shared = test.select("task_group").distinct().withColumn("__shared", F.lit(True))
    rest = runs.where(F.col("family") != family).join(shared, "task_group", "left")
    role = F.when(F.col("family").isin(*eval_only), "eval_only").when(F.col("__shared"), "dropped").otherwise("train")
    return test.select("uid", F.lit("test").alias("role")).unionByName(rest.select("uid", role.alias("role")))


def _table(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def grouped_kfold(runs: DataFrame, k: int, seed: int, family: str | None = None, eval_only=EVAL_ONLY) -> DataFrame:
    """(uid, fold): sorted task groups, shuffled by the seed, dealt round."""
    if family in eval_only:
        raise ValueError(f"{family} is for evaluation only")
    own = runs if family is None else runs.where(F.col("family") == family)
    groups = [r[0] for r in own.select("task_group").distinct().orderBy("task_group").collect()]  # names of groups only
    if len(groups) < k:
        raise ValueError(f"{len(groups)} task groups are too few for {k} folds")
    random.Random(seed).shuffle(groups)
    folds = _table(runs.sparkSession, [(g, i % k) for i, g in enumerate(groups)], "task_group string, fold int")
    return own.select("uid", "task_group").join(folds, "task_group").select("uid", "fold")


def healthy_subset(runs: DataFrame, n: int, seed: int, without_groups: DataFrame | None = None, corpora: list[str] | None = None) -> DataFrame:
    """n healthy runs in a seeded order, outside of some task groups, of some corpora."""
    pool = runs.where("failure_class is null")
    if corpora is not None:
        pool = pool.where(F.col("corpus").isin(*corpora))
    if without_groups is not None:
        pool = pool.join(without_groups, "task_group", "left_anti")
    return pool.orderBy(seeded_order(seed, "uid"), "uid").limit(n).select("uid")


def split_by_task_group(runs: DataFrame, fraction: float, seed: int) -> DataFrame:
    """(uid, part): whole groups go to validation, in a seeded order, until they hold the fraction of runs.

    Fewer than two groups, or none left for one of the parts, fails the query.
    """
    sizes = runs.groupBy("task_group").agg(F.count("*").alias("n")).withColumn("__order", seeded_order(seed, "task_group"))
    before = held_before(sizes, "__order", "n", "task_group")
    total = F.broadcast(runs.agg(F.count("*").alias("__total"), F.countDistinct("task_group").alias("__groups")))
    placed = before.crossJoin(total).withColumn("part", F.when(F.col("__before") < fraction * F.col("__total"), "validation").otherwise("fit"))
    sides = F.broadcast(placed.agg(F.countDistinct("part").alias("__sides")))
    few = F.raise_error(F.lit("a split needs a task group on each side"))
    checked = placed.crossJoin(sides).withColumn("part", F.when(F.col("__sides") == 2, F.col("part")).otherwise(few))
    return runs.join(checked.select("task_group", "part"), "task_group").select("uid", "part")


def held_before(rows: DataFrame, order: str, n: str, tie: str) -> DataFrame:
    """``rows`` with ``__before``, the sum of ``n`` over the rows that come before in the order of a column of hexadecimal digits."""
    share = rows.withColumn("__share", F.substring(order, 1, 2))
    sums = share.groupBy("__share").agg(F.sum(n).alias("__sum"))
    base = sums.select("__share", F.coalesce(F.sum("__sum").over(Window.orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))  # 256 rows
    own = F.coalesce(F.sum(n).over(Window.partitionBy("__share").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return share.withColumn("__own", own).join(F.broadcast(base), "__share").withColumn("__before", F.col("__own") + F.col("__base")).drop("__share", "__own", "__base")


def three_way(spark: SparkSession, uids: list[str], seed: int, shares=(0.6, 0.2)) -> DataFrame:
    """A seeded permutation cut at rounded shares (half to even)."""
    order = np.random.default_rng(seed).permutation(len(uids))
    a = round(shares[0] * len(uids))
    b = a + round(shares[1] * len(uids))
    return _table(spark, [(uids[i], "fit" if k < a else "validation" if k < b else "test") for k, i in enumerate(order)], "uid string, part string")


def calibration_draws(spark: SparkSession, eligible: list[str], n: int, draws: int, seed: int, key=(), half_seed: int = 0) -> DataFrame | None:
    """(draw, uid, half) of ``draws`` samples of n; None if there are too few."""
    if n > len(eligible):
        return None
    rows = []
    for r in range(draws):
        picked = np.random.default_rng([seed, *key, n, r]).choice(len(eligible), n, replace=False)
        order = np.random.default_rng([half_seed, r]).permutation(n)
        rows += [(r, eligible[picked[i]], "A" if k < n // 2 else "B") for k, i in enumerate(order)]
    return _table(spark, rows, "draw int, uid string, half string")


def subset_draws(spark: SparkSession, uids: list[str], size: int, n: int, seed: int) -> DataFrame:
    """n different subsets of a size."""
    rng, seen = np.random.default_rng(seed), set()
    while len(seen) < n:
        seen.add(tuple(sorted(rng.choice(len(uids), size, replace=False).tolist())))
    return _table(spark, [(k, uids[i]) for k, s in enumerate(sorted(seen)) for i in s], "draw int, uid string")


def eligible(runs: DataFrame, others: DataFrame, t: int) -> DataFrame:
    """Healthy runs of ``others`` that reach step t."""
    return runs.where(F.col("failure_class").isNull() & (F.col("len") >= t + 1)).join(others.select("uid"), "uid", "left_semi").select("uid")
