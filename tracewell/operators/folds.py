"""Fold plans: which runs fit, validate and test in each fold, their scores on a common scale, and draws.

Orders that only need to look random are by the MD5 of a seed and the row's names, so that they hold
on any engine and need no list of names on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalars import seeded_order

#: Tasks that count the plans of single groups.
FOLD_TASKS = 192


def dealt_folds(runs: DataFrame, k: int, seed: int, by: str = "task_group") -> DataFrame:
    """(uid, fold): whole groups dealt round in a seeded order."""
    sizes = runs.select(by).distinct().withColumn("__order", seeded_order(seed, by))
    # One row per group, ranked within shares of the orders' first digit, so that no task sorts all groups.
    placed = ranked(sizes, "__order", [by]).select(by, ((F.col("nth") - 1) % k).cast("int").alias("fold"))
    return runs.join(placed, by).select("uid", "fold")


def ranked(rows: DataFrame, order: str, ties: list[str]) -> DataFrame:
    """``rows`` with ``nth``, their place from 1 in the order of a column of hexadecimal digits."""
    share = rows.withColumn("__share", F.substring(order, 1, 2))
    n = share.groupBy("__share").agg(F.count("*").alias("__n"))
    before = n.select("__share", F.coalesce(F.sum("__n").over(Window.orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # 256 rows
    own = F.row_number().over(Window.partitionBy("__share").orderBy(order, *ties))
    return share.withColumn("__own", own).join(F.broadcast(before), "__share").withColumn("nth", F.col("__own") + F.col("__before")).drop("__share", "__own", "__before")


def _parts(pool: DataFrame, keys: list[str], fraction: float, seed: Column) -> DataFrame:
    """``pool`` with ``part``: whole task groups go to validation, in a seeded order, until they hold the fraction."""
    sizes = pool.groupBy(*keys, "task_group").agg(F.count("*").alias("__n"), F.first(seed).alias("__seed"))
    w = Window.partitionBy(*keys).orderBy(seeded_order(F.col("__seed"), "task_group"), "task_group")
    held = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__n").over(Window.partitionBy(*keys))
    placed = sizes.select(*keys, "task_group", F.when(held < fraction * total, "validation").otherwise("fit").alias("part"))
    sides = placed.groupBy(*keys).agg(F.countDistinct("part").alias("__sides"))
    few = F.raise_error(F.lit("a pool needs two task groups at least, one on each side"))
    checked = placed.join(sides, keys).withColumn("part", F.when(F.col("__sides") == 2, F.col("part")).otherwise(few)).drop("__sides")
    return pool.join(checked, [*keys, "task_group"])


def plan(runs: DataFrame, folds: DataFrame, source_corpus: str, target_corpus: str, fraction: float, seed: int) -> DataFrame:
    """(fold, monitor, uid, part): the plans of all folds.

    ``folds`` are (uid, fold) of the target's runs: each fold's own are its ``eval`` rows, of both monitors.
    Monitor A learns from healthy source runs, B from healthy target runs of the other folds; neither
    from a task group that the fold tests.
    """
    target = runs.where(F.col("corpus") == target_corpus).join(folds, "uid")
    healthy = F.col("failure_class").isNull()
    tested = target.select("fold", "task_group").distinct()
    numbers = folds.select("fold").distinct()
    source = runs.where((F.col("corpus") == source_corpus) & healthy).select("uid", "task_group").crossJoin(F.broadcast(numbers)).withColumn("monitor", F.lit("A"))
    others = target.where(healthy).select("uid", "task_group", F.col("fold").alias("__own")).crossJoin(F.broadcast(numbers)).where("fold <> __own").drop("__own").withColumn("monitor", F.lit("B"))
    pool = source.unionByName(others).join(tested, ["fold", "task_group"], "left_anti")
    parts = _parts(pool, ["fold", "monitor"], fraction, 1000 * F.lit(seed) + F.col("fold")).select("fold", "monitor", "uid", "part")
    evals = target.select("fold", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("monitor"), "uid", F.lit("eval").alias("part"))
    return parts.unionByName(evals)


def plan_grouped_folds(runs: DataFrame, source_corpus: str, target_corpus: str, k: int, seed: int, fraction: float) -> DataFrame:
    """Plans of k folds of the target's task groups."""
    target = runs.where(F.col("corpus") == target_corpus)
    return plan(runs, dealt_folds(target, k, seed), source_corpus, target_corpus, fraction, seed)


def plan_leave_one_group_out(runs: DataFrame, source_corpus: str, target_corpus: str, seed: int, fraction: float) -> DataFrame:
    """Plans of a fold per task group of the target, numbered by name."""
    target = runs.where(F.col("corpus") == target_corpus)
    named = target.select("task_group").distinct().withColumn("__order", F.hex("task_group"))
    folds = target.join(ranked(named, "__order", ["task_group"]).select("task_group", (F.col("nth") - 1).cast("int").alias("fold")), "task_group").select("uid", "fold")
    return plan(runs, folds, source_corpus, target_corpus, fraction, seed)


def leave_one_group_out_counts(runs: DataFrame, source_corpus: str, target_corpus: str, seed: int, fraction: float) -> DataFrame:
    """(fold, monitor, part, n): how many runs the plans of ``plan_leave_one_group_out`` have in each part.

    A fold has an order of its own of all task groups, so the work is the number of groups squared; but
    an order is made, read off and forgotten in a task, from the groups' names and sizes, which every
    task gets. Nothing of that size is written or shuffled.
    """
    spark = runs.sparkSession
    healthy = F.col("failure_class").isNull()
    target = runs.where(F.col("corpus") == target_corpus)
    sides = runs.where(healthy & F.col("corpus").isin(source_corpus, target_corpus)).groupBy("task_group")
    per = sides.agg(F.count_if(F.col("corpus") == source_corpus).alias("A"), F.count_if(F.col("corpus") == target_corpus).alias("B")).where("task_group IS NOT NULL").toArrow().to_pandas()  # a name and two counts per task group
    names = [g.encode() for g in per["task_group"]]
    # Digests decide, and the names' own order where they are equal.
    order = np.argsort(np.array(names, dtype=object), kind="stable") if names else np.zeros(0, int)
    there = [(m, per[m].to_numpy(), [i for i in order if per[m].to_numpy()[i]]) for m in "AB"]
    sent = spark.sparkContext.broadcast([(m, [names[i] for i in at], n[at]) for m, n, at in there])
    tested = target.where("task_group IS NOT NULL").groupBy("task_group").agg(F.count("*").alias("n_eval")).withColumn("__order", F.hex("task_group"))
    numbered = ranked(tested, "__order", ["task_group"]).select((F.col("nth") - 1).cast("int").alias("fold"), "task_group", "n_eval")

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = [{g: i for i, g in enumerate(gs)} for _, gs, _ in sent.value]
        for f in frames:
            out = []
            for fold, group, n_eval in zip(f["fold"], f["task_group"], f["n_eval"]):
                start = hashlib.md5(f"{1000 * seed + fold}:".encode())
                for (monitor, gs, sizes), number in zip(sent.value, at):
                    out.append((fold, monitor, "eval", n_eval))
                    keep = sizes
                    if (own := number.get(group.encode())) is not None:  # the fold's own group is not in its pool
                        keep = sizes.copy()
                        keep[own] = 0
                    total = int(keep.sum())
                    if not total:
                        continue
                    digests = []
                    for g in gs:
                        d = start.copy()
                        d.update(g)
                        digests.append(d.digest())
                    low, high = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).T[::-1].astype(np.uint64)
                    by = np.argsort(high, kind="stable")
                    if (high[by][1:] == high[by][:-1]).any():
                        by = np.lexsort((low, high))
                    held = keep[by]
                    before = np.cumsum(held) - held
                    n = int(held[before < fraction * total].sum())
                    if n == total:
                        raise ValueError("a pool needs two task groups at least, one on each side")
                    out += [(fold, monitor, "validation", n), (fold, monitor, "fit", total - n)]
            yield pd.DataFrame(out, columns=["fold", "monitor", "part", "n"])

    return numbered.repartition(FOLD_TASKS, "fold").mapInPandas(counted, "fold int, monitor string, part string, n long")


def standardised(scores: DataFrame, plans: DataFrame) -> DataFrame:
    """(fold, monitor, uid, raw, score): the eval rows' scores in units of the monitor's own validation runs.

    ``scores`` are (fold, monitor, uid, raw) by the monitor that the fold fitted. Validation scores
    that are all equal fail the query.
    """
    keys = ["fold", "monitor"]
    placed = scores.join(plans, [*keys, "uid"])
    scale = placed.where("part = 'validation'").groupBy(*keys).agg(F.avg("raw").alias("val_mean"), F.stddev_pop("raw").alias("val_std"))
    same = F.raise_error(F.lit("constant validation scores"))
    z = F.when(F.col("val_std") > 0, (F.col("raw") - F.col("val_mean")) / F.col("val_std")).otherwise(same)
    return placed.where("part = 'eval'").join(F.broadcast(scale), keys).select(*keys, "uid", "raw", z.alias("score"))


def fold_info(plans: DataFrame, runs: DataFrame) -> DataFrame:
    """Per fold: runs that fit, validate and test, by monitor; healthy and failed test runs, task groups."""
    j = plans.join(runs.select("uid", "failure_class", "task_group"), "uid")
    n = lambda m, p: F.count_if((F.col("monitor") == m) & (F.col("part") == p))
    tested = (F.col("monitor") == "A") & (F.col("part") == "eval")
    return j.groupBy("fold").agg(
        *(n(m, p).alias(f"n_{p}_{m}") for m in "AB" for p in ("fit", "validation")), F.count_if(tested).alias("n_eval"),
        F.count_if(tested & F.col("failure_class").isNull()).alias("n_healthy"), F.count_if(tested & F.col("failure_class").isNotNull()).alias("n_failed"),
        F.countDistinct(F.when(tested, F.col("task_group"))).alias("n_groups"),
    )


def eval_key(folds: DataFrame) -> DataFrame:
    """One hash of all (uid, fold): equal for equal test sets, whatever the order."""
    # Sums of hashes add up in any order, so no task holds all names.
    one = F.conv(F.substring(F.sha2(F.concat_ws(":", "uid", "fold"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return folds.agg(F.sum(one).alias("eval_key"), F.count("*").alias("n"))


def pool_counts(runs: DataFrame, folds: DataFrame, checkpoints, budgets) -> DataFrame:
    """Per (t, fold): healthy test runs that have step t, eligible ones of the other folds, and whether each budget can be drawn."""
    at = runs.join(folds, "uid").withColumn("t", F.explode(F.array(*map(F.lit, checkpoints))))
    there = F.col("failure_class").isNull() & (F.col("len") >= F.col("t") + 1)
    per = at.groupBy("t", "fold").agg(F.count("*").alias("n_runs"), F.count_if(there).alias("test_healthy"))
    total = F.sum("test_healthy").over(Window.partitionBy("t"))  # a row per fold
    out = per.withColumn("eligible", total - F.col("test_healthy"))
    return out.withColumns({f"feasible_{b}": F.col("eligible") >= b for b in budgets})


def folds_skipped(pools: DataFrame, budgets) -> DataFrame:
    """Per t: healthy runs, and how many folds each budget must skip."""
    return pools.groupBy("t").agg(F.sum("test_healthy").alias("healthy_with_step"), *(F.count_if(~F.col(f"feasible_{b}")).alias(f"skipped_{b}") for b in budgets))


def seeded_draws(pool: DataFrame, n: int, draws: int, seed: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, draw, uid, half): samples of n of each pool, cut into halves; a pool of fewer has no rows."""
    sizes = pool.groupBy(*by).agg(F.count("*").alias("__n")) if by else pool.agg(F.count("*").alias("__n"))
    fits = pool.join(F.broadcast(sizes), by) if by else pool.crossJoin(F.broadcast(sizes))
    drawn = fits.where(F.col("__n") >= n).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    nth = F.row_number().over(Window.partitionBy(*by, "draw").orderBy(seeded_order(seed, "draw", "uid"), "uid"))
    return drawn.withColumn("__k", nth).where(F.col("__k") <= n).select(*by, "draw", "uid", F.when(F.col("__k") <= n // 2, "A").otherwise("B").alias("half"))


def group_split_draws(pool: DataFrame, n: int, draws: int, seed: int, tries: int) -> DataFrame:
    """(draw, uid, half, tries): samples whose halves come from different task groups.

    Per draw, task groups go to either side by a seeded coin, again and again until both sides have
    enough runs; a draw without such a split has no rows.
    """
    half = n // 2
    sizes = pool.groupBy("task_group").agg(F.count("*").alias("__n"))
    coins = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    side = F.when(F.substring(seeded_order(seed, "draw", "k", "task_group"), 1, 1) < "8", "A").otherwise("B")
    tossed = coins.withColumn("half", side)
    enough = tossed.groupBy("draw", "k").agg(F.sum(F.when(F.col("half") == "A", F.col("__n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("half") == "B", F.col("__n")).otherwise(0)).alias("b"))
    first = enough.where((F.col("a") >= half) & (F.col("b") >= n - half)).groupBy("draw").agg(F.min("k").alias("k"))
    sides = tossed.join(F.broadcast(first), ["draw", "k"]).select("draw", "k", "task_group", "half")
    nth = F.row_number().over(Window.partitionBy("draw", "half").orderBy(seeded_order(seed, "draw", "uid"), "uid"))
    rows = pool.select("uid", "task_group").join(sides, "task_group").withColumn("__k", nth)
    return rows.where(F.col("__k") <= F.when(F.col("half") == "A", half).otherwise(n - half)).select("draw", "uid", "half", (F.col("k") + 1).alias("tries"))


def random_split(runs: DataFrame, seed: int, shares=(0.6, 0.2)) -> DataFrame:
    """(uid, part): fit, validation and test by a seeded order, cut at rounded shares of all runs."""
    placed = ranked(runs.select("uid").withColumn("__order", seeded_order(seed, "uid")), "__order", ["uid"])
    n = runs.agg(F.bround(F.count("*") * F.lit(shares[0])).alias("__a"), F.bround(F.count("*") * F.lit(shares[1])).alias("__b"))
    part = F.when(F.col("nth") <= F.col("__a"), "fit").when(F.col("nth") <= F.col("__a") + F.col("__b"), "validation").otherwise("test")
    return placed.crossJoin(F.broadcast(n)).select("uid", part.alias("part"))


def split_overlap(parts: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: test runs whose value also occurs in fit, and all test runs."""
    placed, out = parts.join(runs, "uid"), None
    for k in keys:
        fitted = placed.where("part = 'fit'").select(F.col(k).alias("__k")).distinct().withColumn("__there", F.lit(True))
        one = placed.where("part = 'test'").join(fitted, F.col(k) == F.col("__k"), "left").agg(F.count("__there").alias("n_shared"), F.count("*").alias("n_test")).select(F.lit(k).alias("key"), "n_shared", "n_test")
        out = one if out is None else out.unionByName(one)
    return out


def over_seeds(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, standard deviation and range of a value over seeds."""
    x = F.col(value)
    return values.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"))


def stratified(runs: DataFrame, stratum: Column, sizes: dict[str, int], seed: int) -> DataFrame:
    """(uid, stratum): a seeded sample of each stratum; one with too few runs fails the query."""
    rows = runs.withColumn("stratum", stratum).where(F.col("stratum").isin(*sizes))
    nth = F.row_number().over(Window.partitionBy("stratum").orderBy(seeded_order(seed, "uid"), "uid"))
    size = F.coalesce(*(F.when(F.col("stratum") == k, F.lit(n)) for k, n in sizes.items()))
    n = F.count("*").over(Window.partitionBy("stratum"))
    few = F.raise_error(F.concat(F.lit("too few runs in stratum "), "stratum"))
    return rows.withColumns({"__k": nth, "__n": n}).where(F.when(F.col("__n") >= size, F.col("__k") <= size).otherwise(few)).select("uid", "stratum")


def determinism_subset(prompts: DataFrame, n: int, seed: int, key: str = "uid") -> DataFrame:
    """The prompts that are asked again, to see whether a repeat repeats: n in a seeded order."""
    return prompts.orderBy(seeded_order(seed, key), key).limit(n)


def fitted_plans(steps: DataFrame, plans: DataFrame, monitors, raw: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(fold, monitor, uid, raw, score) of the eval rows: A and B of each fold fitted on their own part, in one job.

    ``monitors`` has ``fit(steps, members)`` and ``score(steps, pairs)`` over many models. A run's raw score
    is its highest, unless ``raw`` makes (model, uid, raw) of the steps' scores.
    """
    named = plans.select("*", F.concat_ws(":", F.col("fold").cast("string"), "monitor").alias("model"))
    monitors.fit(steps, named.where("part = 'fit'").select("model", "uid"))
    found = monitors.score(steps, named.where("part <> 'fit'").select("model", "uid").distinct())
    top = raw(found) if raw else found.groupBy("model", "uid").agg(F.max("score").alias("raw"))
    parts = F.split("model", ":")
    return standardised(top.select(parts[0].cast("int").alias("fold"), parts[1].alias("monitor"), "uid", "raw"), plans)
