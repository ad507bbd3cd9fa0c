"""Task groups as connected components, and runs that are each other's twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import call_key

#: Share of all ties from which a key is a hub.
HUB_SHARE = 1 / 500


def task_groups(rows: DataFrame, keys: list[str], uid: str = "uid", unknown=None, save=None) -> DataFrame:
    """(uid, task_group): runs that share the value of a key, directly or through others.

    Null keys tie nothing. A run without any key is a group of its own, named by ``unknown``. A group
    is named after its least run. ``save`` writes a frame and reads it back, to cut the lineage of the
    rounds; by default a reliable checkpoint in the shared folder.
    """
    if save is None:
        from tracewell.plans.scratch import cut as save
    tied = reduce(DataFrame.unionByName, [rows.where(F.col(k).isNotNull()).select(F.col(uid).alias("u"), F.concat(F.lit(f"{i}:"), k).alias("k")) for i, k in enumerate(keys)])
    tied = save(tied.distinct())
    label = tied.groupBy("u").agg(F.min("u").alias("c"))
    # Keys of more than a share of all ties, of which there are 1/HUB_SHARE at most, go by broadcast:
    # so no task gets all runs of a common key.
    most = max(1000, int(tied.count() * HUB_SHARE))
    hubs = save(tied.groupBy("k").count().where(F.col("count") > most).select("k"))
    common, rest = tied.join(F.broadcast(hubs), "k", "left_semi"), tied.join(F.broadcast(hubs), "k", "left_anti")
    while True:
        # The least label of each key, then of each run's keys, then of the run that this label names.
        by_key = tied.join(label, "u").groupBy("k").agg(F.min("c").alias("c"))
        of_hubs = common.join(F.broadcast(by_key.join(F.broadcast(hubs), "k", "left_semi")), "k")
        near = of_hubs.unionByName(rest.join(by_key, "k")).groupBy("u").agg(F.min("c").alias("c"))
        jumped = near.alias("a").join(near.alias("b"), F.col("a.c") == F.col("b.u")).select(F.col("a.u").alias("u"), F.least("a.c", "b.c").alias("c"))
        new = save(jumped)
        moved = new.join(label.withColumnRenamed("c", "before"), "u").where("c <> before").limit(1).count()
        label = new
        if not moved:
            break
    alone = unknown if unknown is not None else F.concat(F.lit("unknown:"), F.col(uid))
    found = rows.join(label.withColumnRenamed("u", uid), uid, "left")
    return found.select(uid, F.coalesce("c", alone).alias("task_group"))


def trajectory_hashes(steps: DataFrame) -> DataFrame:
    """(uid, trajectory): a hash of the calls and results of each step, in order."""
    one = F.coalesce(F.concat_ws("\u0002", call_key(F.col("tool_name"), F.col("args")), F.col("result")), F.lit(""))
    rows = steps.select("uid", F.struct("step_idx", one.alias("call")).alias("s"))
    return rows.groupBy("uid").agg(F.sha2(F.concat_ws("\u0003", F.transform(F.array_sort(F.collect_list("s")), lambda s: s["call"])), 256).alias("trajectory"))


def prefix_signatures(steps: DataFrame, t: int) -> DataFrame:
    """(uid, signature) of the calls up to step t, of runs that reach it."""
    rows = steps.where(F.col("step_idx") <= t).select("uid", "step_idx", F.coalesce(call_key(F.col("tool_name"), F.col("args")), F.lit("-")).alias("call"))
    out = rows.groupBy("uid").agg(F.concat_ws("\u0003", F.transform(F.array_sort(F.collect_list(F.struct("step_idx", "call"))), lambda s: s["call"])).alias("signature"), F.count("*").alias("n"))
    return out.where(F.col("n") == t + 1).select("uid", "signature")


def twin_clusters(runs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Per corpus: clusters of more than one run, runs in them, the largest, those mixing labels or spanning groups."""
    c = runs.join(hashes, "uid").groupBy("corpus", "trajectory").agg(
        F.count("*").alias("n"), F.count_if(F.col("failure_class").isNull()).alias("h"), F.countDistinct("task_group").alias("g")
    ).where("n > 1")
    return c.groupBy("corpus").agg(F.count("*").alias("clusters"), F.sum("n").alias("runs"), F.max("n").alias("largest"), F.count_if((F.col("h") > 0) & (F.col("h") < F.col("n"))).alias("mixed"), F.count_if(F.col("g") > 1).alias("spanning"))


def shared_twins(runs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(trajectory, n_corpora) of trajectories that several corpora have."""
    return runs.join(hashes, "uid").groupBy("trajectory").agg(F.countDistinct("corpus").alias("n_corpora")).where("n_corpora > 1")


def overlap_counts(test: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: test rows whose value occurs in fit."""
    return reduce(DataFrame.unionByName, [test.join(fit.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_semi").agg(F.count("*").alias("n")).select(F.lit(k).alias("key"), "n") for k in keys])


def indistinguishable(evals: DataFrame, signatures: DataFrame) -> DataFrame:
    """Positives whose calls so far equal a healthy run's of the same task group, per class."""
    signed = evals.join(signatures, "uid")
    healthy = signed.where("y = 0").select("task_group", "signature").distinct().withColumn("__same", F.lit(True))
    return signed.where("y = 1").join(healthy, ["task_group", "signature"], "left").groupBy("failure_class").agg(F.count("*").alias("n_pos"), F.count("__same").alias("n_same"), (F.count("__same") / F.count("*")).alias("share"))
